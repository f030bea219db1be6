"""Fill-in-the-middle transformation by escaped marker injection.

A text is cut into units (blanks and the word after them; blanks at the end are a unit of their own).
A delimiter character is escaped in the text, ``regexp_replace`` appends it bare after every unit, the
number of delimiters is the number of units, and ``substring_index`` takes the parts before, between
and after two ranks out of the marked text; then the delimiters go and the escapes are undone.  All of
it is column expressions in one projection over the scan: no exchange, no Python.

The ranks and the form come from a hash of the id and the seed, so a document is always cut alike,
however the table is partitioned.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain.
Repeated rows are cut alike; a null id is hashed like the empty string.  The delimiter and the escape
character may stand in the text.  An empty table gives an empty result; further columns, whatever
their names, are ignored.  A very long text is worked on as one value (a few copies of it at a time),
in time that grows with its length.  Ties: equal ranks give an empty middle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Neither is a blank, so neither changes where units end; in the escaped text every ESCAPE is followed by one of KINDS.
DELIMITER, ESCAPE = "\u0001", "\u0002"
KINDS = {DELIMITER: "d", ESCAPE: "e"}


@dataclass(frozen=True)
class Sentinels:
    """Marks before the prefix, the suffix and the middle; none may be part of, or overlap, another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def escaped(text: Column) -> Column:
    """The text without a bare delimiter."""
    once = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + KINDS[ESCAPE]))
    return F.replace(once, F.lit(DELIMITER), F.lit(ESCAPE + KINDS[DELIMITER]))


def unescaped(marked: Column) -> Column:
    """The text of a part: its delimiters taken out, then the escapes undone."""
    bare = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + KINDS[DELIMITER]), F.lit(DELIMITER)), F.lit(ESCAPE + KINDS[ESCAPE]), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), UNIT, "$0" + DELIMITER)


def ranked(text: Column, delimiter: str, rank: Column) -> Column:
    """What stands before the delimiter of that rank (after it, counted from the end, where the rank is negative)."""
    return F.call_function("substring_index", text, F.lit(delimiter), rank.cast("int"))


def draws(id_column: Column, seed: int, n: int) -> list[Column]:
    """``n`` numbers of 32 bits (at most 8) from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def transformed(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, percent: int = 50, suffix_first: int = 80, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: each text as it goes into training.

    ``percent`` of the texts are rearranged, ``suffix_first`` percent of these as suffix, prefix, middle
    (spm) and the others as prefix, suffix, middle (psm); the rest stays plain.
    """
    s = sentinels
    text = F.coalesce(documents[text_column].cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(documents[id_column], seed, 4)
    form = F.when((text == "") | F.contains(text, F.lit(s.prefix)) | F.contains(text, F.lit(s.suffix)) | F.contains(text, F.lit(s.middle)) | (h3 % 100 >= percent), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = documents.select(documents[id_column].alias("doc_id"), text.alias("text"), marked(text).alias("marked"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    cut = cut.withColumn("n", F.char_length("marked").cast("long") - F.char_length(F.replace("marked", F.lit(DELIMITER), F.lit(""))))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = cut.select("doc_id", "text", "marked", "form", "n", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    whole, a, b, n = F.col("marked"), F.col("a"), F.col("b"), F.col("n")
    moved = F.col("form") != "plain"
    parts = cut.select(
        "doc_id", "text", "form", "n",
        F.when(moved, unescaped(ranked(whole, DELIMITER, a))).alias("prefix"),
        F.when(moved, unescaped(ranked(ranked(whole, DELIMITER, b), DELIMITER, a - b))).alias("middle"),
        F.when(moved, unescaped(ranked(whole, DELIMITER, b - n - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(s.prefix), "prefix", F.lit(s.suffix), "suffix", F.lit(s.middle), "middle")
    spm = F.concat(F.lit(s.suffix), "suffix", F.lit(s.prefix), "prefix", F.lit(s.middle), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return parts.select("doc_id", "n", "form", *[F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")], output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text again, from the output and its form alone.

    A rearranged text holds each sentinel once, as texts with sentinels stay plain.
    """
    s = sentinels
    middle = F.substring_index(output, s.middle, -1)
    head = F.substring_index(output, s.middle, 1)

    def between(left: str, right: str) -> tuple[Column, Column]:
        """The part after the leading mark ``left``, and that after ``right``."""
        return F.substring_index(F.substring_index(head, right, 1), left, -1), F.substring_index(head, right, -1)

    prefix_first, suffix_second = between(s.prefix, s.suffix)
    suffix_first, prefix_second = between(s.suffix, s.prefix)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix_first, middle, suffix_second)).otherwise(F.concat(prefix_second, middle, suffix_first))


def op11_marker_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cut and digests of its output and of the text rebuilt from that output."""
    done = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
