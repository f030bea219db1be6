"""Quality rules by distribution divergence from language references.

Each text has two histograms: of its characters over ``CLASSES`` and of its words over the common
words of its language (and one cell for all others).  A reference is the same histogram over all
texts of a language.  A text fails if the Jensen-Shannon distance of either histogram to its
reference is above a limit; histograms of fewer than ``min_words`` words (``min_chars`` characters)
say too little and never fail a text.  As a sample of n words from the reference itself lies at a
distance that falls with the square root of n, the limit for words is ``max_word_distance +
word_noise / sqrt(n)``.

References are counted over all documents.  Common words of a language are those that make up at
least ``common_share`` of its words, so there are at most ``1 / common_share``; languages with less
than ``language_share`` of all words have no reference of their own.  Both bounds hold whatever the
corpus, so the references may be broadcast.  Before that, words are counted by hash, summed in each
slice of texts, in each task, and then across tasks.

Texts whose language is null or has no reference are compared with every reference and keep the
least distance.  Words here are lower-cased (A-Z) and lose ASCII punctuation at the ends.

Defined cases: a null or empty text has no words and fails the base rule; where no language has a
reference, distances are null and only the base rule decides.  Repeated rows are judged alike; null
ids are passed on; an empty table gives an empty result; further columns are ignored.
A very long text is a slice of its own, so a task holds one such text; there is nothing to tie, as a
limit that is met exactly is no failure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .decontaminate import tokens_of

#: Cells of the character histogram; every byte that begins a character belongs to one.
CLASSES = ("lower vowel", "lower consonant", "upper", "digit", "blank", "line end", "sentence mark", "other mark", "symbol", "accented", "other")


def _classes() -> np.ndarray:
    table = np.full(256, 10, np.int64)
    for byte in range(128):
        c = chr(byte)
        table[byte] = 0 if c in "aeiouy" else 1 if c.isalpha() and c.islower() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in " \t" else 5 if c in "\n\r" else 6 if c in ".,;:!?" else 8 if c in "#*$%&|<>@^~=+\\_{}[]`" else 7 if 32 < byte < 127 else 10
    table[0xC3:0xC7] = 9  # Latin letters with marks
    return table


CLASS_OF = _classes()
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BEGINS = (np.arange(256) & 0xC0) != 0x80


def class_counts(texts: kernel.Texts) -> np.ndarray:
    """Characters of each class in each text."""
    place = np.flatnonzero(BEGINS[texts.data])
    doc = np.searchsorted(texts.offsets, place, "right") - 1
    cell = doc * len(CLASSES) + CLASS_OF[texts.data[place]]
    return np.bincount(cell, minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def base_counts(texts: kernel.Texts) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    n, d = len(texts), texts.data
    words = kernel.split_words(texts)
    n_words = words.counts()
    character = np.concatenate([[0], np.cumsum(BEGINS[d])])
    word_chars = np.bincount(words.doc, weights=character[words.end] - character[words.start], minlength=n)
    symbol = np.concatenate([[0], np.cumsum(IS_SYMBOL[d])])
    n_symbols = symbol[texts.offsets[1:]] - symbol[texts.offsets[:-1]]
    hashes = kernel.word_hashes(words)
    window, at = kernel.window_hashes(hashes, words.doc, 3)
    salt = kernel.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    twice = at[kernel.seen_twice(window ^ salt[words.doc[at]])]
    n_repeat = np.bincount(words.doc[kernel.covered(twice, 3, len(hashes))], minlength=n)
    n_dup = np.zeros(n, np.int64)
    if len(d):
        cut = np.zeros(len(d) + 1, bool)
        cut[texts.offsets] = True
        cut[1:] |= d == 10
        start = np.flatnonzero(cut[: len(d)])
        end = np.append(start[1:], len(d))
        end = end - (d[end - 1] == 10)
        wordy = np.concatenate([[0], np.cumsum(~kernel.IS_SPACE[d])])
        full = wordy[end] > wordy[start]
        start, end = start[full], end[full]
        doc = np.searchsorted(texts.offsets, start, "right") - 1
        again = kernel.seen_before(kernel.span_hashes(d, start, end) ^ salt[doc])
        n_dup = np.bincount(doc[again], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars.astype(np.int64), "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of each row of counts ``p`` to the shares ``q``."""
    p = p / np.maximum(1, p.sum(axis=-1, keepdims=True))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def language_counts(documents: DataFrame) -> DataFrame:
    """From ``(doc_id, lang, text)``: ``(lang, kind, key, n)``; kind 0 counts characters by class, kind 1 words by hash."""

    def scan(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            code = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = langs.dictionary.to_pylist()
            for texts in kernel.text_slices(batch.column(2)):
                lang = code[texts.first_row : texts.first_row + len(texts)]
                tokens, doc = tokens_of(texts)
                classes = class_counts(texts)
                for k in np.unique(lang[lang >= 0]):
                    word, n = np.unique(tokens[lang[doc] == k], return_counts=True)
                    cells = classes[lang == k].sum(axis=0)
                    keys = np.concatenate([np.arange(len(CLASSES)), word.view(np.int64)])
                    kind = np.concatenate([np.zeros(len(CLASSES), np.int32), np.ones(len(word), np.int32)])
                    yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(keys), pa.string()), pa.array(kind), pa.array(keys), pa.array(np.concatenate([cells, n]))], ["lang", "kind", "key", "n"])

    counts = documents.mapInArrow(scan, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return counts


def references(documents: DataFrame, *, common_share: float = 0.002, language_share: float = 0.001) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language: shares of the character classes, sorted hashes of its common words, their shares (the last: all others)."""
    from .storage import stored

    counts = stored(language_counts(documents), "divergence-counts")
    totals = counts.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    grand = totals.agg(F.sum("total")).first()[0] or 0
    large = {r["lang"]: r["total"] for r in totals.where(F.col("total") >= language_share * grand).where("total > 0").collect()}
    words: dict[str, dict[int, int]] = {lang: {} for lang in large}
    cells = {lang: np.zeros(len(CLASSES)) for lang in large}
    common = counts.join(F.broadcast(totals.where(F.col("total") >= language_share * grand)), "lang").where("kind = 0 or n >= total * " + repr(common_share))
    for r in common.collect():
        if r["kind"]:
            words[r["lang"]][r["key"]] = r["n"]
        else:
            cells[r["lang"]][r["key"]] = r["n"]
    out = {}
    for lang, total in large.items():
        keys = np.array(list(words[lang]), np.int64).view(np.uint64)
        n = np.array(list(words[lang].values()), np.float64)
        order = np.argsort(keys)
        shares = np.append(n[order], total - n.sum()) / total
        out[lang] = cells[lang] / max(1, cells[lang].sum()), keys[order], shares
    return out


RULE_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", max_class_distance: float = 0.25, max_word_distance: float = 0.1, word_noise: float = 2.4, min_words: int = 50, min_chars: int = 200, common_share: float = 0.002) -> DataFrame:
    """Base counts, distances and verdict of every document."""
    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[lang_column].cast("string").alias("lang"), documents[text_column].alias("text"))
    held = documents.sparkSession.sparkContext.broadcast(references(docs, common_share=common_share))
    names = [f.split()[0] for f in RULE_SCHEMA.split(", ")]

    def scan(batches):
        refs = held.value
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for texts in kernel.text_slices(batch.column(2)):
                n = len(texts)
                base = base_counts(texts)
                classes = class_counts(texts)
                tokens, doc = tokens_of(texts)
                lang = langs[texts.first_row : texts.first_row + n]
                by_class, by_word = np.full(n, np.nan), np.full(n, np.nan)
                for name, (class_shares, common, word_shares) in refs.items():
                    rows = np.array([x == name or x not in refs for x in lang])
                    if not rows.any():
                        continue
                    number = np.cumsum(rows) - 1
                    mine = rows[doc]
                    cell = np.searchsorted(common, tokens[mine])
                    found = cell < len(common)
                    found[found] = common[cell[found]] == tokens[mine][found]
                    cell[~found] = len(common)
                    width = len(common) + 1
                    hist = np.bincount(number[doc[mine]] * width + cell, minlength=rows.sum() * width).reshape(-1, width)
                    by_class[rows] = np.fmin(by_class[rows], distance(classes[rows], class_shares))
                    by_word[rows] = np.fmin(by_word[rows], distance(hist, word_shares))
                few = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                far = (by_class > max_class_distance) & (classes.sum(axis=1) >= min_chars)
                far |= (by_word > max_word_distance + word_noise / np.sqrt(np.maximum(1, base["n_words"]))) & (base["n_words"] >= min_words)
                ids = batch.column(0).slice(texts.first_row, n)
                columns = [ids, *(pa.array(base[c].astype(np.int64)) for c in names[1:6]), pa.array(few), pa.array(~few & ~far), pa.array(by_class, from_pandas=True), pa.array(by_word, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(scan, RULE_SCHEMA)


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS n_chars
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), letters AS (
  SELECT doc_id, lang, c, CASE
    WHEN unicode(c) >= 448 OR (unicode(c) >= 128 AND unicode(c) < 192) OR unicode(c) < 9 OR unicode(c) BETWEEN 11 AND 12 OR unicode(c) BETWEEN 14 AND 31 OR unicode(c) = 127 THEN 10
    WHEN unicode(c) >= 192 THEN 9 WHEN c IN ('a', 'e', 'i', 'o', 'u', 'y') THEN 0 WHEN c BETWEEN 'a' AND 'z' THEN 1 WHEN c BETWEEN 'A' AND 'Z' THEN 2 WHEN c BETWEEN '0' AND '9' THEN 3
    WHEN unicode(c) IN (9, 32) THEN 4 WHEN unicode(c) IN (10, 13) THEN 5 WHEN c IN ('.', ',', ';', ':', '!', '?') THEN 6 WHEN regexp_matches(c, '[#*$%&|<>@^~=+\\_{}\[\]`]') THEN 8 ELSE 7 END AS cell
  FROM (SELECT doc_id, lang, unnest(regexp_extract_all(t, '(?s).')) AS c FROM d)
), tok AS (
  SELECT doc_id, lang, word FROM (SELECT doc_id, lang, trim(translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~') AS word FROM d) WHERE word <> ''
), totals AS (
  SELECT lang, count(*) AS total FROM tok WHERE lang IS NOT NULL GROUP BY lang
), refs AS (
  SELECT lang AS ref, total FROM totals WHERE total >= 0.001 * (SELECT sum(total) FROM totals)
), pairs AS (
  SELECT doc_id, ref, total FROM base JOIN refs ON base.lang = refs.ref OR base.lang IS NULL OR base.lang NOT IN (SELECT ref FROM refs)
), common AS (
  SELECT ref, word, n / total AS q FROM (SELECT lang, word, count(*) AS n FROM tok GROUP BY 1, 2) x JOIN refs ON x.lang = refs.ref WHERE n >= total * 0.002
), own AS (
  SELECT doc_id, word, count(*) AS n FROM tok GROUP BY 1, 2
), size AS (
  SELECT doc_id, sum(n) AS n FROM own GROUP BY 1
), wcells AS (
  SELECT p.doc_id, p.ref, coalesce(own.n, 0) / greatest(1, coalesce(size.n, 0)) AS p, c.q, size.n AS words FROM pairs p JOIN common c USING (ref) LEFT JOIN own ON own.doc_id = p.doc_id AND own.word = c.word LEFT JOIN size ON size.doc_id = p.doc_id
), wall AS (
  SELECT doc_id, ref, p, q FROM wcells UNION ALL SELECT doc_id, ref, CASE WHEN any_value(words) > 0 THEN greatest(0, 1 - sum(p)) ELSE 0 END, 1 - sum(q) FROM wcells GROUP BY 1, 2
), wdist AS (
  SELECT doc_id, ref, sqrt(greatest(0, least(1, sum(CASE WHEN p > 1e-12 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS dist FROM wall GROUP BY 1, 2
), lref AS (
  SELECT lang AS ref, cell, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS q FROM letters WHERE lang IN (SELECT ref FROM refs) GROUP BY 1, 2
), lown AS (
  SELECT doc_id, cell, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM letters GROUP BY 1, 2
), lcells AS (
  SELECT p.doc_id, p.ref, k.cell, coalesce(lown.p, 0) AS p, coalesce(lref.q, 0) AS q FROM pairs p CROSS JOIN range(0, 11) AS k(cell) LEFT JOIN lown ON lown.doc_id = p.doc_id AND lown.cell = k.cell LEFT JOIN lref ON lref.ref = p.ref AND lref.cell = k.cell
), ldist AS (
  SELECT doc_id, ref, sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS dist FROM lcells GROUP BY 1, 2
), best AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, (SELECT min(dist) FROM ldist WHERE ldist.doc_id = base.doc_id) AS cd, (SELECT min(dist) FROM wdist WHERE wdist.doc_id = base.doc_id) AS wd FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > 0.25 AND n_chars >= 200, false) AND NOT coalesce(wd > 0.1 + 2.4 / sqrt(greatest(1, n_words)) AND n_words >= 50, false) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM best
"""
