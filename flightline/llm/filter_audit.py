"""Filter interaction audit: what every order of quality filters removes, and what each filter adds to the others.

One scan of the Arrow buffers gives each document a mask of the filters that it fails: vectorised byte
classes and prefix sums count words, capitals, code points and symbols, and the sorted hashes of a
document's words, equal neighbours verified word for word, count its distinct words.  A digest of the
text tells exact copies.  From then on documents are narrow rows: the least id of each text comes from
partial aggregates, and a row is a copy unless it is itself that (text, id) pair, so no join key is
shared by all copies of a text.  Rows are then counted by (part, mask, labels), at most 128 counts a
part with five filters, and masks reduce these counts to all orders at once.

Defined cases: a null text is empty and holds no word; a null part is the empty string.  A null id comes
after all others: it is a copy if any row with an id has its text, and rows with null ids are no copies of
each other.  Repeated rows (ties: the same least id and text) are none of them copies, as no smaller id
has the text.  Labels that name an id several times count if any does; null ids have no labels; an id
without labels is neither good nor toxic.  An empty table gives an empty result; further columns,
whatever their names, are ignored.  Slices of the scan hold a few megabytes, or one longer text.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .storage import stored

BEGINS = (np.arange(256) & 0xC0) != 0x80
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
#: ``KEEP[n]`` keeps the first n bytes of eight.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words longer than this are hashed and compared one by one.
LONG_WORD = 256


@dataclass(frozen=True)
class Rules:
    """A: under ``least_words`` words; B: under ``least_distinct`` percent of the words distinct; C: over ``most_capitals`` percent capitals; D: one of ``symbols``; E: a copy of a smaller id's text."""

    least_words: int = 200
    least_distinct: int = 50
    most_capitals: int = 3
    symbols: str = "#$%&*|"


def _eights(words: kernel.Words) -> np.ndarray:
    """The eight bytes from every place on, as one number each."""
    padded = np.zeros(len(words.data) + 8, np.uint8)
    padded[: len(words.data)] = words.data
    return np.ndarray((len(words.data) + 1,), "<u8", padded.data, strides=(1,))


def word_keys(words: kernel.Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a step."""
    length = words.end - words.start
    view = _eights(words)
    h = kernel.mix((view[words.start] & KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, at = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(more):
        h[more] = kernel.mix(h[more] ^ ((view[words.start[more] + at] & KEEP[np.minimum(length[more] - at, 8)]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(at)))
        at += 8
        more = more[length[more] > at]
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        h[k] = int.from_bytes(blake2b(words.data[words.start[k] : words.end[k]], digest_size=8).digest(), "little")
    return h


def equal_words(words: kernel.Words, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether word ``x[i]`` and word ``y[i]`` are the same bytes."""
    length = words.end - words.start
    view = _eights(words)
    same = length[x] == length[y]
    left, at = np.flatnonzero(same & (length[x] <= LONG_WORD)), 0
    while len(left):
        keep = KEEP[np.minimum(length[x[left]] - at, 8)]
        ok = ((view[words.start[x[left]] + at] ^ view[words.start[y[left]] + at]) & keep) == 0
        same[left[~ok]] = False
        at += 8
        left = left[ok & (length[x[left]] > at)]
    for k in np.flatnonzero(same & (length[x] > LONG_WORD)).tolist():
        same[k] = np.array_equal(words.data[words.start[x[k]] : words.end[x[k]]], words.data[words.start[y[k]] : words.end[y[k]]])
    return same


def distinct_words(words: kernel.Words, keys: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each text: sorted hashes a text, equal neighbours verified; texts in which two words share a hash are counted by the words."""
    n, count = len(words.texts), words.counts()
    if not len(words.start):
        return count
    bits = np.uint64(max(1, (n - 1).bit_length()))
    keys = word_keys(words) if keys is None else keys
    keys = (keys >> bits) | (words.doc.astype(np.uint64) << (np.uint64(64) - bits))
    order = np.argsort(keys)
    ranked = keys[order]
    twin = np.flatnonzero(ranked[1:] == ranked[:-1])
    x, y = order[twin], order[twin + 1]
    out = count - np.bincount(words.doc[x], minlength=n)
    differ = ~equal_words(words, x, y)
    for k in np.unique(words.doc[x[differ]]).tolist():
        own = words.doc == k
        out[k] = len({words.data[a:b].tobytes() for a, b in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)})
    return out


def failures(texts: kernel.Texts, rules: Rules) -> np.ndarray:
    """Bits 1, 2, 4, 8 of each text for the conditions A, B, C, D."""
    words = kernel.split_words(texts)
    n_words, distinct = words.counts(), distinct_words(words)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in rules.symbols]] = True

    def inside(member: np.ndarray) -> np.ndarray:
        running = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(member[texts.data], out=running[1:])
        return running[texts.offsets[1:]] - running[texts.offsets[:-1]]

    few = n_words < rules.least_words
    poor = 100 * distinct < rules.least_distinct * n_words
    loud = 100 * inside(CAPITAL) > rules.most_capitals * inside(BEGINS)
    return few + 2 * poor + 4 * loud + 8 * (inside(symbol) > 0)


def masks(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """``doc_id, part, mask``: the filters that each document fails, as bits 1 (A) to 16 (E)."""

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(2)):
                at = slice(texts.first_row, texts.first_row + len(texts))
                digests = [blake2b(texts.data[a:b], digest_size=16).digest() for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], pa.array(failures(texts, rules).astype(np.int32)), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), F.coalesce(documents[part_column].cast("string"), F.lit("")).alias("part"), documents[text_column].alias("text"))
    rows = stored(docs.mapInArrow(scan, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    firsts = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    held = rows.join(firsts, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    return held.select("doc_id", "part", (F.col("mask") + F.when(F.col("_digest").isNull(), 16).otherwise(0)).alias("mask"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """From ``part, mask, good, toxic, n`` (bit k of ``mask``: letter k fails): a row for each part, order of the filters and step.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails it, removed before), ``unique_fails``
    (fails it alone), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``, what the step's
    filter removes summed over all orders.
    """
    size = len(letters)
    if factorial(size) > 5040:
        raise ValueError("orders of at most seven filters")
    cells = np.arange(1 << size)
    orders = list(permutations(range(size)))
    filters = np.array(orders).ravel()
    own = (1 << filters)[:, None]
    before = np.array([[sum(1 << f for f in order[:k]) for k in range(size)] for order in orders]).ravel()[:, None]
    fails, gone = (cells & own) > 0, (cells & before) > 0
    names = np.repeat(["".join(letters[f] for f in order) for order in orders], size)
    steps = np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders))

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        def by_mask(weight: np.ndarray) -> np.ndarray:
            out = np.zeros(1 << size, np.int64)
            np.add.at(out, pdf["mask"].to_numpy(), weight)
            return out

        n = pdf["n"].to_numpy(np.int64)
        every, good, toxic = by_mask(n), by_mask(n * pdf["good"].to_numpy(np.int64)), by_mask(n * pdf["toxic"].to_numpy(np.int64))
        taken = (fails & ~gone).astype(np.int64)
        removed = taken @ every
        shares = np.zeros(size, np.int64)
        np.add.at(shares, filters, removed)
        return pd.DataFrame(
            {
                "part": pdf["part"].iloc[0], "filter_order": names, "step": steps, "kept": (~fails & ~gone).astype(np.int64) @ every, "removed": removed, "redundant": (fails & gone).astype(np.int64) @ every,
                "unique_fails": every[1 << filters], "good_lost": taken @ good, "toxic_lost": taken @ toxic, "shapley": shares[filters],
            }
        )

    # A group is one part's counts: at most 4 * 2**len(letters) rows, whatever the corpus.
    return counts.groupBy("part").applyInPandas(reduce, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The interactions of the five filters over all documents, with what labelled documents they cost."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    failing = masks(documents, id_column=id_column, text_column=text_column, part_column=part_column, rules=rules).join(told, F.col("doc_id") == F.col("_id"), "left")
    counts = failing.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    return interactions(counts, "ABCDE")


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT d.doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first_id THEN 16 ELSE 0 END AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN told ON told.doc_id = d.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM failing GROUP BY 1, 2
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM orders, range(1, 6) AS s(step)
), found AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN x ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM found
"""
