"""Benchmark decontamination with spaced seeds.

Tokens are words, A-Z lower-cased, without ASCII punctuation at either end (a word of punctuation
alone is no token).  A seed is the hash of the tokens under a fixed mask laid at some position; the
masks' gaps ignore whatever stands there.  Test seeds are joined with the training seeds; around
each hit both sides are laid over each other along the hit's diagonal and compared token by token.
An overlap is a stretch of which every token lies in a window of ``window`` tokens with at least
``need`` equal ones (for shorter items: the whole item, with the same share of equal tokens).

``MASKS`` find every window of 13 tokens with at most 2 substitutions (a test tries all of them).
Items shorter than the window have masks of their own length: where k tokens may differ, k + 1
masks that share no position, one of which no substitution touches.  Documents are scanned for the
lengths that the benchmark has.

Scale: documents are scanned once; a bitmap of fixed size (``FILTER_BITS``), whatever the size of
the benchmark, drops nearly all training seeds in the scan, and only those left are shuffled to the
join.  A larger benchmark makes the bitmap fuller, so more seeds are shuffled; results don't change.

Defined cases: null or empty texts have no tokens, and items without tokens are never found.  A passage
in several places gives a row for each; repeated document rows give repeated work but the result is
distinct; items of equal tokens (ties) are each named.  Empty tables give an empty result.  Rows with a
null id take part, with a null id in the result.  Further columns are ignored.  A very long text is a slice
of its own in the scan; what leaves it are the stretches around seeds, and a stretch is laid over an item
once, however many places of both meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .bitmap import build_bitmap, held, without
from .storage import stored

#: Positions that count, relative to the seed's first token.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
MASK_SPAN = max(places[-1] for places in MASKS) + 1
FILTER_BITS = 1 << 24
#: Stands for a null item id in a set of ids.
NO_ID = -(2**63)
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens_of(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice of texts, and the text of each."""
    words = kernel.split_words(texts, lower=True)
    if not len(words.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, end = _strip(words.data, words.start, words.end)
    keep = start < end
    return kernel.span_hashes(words.data, start[keep], end[keep]), words.doc[keep]


def _strip(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move both ends of each span inwards over punctuation."""
    n = len(data)
    plain = ~PUNCTUATION[data]
    place = np.arange(n, dtype=np.int64)
    following = np.where(plain, place, n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(plain, place, -1))
    return np.minimum(following[start], end), np.maximum(preceding[end - 1] + 1, start)


def masks_for(size: int, window: int, need: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """Number, span and places of the masks for items of ``size`` tokens (``window`` or more: those of ``MASKS``)."""
    if size >= window:
        return [(number, MASK_SPAN, places) for number, places in enumerate(MASKS)]
    parts = size - math.ceil(need * size / window) + 1
    return [(100 * size + k, size, tuple(range(k, size, parts))) for k in range(parts)]


def seeds_of(tokens: np.ndarray, doc: np.ndarray, masks: list[tuple[int, int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """All seeds of the masks: hash (of the mask's number too) and index of the first token."""
    hashes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for number, span, places in masks:
        h, first = kernel.window_hashes(tokens, doc, span, places)
        hashes.append(kernel.mix(h + np.uint64(number)))
        at.append(first)
    return np.concatenate(hashes), np.concatenate(at)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def _ids(batch: pa.RecordBatch, first: int, n: int) -> pa.Array:
    return batch.column(0).slice(first, n).cast(pa.int64())


def item_tokens(items: DataFrame) -> DataFrame:
    """``(item_id, text)`` to ``(item_id, tokens array<long>)``."""

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                tokens, doc = tokens_of(texts)
                lists = _lists(tokens.view(np.int64), np.bincount(doc, minlength=len(texts)))
                yield pa.RecordBatch.from_arrays([_ids(batch, texts.first_row, len(texts)), lists], ["item_id", "tokens"])

    return items.mapInArrow(scan, "item_id long, tokens array<long>")


def item_seeds(tokens: DataFrame, sizes: list[int], window: int, need: int) -> DataFrame:
    """``(item_id, tokens)`` to ``(seed, item_id, item_at)``; ``sizes`` are the lengths of items, all of ``window`` and more as ``window``."""

    def scan(batches):
        schema = pa.schema([("seed", pa.int64()), ("item_id", pa.string()), ("item_at", pa.int32())])
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            first = np.concatenate([[0], np.cumsum(lengths)])
            for size in sizes:
                seed, at = seeds_of(values, doc, masks_for(size, window, need))
                own = np.minimum(lengths[doc[at]], window) == size
                seed, at = seed[own], at[own]
                yield _rows(schema, seed.view(np.int64), batch.column(0).take(pa.array(doc[at])), at - first[doc[at]])

    return tokens.mapInArrow(scan, "seed long, item_id string, item_at int")


def candidate_regions(documents: DataFrame, bitmap, window: int, masks: list[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """Scan ``(doc_id, text)``; each run of seeds that pass the bitmap gives one row.

    ``tokens`` are the tokens from ``window`` before the run to ``window`` after it, ``first`` is the
    index in the document of the first of them; ``seeds`` and ``places`` are the run's seeds.  Seeds also
    pass by chance; the join drops those.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("tokens", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def scan(batches):
        cells = bitmap.value
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                tokens, doc = tokens_of(texts)
                seed, at = seeds_of(tokens, doc, masks)
                hit = np.flatnonzero(held(cells, seed.view(np.int64)))
                if not len(hit):
                    continue
                hit = hit[np.argsort(at[hit], kind="stable")]
                seed, at = seed[hit], at[hit]
                new = np.ones(len(at), bool)
                new[1:] = (doc[at[1:]] != doc[at[:-1]]) | (at[1:] - at[:-1] > window)
                run = np.flatnonzero(new)
                stop = np.append(run[1:], len(at))
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
                owner = doc[at[run]]
                low = np.maximum(at[run] - window, bounds[owner])
                high = np.minimum(at[stop - 1] + window + MASK_SPAN, bounds[owner + 1])
                sizes = high - low
                inside = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        _ids(batch, texts.first_row, len(texts)).take(pa.array(owner)), pa.array(low - bounds[owner]), _lists(tokens[inside].view(np.int64), sizes),
                        _lists(seed.view(np.int64), stop - run), _lists(at - np.repeat(low, stop - run), stop - run),
                    ],
                    schema=schema,
                )

    return documents.mapInArrow(scan, "doc_id long, first long, tokens array<long>, seeds array<long>, places array<long>")


def overlaps(item: np.ndarray, region: np.ndarray, diagonal: int, window: int, need: int) -> list[tuple[int, int, int]]:
    """Stretches (first token of the item, length, equal tokens) along ``diagonal`` = region place - item place."""
    low, high = max(0, -diagonal), min(len(item), len(region) - diagonal)
    if len(item) < window:
        need, window = math.ceil(need * len(item) / window), len(item)
    if high - low < window:
        return []
    equal = item[low:high] == region[low + diagonal : high + diagonal]
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(total[window:] - total[:-window] >= need)
    if not len(good):
        return []
    inside = kernel.covered(good, window, high - low).astype(np.int8)
    edge = np.diff(np.concatenate([[0], inside, [0]]))
    return [(low + int(a), int(b - a), int(total[b] - total[a])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 13, need: int = 11) -> DataFrame:
    """Rows ``doc_id, item_id, doc_start, item_start, n_tokens, n_equal``: the passages of items found in documents, in tokens."""
    spark = documents.sparkSession
    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    named = item_tokens(benchmark.select(benchmark[item_column].cast("long").alias("item_id"), benchmark[item_text_column].alias("text")))
    # Items of equal tokens are looked for once; ``item_id`` numbers the lists of tokens until the end.
    every = stored(named.where(F.size("tokens") > 0).groupBy("tokens").agg(F.collect_set(F.coalesce("item_id", F.lit(NO_ID))).alias("ids")).withColumn("item_id", F.expr("uuid()")), "decontaminate-items")
    items = every.select("item_id", "tokens")
    # At most ``window`` lengths.
    sizes = sorted(r["size"] for r in items.select(F.least(F.size("tokens"), F.lit(window)).alias("size")).where("size > 0").distinct().collect())
    masks = [mask for size in sizes for mask in masks_for(size, window, need)]
    seeds = item_seeds(items, sizes, window, need).distinct()
    bitmap = spark.sparkContext.broadcast(build_bitmap(seeds.select("seed"), FILTER_BITS))
    regions = stored(candidate_regions(docs, bitmap, window, masks).withColumn("region_id", F.expr("uuid()")), "decontaminate-regions")
    hits = regions.select("region_id", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("region_id", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    met = hits.join(seeds, "seed").select("region_id", "item_id", (F.col("place") - F.col("item_at")).alias("diagonal"))
    # A row for each region and item, however many diagonals they meet on, so that a region goes out once for each item.
    pairs = met.groupBy("region_id", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))
    laid = pairs.join(regions.select("region_id", "doc_id", "first", F.col("tokens").alias("region")), "region_id").join(items.select("item_id", F.col("tokens").alias("item")), "item_id")

    def verify(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_tokens", pa.int64()), ("n_equal", pa.int64())])
        for batch in batches:
            doc_id, item_id, first = (batch.column(c).to_pylist() for c in ("doc_id", "item_id", "first"))
            region, item, diagonals = batch.column("region"), batch.column("item"), batch.column("diagonals")
            for k in range(batch.num_rows):
                own, there = item[k].values.to_numpy(), region[k].values.to_numpy()
                found = [(doc_id[k], item_id[k], first[k] + at + d, at, n, equal) for d in diagonals[k].as_py() for at, n, equal in overlaps(own, there, d, window, need)]
                if found:
                    yield _rows(schema, *zip(*found, strict=True))

    # One passage can lie in two regions that overlap.
    spans = laid.mapInArrow(verify, "doc_id long, item string, doc_start long, item_start long, n_tokens long, n_equal long").distinct()
    ids = every.select(F.col("item_id").alias("item"), F.explode("ids").alias("_id")).select("item", F.when(F.col("_id") != NO_ID, F.col("_id")).alias("item_id"))
    return spans.join(ids, "item").select("doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a contaminated span, with their columns."""
    id_column = options.get("id_column", "doc_id")
    leaked = stored(contaminated_spans(documents, benchmark, **options).select("doc_id").distinct(), "decontaminate-leaked")
    return without(documents, id_column, leaked)


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH dt AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x <> '') AS w FROM documents
), it AS (
  SELECT item_id, list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x <> '') AS w FROM benchmark
), de AS (
  SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM dt
), ie AS (
  SELECT item_id, len(w) AS size, unnest(w) AS t, unnest(range(0, len(w))) AS j FROM it
), pairs AS (
  SELECT doc_id, item_id, p - j AS diagonal FROM de JOIN ie USING (t) GROUP BY doc_id, item_id, p - j, size HAVING count(*) >= CASE WHEN size >= 13 THEN 11 ELSE ceil(11 * size / 13) END
), laid AS (
  SELECT doc_id, item_id, diagonal, j, len(iw) AS size, CAST(iw[j + 1] = dw[j + diagonal + 1] AS INT) AS e
  FROM (SELECT p.*, dt.w AS dw, it.w AS iw, unnest(range(greatest(0, -diagonal), least(len(it.w), len(dt.w) - diagonal))) AS j FROM pairs p JOIN dt USING (doc_id) JOIN it USING (item_id))
), starts AS (
  -- Diagonals with too few equal tokens for any window are left out above; no seeds here.
  SELECT *, CASE WHEN size >= 13 THEN CAST(count(*) OVER f = 13 AND sum(e) OVER f >= 11 AS INT) ELSE CAST(count(*) OVER a = size AND sum(e) OVER a >= ceil(11 * size / 13) AS INT) END AS good
  FROM laid WINDOW f AS (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), a AS (PARTITION BY doc_id, item_id, diagonal)
), inside AS (
  SELECT * FROM (SELECT *, max(good) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS covered FROM starts) WHERE covered = 1
), islands AS (
  SELECT *, j - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS island FROM inside
)
SELECT DISTINCT doc_id, item_id, CAST(min(j) + diagonal AS BIGINT) AS doc_start, CAST(min(j) AS BIGINT) AS item_start, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(e) AS BIGINT) AS n_equal
FROM islands GROUP BY doc_id, item_id, diagonal, island
"""
