"""MinHash near-duplicates by min-max hashing.

Under each permutation of the shingles' hashes both the least and the greatest value are kept, so a
signature of ``2 * permutations`` values costs half the hash evaluations, and as the two ends of one
permutation repel each other its estimate varies less.  Bands take ends of different permutations, half
of them minima.  With 24 bands of six values two sets at a Jaccard similarity of 0.85 share no band with
probability 1.2e-5 (at 0.9, 4e-9); every pair that shares one is decided by the full sets.

Documents with equal sets fall together first; what is indexed are distinct sets, told by 128 bits.
Then, in two rounds:

1. Rows (band, set) are sorted by ranges, so a band that very many sets share is cut over tasks.  Each
   stretch of at most ``stretch`` sets tries all its sets with its first few, and stretches of one
   band are chained by their first sets, so pairs grow in proportion.  Pairs are verified by the
   intersection of the sets, and those that hold contract to components.
2. Bands whose sets still lie in several components are decided in whole: equal memberships once, sets
   dealt into blocks of bounded bytes, each pair of blocks a task's group, in which the overlaps of all
   sets of different components are products of their incidence matrices.  Only one link for each two
   components leaves a group.  So no link between sets that share a band is lost, and no pairs of a
   group are emitted; a band whose sets are near each other but unlinked costs time that grows with the
   square of their number.

Defined cases: null and empty texts, and those without words, have no shingle and stand alone; fewer
words than a shingle are one shingle.  Repeated rows and ids are rows of their own; a null id counts
after all others (a component of null ids only has a null id, and a row with a null id is kept only
there).  Ties: a similarity of exactly the limit is a link.  An empty table gives an empty result; further
columns, whatever their names, are ignored.  A very long text is one set, in a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .bitmap import bits_for, build_bitmap, held, parted
from .overlaps import decided, undecided
from .simhash import components, from_arrow, shingle_sets, to_arrow
from .storage import stored

PERMUTATIONS, BANDS = 72, 24
_RANDOM = np.random.default_rng(20250113)
_FACTOR = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
#: Sets of a band that are tried with a stretch's first ones before a new stretch begins, and how many first ones there are.
STRETCH, LEADERS = 1000, 3

def set_values(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all sets on end, and where each set begins (and the last ends)."""
    sets = sets.cast(pa.large_binary())
    offsets = np.frombuffer(sets.buffers()[1], np.int64)[sets.offset : sets.offset + len(sets) + 1]
    raw = sets.buffers()[2]
    values = np.frombuffer(raw, np.uint64, (offsets[-1] - offsets[0]) // 8, offsets[0]) if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
    return values, (offsets - offsets[0]) // 8


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart, shape (sets, 2), for sets that are not empty."""
    size = np.diff(first).astype(np.uint64)
    out = np.zeros((len(size), 2), np.uint64)
    for word, salt in enumerate((0x9FB21C651E98DF25, 0xA0761D6478BD642F)):
        out[:, word] = kernel.mix(np.add.reduceat(kernel.mix(values + np.uint64(salt)), first[:-1]) + size * np.uint64(salt))
    return out


def ends(values: np.ndarray, first: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each set (none empty) under each permutation, both of shape (permutations, sets)."""
    low, high = np.empty((permutations, len(first) - 1), np.uint64), np.empty((permutations, len(first) - 1), np.uint64)
    moved = np.empty_like(values)
    for p in range(permutations):
        np.multiply(values ^ _SHIFT[p], _FACTOR[p], out=moved)
        np.minimum.reduceat(moved, first[:-1], out=low[p])
        np.maximum.reduceat(moved, first[:-1], out=high[p])
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of each set, shape (sets, bands): half of a band's values are minima, half maxima of other permutations."""
    permutations = len(low)
    rows = permutations // bands
    out = np.empty((low.shape[1], bands), np.uint64)
    for b in range(bands):
        h = np.full(low.shape[1], b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = kernel.mix(h ^ low[k])
            h = kernel.mix(h + high[(k + permutations // 2) % permutations])
        out[:, b] = h
    return out


def sketches(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """``doc_id, node, n_shingles, bands`` of each document; without words ``node`` and ``bands`` are null."""
    if permutations % bands or not 0 < permutations <= len(_FACTOR):
        raise ValueError("permutations must be a multiple of the bands, 256 at most")

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                values, first = set_values(shingle_sets(texts, shingle))
                size = np.diff(first)
                some = np.flatnonzero(size)
                places = np.full(len(size), -1)
                places[some] = np.arange(len(some))
                at = pa.array(places, mask=places < 0)
                first = np.append(first[:-1][some], first[-1])
                keys = set_keys(values, first) if len(some) else np.zeros((0, 2), np.uint64)
                own = band_keys(*ends(values, first, permutations), bands) if len(some) else np.zeros((0, bands), np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first_row, len(texts)), to_arrow(keys).take(at), pa.array(size.astype(np.int64)), to_arrow(own).take(at)], ["doc_id", "node", "n_shingles", "bands"])

    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return docs.mapInArrow(scan, "doc_id long, node binary, n_shingles long, bands binary")


def banded(distinct: DataFrame, bands: int = BANDS) -> DataFrame:
    """``band, node``: a row for each band of each distinct set."""

    def spread(batches):
        for batch in batches:
            nodes, own = from_arrow(batch.column(0), 128), from_arrow(batch.column(1), 64 * bands)
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel().view(np.int64)), to_arrow(np.repeat(nodes, bands, axis=0))], ["band", "node"])

    return distinct.select("node", "bands").mapInArrow(spread, "band long, node binary")


def stretches(rows: DataFrame, stretch: int = STRETCH, leaders: int = LEADERS) -> DataFrame:
    """``a, b``: the pairs to try first, from rows ``band, node`` without repetition.

    A task holds one stretch; what a band has in other tasks is chained to it by the first sets of each.
    """

    def pair(batches):
        bands, nodes = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)  # the stretch that may go on
        begun, head = False, None
        last = (0, None)

        def edge(a, b, band=None):
            return pa.RecordBatch.from_arrays([to_arrow(a), to_arrow(b) if b is not None else pa.nulls(len(a), pa.binary()), pa.array(np.zeros(len(a), np.int64) if band is None else band)], ["a", "b", "band"])

        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(bands)
            bands = np.concatenate([bands, kernel.ints(batch.column(0))])
            nodes = np.concatenate([nodes, from_arrow(batch.column(1), 128)])
            n = len(bands)
            fresh = np.ones(n, bool)
            fresh[1:] = bands[1:] != bands[:-1]
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            place = (np.arange(n) - run) % stretch
            start = np.arange(n) - place
            if not begun:
                begun = True
                yield edge(nodes[:1], None, bands[:1])
            new = np.arange(n) >= old
            for k in range(leaders):
                who = np.flatnonzero(new & (place > k))
                if len(who):
                    yield edge(nodes[start[who] + k], nodes[who])
            # Stretches of a band after its first are chained to the one before.
            chained = np.flatnonzero(new & (place == 0) & ~fresh)
            if len(chained):
                yield edge(nodes[chained - stretch], nodes[chained])
            if old == 0 and head is not None and head[0] == bands[0]:
                yield edge(head[1], nodes[:1])
            tail = int(start[-1])
            last = bands[tail : tail + 1], nodes[tail : tail + 1]
            if place[-1] == stretch - 1:
                # The next row begins another stretch.
                head = (bands[tail], nodes[tail : tail + 1])
                bands, nodes = bands[n:], nodes[n:]
            else:
                head = None
                bands, nodes = bands[tail:], nodes[tail:]
        if begun:
            yield edge(last[1], None, last[0])

    ordered = rows.repartitionByRange("band", "node").sortWithinPartitions("band", "node")
    found = stored(ordered.mapInArrow(pair, "a binary, b binary, band long"), "minmax-pairs")
    # At most two first sets a task.
    across = found.where("b is null").select("band", F.col("a").alias("b")).distinct().withColumn("a", F.lag("b").over(Window.partitionBy("band").orderBy("b"))).where("a is not null")
    return found.where("b is not null").select("a", "b").unionByName(across.select("a", "b")).distinct()


def sets_of(documents: DataFrame, distinct: DataFrame, wanted: DataFrame, *, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """``node, shingles`` of the ``wanted`` nodes, read from the document with each one's least id, and of the few others that a bitmap lets through.

    Sets are longer than their texts, so they stay where they are read: only those of nodes that are read more than once are exchanged.
    """
    spark = documents.sparkSession
    named = stored(distinct.join(wanted, "node").select("least"), "minmax-wanted")
    cells = spark.sparkContext.broadcast(build_bitmap(named.select(F.xxhash64("least").alias("key")), bits_for(named.count())))

    def scan(batches):
        for batch in batches:
            part = batch.filter(pa.array(held(cells.value, kernel.ints(batch.column(1)))))
            for texts in kernel.text_slices(part.column(0)):
                sets = shingle_sets(texts, shingle)
                values, first = set_values(sets)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    keys = set_keys(values, np.append(first[:-1][some], first[-1]))
                    yield pa.RecordBatch.from_arrays([to_arrow(keys), sets.take(pa.array(some))], ["node", "shingles"])

    docs = documents.select(documents[text_column].alias("text"), F.xxhash64(documents[id_column].cast("long")).alias("key"))
    read = stored(docs.mapInArrow(scan, "node binary, shingles binary"), "minmax-sets").withColumn("key", F.xxhash64("node"))
    once, more = parted(read, "key", stored(read.groupBy("key").count().where("count > 1").select("key"), "minmax-repeated"))
    return once.select("node", "shingles").unionByName(more.select("node", "shingles").dropDuplicates(["node"]))


def only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` less most of those that are none of ``nodes``, without an exchange of sets."""
    wanted = stored(nodes.select(F.xxhash64("node").alias("key")).distinct(), "minmax-only")
    return parted(sets.withColumn("key", F.xxhash64("node")), "key", wanted)[1].drop("key")


def confirmed(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have ``100 * intersection >= percent * union``; ``sizes`` are ``node, n_shingles``."""
    # Sizes that are too far apart need no look at the shingles.
    near = 100 * F.least("_a", "_b") >= percent * F.greatest("_a", "_b")
    sized = pairs.join(sizes.toDF("a", "_a"), "a").join(sizes.toDF("b", "_b"), "b").where(near).select("a", "b")
    tried = stored(sized, "minmax-tried")
    left = only(sets, tried.select(F.col("a").alias("node"))).select(F.col("node").alias("a"), F.col("shingles").alias("own"))
    right = only(sets, tried.select(F.col("b").alias("node"))).select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    both = tried.join(left, "a").join(right, "b").select("a", "b", "own", "other")

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

    return both.mapInArrow(compare, "a binary, b binary")


def near_duplicates(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 85, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each document.

    Links are pairs with ``100 * intersection >= percent * union`` of their sets of shingles.  For
    another ``percent``, take bands of as many values as leave few pairs unmet.
    """
    drawn = stored(sketches(documents, id_column=id_column, text_column=text_column, shingle=shingle, permutations=permutations, bands=bands), "minmax-sketches")
    distinct = stored(drawn.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "minmax-distinct")
    rows = banded(distinct, bands)
    pairs = stored(stretches(rows, STRETCH, LEADERS), "minmax-candidates")
    wanted = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "minmax-nodes")
    sets = sets_of(documents, distinct, wanted, id_column=id_column, text_column=text_column, shingle=shingle)
    # What shares no band is of no use from here on, and leaves before it is spread over bands.
    keyed = distinct.withColumn("key", F.xxhash64("node"))
    near = stored(parted(keyed, "key", wanted.select(F.xxhash64("node").alias("key")).distinct())[1].join(wanted, "node").select("node", "n_shingles", "bands"), "minmax-near")
    sizes = near.select("node", "n_shingles")
    # One pair for each set first; then of the others only those that lie between components.
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "minmax-first")
    links = stored(confirmed(first, sets, sizes, percent), "minmax-links")
    roots = stored(components(links), "minmax-roots")
    root = lambda c: F.coalesce(f"_{c}", c)
    others = pairs.join(first, ["a", "b"], "left_anti").join(roots.toDF("a", "_a"), "a", "left").join(roots.toDF("b", "_b"), "b", "left").where(root("a") != root("b"))
    links = links.unionByName(stored(confirmed(others.select("a", "b"), sets, sizes, percent), "minmax-links"))
    roots = stored(components(links), "minmax-roots")
    left = stored(undecided(banded(near, bands), roots, sizes, LEADERS + 2), "minmax-undecided")
    if not left.isEmpty():
        roots = components(links.unionByName(decided(left, only(sets, left.select("node")), percent, "binary")))
    grouped = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    alone = F.col("node").isNull()
    found = drawn.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), sized AS (
  SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM s
), sizes AS (
  SELECT DISTINCT doc_id, n FROM sized
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS c FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common WHERE 100 * c >= 85 * (total - c) UNION ALL SELECT y, x FROM common WHERE 100 * c >= 85 * (total - c)
), reach AS (
  SELECT x AS doc_id, y AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
), least_id AS (
  SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""
