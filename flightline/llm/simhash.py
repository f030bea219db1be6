"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of a fingerprint are grouped into partitions, correlated ones together, and each fingerprint
gets a threshold for each partition, with the thresholds adding up to ``radius - partitions + 1`` (-1:
not probed).  If two fingerprints differed by more than the threshold in every partition, they would
differ in more than ``radius`` bits in all, so probing every partition within its threshold finds
every pair within ``radius``.  The thresholds are allocated for each fingerprint by dynamic programming
on the candidates they would bring, which the histograms of the partitions' values tell
(``partitions * 2**width`` numbers, whatever the corpus).

Copies fall together first, as only distinct fingerprints are indexed.  A bucket in which more than
``large`` fingerprints share a partition's value is split by one more block of bits: the other bits
hold at most ``radius`` differing ones, so one of any ``radius + 1`` blocks is equal.  Where links go
beyond the radius it is cut into parts, and each pair of parts is a bucket: what is met never depends on
a bucket's size.  Inside a bucket
fingerprints are compared in blocks, and what leaves it is the least spanning forest of the pairs
within ``reach`` by their distance, never all pairs.  Components grow out of these by alternately
linking each node's larger and smaller neighbours to the least, written to a table each round.

Fingerprints of 64 bits can be told apart at small radii only: two texts that share 80 % of their
shingles differ in about 10 of 64 bits.  For a similarity of shingle sets there is a wide scheme
(``WIDE``): 192 bits in 16 partitions, of which two such texts have one within its threshold in 98 of 100
cases; pairs met within ``reach`` that lie on a bucket's forest are verified by the exact similarity of
their sets of shingles, and groups in which some fail are decided pair by pair (:mod:`.overlaps`).

Defined cases: a null or empty text, or one without words, has fingerprint zero, linked like any
other; fewer words than a shingle make one shingle of them all.  Repeated rows and ids are rows of
their own that link like others; a null id counts as larger than any other.  Where similarity is
verified, a text that stands under null ids alone links to its copies only, and of several texts
under one id any may hold a link.  Empty tables give an empty result; further columns are ignored.
A very long text is a slice of its own; what leaves the scan is its fingerprint.  Ties: a bit set in exactly
half of the hashes is 0, and of equally near pairs that with the lesser nodes is taken.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .bitmap import bits_for, build_bitmap, held, parted
from .overlaps import decided, undecided
from .storage import free_name, stored


@dataclass(frozen=True)
class Scheme:
    """``bits`` in ``partitions``; pairs within ``radius`` are met for certain, and those met are links up to ``reach`` (the radius unless given)."""

    bits: int = 64
    partitions: int = 4
    radius: int = 2
    reach: int | None = None
    #: Highest threshold of a partition; partitions * (most + 1) must be above the radius.
    most: int = 2
    #: Fingerprints that may share a partition's value before their bucket is split.
    large: int = 1024

    def __post_init__(self) -> None:
        if self.bits % 64 or self.bits % self.partitions or self.width > 16 or self.partitions * (self.most + 1) <= self.radius:
            raise ValueError("bits must be words of 64 in equal partitions of at most 16 bits, with thresholds that add up")

    @property
    def width(self) -> int:
        return self.bits // self.partitions

    @property
    def farthest(self) -> int:
        return self.radius if self.reach is None else self.reach

    def flips(self, errors: int) -> np.ndarray:
        """All values with ``errors`` bits of a partition set."""
        return np.array([sum(1 << b for b in bits) for bits in combinations(range(self.width), errors)], np.int64)


NARROW = Scheme()
WIDE = Scheme(bits=192, partitions=16, radius=17, reach=48, most=1, large=16_384)
BLOCK = 1024


def fingerprints_of(texts: kernel.Texts, shingle: int = 3, bits: int = 64) -> np.ndarray:
    """Shape (texts, bits / 64).  Bit b is 1 if it is set in over half of the hashes of the text's shingles: XXH64 (seed 42), and mixtures of it for further words."""
    from xxhash import xxh64_intdigest

    words = kernel.split_words(texts, lower=True)
    n = len(texts)
    out = np.zeros((n, bits // 64), np.uint64)
    if not len(words.start):
        return out
    # The words on end with one blank after each, so that a shingle is one span.
    length = words.end - words.start
    start = np.cumsum(length + 1) - length - 1
    joined = np.full(int(start[-1] + length[-1] + 1), 32, np.uint8)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    joined[np.repeat(start, length) + inside] = words.data[np.repeat(words.start, length) + inside]
    count = words.counts()
    first = np.cumsum(count) - count
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), shingles)
    begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(begin + shingle, (first + count)[owner]) - 1
    raw = memoryview(joined.tobytes())
    hashes = np.fromiter((xxh64_intdigest(raw[a:b], 42) for a, b in zip(start[begin].tolist(), (start[last] + length[last]).tolist(), strict=True)), np.uint64, len(begin))
    has = np.flatnonzero(shingles)
    at = (np.cumsum(shingles) - shingles)[has]
    for word in range(bits // 64):
        if word:
            hashes = kernel.mix(hashes + np.uint64(word))
        for b in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(b)) & np.uint64(1)).astype(np.int32), at)
            out[has, word] |= (2 * ones > shingles[has]).astype(np.uint64) << np.uint64(b)
    return out


def nodes_of(fps: np.ndarray) -> np.ndarray:
    """A long for each fingerprint: itself if it has 64 bits, else a hash."""
    node = fps[:, 0].copy()
    for word in range(1, fps.shape[1]):
        node = kernel.mix(node ^ kernel.mix(fps[:, word] + np.uint64(word)))
    return node.view(np.int64)


def to_arrow(fps: np.ndarray) -> pa.Array:
    """Fingerprints as binary values, the highest byte of each word first."""
    size = 8 * fps.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(fps), [None, pa.py_buffer(np.arange(len(fps) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(fps.astype(">u8")))])


def from_arrow(column: pa.Array, bits: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, bits // 64), np.uint64)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], ">u8", (offsets[-1] - offsets[0]) // 8, offsets[0]).astype(np.uint64).reshape(-1, bits // 64)


def text_hashes(texts: kernel.Texts) -> np.ndarray:
    """A hash of each whole text, as a long."""
    return kernel.span_hashes(texts.data, texts.offsets[:-1], texts.offsets[1:]).view(np.int64)


def fingerprint(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, bits: int = 64, hashed: bool = False) -> DataFrame:
    """``doc_id, node, fp`` (see :func:`nodes_of` and :func:`to_arrow`), and ``text_hash`` if ``hashed``."""
    names = ["doc_id", "node", "fp", "text_hash"][: 3 + hashed]

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                fps = fingerprints_of(texts, shingle, bits)
                columns = [batch.column(0).slice(texts.first_row, len(texts)), pa.array(nodes_of(fps)), to_arrow(fps)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text_hashes(texts))] if hashed else columns, names)

    return documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text")).mapInArrow(scan, "doc_id long, node long, fp binary" + ", text_hash long" * hashed)


def _bit(fps: np.ndarray, b: int) -> np.ndarray:
    return ((fps[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64)


def bit_groups(distinct: DataFrame, scheme: Scheme = NARROW) -> np.ndarray:
    """The bits in order of their partitions: correlated bits together.

    One table of co-occurrences, bits x bits, summed over all fingerprints, reaches the driver.
    """
    size = scheme.bits

    def together(batches):
        total = np.zeros((size, size))
        n = 0
        for batch in batches:
            fps = from_arrow(batch.column(0), size)
            bits = np.stack([_bit(fps, b) for b in range(size)], axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size + 1)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    sums = distinct.select("fp").mapInArrow(together, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().set_index("cell")["n"]
    if not len(sums):
        return np.arange(size)
    n = sums[size * size]
    joint = sums.drop(size * size).sort_index().to_numpy().reshape(size, size) / n
    mean = np.diag(joint)
    spread = np.sqrt(np.maximum(1e-12, mean * (1 - mean)))
    tie = np.abs((joint - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, order = list(range(size)), []
    for _ in range(scheme.partitions):
        sub = tie[np.ix_(free, free)]
        group = [free[int(sub.sum(axis=1).argmax())]]
        while len(group) < scheme.width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(tie[np.ix_(rest, group)].mean(axis=1).argmax())])
        order += group
        free = [b for b in free if b not in group]
    return np.array(order)


def value_of(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The integer that the named bits make."""
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(bits.tolist()):
        out |= _bit(fps, bit) << k
    return out


def parts_of(fps: np.ndarray, order: np.ndarray, scheme: Scheme = NARROW) -> np.ndarray:
    """The value of each partition: shape (n, partitions)."""
    return np.stack([value_of(fps, own) for own in order.reshape(scheme.partitions, scheme.width)], axis=1)


def candidate_tables(counts: np.ndarray, scheme: Scheme = NARROW) -> np.ndarray:
    """From counts (partitions, 2**width): fingerprints within 0, 1, ... bits of each value, shape (partitions, most + 1, 2**width)."""
    values = np.arange(1 << scheme.width)
    out = np.zeros((scheme.partitions, scheme.most + 1, 1 << scheme.width), np.float32)
    for p in range(scheme.partitions):
        for e in range(scheme.most + 1):
            out[p, e] = sum(counts[p][values ^ f] for f in scheme.flips(e)) + (out[p, e - 1] if e else 0)
    return out


def allocate(parts: np.ndarray, tables: np.ndarray, scheme: Scheme = NARROW) -> np.ndarray:
    """Thresholds (n, partitions) with the least candidates and probes, adding up to radius - partitions + 1.

    Dynamic programming over the partitions; the state is the sum so far of (threshold + 1).
    """
    n, units, most = len(parts), scheme.radius + 1, scheme.most + 1
    probes = np.cumsum([len(scheme.flips(e)) for e in range(most)])
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    back = np.zeros((scheme.partitions, units + 1, n), np.int8)
    for p in range(scheme.partitions):
        cost = [np.zeros(n)] + [tables[p, e, parts[:, p]] + probes[e] for e in range(most)]
        new = np.full((units + 1, n), np.inf)
        for total in range(units + 1):
            for spent in range(min(total, most) + 1):
                trial = best[total - spent] + cost[spent]
                better = trial < new[total]
                new[total][better] = trial[better]
                back[p, total][better] = spent
        best = new
    out = np.zeros((n, scheme.partitions), np.int64)
    total = np.full(n, units)
    for p in reversed(range(scheme.partitions)):
        spent = back[p, total, np.arange(n)].astype(np.int64)
        out[:, p] = spent - 1
        total -= spent
    return out


def probes_of(fps: np.ndarray, order: np.ndarray, counts: np.ndarray, tables: np.ndarray, scheme: Scheme = NARROW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, index of the fingerprint, is a query) of the index and of the probes of each fingerprint."""
    parts = parts_of(fps, order, scheme)
    thresholds = allocate(parts, tables, scheme)
    own_bits = order.reshape(scheme.partitions, scheme.width)
    keys, owners, asks = [], [], []

    def put(key: np.ndarray, who: np.ndarray, query: bool) -> None:
        keys.append(key)
        owners.append(who)
        asks.append(np.full(len(key), query))

    def emit(p: int, value: np.ndarray, who: np.ndarray, query: bool) -> None:
        large = counts[p][value] > scheme.large
        put((p * 64 + 63 << 40) | (value[~large] << 24), who[~large], query)
        if large.any() and scheme.farthest > scheme.radius:
            # Links go beyond what blocks of bits would find, so every pair of two parts of the bucket is a bucket of its own.
            value, who = value[large], who[large]
            parts = np.minimum(np.ceil(counts[p][value] / max(1, scheme.large)).astype(np.int64), 4096)
            own = (kernel.mix(fps[who, 0]) % parts.astype(np.uint64)).astype(np.int64)
            which = np.repeat(np.arange(len(who)), parts)
            other = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            member, asking = (other, own[which]) if query else (own[which], other)
            put((p * 64 + 62 << 40) | (value[which] << 24) | (member << 12) | asking, who[which], query)
        elif large.any():
            rest = np.setdiff1d(order, own_bits[p], assume_unique=True)
            for block, bits in enumerate(np.array_split(rest, scheme.radius + 1)):
                put((p * 64 + block << 40) | (value[large] << 24) | value_of(fps[who[large]], bits), who[large], query)

    everyone = np.arange(len(fps))
    for p in range(scheme.partitions):
        emit(p, parts[:, p], everyone, False)
        for e in range(scheme.most + 1):
            who = np.flatnonzero(thresholds[:, p] >= e)
            for f in scheme.flips(e):
                value = parts[who, p] ^ f
                some = counts[p][value] > (0 if e else 1)  # nobody else there
                emit(p, value[some], who[some], True)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(asks)


def _forest(fps: np.ndarray, queries: np.ndarray, members: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least spanning forest, by distance, of the pairs (query, member) within ``reach`` in one bucket: indices into ``fps``.

    Rows of one fingerprint are one node.  In each round every component takes its nearest pair to
    another one, ties by the nodes' numbers, so a round halves the components at least and holds one
    block of distances at a time, however many pairs are near.
    """
    far = np.int16(fps.shape[1] * 64 + 1)
    starts = [(a, b) for a in range(0, len(queries), BLOCK) for b in range(0, len(members), BLOCK)]

    def distances(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, m = queries[a : a + BLOCK], members[b : b + BLOCK]
        d = np.bitwise_count(fps[q, 0][:, None] ^ fps[m, 0][None, :]).astype(np.int16)
        for w in range(1, fps.shape[1]):
            d += np.bitwise_count(fps[q, w][:, None] ^ fps[m, w][None, :])
        d[(d > reach) | (d == 0)] = far
        return q, m, d

    none = np.zeros(0, np.int64)
    live = [s for s in starts if (distances(*s)[2] < far).any()]
    if not live:
        return none, none
    known, first, node = np.unique(nodes_of(fps), return_index=True, return_inverse=True)
    n = np.int64(len(known))
    label, left, right = np.arange(n), [], []
    nothing = np.iinfo(np.int64).max
    while True:
        best = np.full(n, nothing)  # of each component: distance, lesser node, greater node as one number
        for start in live:
            q, m, d = distances(*start)
            x, y = node[q], node[m]
            if left:
                d[label[x][:, None] == label[y][None, :]] = far
            for near, i, j in ((d.min(axis=1), x, y[d.argmin(axis=1)]), (d.min(axis=0), x[d.argmin(axis=0)], y)):
                ok = near < far
                i, j = i[ok], j[ok]
                key = (near[ok].astype(np.int64) * n + np.minimum(i, j)) * n + np.maximum(i, j)
                np.minimum.at(best, label[i], key)
                np.minimum.at(best, label[j], key)
        own = np.flatnonzero(best < nothing)
        if not len(own):
            break
        edges = np.unique(best[own])
        a, b = edges // n % n, edges % n
        left.append(a)
        right.append(b)
        # Components follow their pairs; where two took the same one, the lesser stays.
        to = np.arange(n)
        ends = np.stack([label[best[own] // n % n], label[best[own] % n]])
        to[own] = np.where(ends[0] == own, ends[1], ends[0])
        both = own[(to[to[own]] == own) & (own < to[own])]
        to[both] = both
        while (to != to[to]).any():
            to = to[to]
        label = to[label]
    return first[np.concatenate(left)], first[np.concatenate(right)]


def links(distinct: DataFrame, scheme: Scheme = NARROW) -> DataFrame:
    """``a, b`` (a < b): links among distinct fingerprints (columns ``node, fp``) that hold all components together."""
    spark = distinct.sparkSession
    order = bit_groups(distinct, scheme)
    cells = 1 << scheme.width

    def values(batches):
        for batch in batches:
            parts = parts_of(from_arrow(batch.column(0), scheme.bits), order, scheme)
            cell, n = np.unique(parts + np.arange(scheme.partitions) * cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    counts = np.zeros(scheme.partitions * cells, np.float32)
    seen = distinct.select("fp").mapInArrow(values, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most partitions * 2**width rows
    counts[seen["cell"].to_numpy(np.int64)] = seen["n"].to_numpy()
    counts = counts.reshape(scheme.partitions, cells)
    known = spark.sparkContext.broadcast((order, counts, candidate_tables(counts, scheme)))

    def probe(batches):
        order, counts, tables = known.value
        for batch in batches:
            fps = from_arrow(batch.column(0), scheme.bits)
            for a in range(0, len(fps), 1024):
                part = fps[a : a + 1024]
                keys, owners, asks = probes_of(part, order, counts, tables, scheme)
                yield pa.RecordBatch.from_arrays([pa.array(keys), to_arrow(part[owners]), pa.array(asks)], ["key", "fp", "query"])

    def verify(batches):
        # Rows come sorted by key; a bucket can go on in the next batch.
        keys, fps, asks = np.zeros(0, np.int64), np.zeros((0, scheme.bits // 64), np.uint64), np.zeros(0, bool)

        def of(keys, fps, asks):
            # A link to be found needs a query and a member that differ; most buckets have none.
            cut = np.flatnonzero(np.diff(keys)) + 1
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(keys)).tolist(), strict=True):
                if b - a > 1:
                    ask = asks[a:b]
                    if ask.any() and not ask.all():
                        x, y = _forest(fps[a:b], np.flatnonzero(ask), np.flatnonzero(~ask), scheme.farthest)
                        left.append(a + x)
                        right.append(a + y)
            x, y = nodes_of(fps[np.concatenate(left)]), nodes_of(fps[np.concatenate(right)])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, kernel.ints(batch.column(0))])
            fps = np.concatenate([fps, from_arrow(batch.column(1), scheme.bits)])
            asks = np.concatenate([asks, batch.column(2).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield of(keys[:whole], fps[:whole], asks[:whole])
                keys, fps, asks = keys[whole:], fps[whole:], asks[whole:]
        if len(keys):
            yield of(keys, fps, asks)

    rows = distinct.select("fp").mapInArrow(probe, "key long, fp binary, query boolean")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


def shingle_sets(texts: kernel.Texts, shingle: int) -> pa.Array:
    """The sorted distinct hashes of each text's shingles (of all its words where they are fewer), as binary values of 64-bit integers."""
    words = kernel.split_words(texts, lower=True)
    hashes, count = kernel.word_hashes(words), words.counts()
    h, at = kernel.window_hashes(hashes, words.doc, shingle)
    owner = words.doc[at]
    first = words.firsts()
    few = np.flatnonzero((count > 0) & (count < shingle))
    short = np.array([kernel.window_hashes(hashes[first[k] : first[k + 1]], words.doc[first[k] : first[k + 1]], int(count[k]))[0][0] for k in few.tolist()], np.uint64)
    h, owner = np.append(h, short), np.append(owner, few)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    offsets = np.append(0, 8 * np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(h))])


def sets_of(nodes: DataFrame, distinct: DataFrame, documents: DataFrame, *, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """``node, shingles`` of the ``nodes``, each read from one document, that with the least id (its text told by a hash, as ids may be repeated); only documents that a bitmap of those ids holds leave the scan."""
    spark = documents.sparkSession
    wanted = stored(nodes.join(distinct, "node").where("least is not null").select("node", F.col("least").alias("doc_id"), "text_hash"), "near-wanted")
    cells = spark.sparkContext.broadcast(build_bitmap(wanted.select(F.xxhash64("doc_id").alias("key")), bits_for(wanted.count())))

    def scan(batches):
        for batch in batches:
            part = batch.filter(pa.array(held(cells.value, kernel.ints(batch.column(2)))))
            for texts in kernel.text_slices(part.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(texts.first_row, len(texts)), pa.array(text_hashes(texts)), shingle_sets(texts, shingle)], ["doc_id", "text_hash", "shingles"])

    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text")).withColumn("key", F.xxhash64("doc_id"))
    return stored(docs.mapInArrow(scan, "doc_id long, text_hash long, shingles binary").join(wanted, ["doc_id", "text_hash"]).select("node", "shingles").dropDuplicates(["node"]), "near-shingles")


def verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``edges`` (``a, b``) whose sets of shingles have a Jaccard similarity of ``percent`` hundredths or more."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("own")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("other")), "b").select("a", "b", "own", "other")

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common) and common > 0
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long").distinct()


def roots_of_near_sets(met: DataFrame, distinct: DataFrame, documents: DataFrame, *, id_column: str, text_column: str, shingle: int, percent: int) -> DataFrame:
    """``node, root`` of the links among sets of shingles, from pairs ``met`` (``a, b``) that hold together all that may be near each other.

    The pairs themselves are verified first.  Where a group that they hold together does not become one
    component by that, all its sets of different components are compared: a pair that no met one
    stands for is not lost.
    """
    nodes = stored(met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct(), "near-nodes")
    sets = sets_of(nodes, distinct, documents, id_column=id_column, text_column=text_column, shingle=shingle)
    roots = stored(components(stored(verified(met, sets, percent), "near-links")), "near-roots")
    crossing = stored(_between_components(met, roots), "near-crossing")
    if crossing.isEmpty():
        return roots
    # Only components that a met pair joins to another one are of use from here on.
    groups = components(crossing).select(F.col("node").alias("root"), F.col("root").alias("band"))
    every = groups.unionByName(groups.select(F.col("band").alias("root"), "band").distinct())
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    sizes = sets.select("node", (F.length("shingles") / 8).cast("long").alias("n_shingles"))
    left = stored(undecided(rooted.join(every, "root").select("band", "node"), roots, sizes, 3), "near-undecided")
    if left.isEmpty():
        return roots
    top = stored(components(_between_components(decided(left, sets, percent, "long"), roots)), "near-top")
    above = top.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return roots.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root")).unionByName(top)


def _between_components(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges as pairs of different roots."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
    met = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    return met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node reachable, for every node of ``edges`` (``a, b`` longs).

    Alternating star contraction: each round links every node's larger neighbours, then every node's
    smaller neighbours, to the least of them; it ends when a round changes nothing.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "component-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("low").alias("a"), F.col("b")).where("a < b").distinct()
        # Small star: edges point from b to its smaller neighbours a.
        small_least = large.groupBy("b").agg(F.min("a").alias("low"))
        met = large.join(small_least, "b")
        small = met.select(F.col("low").alias("a"), F.col("a").alias("b")).unionByName(met.select(F.col("low").alias("a"), F.col("b"))).where("a < b").distinct()
        new = stored(small, "component-edges")
        changed = new.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
        before = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
        edges = new
        if changed == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _grouped(documents: DataFrame, id_column: str, text_column: str, shingle: int, scheme: Scheme, least_similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node, fp`` of every document, and ``node, root, component_id, component_size`` of every fingerprint."""
    verify = least_similarity is not None
    fps = stored(fingerprint(documents, id_column=id_column, text_column=text_column, shingle=shingle, bits=scheme.bits, hashed=verify), "simhash")
    told = [F.min_by("text_hash", "doc_id").alias("text_hash")] * verify
    distinct = stored(fps.groupBy("node", "fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *told), "simhash-distinct")
    found = links(distinct, scheme)
    if least_similarity is None:
        near = components(found)
    else:
        near = roots_of_near_sets(stored(found, "simhash-candidates"), distinct, documents, id_column=id_column, text_column=text_column, shingle=shingle, percent=round(100 * least_similarity))
    roots = near.select(F.col("node").alias("inner"), "root")
    # Components of fingerprints, by their least document.
    grouped = distinct.join(roots, F.col("node") == F.col("inner"), "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    totals = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("component_size"))
    return fps, grouped.select("node", "root").join(totals, "root")


def near_duplicates(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, scheme: Scheme = NARROW, least_similarity: float | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id, component_size``: one row for each document."""
    fps, named = _grouped(documents, id_column, text_column, shingle, scheme, least_similarity)
    return fps.join(named, "node").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "component_size")


def keep_one(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, scheme: Scheme = NARROW, least_similarity: float | None = None) -> DataFrame:
    """One document of each component, with its columns: that with the least id, null ids last, and of rows that share it any one."""
    fps, named = _grouped(documents, id_column, text_column, shingle, scheme, least_similarity)
    known = stored(fps.join(named, "node").select("doc_id", "node", "root", "component_id"), "simhash-components")
    mark = free_name(documents, "_mark")
    # Ids that stand in one row only are told by the id.
    shared = stored(known.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(mark)), "simhash-shared")
    later = stored(known.where("doc_id > component_id").select(F.col("doc_id").alias(mark)).distinct(), "simhash-later")
    # Only rows that may go, or whose id others have, are exchanged.
    untouched, touched = parted(documents, id_column, later.unionByName(shared).distinct())
    own = touched[id_column].cast("long")
    kept = touched.join(later, own == F.col(mark), "left_anti")
    if shared.isEmpty():
        return untouched.unionByName(kept)
    kept = untouched.unionByName(kept.join(shared, own.eqNullSafe(F.col(mark)), "left_anti"))
    # Rows whose id others have, or that have none, are told by id and fingerprint.
    rows = touched.join(shared, own.eqNullSafe(F.col(mark)), "left_semi")
    names, node = documents.columns, free_name(documents, "_node")
    place = names.index(text_column)

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(place)):
                yield pa.RecordBatch.from_arrays([*batch.slice(texts.first_row, len(texts)).columns, pa.array(nodes_of(fingerprints_of(texts, shingle, scheme.bits)))], [*names, node])

    marked = rows.mapInArrow(scan, T.StructType([*documents.schema.fields, T.StructField(node, T.LongType())]))
    root, low = free_name(documents, "_root"), free_name(documents, "_low")
    of_node = known.select(F.col("node").alias(mark), F.col("root").alias(root), F.col("component_id").alias(low)).distinct()
    least = marked.join(of_node, F.col(node) == F.col(mark)).where(marked[id_column].cast("long").eqNullSafe(F.col(low)))
    # Of rows that share the id the one whose hash is least: the same one if a task runs again.
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    one = least.groupBy(root).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(mark))
    return kept.unionByName(one.select(f"{mark}.*"))


def op3_generalised_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
