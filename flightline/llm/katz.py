"""Katz backoff scores from Good-Turing discounted n-gram counts (words and pairs of words).

p(w|v) is d(c) * c(v,w) / c(v) for pairs counted ``least_pair`` times or more in training (once, in
the registered query), and a(v) * p(w) for all others, where a(v) makes p(.|v) add up to one exactly; p(w) is d(c) * c(w) / N
for known words, and what the discounts leave is the probability of the one unknown word.  A text
is w1 ... wn and an end, read after a start.

A text's score is evaluated token by token, but regrouped so that no token needs a look-up of its
own.  For the pair (v, w) it adds ``log p(v)`` for its first word and, by the recursion, either
``log p(w|v) - log p(w)`` or ``log a(v)``; the end's ``log p`` is added once for each text.  So all
that is asked stands with the pair's first word.

Data flow.  Pairs are packed in blocks of documents: for each bucket (by the first word) one binary
row with the distinct pairs and which documents have them.  That table is stored bucketed and never
exchanged: each bucket counts its pairs and asks for the p(w) of its distinct second words, and
scoring counts again and normalises with the answers, so no row is ever made for a pair.  Words that make up more than 1 / (4 * buckets) of the corpus (at
most that many, so they may be broadcast) are dealt by the pair instead, which splits the hot ones.
Second words are told apart by 48 bits of their hash within a pair, first words by 64.

Defined cases: null is the empty text, whose only token is the end.  Rows with equal ids are scored
each by itself; a row with a null id trains and is not held out.  Without training rows every
token is unknown, and the base score is that of no counts.  An empty table gives an empty result;
further columns are ignored.
A very long text lies in one block, which is then as long as it; ties do not arise.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .storage import new_path, stored

START, END = np.uint64(0x5A17_0000_0000_0001), np.uint64(0xE2D0_0000_0000_0001)
GOOD_TURING_TO = 5
BLOCK_TOKENS = 1 << 20
#: Tokens of a bucket, which a worker holds whole; the number of buckets follows the corpus.
BUCKET_TOKENS = 9 << 18
#: Files that the bucketed table may have before its rows are dealt out by bucket first.
MOST_FILES = 200_000
LOG10 = np.log(10)


def second(w: np.ndarray) -> np.ndarray:
    """The 48 bits by which second words are told apart, as int64."""
    return (w >> np.uint64(16)).astype(np.int64)


def good_turing(counts_of_counts: dict[int, int], least: int = 1, up_to: int = GOOD_TURING_TO) -> np.ndarray:
    """Factors d[r] for counts r = 0 ... up_to (higher counts are not discounted).

    Katz's formula if all counts are kept; plain Good-Turing if low ones are cut off.  Where the
    counts of counts give no factor in (0, 1], (r - 0.5) / r is used.
    """
    n = lambda r: counts_of_counts.get(r, 0)
    d = np.ones(up_to + 1)
    common = (up_to + 1) * n(up_to + 1) / n(1) if least == 1 and n(1) else 0.0
    for r in range(least, up_to + 1):
        raw = (r + 1) * n(r + 1) / (r * n(r)) if n(r) else 0.0
        value = (raw - common) / (1 - common) if common < 1 else 0.0
        d[r] = value if 0 < value <= 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c for counts of 1 or more."""
    return np.where(c > GOOD_TURING_TO, c, c * d[np.minimum(c, GOOD_TURING_TO)])


@dataclass
class WordStats:
    """What training tells of single words: N, V, the discounts, the unknown word's probability, and the heavy words."""

    tokens: int
    types: int
    discount: np.ndarray
    unknown: float
    total: float
    texts: int
    heavy: dict[int, int] = field(default_factory=dict)

    def p(self, c: np.ndarray) -> np.ndarray:
        """p(w) from the count of w (0: unknown)."""
        c = np.asarray(c)
        return np.where(c > 0, discounted(np.maximum(c, 1), self.discount) / self.total, self.unknown)

    def log_p(self, c: np.ndarray) -> np.ndarray:
        return np.log(self.p(c))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log((np.asarray(c) + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def word_counts(docs: DataFrame) -> DataFrame:
    """From ``(doc_id, text, held_out)``: ``word, c`` over the training rows, ends included."""

    def scan(batches):
        for batch in batches:
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            for texts in kernel.text_slices(batch.column(1)):
                own = train[texts.first_row : texts.first_row + len(texts)]
                words = kernel.split_words(texts, lower=True)
                word, c = np.unique(kernel.word_hashes(words)[own[words.doc]], return_counts=True)
                if own.any():
                    word, c = np.append(word, END), np.append(c, own.sum())
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], ["word", "c"])

    return docs.mapInArrow(scan, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_stats(words: DataFrame, buckets: int) -> WordStats:
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    low = {r["c"]: r["count"] for r in words.where(F.col("c") <= GOOD_TURING_TO + 1).groupBy("c").count().collect()}
    heavy = {r["word"]: r["c"] for r in words.where(F.col("c") > max(1, total["n"] // (4 * buckets))).collect()}  # at most 4 * buckets rows
    d = good_turing(low)
    left = sum(n * r * (1 - d[r]) for r, n in low.items() if r <= GOOD_TURING_TO)
    mass = float(total["n"]) if left > 0 else total["n"] + 1.0
    texts = heavy.get(int(END.view(np.int64)))
    if texts is None:
        ends = words.where(F.col("word") == F.lit(int(END.view(np.int64)))).first()
        texts = ends["c"] if ends else 0
    return WordStats(total["n"], total["v"], d, (left if left > 0 else 1.0) / mass, mass, texts, heavy)


def bucket_count(spark: SparkSession, tokens: int) -> int:
    """At least one bucket for each shuffle partition, and as many as keep a bucket near ``BUCKET_TOKENS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))


def bucket_names(spark: SparkSession, buckets: int) -> np.ndarray:
    """For each bucket an integer that Spark's bucketing puts into a file of its own, so that buckets are tasks, evenly."""
    tried = spark.range(40 * buckets + 400).select(F.col("id").cast("int").alias("name"))
    found = tried.groupBy(F.pmod(F.hash("name"), F.lit(buckets)).alias("place")).agg(F.min("name").alias("name")).orderBy("place").collect()
    if len(found) < buckets:
        raise ValueError(f"no names for {buckets} buckets")
    return np.array([r["name"] for r in found], np.int32)


def bucket_of(v: np.ndarray, w: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket of each pair; ``heavy`` is the sorted hashes of the heavy first words, ``w`` 48 bits."""
    base = (v >> np.uint64(33)).astype(np.int64)
    at = np.minimum(np.searchsorted(heavy, v), max(0, len(heavy) - 1))
    split = heavy[at] == v if len(heavy) else np.zeros(len(v), bool)
    return (base + np.where(split, w, 0)) % buckets


def pack_block(v: np.ndarray, s: np.ndarray, doc: np.ndarray, ids: np.ndarray, train: np.ndarray, missing: np.ndarray, heavy: np.ndarray, bucket_name: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """One binary row for each bucket: the distinct pairs of a block of documents and where they occur."""
    bucket = bucket_of(v, s, heavy, len(bucket_name)).astype(np.int32)
    order = np.lexsort((s, v, bucket))
    b, v, s, doc = bucket[order], v[order], s[order], doc[order]
    del bucket, order
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1]) | (b[1:] != b[:-1])
    pair = np.flatnonzero(new)
    times = np.diff(np.append(pair, len(v)))
    run = np.ones(len(pair), bool)
    run[1:] = (v[pair][1:] != v[pair][:-1]) | (b[pair][1:] != b[pair][:-1])
    first = np.flatnonzero(run)
    runs = np.diff(np.append(first, len(pair)))
    flags = np.packbits(train).tobytes()
    names, first_of = np.unique(b, return_index=True)
    rows = []
    ends = np.append(first_of[1:], len(v))
    for lo, hi in zip(first_of.tolist(), ends.tolist(), strict=True):
        p0, p1 = np.searchsorted(pair, [lo, hi])
        r0, r1 = np.searchsorted(first, [p0, p1])
        seconds = s[pair[p0:p1]]
        begins = doc[lo:hi][v[lo:hi] == START]  # each text once, in one of the buckets
        sizes = np.array([len(ids), len(begins), r1 - r0, p1 - p0, hi - lo], "<i8")
        words = v[pair[first[r0:r1]]]
        high = np.diff(words >> np.uint64(32), prepend=np.uint64(0)).astype("<u4")
        columns = [sizes, begins.astype("<u2"), ids[begins], missing[begins].astype("u1"), high, words.astype("<u4"), runs[r0:r1].astype("<u4"), (seconds >> 32).astype("<u2"), (seconds & 0xFFFFFFFF).astype("<u4"), times[p0:p1].astype("<u4"), doc[lo:hi].astype("<u2")]
        rows.append(flags + b"".join([c.tobytes() for c in columns]) + np.array([len(flags)], "<i8").tobytes())
    return bucket_name[names], rows


@dataclass
class Block:
    """Of one bucket: ``begins`` are the texts whose first word is here, with their ids; ``s[k]`` follows ``v[k]`` in ``times[k]`` of the places ``doc``."""

    train: np.ndarray
    begins: np.ndarray
    ids: np.ndarray
    missing: np.ndarray
    v: np.ndarray
    s: np.ndarray
    times: np.ndarray
    doc: np.ndarray


def unpack_block(raw: bytes) -> Block:
    (at,) = np.frombuffer(raw, "<i8", 1, len(raw) - 8).tolist()
    flags = np.frombuffer(raw, "u1", at)
    n_docs, n_begins, n_runs, n_pairs, n_places = np.frombuffer(raw, "<i8", 5, at).tolist()
    at += 40

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    begins, ids, missing = take("<u2", n_begins).astype(np.int64), take("<i8", n_begins), take("u1", n_begins).astype(bool)
    v = (np.cumsum(take("<u4", n_runs).astype(np.uint64)) << np.uint64(32)) | take("<u4", n_runs)
    runs = take("<u4", n_runs)
    high, low = take("<u2", n_pairs), take("<u4", n_pairs)
    return Block(np.unpackbits(flags, count=n_docs).astype(bool), begins, ids, missing, np.repeat(v, runs), (high.astype(np.int64) << 32) | low, take("<u4", n_pairs).astype(np.int64), take("<u2", n_places).astype(np.int64))


def pack(docs: DataFrame, heavy: np.ndarray, names: np.ndarray) -> str:
    """Store the packed pairs of ``(doc_id, text, held_out)`` as a table bucketed by ``bucket``, ``bucket, block, pairs``, and return its name."""

    def scan(batches):
        parts: list[tuple] = []
        held, n_docs = 0, 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts.clear()
            own, rows = pack_block(*columns, heavy, names)
            block = uuid.uuid4().int >> 65
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "block", "pairs"])

        for batch in batches:
            ids, missing = kernel.ints(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            for texts in kernel.text_slices(batch.column(1)):
                n = len(texts)
                if parts and n_docs + n > 60_000:
                    yield flush()
                    held, n_docs = 0, 0
                words = kernel.split_words(texts, lower=True)
                h, bounds = kernel.word_hashes(words), words.firsts()
                # Each text is START w1 ... wn END.
                size = np.diff(bounds) + 2
                line = np.empty(int(size.sum()), np.uint64)
                stop = np.cumsum(size)
                line[stop - size], line[stop - 1] = START, END
                inner = np.arange(len(h)) + 2 * words.doc + 1
                line[inner] = h
                doc = np.repeat(np.arange(n), size)
                begins = np.flatnonzero(doc[:-1] == doc[1:])
                own = slice(texts.first_row, texts.first_row + n)
                parts.append((line[begins], second(line[begins + 1]), (doc[begins] + n_docs).astype(np.int32), ids[own], train[own], missing[own]))
                held, n_docs = held + len(begins), n_docs + n
                if held >= BLOCK_TOKENS:
                    yield flush()
                    held, n_docs = 0, 0
        if parts:
            yield flush()

    rows = docs.mapInArrow(scan, "bucket int, block long, pairs binary")
    return _bucketed(rows, "pairs", len(names))


def _bucketed(rows: DataFrame, name: str, partitions: int) -> str:
    """Write as a table in the shared folder, bucketed by ``bucket``, and return its name."""
    table = f"katz_{name}_{uuid.uuid4().hex}"
    if rows.rdd.getNumPartitions() * partitions > MOST_FILES:
        rows = rows.repartition(partitions, "bucket")
    rows.write.format("parquet").option("compression", "zstd").option("path", new_path(rows.sparkSession, f"katz-{name}")).bucketBy(partitions, "bucket").saveAsTable(table)
    return table


def training_pairs(blocks: list[Block], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``v, s, c`` of the pairs of one bucket counted ``least`` times or more in training, sorted, and how many pairs are counted 1, 2, ... times."""
    v, s = np.concatenate([b.v for b in blocks]), np.concatenate([b.s for b in blocks])
    c = np.concatenate([np.add.reduceat(b.train[b.doc].astype(np.int64), np.cumsum(b.times) - b.times) for b in blocks])
    v, s, c = v[c > 0], s[c > 0], c[c > 0]
    order = np.lexsort((s, v))
    v, s, c = v[order], s[order], c[order]
    del order
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    if len(at):
        v, s, c = v[at], s[at], np.add.reduceat(c, at)
    low = np.bincount(np.minimum(c, GOOD_TURING_TO + 2), minlength=GOOD_TURING_TO + 3)[1 : GOOD_TURING_TO + 2]
    keep = c >= least
    return v[keep], s[keep], c[keep], low


def by_part(s: np.ndarray, parts: int) -> np.ndarray:
    """The distinct second words, in order of their part (``s % parts``)."""
    s = np.unique(s)
    return s[np.argsort(s % parts, kind="stable")]


def asks(pairs: DataFrame, heavy: np.ndarray, least: int, parts: int) -> DataFrame:
    """What the buckets' counts tell and ask: ``bucket, part, v, r, n, seconds, of_heavy``.

    With null ``part``: ``n`` pairs of the bucket have count ``r``; with a heavy ``v``, ``n`` of its pairs, or for
    ``r`` above the discounted counts their total.  Otherwise the distinct second words of the bucket in that part of
    the words, and for each pair of a heavy word which of them it has.
    """

    def ask(table: pa.Table) -> pa.Table:
        v, s, c, low = training_pairs([unpack_block(x.as_py()) for x in table.column("pairs")], least)
        rows: list[tuple] = [(None, None, r, int(n), None, None) for r, n in enumerate(low, 1)]
        seconds = by_part(s, parts)
        at = np.minimum(np.searchsorted(heavy, v), max(0, len(heavy) - 1))
        own = np.flatnonzero(heavy[at] == v) if len(heavy) else np.zeros(0, np.int64)
        who, its = at[own], np.minimum(c[own], GOOD_TURING_TO + 1)
        cells, cell = np.unique(who * (GOOD_TURING_TO + 2) + its, return_inverse=True)
        sums = np.bincount(cell, weights=np.where(its > GOOD_TURING_TO, c[own], 1), minlength=len(cells)).astype(np.int64)
        rows += [(None, int(heavy[k // (GOOD_TURING_TO + 2)].view(np.int64)), int(k % (GOOD_TURING_TO + 2)), int(n), None, None) for k, n in zip(cells, sums, strict=True)]
        place = s[own] % parts
        order = np.lexsort((s[own], place))
        who, second_of, place = who[order], s[own][order], place[order]
        part, first = np.unique(seconds % parts, return_index=True)
        for p, lo, hi in zip(part.tolist(), first.tolist(), np.append(first, len(seconds))[1:].tolist(), strict=True):
            a, b = np.searchsorted(place, [p, p + 1])
            here = seconds[lo:hi]
            packed = (here >> 32).astype("<u2").tobytes() + (here & 0xFFFFFFFF).astype("<u4").tobytes()
            rows.append((p, None, None, None, packed, np.searchsorted(here, second_of[a:b]).astype("<u4").tobytes() + who[a:b].astype("<u4").tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.table([pa.array(np.full(len(rows), table.column("bucket")[0].as_py(), np.int32)), *columns], names=["bucket", "part", "v", "r", "n", "seconds", "of_heavy"])

    return pairs.select("bucket", "pairs").groupBy("bucket").applyInArrow(ask, "bucket int, part int, v long, r long, n long, seconds binary, of_heavy binary")


def answers(asked: DataFrame, words: DataFrame, stats: WordStats, heavy: np.ndarray, parts: int) -> DataFrame:
    """``bucket, part, v, p, ps``: p(w) of the second words asked for, in their order, and of each heavy word the sum ``p`` over a part."""

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
        names = ["bucket", "part", "v", "p", "ps"]
        if not asked.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        word, which = np.unique(kernel.ints(known.column("s").combine_chunks()), return_inverse=True)
        p = np.bincount(which, weights=stats.p(kernel.ints(known.column("c").combine_chunks())), minlength=len(word))
        part, total = asked.column("part")[0].as_py(), np.zeros(len(heavy))
        rows: list[tuple] = []
        for bucket, raw, of_heavy in zip(asked.column("bucket").to_pylist(), asked.column("seconds"), asked.column("of_heavy"), strict=True):
            raw, of_heavy = raw.as_py(), of_heavy.as_py()
            n, m = len(raw) // 6, len(of_heavy) // 8
            s = (np.frombuffer(raw, "<u2", n).astype(np.int64) << 32) | np.frombuffer(raw, "<u4", n, 2 * n)
            own = p[np.searchsorted(word, s)]
            total += np.bincount(np.frombuffer(of_heavy, "<u4", m, 4 * m), weights=own[np.frombuffer(of_heavy, "<u4", m)], minlength=len(heavy))
            rows.append((bucket, part, None, None, own.astype("<f8").tobytes()))
        rows += [(None, part, int(heavy[k].view(np.int64)), float(total[k]), None) for k in np.flatnonzero(total)]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    s = F.shiftrightunsigned("word", 16)
    by_word = words.select((s % parts).cast("int").alias("part"), s.alias("s"), "c")
    own = asked.where("part is not null").select("bucket", "part", "seconds", "of_heavy")
    return own.groupBy("part").cogroup(by_word.groupBy("part")).applyInArrow(answer, "bucket int, part int, v long, p double, ps binary")


@dataclass
class Model:
    """``words`` (word, c); ``known`` (bucket, v, c, part, ps): the counts of light words, and the p(w) of each bucket's second words by part; log a(v) and divisor of heavy words; the pairs' discounts; and the numbers."""

    stats: WordStats
    words: DataFrame
    known: DataFrame
    heavy_alpha: dict[int, float]
    heavy_total: dict[int, float]
    discount: np.ndarray
    least: int
    buckets: int


def _alpha(kept: np.ndarray, likely: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log a(v), and the total by which counts of v are divided: c(v), or one more where nothing would be left."""
    total = np.where(c - kept > 1e-9 * c, c, c + 1.0)
    return np.log(np.maximum(1e-300, 1 - kept / total)) - np.log(np.maximum(1e-300, 1 - likely)), total


def train(docs: DataFrame, least: int, buckets: int | None = None) -> tuple[Model, str]:
    """The model of the rows that are not held out, and the table with the packed pairs of all rows."""
    spark = docs.sparkSession
    words = stored(word_counts(docs), "katz-words")
    if buckets is None:
        buckets = bucket_count(spark, words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    names = bucket_names(spark, buckets)
    stats = word_stats(words, buckets)
    heavy_words = dict(stats.heavy)
    heavy_words[int(START.view(np.int64))] = stats.texts
    heavy = np.sort(np.array(list(heavy_words), np.int64).view(np.uint64))
    table = pack(docs, heavy, names)
    pairs = spark.table(table)
    asked = stored(asks(pairs, heavy, least, buckets), "katz-asked")
    told = asked.where("part is null").groupBy("v", "r").agg(F.sum("n").alias("n")).collect()  # at most 6 rows for each of 4 * buckets + 2
    low = {r["r"]: r["n"] for r in told if r["v"] is None}
    d = good_turing(low, least)
    answered = stored(answers(asked, words, stats, heavy, buckets), "katz-answered")
    # Heavy first words: at most 4 * buckets + 1 rows.
    kept: dict[int, float] = {}
    for r in told:
        if r["v"] is not None:
            kept[r["v"]] = kept.get(r["v"], 0.0) + r["n"] * (r["r"] * float(d[r["r"]]) if r["r"] <= GOOD_TURING_TO else 1.0)
    likely = {r["v"]: r["p"] for r in answered.where("v is not null").groupBy("v").agg(F.sum("p").alias("p")).collect()}
    alpha, total_of = {}, {}
    for v in likely:
        a, t = _alpha(np.array([kept[v]]), np.array([likely[v]]), np.array([float(heavy_words[v])]))
        alpha[v], total_of[v] = float(a[0]), float(t[0])
    base = F.element_at(F.array(*[F.lit(int(x)) for x in names]), (F.shiftrightunsigned("word", 33) % buckets).cast("int") + 1)
    singles = words.where(~F.col("word").isin(list(stats.heavy))).select(base.alias("bucket"), F.col("word").alias("v"), "c", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("ps"))
    by_bucket = answered.where("v is null").select("bucket", F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("c"), "part", "ps")
    return Model(stats, words, by_bucket.unionByName(singles), alpha, total_of, d, least, buckets), table


def score(pairs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every packed document."""
    stats = model.stats
    heavy_c = dict(stats.heavy)
    start = int(START.view(np.int64))
    heavy = np.sort(np.array([*heavy_c, start], np.int64).view(np.uint64))
    heavy_counts = np.array([heavy_c.get(int(x), 0) for x in heavy.view(np.int64)], np.int64)
    heavy_alpha = np.array([model.heavy_alpha.get(int(x), 0.0) for x in heavy.view(np.int64)])
    heavy_total = np.array([model.heavy_total.get(int(x), 1.0) for x in heavy.view(np.int64)])
    discount, least, parts = model.discount, model.least, model.buckets
    end_count = np.array([stats.texts])
    end_known, end_base, end_log = int(stats.texts > 0), float(stats.log_base(end_count)[0]), float(stats.log_p(end_count)[0])

    def pair_key(v: np.ndarray, s: np.ndarray) -> np.ndarray:
        return kernel.mix(v ^ kernel.mix(s.astype(np.uint64)))

    def part(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "sums": pa.array([], pa.binary())})
        blocks_in = [unpack_block(x.as_py()) for x in asked.column("pairs")]
        v, s, c, _ = training_pairs(blocks_in, least)
        single = known.column("v").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        light, n_light = kernel.ints(known.column("v").combine_chunks())[single].view(np.uint64), kernel.ints(known.column("c").combine_chunks())[single]
        own = np.argsort(light)
        light, n_light = light[own], n_light[own]
        # p(w) of the second words, as answered part by part.
        told = sorted((part, x) for part, x in zip(known.column("part").to_pylist(), known.column("ps").to_pylist(), strict=True) if x is not None)
        seconds, p = by_part(s, parts), np.frombuffer(b"".join(x for _, x in told), "<f8")
        by_second = np.argsort(seconds)
        p = p[by_second][np.searchsorted(seconds[by_second], s)]
        kept = discounted(c, discount)
        at = np.minimum(np.searchsorted(light, v), max(0, len(light) - 1))
        is_light = light[at] == v if len(light) else np.zeros(len(v), bool)
        log_alpha, total = _alpha(np.bincount(at[is_light], weights=kept[is_light], minlength=len(light)), np.bincount(at[is_light], weights=p[is_light], minlength=len(light)), n_light)
        divisor = heavy_total[np.minimum(np.searchsorted(heavy, v), len(heavy) - 1)]
        if len(light):
            divisor = np.where(is_light, total[at], divisor)
        gain = np.log(kept / divisor) - np.log(p)
        # Words of the bucket, and the heavy ones.
        word = np.append(light, heavy)
        order = np.argsort(word)
        word, count, alpha = word[order], np.append(n_light, heavy_counts)[order], np.append(log_alpha, heavy_alpha)[order]
        key = pair_key(v, s)
        by_key = np.argsort(key)
        key, gain = key[by_key], gain[by_key]
        del v, s, c, kept, divisor, by_key
        blocks, sums = [], []
        for block, b in zip(asked.column("block").to_pylist(), blocks_in, strict=True):
            at = np.minimum(np.searchsorted(word, b.v), len(word) - 1)
            found = word[at] == b.v
            n = np.where(found, count[at], 0)
            back = np.where(found, alpha[at], 0.0)
            k = pair_key(b.v, b.s)
            place = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
            step = np.where(key[place] == k, gain[place], back) if len(key) else back
            token = b.v != START
            base = np.where(token, stats.log_base(n), 0.0)
            step = step + np.where(token, stats.log_p(n), 0.0)
            owner = b.doc
            spread = lambda x: np.bincount(owner, weights=np.repeat(x, b.times), minlength=len(b.train))  # noqa: B023, E731
            here = np.unique(owner)
            counts = np.stack([spread(token)[here], spread(token & (n > 0))[here]]).astype("<u4")
            header = np.array([len(b.train), len(b.begins), len(here)], "<i8")
            blocks.append(block)
            sums.append(b"".join([header.tobytes(), b.begins.astype("<u2").tobytes(), b.ids.tobytes(), b.missing.astype("u1").tobytes(), here.astype("<u2").tobytes(), counts.tobytes(), spread(base)[here].tobytes(), spread(step)[here].tobytes()]))
        return pa.table({"block": pa.array(blocks, pa.int64()), "sums": pa.array(sums, pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        ids = missing = total = None
        for raw in table.column("sums"):
            raw, at = raw.as_py(), 24

            def take(kind: str, n: int) -> np.ndarray:
                nonlocal at
                out = np.frombuffer(raw, kind, n, at)  # noqa: B023
                at += out.nbytes
                return out

            n_docs, n_first, n_here = np.frombuffer(raw, "<i8", 3).tolist()
            if total is None:
                ids, missing, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), np.zeros((4, n_docs))
            first = take("<u2", n_first)
            ids[first], missing[first] = take("<i8", n_first), take("u1", n_first).astype(bool)
            here = take("<u2", n_here)
            for k, kind in enumerate(("<u4", "<u4", "<f8", "<f8")):
                total[k, here] += take(kind, n_here)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=missing), "n_tokens": pa.array(total[0].astype(np.int64) + 1), "n_known": pa.array(total[1].astype(np.int64) + end_known),
                "base_score": pa.array((total[2] + end_base) / LOG10), "score": pa.array((total[3] + end_log) / LOG10),
            }
        )

    by_block = pairs.groupBy("bucket").cogroup(model.known.groupBy("bucket")).applyInArrow(part, "block long, sums binary")
    return by_block.groupBy("block").applyInArrow(whole, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def katz_scores(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_out_fold: int = 1, least_pair: int = 1) -> DataFrame:
    """Train on the rows outside the held-out fold and score every row; pairs counted below ``least_pair`` are cut off (1: none).

    The scores are stored, and the table of pairs leaves the catalogue again.
    """
    spark = documents.sparkSession
    own = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    model, table = train(own.withColumn("held_out", held), least_pair)
    scores = score(spark.table(table), model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.stats.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    out = stored(scores, "katz-scores")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return out


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
