"""Removal of passages that an earlier document has, located with sharded Aho-Corasick automata.

A window is ``window`` (13) words on end.  Each word is removed that lies in a window which also
begins in a document with a smaller id; windows are those of the input.

1. Anchors.  The anchor of a window is the least hash among its 6-word sequences, so equal windows
   have equal anchors, and a text has an anchor for every four or five words.  Anchors that lie in
   two different texts at least are kept, as a bitmap of bounded size.  (Copies of a whole text are
   told by its hash: of equal texts, all but the first lose every word that lies in a window.)
2. Regions.  Each run of windows with one kept anchor is a region: its words, and where it begins in
   its document.  Equal regions are one from here on, however many documents hold them.
3. Confirmed passages.  Windows of regions, word for word, that lie in two different texts, with
   the least id.
4. Automata.  Confirmed passages and regions are dealt to shards by their anchor, so a passage and all
   its occurrences meet.  Each shard compiles its passages into an automaton (pyahocorasick, over
   sequences of words numbered by a dictionary of the shard) and streams all its regions through it,
   a bounded number at a time.  What comes out is every occurrence of every passage; nothing else
   decides.
5. Occurrences go back to the documents that hold the region, and each text is cut once.

A shard holds about ``SHARD_WINDOWS`` passages and ``SHARD_REGIONS`` regions; the number of shards grows
with the corpus.  Shards are small because a state of the automaton looks through its successors
one by one, and the first has one for every first word.  An anchor with more than ``BUSY_REGIONS``
different regions has these taken apart into windows, which are dealt by anchor and window, each
passage to the one shard of its window; a window in more than ``BUSY_REGIONS`` regions is dealt by region
too, and its passage goes to each of those shards.  Either way the rows made follow the input.

Defined cases: null is the empty text; a text of fewer than ``window`` words loses nothing.  Rows
with equal ids are one document each, neither before the other; a null id counts like the largest
long.  An empty table gives an empty result; further columns are ignored.
A very long text is a slice of its own in the scans and is cut whole.  Ties: of rows with the least id of a
window each keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .bitmap import build_bitmap, held, parted
from .storage import free_name, stored

WINDOW, ANCHOR = 13, 6
SPREAD = WINDOW - ANCHOR + 1
MOST_BITS = 1 << 28
SHARD_WINDOWS, SHARD_REGIONS, BUSY_REGIONS = 1_500, 3_000, 3_000
#: Words that are put together, and bytes that are taken apart or streamed, at a time (or one region that is longer), and windows cut out at a time.
CHUNK_WORDS, CHUNK_BYTES, CHUNK_WINDOWS = 100_000, 1 << 19, 1 << 15
#: Tables of busy anchors and windows are broadcast up to this many rows.
BROADCAST_ROWS = 1_000_000
LAST_ID = np.iinfo(np.int64).max


def text_hashes(texts: kernel.Texts) -> np.ndarray:
    return kernel.span_hashes(texts.data, texts.offsets[:-1], texts.offsets[1:])


def anchors(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window and the index of the window's first word."""
    grams, _ = kernel.window_hashes(hashes, np.zeros(len(hashes), np.int64), ANCHOR)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = grams
    width = 1
    while width < SPREAD:
        step = min(width, SPREAD - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    return least[:n][at], at


def _runs(anchor: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of each run of neighbouring windows of one document with one anchor."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at))


def recurring_anchors(documents: DataFrame) -> DataFrame:
    """Anchors (longs) that lie in at least two different texts of ``(doc_id, text)``."""

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                words = kernel.split_words(texts)
                anchor, at = anchors(kernel.word_hashes(words), words.doc)
                first, _ = _runs(anchor, at, words.doc)
                own = text_hashes(texts).view(np.int64)[words.doc[at[first]]]
                order = np.lexsort((own, anchor[first]))
                a, t = anchor[first][order], own[order]
                new = np.ones(len(a), bool)
                new[1:] = a[1:] != a[:-1]
                start = np.flatnonzero(new)
                if len(start):
                    stop = np.append(start[1:], len(a)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(a[start].view(np.int64)), pa.array(t[start]), pa.array(t[stop])], ["anchor", "low", "high"])

    seen = documents.mapInArrow(scan, "anchor long, low long, high long")
    return seen.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("anchor")


def _lots(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most`` or less, or a single one that is larger."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _spelled(words: kernel.Words, pick: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of ``size`` of the picked words, each word with a blank after it, as one binary value a run."""
    start, length = words.start[pick], (words.end - words.start)[pick]
    place = np.cumsum(length + 1) - length - 1
    data = np.full(int(length.sum() + len(length)), 32, np.uint8)
    inside = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    data[inside] = words.data[inside + np.repeat(start - place, length)]
    offsets = np.append(place[np.cumsum(size) - size], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string column, and where each value begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def regions_of(documents: DataFrame, bitmap) -> DataFrame:
    """``anchor, region, words, doc_id, text_hash, at``; and for each document a row with a null anchor.

    ``words`` are the region's words, each with a blank after it, ``region`` is their hash, ``at`` the place of the
    first.  In a document's row ``region`` is a second hash of the whole text.
    """
    schema = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("words", pa.string()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32())])

    def scan(batches):
        cells = bitmap.value
        for batch in batches:
            ids = kernel.ints(batch.column(0))
            for texts in kernel.text_slices(batch.column(1), limit=1 << 20):
                own = text_hashes(texts).view(np.int64)
                mine = ids[texts.first_row : texts.first_row + len(texts)]
                raw, ends = memoryview(texts.data), texts.offsets.tolist()
                second = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                none = pa.nulls(len(texts))
                yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(second, pa.int64()), none.cast(pa.string()), pa.array(mine), pa.array(own), none.cast(pa.int32())], schema=schema)
                words = kernel.split_words(texts)
                anchor, at = anchors(kernel.word_hashes(words), words.doc)
                first, stop = _runs(anchor, at, words.doc)
                keep = held(cells, anchor[first].view(np.int64))
                first, stop = first[keep], stop[keep]
                bounds = words.firsts()
                for a, b in _lots(stop - first + WINDOW - 1, CHUNK_WORDS):
                    low, size = at[first[a:b]], (stop - first)[a:b] + WINDOW - 1
                    inside = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                    spelled = _spelled(words, inside, size)
                    data, offsets = _data(spelled)
                    doc = words.doc[low]
                    columns = [pa.array(anchor[first[a:b]].view(np.int64)), pa.array(kernel.span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)), spelled.cast(pa.string()), pa.array(mine[doc]), pa.array(own[doc]), pa.array((low - bounds[doc]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return documents.mapInArrow(scan, "anchor long, region long, words string, doc_id long, text_hash long, at int")


def windows_of(regions: DataFrame) -> DataFrame:
    """The windows of regions: ``anchor, region, place, words, least, low, high``."""
    schema = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("place", pa.int32()), ("words", pa.string()), ("least", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def scan(batches):
        for whole in batches:
            _, ends = _data(whole.column("words"))
            for first, last in _lots(np.diff(ends), CHUNK_BYTES):
                batch = whole.slice(first, last - first)
                data, offsets = _data(batch.column("words"))
                blank = np.flatnonzero(data == 32)
                start = np.append(0, blank[:-1] + 1)
                owner = np.searchsorted(offsets, start, "right") - 1
                every = np.flatnonzero(owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1 :]) if len(owner) >= WINDOW else np.zeros(0, np.int64)
                begins = np.searchsorted(owner, np.arange(batch.num_rows))
                for k in range(0, len(every), CHUNK_WINDOWS):
                    at = every[k : k + CHUNK_WINDOWS]
                    low, high = start[at], blank[at + WINDOW - 1] + 1
                    size = high - low
                    stop = np.cumsum(size)
                    copied = data[np.repeat(low - stop + size, size) + np.arange(int(size.sum()))]
                    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, stop).astype(np.int32)), pa.py_buffer(copied)]).cast(pa.string())
                    place, take = at - begins[owner[at]], pa.array(owner[at])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("anchor", "region")), pa.array(place.astype(np.int32)), words, *(batch.column(c).take(take) for c in ("least", "low", "high"))], schema=schema)

    return regions.select("anchor", "region", "words", "least", "low", "high").mapInArrow(scan, "anchor long, region long, place int, words string, least long, low long, high long")


def confirmed_passages(regions: DataFrame) -> DataFrame:
    """``anchor, words, least, times``: windows of distinct regions that lie in two different texts, their least document, and how many regions have them."""
    rows = windows_of(regions).groupBy("anchor", "words").agg(F.min("least").alias("least"), F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("times"))
    return rows.where("low <> high").select("anchor", "words", "least", "times")


class Shard:
    """An automaton of confirmed passages, through which regions are streamed."""

    def __init__(self, passages: pa.Array, least: np.ndarray):
        import ahocorasick

        words, _ = self._words(passages)
        self.vocabulary = words.unique()
        self.least = least
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        codes = self._codes(words).reshape(-1, WINDOW).tolist()
        for number, sequence in enumerate(codes):
            self.automaton.add_word(tuple(sequence), number)
        self.automaton.make_automaton()

    @staticmethod
    def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words (each with its blank) of all values on end, and the number of words of each value."""
        data, offsets = _data(column)
        blank = np.flatnonzero(data == 32)
        bounds = np.append(0, blank + 1)
        words = pa.Array.from_buffers(pa.large_binary(), len(blank), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return words, np.diff(np.searchsorted(blank, offsets))

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Numbers of words in the shard's dictionary; 0 for words that no passage has."""
        return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def find(self, regions: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of the passages: region, place of the first word in it, least document."""
        words, size = self._words(regions)
        spaced = np.zeros(len(words) + len(size), np.int64)  # a 0 after each region
        start = np.cumsum(size + 1) - size - 1
        spaced[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = self._codes(words)
        found = list(self.automaton.iter(tuple(spaced.tolist())))
        end = np.fromiter((e for e, _ in found), np.int64, len(found))
        number = np.fromiter((n for _, n in found), np.int64, len(found))
        region = np.searchsorted(start, end, "right") - 1
        return region, end - WINDOW + 1 - start[region], self.least[number]


def _small(table: DataFrame) -> DataFrame:
    """Broadcast a stored table if it is small enough; else it is joined by exchange."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def occurrences(regions: DataFrame, passages: DataFrame) -> DataFrame:
    """``anchor, region, places array<int>, least array<long>``: where in each region a passage begins, by sharded automata."""
    n_windows, n_regions = passages.count(), regions.count()
    shards = max(1, -(-n_windows // SHARD_WINDOWS), -(-n_regions // SHARD_REGIONS))
    # Busy anchors: windows are dealt, 8 to a region at most on average; busy windows by region too.
    busy = stored(regions.groupBy("anchor").count().where(F.col("count") > BUSY_REGIONS).select("anchor", F.ceil(8 * F.col("count") / BUSY_REGIONS).cast("int").alias("salts")), "repeats-busy")
    hot = stored(passages.where(F.col("times") > BUSY_REGIONS).join(_small(busy), "anchor", "left_semi").select("anchor", "words", F.ceil(F.col("times") / BUSY_REGIONS).cast("int").alias("parts")), "repeats-hot")
    busy, hot = _small(busy), _small(hot)
    nothing = F.lit(None)
    by_window = F.pmod(F.xxhash64("words"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = passages.join(busy, "anchor", "left").join(hot, ["anchor", "words"], "left")
    compiled = dealt.select("anchor", by_window.alias("salt"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), nothing.cast("long").alias("region"), nothing.cast("int").alias("place"), "least", "words")
    plain = regions.join(busy, "anchor", "left_anti").select("anchor", F.lit(0).alias("salt"), F.lit(0).alias("part"), F.lit(1).alias("kind"), "region", F.lit(0).alias("place"), nothing.cast("long").alias("least"), "words")
    apart = windows_of(regions.join(busy, "anchor", "left_semi")).join(busy, "anchor").join(hot, ["anchor", "words"], "left")
    pieces = apart.select("anchor", by_window.alias("salt"), F.pmod("region", F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("kind"), "region", "place", nothing.cast("long").alias("least"), "words")
    rows = compiled.unionByName(plain).unionByName(pieces).withColumn("shard", F.pmod(F.xxhash64("anchor", "salt", "part"), F.lit(shards)).cast("int")).select("shard", "kind", "anchor", "region", "place", "least", "words")

    def search(batches):
        current, compiled, shard = None, [], None

        def stream(part):
            region, place, low = shard.find(part.column("words"))
            order = np.argsort(region, kind="stable")
            region, place, low = region[order], place[order], low[order]
            distinct, n = np.unique(region, return_counts=True)
            place += kernel.ints(part.column("place"))[region]
            offsets, take = pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(distinct)
            columns = [part.column("anchor").take(take), part.column("region").take(take), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(low))]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "region", "places", "least"])

        for batch in batches:
            number = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(number)).tolist(), strict=True):
                if a == b:
                    continue
                if number[a] != current:
                    current, compiled, shard = number[a], [], None
                part = batch.slice(a, b - a)
                split = int(np.searchsorted(part.column(1).to_numpy(), 1))  # passages come first
                if split:
                    compiled.append(part.slice(0, split))
                if split < part.num_rows and compiled:
                    if shard is None:
                        table = pa.Table.from_batches(compiled).combine_chunks()
                        shard = Shard(table.column("words").chunk(0), kernel.ints(table.column("least").chunk(0)))
                    regions_ = part.slice(split)
                    _, ends = _data(regions_.column("words"))
                    for first, last in _lots(np.diff(ends), CHUNK_BYTES):
                        yield stream(regions_.slice(first, last - first))

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(search, "anchor long, region long, places array<int>, least array<long>")


def kept_texts(words: kernel.Words, keep: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Kept words of each text on end, joined by blanks, and where each text begins (and the last ends, each with a blank after it)."""
    start, length = words.start[keep], (words.end - words.start)[keep]
    place = np.cumsum(length + 1) - length - 1
    total = int(length.sum() + len(length))
    joined = np.full(total, 32, np.uint8)
    shift = np.repeat(start - place, length)
    inside = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    joined[inside] = words.data[inside + shift]
    size = np.bincount(words.doc[keep], weights=length + 1, minlength=len(words.texts)).astype(np.int64)
    return memoryview(joined.tobytes()), np.concatenate([[0], np.cumsum(size)])


def removals(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, whole, starts``: rows that lose words, as copies of an earlier text (``whole``) or by windows that begin at ``starts``."""
    spark = documents.sparkSession
    recurring = stored(recurring_anchors(documents), "repeats-anchors")
    bits = 1 << 20
    while bits < MOST_BITS and bits < 32 * recurring.count():
        bits *= 2
    bitmap = spark.sparkContext.broadcast(build_bitmap(recurring, bits))
    table = stored(regions_of(documents, bitmap), "repeats-regions")
    held_regions = table.where("anchor is not null")
    distinct = stored(held_regions.groupBy("anchor", "region", "words").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high")), "repeats-distinct")
    passages = stored(confirmed_passages(distinct), "repeats-passages")
    found = stored(occurrences(distinct, passages), "repeats-found")
    met = held_regions.select("anchor", "region", "doc_id", "text_hash", "at").join(found, ["anchor", "region"])
    later = F.transform(F.filter(F.arrays_zip("places", "least"), lambda x: x["least"] < F.col("doc_id")), lambda x: x["places"] + F.col("at"))
    windows = met.select("doc_id", "text_hash", later.alias("starts")).where(F.size("starts") > 0).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    texts = table.where("anchor is null").select("doc_id", "text_hash", F.col("region").alias("second"))
    # Stored, so that both sides of the join below are plain exchanges and a text with very many copies can be split.
    first = stored(texts.groupBy("text_hash", "second").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "repeats-copies")
    copies = texts.join(first, ["text_hash", "second"]).where("doc_id > first").select("doc_id", "text_hash").distinct().withColumn("whole", F.lit(True))
    return windows.join(copies, ["doc_id", "text_hash"], "full").select("doc_id", "text_hash", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")


def deduplicate(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document, and ``with_text`` ``kept``, the kept words joined by blanks."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(documents[id_column].cast("long"), F.lit(int(LAST_ID))).alias("doc_id"), documents[text_column].alias("text"), documents[id_column].cast("long").alias("given"))
    work = stored(removals(docs.select("doc_id", "text")), "repeats-removals")
    # Most documents lose nothing; a bitmap of the others' ids spares them the exchange.
    touched = spark.sparkContext.broadcast(build_bitmap(work.select(F.xxhash64("doc_id").alias("key")), 1 << 24))
    keyed = docs.withColumn("key", F.xxhash64("doc_id"))

    def result(ids, words, gone):
        raw, bounds = kept_texts(words, np.flatnonzero(~gone))
        n, removed = words.counts(), np.bincount(words.doc[gone], minlength=len(words.texts))
        kept = [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [ids, pa.array(n), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        if with_text:
            columns.append(pa.array([k.tobytes() for k in kept], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    def untouched(batches):
        for batch in batches:
            part = batch.filter(pa.array(~held(touched.value, kernel.ints(batch.column("key")))))
            for texts in kernel.text_slices(part.column("text")):
                words = kernel.split_words(texts)
                yield result(part.column("given").slice(texts.first_row, len(texts)), words, np.zeros(len(words.start), bool))

    def maybe(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("given", pa.int64()), ("text_hash", pa.int64())])
        for batch in batches:
            part = batch.filter(pa.array(held(touched.value, kernel.ints(batch.column("key")))))
            for texts in kernel.text_slices(part.column("text")):
                rows = part.slice(texts.first_row, len(texts))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text").cast(pa.string()), rows.column("given"), pa.array(text_hashes(texts).view(np.int64))], schema=schema)

    def cut(batches):
        for batch in batches:
            starts, whole = batch.column("starts"), batch.column("whole").to_pylist()
            for texts in kernel.text_slices(batch.column("text")):
                words = kernel.split_words(texts)
                gone = np.zeros(len(words.start), bool)
                bounds = words.firsts()
                for k in range(len(texts)):
                    row, own = texts.first_row + k, slice(int(bounds[k]), int(bounds[k + 1]))
                    n = own.stop - own.start
                    if whole[row]:
                        gone[own] = n >= WINDOW
                    elif starts[row].is_valid:
                        gone[own] = kernel.covered(starts[row].values.to_numpy().astype(np.int64), WINDOW, n)
                yield result(batch.column("given").slice(texts.first_row, len(texts)), words, gone)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    lost = keyed.mapInArrow(maybe, "doc_id long, text string, given long, text_hash long").join(work, ["doc_id", "text_hash"], "left").select("given", "text", "starts", "whole")
    return keyed.mapInArrow(untouched, schema).unionByName(lost.mapInArrow(cut, schema))


def remove_repeats(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with their columns; texts that lose words become their kept words, joined by blanks, the others stay as they are."""
    docs = documents.select(F.coalesce(documents[id_column].cast("long"), F.lit(int(LAST_ID))).alias("doc_id"), documents[text_column].alias("text"))
    own_key, own, key, whole_name, starts_name = (free_name(documents, f"_repeats_{c}") for c in ("key", "id", "hash", "whole", "starts"))
    work = stored(removals(docs), "repeats-removals").select(F.col("doc_id").alias(own), F.col("text_hash").alias(key), F.col("whole").alias(whole_name), F.col("starts").alias(starts_name))
    names = documents.columns
    at_text = names.index(text_column)

    def keyed(batches):
        for batch in batches:
            hashes = [text_hashes(texts).view(np.int64) for texts in kernel.text_slices(batch.column(at_text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], [*names, own_key])

    def cut(batches):
        for batch in batches:
            whole, starts = batch.column(whole_name).to_pylist(), batch.column(starts_name)
            out = batch.column(at_text).to_pylist()
            for texts in kernel.text_slices(batch.column(at_text)):
                rows = [k for k in range(len(texts)) if whole[texts.first_row + k] is not None]
                if not rows:
                    continue
                words = kernel.split_words(texts)
                bounds = words.firsts()
                gone = np.zeros(len(words.start), bool)
                for k in rows:
                    row, own = texts.first_row + k, slice(int(bounds[k]), int(bounds[k + 1]))
                    n = own.stop - own.start
                    gone[own] = n >= WINDOW if whole[row] else kernel.covered(starts[row].values.to_numpy().astype(np.int64), WINDOW, n)
                raw, places = kept_texts(words, np.flatnonzero(~gone))
                for k in rows:
                    if gone[bounds[k] : bounds[k + 1]].any():
                        out[texts.first_row + k] = str(raw[places[k] : max(places[k], places[k + 1] - 1)], "utf-8")
            columns = [batch.column(c) for c in range(len(names))]
            columns[at_text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    # Most documents lose nothing and stay out of the exchange.
    last = int(LAST_ID)
    losing = work.select(F.when(F.col(own) != last, F.col(own)).alias("doc_id")).distinct()
    untouched, touched = parted(documents, id_column, losing)
    with_key = touched.mapInArrow(keyed, T.StructType([*documents.schema.fields, T.StructField(own_key, T.LongType())]))
    own_id = F.coalesce(with_key[id_column].cast("long"), F.lit(int(LAST_ID)))
    joined = with_key.join(work, (own_id == F.col(own)) & (F.col(own_key) == F.col(key)), "left")
    return untouched.unionByName(joined.mapInArrow(cut, documents.schema))


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 12) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), least AS (
  SELECT g, min(doc_id) AS low FROM win GROUP BY g
), hit AS (
  SELECT win.doc_id, win.i FROM win JOIN least USING (g) WHERE low < win.doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(0, 13)) AS k)
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.i) AS t, count(*) AS n FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY 1
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
