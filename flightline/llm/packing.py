"""Packing documents into training sequences by a configuration linear program.

A document's ids are its token ids and then the end id; only longer ones than a sequence are cut.
How many pieces have each length is all that the packing needs to know: at most ``capacity``
numbers, however large the corpus.  The program has a variable for each configuration (how many
pieces of each length share a sequence) and asks for the fewest sequences that hold all pieces.  It
is solved by multiplicative weights: lengths that are behind in being covered get dearer, and a
knapsack dynamic program over the capacity prices the best configurations.  Rounding takes whole
configurations while their pieces last and packs what is left by best fit decreasing, again on
counts; a plan that best fit decreasing alone would better is dropped for it.  Pieces then take the slots of their length in order of their rank among pieces of that
length, which is counted in buckets, so no length, however frequent, meets in one task.

Defined cases: null is the empty text, a piece of just the end id.  Rows with equal ids are packed
each by itself; a null id is passed on.  An empty table gives an empty result.  Further columns are
ignored.  A very long text is tokenised whole and cut into pieces.  Ties: pieces of equal length are taken in
any order, as all orders need as many sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .chunks import PieceTable
from .storage import stored

#: Buckets in which the pieces of one length are ranked; the table of their offsets has at most ``capacity * BUCKETS`` rows.
BUCKETS = 64


_tables: dict[str, tuple] = {}


def _table(path: str):
    if path not in _tables:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)

        def encode(words: list[bytes]) -> list[list[int]]:
            return [e.ids for e in library.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]

        _tables[path] = PieceTable(encode, np.uint32)
    return _tables[path]


def pieces_of(documents: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece.

    For tokenizers that drop white space before they split, as a text's ids are then those of its
    words on end.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def scan(batches):
        table = _table(tokenizer_path)
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                words = kernel.split_words(texts)
                at, size = table.look_up(words.data, words.start, words.end, kernel.word_hashes(words))
                flat = table.gather(at, size)
                per_doc = np.bincount(words.doc, weights=size, minlength=len(texts)).astype(np.int64) + 1
                ids = np.full(int(per_doc.sum()), end_id, "<u4")
                ids[np.arange(len(flat)) + np.repeat(words.doc, size)] = flat
                first = np.cumsum(per_doc) - per_doc
                n = -(-per_doc // capacity)
                owner = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(per_doc[owner] - start, capacity)
                raw, begin = memoryview(ids.tobytes()), (first[owner] + start) * 4
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(begin.tolist(), (length * 4).tolist(), strict=True)]
                doc_id = batch.column(0).slice(texts.first_row, len(texts)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=schema)

    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return docs.mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the greatest weight of lengths that fit each capacity, and the length taken last (0: none).

    ``weights[l]`` is that of length ``l`` (index 0 unused; a negative weight bars the length).
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        with_last = weights[1 : c + 1] + best[c - 1 :: -1]
        k = int(with_last.argmax())
        if with_last[k] > best[c - 1] + 1e-12:
            best[c], last[c] = with_last[k], k + 1
        else:
            best[c], last[c] = best[c - 1], 0
    return best, last


def _filled(room: int, last: np.ndarray) -> Counter:
    """The configuration the knapsack found for ``room``."""
    found: Counter = Counter()
    while room > 0:
        if last[room]:
            found[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return found


def solve(demand: np.ndarray, capacity: int, *, rounds: int = 40, step: float = 0.25, slack: float = 0.002) -> dict[tuple[tuple[int, int], ...], float]:
    """Multiplicative weights for the configuration program: configurations and how often to use each.

    ``demand[l]`` pieces have length ``l``.  In each round the knapsack is solved once; every
    configuration that it gives with some length forced in, and that is worth within ``slack`` of
    the best, is used until one of its lengths has been covered by ``step`` more of its demand.
    """
    present = np.flatnonzero(demand)
    if not len(present):
        return {}
    weights = np.full(capacity + 1, -1.0)
    weights[present] = present / capacity
    cover = np.zeros(capacity + 1)
    use: dict[tuple[tuple[int, int], ...], float] = {}
    for round_ in range(rounds):
        target = min(1.0, (round_ + 1) * step)
        best, last = price(weights, capacity)
        for length in present[::-1]:
            if cover[length] >= target or weights[length] + best[capacity - length] < (1 - slack) * best[capacity]:
                continue
            found = _filled(capacity - int(length), last)
            found[int(length)] += 1
            amount = min((target - cover[k]) * demand[k] / n if cover[k] < target else step * demand[k] / n / 8 for k, n in found.items())
            key = tuple(sorted(found.items()))
            use[key] = use.get(key, 0.0) + amount
            for k, n in found.items():
                cover[k] += amount * n / demand[k]
        if cover[present].min() >= 1:
            break
        behind = np.maximum(0, cover[present] - target)
        weights[present] = present / capacity * np.exp(-0.02 * behind - 0.02 * (cover[present] - cover[present].min()))
    return use


def best_fit(left: Counter, capacity: int) -> Counter:
    """Best fit decreasing: configurations and how many sequences have each.

    Open sequences with the same content are one group with a count.  Placing a piece leaves the
    sequence with a smaller room, so while it still fits it is the best fit for the next piece of
    that length: each sequence of the best group takes as many as it can, and a whole group is
    handled at once.  Work follows the number of lengths, not of pieces.
    """
    import bisect

    groups: dict[int, list[list]] = {}  # room -> [content, sequences] with that room
    rooms: list[int] = []
    done: Counter = Counter()

    def put(room: int, content: tuple, sequences: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append([content, sequences])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                content, sequences = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, content, sequences = capacity, (), n
            each = room // length
            whole = min(sequences, n // each)
            if whole:
                put(room - each * length, (*content, (length, each)), whole)
            over = min(n - whole * each, each - 1) if whole < sequences else 0
            if over:
                put(room - over * length, (*content, (length, over)), 1)
            n -= whole * each + over
            untouched = sequences - whole - (over > 0)
            if content and untouched:
                put(room, content, untouched)
    for own in groups.values():
        for content, sequences in own:
            done[tuple(sorted(content))] += sequences
    return done


def _take(chosen: Counter, left: np.ndarray, config: tuple[tuple[int, int], ...], most: int) -> int:
    """Use ``config`` up to ``most`` times while its pieces last; how often it was used."""
    whole = min(most, *(int(left[k]) // n for k, n in config))
    if whole > 0:
        chosen[config] += whole
        for k, n in config:
            left[k] -= whole * n
    return max(whole, 0)


def _rest(left: np.ndarray, capacity: int) -> Counter:
    return best_fit(Counter({int(k): int(left[k]) for k in np.flatnonzero(left)}), capacity)


def _rounded(demand: np.ndarray, use: dict, capacity: int, nearly_full: bool) -> Counter:
    """Whole configurations of the program's solution, then those of the remainder's own program, then best fit.

    ``nearly_full`` takes only configurations that leave next to nothing over, and what rounding left
    goes into exactly full ones at the knapsack's plain prices while that helps.
    """
    left, chosen = demand.copy(), Counter()
    waste = 1 + capacity // 512 if nearly_full else capacity
    for config, amount in sorted(use.items(), key=lambda x: (-x[1], x[0])):
        if capacity - sum(k * n for k, n in config) <= waste:
            _take(chosen, left, config, int(np.ceil(amount)) if nearly_full else int(amount))
    if not nearly_full:
        if left.any():
            for config, amount in sorted(solve(left, capacity, rounds=12).items(), key=lambda x: (-x[1], x[0])):
                _take(chosen, left, config, int(amount))
        return chosen + _rest(left, capacity)
    for _ in range(200):
        weights = np.full(capacity + 1, -1.0)
        present = np.flatnonzero(left)
        if len(present) < 2:
            break
        weights[present] = present / capacity
        _, last = price(weights, capacity)
        taken = 0
        for length in present[::-1]:
            found = _filled(capacity - int(length), last)
            found[int(length)] += 1
            if sum(k * n for k, n in found.items()) == capacity:
                taken += _take(chosen, left, tuple(sorted(found.items())), int(left.sum()))
        if taken * 200 < left.sum() or not taken:
            break
    return chosen + _rest(left, capacity)


def plan(counts: dict[int, int], capacity: int) -> Counter:
    """Configurations (sorted ``(length, pieces)`` pairs) and how many sequences have each; every piece is in one.

    The program's solution is rounded in two ways; best fit decreasing on all pieces is the third
    plan, so the result is never worse than it.  All three work on counts of lengths.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        demand[length] = n
    if not demand.any():
        return Counter()
    use = solve(demand, capacity)
    plans = [_rounded(demand, use, capacity, True), _rounded(demand, use, capacity, False), _rest(demand, capacity)]
    return min(plans, key=lambda p: sum(p.values()))


def slots(chosen: Counter) -> dict[str, np.ndarray]:
    """For each length, blocks of slots: rank of the first, sequences, copies in each, offset.  Sequences are numbered from 0."""
    filled: Counter = Counter()
    rows = []
    sequence = 0
    for config in sorted(chosen):
        offset = 0
        for length, copies in reversed(config):
            rows.append((length, filled[length], sequence, copies, offset))
            filled[length] += copies * chosen[config]
            offset += length * copies
        sequence += chosen[config]
    rows.sort()
    names = ("length", "first_rank", "sequence", "copies", "offset")
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {name: table[:, k] for k, name in enumerate(names)}


def ranked(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add ``rank``: 0, 1, ... among the pieces of each length."""
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    # At most capacity * buckets rows, whatever the corpus.
    return bucketed.withColumn("inside", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", (F.col("inside") + F.col("before")).cast("long")).drop("bucket", "inside", "before")


def pack(documents: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = documents.sparkSession
    pieces = stored(pieces_of(documents, tokenizer_path, capacity=capacity, end_id=end_id, id_column=id_column, text_column=text_column), "packing-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        held = table.value
        order = held["length"] * (1 << 48) + held["first_rank"]
        for batch in batches:
            length, rank = (kernel.ints(batch.column(c)) for c in ("length", "rank"))
            block = np.searchsorted(order, length * (1 << 48) + rank, "right") - 1
            inside = rank - held["first_rank"][block] if len(block) else rank
            copies = held["copies"][block]
            sequence = held["sequence"][block] + inside // copies
            offset = held["offset"][block] + inside % copies * length
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked(pieces).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
