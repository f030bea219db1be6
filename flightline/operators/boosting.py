"""Histogram boosting of many heads at once, with missing values routed by what they gain.

A head is one label against the rest, over the rows that it may see: twelve classes times five folds are
sixty heads, grown together.  Features are binned once (a byte each; missing is a bin of its own), and
every level of every head's tree is one pass: tasks sum gradients, Hessians and rows of each (head,
feature, node, bin), the sums of a feature are added and its best split found in one group, and the driver
sees the best split of each node of each head.  A split tries the missing bin on both sides.

Sums are of whole numbers (gradients in units of 2**-24), so trees do not depend on how rows are dealt.
Margins are written to a table every few rounds; in between tasks go through the trees since.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.sources.scratch import stored

MISSING = 255
UNIT = float(1 << 24)
#: A row and its Hessian (2**22 units at most) are summed as one number, exact for so many rows together: 2**14 * (2**38 + 2**22) < 2**53.
ROW, TOGETHER = float(1 << 38), 1 << 14


@dataclass(frozen=True)
class Settings:
    """``bin_rows``: rows (those with the least hashes of their ids) whose quantiles are the bins' edges; all rows are learned from."""

    rounds: int = 20
    depth: int = 4
    rate: float = 0.2
    penalty: float = 1.0
    bins: int = 64
    least_rows: int = 20
    bin_rows: int = 20_000
    refresh: int = 10


@dataclass
class Trees:
    """One tree of each head: for each node the feature (-1: none, all go left), the last bin that goes left, whether missing does; and the leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, head: int, level: int) -> np.ndarray:
        """The node of each row at a level, 0 ... 2**level - 1."""
        return self.router(head, level)(bins)

    def router(self, head: int, level: int) -> Callable[[np.ndarray], np.ndarray]:
        """:meth:`nodes` of any number of batches.

        Up to level 4 what all inner nodes say of a feature's bin is read at once, a bit for each node, and the bits
        name the node at the level; deeper trees are gone down.
        """
        if level > 4:
            return lambda bins: self._descended(bins, head, level)
        missed, tables, arrived = self._missed(head, level), list(self._tables(head, level)), _node_of(level)

        def route(bins: np.ndarray) -> np.ndarray:
            said = np.full(len(bins), missed, np.uint16)
            for f, table in tables:
                said |= table[bins[:, f]]
            return arrived[said]

        return route

    def _descended(self, bins: np.ndarray, head: int, level: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for k in range(level):
            node = (1 << k) - 1 + at
            f = self.feature[head, node]
            b = bins[rows, np.maximum(f, 0)]
            goes_left = (f < 0) | np.where(b == MISSING, self.left[head, node], b <= self.cut[head, node])
            at = 2 * at + ~goes_left
        return at

    def _missed(self, head: int, level: int) -> int:
        """Bits of the nodes without a feature, where all rows go left."""
        return sum(1 << node for node in range((1 << level) - 1) if self.feature[head, node] < 0)

    def _tables(self, head: int, level: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each feature that nodes ask for, and for each bin the bits of the nodes that send it left."""
        asked = self.feature[head, : (1 << level) - 1]
        bins = np.arange(256)
        for f in np.unique(asked[asked >= 0]):
            table = np.zeros(256, np.uint16)
            for node in np.flatnonzero(asked == f):
                goes_left = np.where(bins == MISSING, self.left[head, node], bins <= self.cut[head, node])
                table |= goes_left.astype(np.uint16) << np.uint16(node)
            yield int(f), table


@cache
def _node_of(level: int) -> np.ndarray:
    """For each pattern of the bits of all inner nodes above ``level``: the node at which a row arrives."""
    bits = np.arange(1 << ((1 << level) - 1))
    at = np.zeros(len(bits), np.int64)
    for k in range(level):
        at = 2 * at + (1 - (bits >> ((1 << k) - 1 + at) & 1))
    return at


@dataclass
class Boosted:
    features: list[str]
    heads: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    depth: int
    trees: list[Trees] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, values[:, j], "left")
        out[np.isnan(values)] = MISSING
        return out

    def adder(self, trees: list[Trees]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of margins (changed in place) and bins that adds what ``trees`` say, for any number of batches."""
        parts = [(head, tree.value[head], tree.router(head, self.depth)) for tree in trees for head in range(len(self.heads))]

        def add(margins: np.ndarray, bins: np.ndarray) -> np.ndarray:
            for head, value, route in parts:
                margins[:, head] += value[route(bins)]
            return margins

        return add


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1)


def _bytes(column: pa.Array, width: int, kind) -> np.ndarray:
    """Values of one width, none null, as rows of a matrix over the column's own buffer."""
    column = column.cast(pa.large_binary())
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", kind, len(column) * width, begin).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(rows))])


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    known = np.unique(values[~np.isnan(values)])
    if len(known) <= bins:
        return (known[:-1] + known[1:]) / 2
    return np.unique(np.quantile(values[~np.isnan(values)], np.arange(1, bins) / bins, method="lower"))


def fit(rows: DataFrame, row_id: str, features: list[str], heads: dict[str, tuple[Column, Column | None]], settings: Settings = Settings()) -> Boosted:
    """Grow all ``heads``: name to (label, 1 or not; which rows to learn from, all if None). NULL and NaN features are missing."""
    s, names = settings, list(heads)
    if not 1 < s.bins < MISSING:
        raise ValueError("bins must be between 2 and 254")
    asked = rows.select(F.col(row_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in features], *[F.when(F.lit(True) if seen is None else F.coalesce(seen, F.lit(False)), F.coalesce((label == 1).cast("int"), F.lit(0))).otherwise(2).alias(f"_head{k}") for k, (label, seen) in enumerate(heads.values())])
    drawn = asked.orderBy(F.xxhash64("_id"), "_id").limit(s.bin_rows).select(*features).toPandas().to_numpy(np.float64)
    columns = [f"_head{k}" for k in range(len(names))]
    shares = asked.agg(*[F.avg(F.when(F.col(c) < 2, F.col(c))).alias(c) for c in columns]).first()
    start = np.array([np.log(q / (1 - q)) for q in (min(max(shares[c] or 0.0, 1e-6), 1 - 1e-6) for c in columns)])
    model = Boosted(features, names, [_edges(drawn[:, j], s.bins) for j in range(len(features))], start, s.depth)

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = _matrix(batch, columns).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([_binary(model.binned(_matrix(batch, features))), _binary(labels), _binary(np.tile(start, (batch.num_rows, 1)))], ["bins", "labels", "margins"])

    table = stored(asked.drop("_id").mapInArrow(bin_rows, "bins binary, labels binary, margins binary"), "boosting-rows")
    since: list[Trees] = []
    for number in range(s.rounds):
        tree = _grown(table, model, since, s)
        model.trees.append(tree)
        since.append(tree)
        if len(since) == s.refresh and number + 1 < s.rounds:
            table, since = stored(_moved_on(table, model, since), "boosting-rows"), []
    return model


def _moved_on(table: DataFrame, model: Boosted, trees: list[Trees]) -> DataFrame:
    n, width = len(model.heads), len(model.features)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = model.adder(trees)
        for batch in batches:
            bins = _bytes(batch.column(0), width, np.uint8)
            margins = add(_bytes(batch.column(2), n, np.float64).copy(), bins)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(margins)], ["bins", "labels", "margins"])

    return table.mapInArrow(move, "bins binary, labels binary, margins binary")


def _grown(table: DataFrame, model: Boosted, since: list[Trees], s: Settings) -> Trees:
    """One more tree for each head, a pass a level."""
    n, inner = len(model.heads), (1 << s.depth) - 1
    tree = Trees(np.full((n, inner), -1), np.zeros((n, inner), np.int64), np.zeros((n, inner), bool), np.zeros((n, 1 << s.depth)))
    value = lambda g, h: -s.rate * g / (h + s.penalty)
    for level in range(s.depth):
        for r in _splits(table, model, since, tree, level, s).collect():  # heads * nodes rows
            b, at = r["best"], (1 << level) - 1 + r["node"]
            if b["gain"] > 1e-9:
                tree.feature[r["head"], at], tree.cut[r["head"], at], tree.left[r["head"], at] = b["feature"], b["cut"], b["left"]
                ends = value(b["gl"], b["hl"]), value(b["gr"], b["hr"])
            else:
                ends = value(b["g"], b["h"]), 0.0
            if level == s.depth - 1:
                tree.value[r["head"], 2 * r["node"]], tree.value[r["head"], 2 * r["node"] + 1] = ends
    return tree


SPLIT = "head int, node int, feature int, gain double, cut int, left boolean, gl double, hl double, gr double, hr double, g double, h double"


def _splits(table: DataFrame, model: Boosted, since: list[Trees], tree: Trees, level: int, s: Settings) -> DataFrame:
    """``head, node, best``: the best split of each node of a level."""
    n, width, size, nodes = len(model.heads), len(model.features), s.bins + 1, 1 << level
    known = Boosted(model.features, model.heads, [], model.start, model.depth)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width, 3, nodes * size), np.int64)
        add, routes = known.adder(since), [tree.router(head, level) for head in range(n)]
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, labels = _bytes(batch.column(0), width, np.uint8), _bytes(batch.column(1), n, np.uint8)
            margins = add(_bytes(batch.column(2), n, np.float64).copy(), bins)
            cell = np.ascontiguousarray(np.where(bins == MISSING, s.bins, bins).T).astype(np.int64)
            for head in range(n):
                own = np.flatnonzero(labels[:, head] < 2)
                if not len(own):
                    continue
                p = 1 / (1 + np.exp(-margins[own, head]))
                g, h = np.rint((p - labels[own, head]) * UNIT), np.rint(p * (1 - p) * UNIT)
                at = routes[head](bins[own]) * size
                for low in range(0, len(own), TOGETHER):
                    part = slice(low, low + TOGETHER)
                    gradients, packed = g[part], h[part] + ROW
                    for j in range(width):
                        cells = at[part] + cell[j, own[part]]
                        total[head, j, 0] += np.bincount(cells, weights=gradients, minlength=nodes * size).astype(np.int64)
                        count, hessians = np.divmod(np.bincount(cells, weights=packed, minlength=nodes * size).astype(np.int64), int(ROW))
                        total[head, j, 1] += hessians
                        total[head, j, 2] += count
        heads, of = np.divmod(np.arange(n * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(heads.astype(np.int32)), pa.array(of.astype(np.int32)), _binary(total.reshape(n * width, -1))], ["head", "feature", "sums"])

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The best split of each node by one feature: a few numbers from every task are added."""
        cells = sum(np.frombuffer(x, np.int64) for x in pdf["sums"]).reshape(3, nodes, size)
        g, h, rows = cells[0] / UNIT, cells[1] / UNIT, cells[2]
        found = []
        for node in range(nodes):
            sides = [np.cumsum(x[node, : s.bins])[:-1] for x in (g, h, rows)]
            whole = [x[node].sum() for x in (g, h, rows)]
            gone = [x[node, s.bins] for x in (g, h, rows)]
            for missing_left in (True, False):
                gl, hl, nl = (a + m * missing_left for a, m in zip(sides, gone, strict=True))
                gr, hr, nr = (w - a for w, a in zip(whole, (gl, hl, nl), strict=True))
                gain = gl**2 / (hl + s.penalty) + gr**2 / (hr + s.penalty) - whole[0] ** 2 / (whole[1] + s.penalty)
                gain = np.where((nl >= s.least_rows) & (nr >= s.least_rows), gain, -np.inf)
                k = int(gain.argmax())
                found.append((key[0], node, key[1], float(gain[k]), k, missing_left, float(gl[k]), float(hl[k]), float(gr[k]), float(hr[k]), float(whole[0]), float(whole[1])))
        return pd.DataFrame(found, columns=[f.split()[0] for f in SPLIT.split(", ")])

    each = table.mapInArrow(sums, "head int, feature int, sums binary").groupBy("head", "feature").applyInPandas(best, SPLIT)
    # Ties: the lesser feature, then missing on the left.
    first = F.max_by(F.struct(*[f.split()[0] for f in SPLIT.split(", ")[2:]]), F.struct(F.col("gain"), -F.col("feature"), F.col("left").cast("int")))
    return each.groupBy("head", "node").agg(first.alias("best"))


def scored(rows: DataFrame, model: Boosted, keep: list[str]) -> DataFrame:
    """``keep`` and ``scores``, an array with each head's probability."""
    names = [*keep, "scores"]
    n = len(model.heads)
    asked = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(model.features)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = model.adder(model.trees)
        for batch in batches:
            values = np.stack([batch.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(model.features))], axis=1) if batch.num_rows else np.zeros((0, len(model.features)))
            margins = add(np.tile(model.start, (batch.num_rows, 1)), model.binned(values))
            p = 1 / (1 + np.exp(-margins))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), pa.array(p.ravel()))], names)

    from pyspark.sql import types as T

    kept = rows.select(*keep).schema.fields
    return asked.mapInArrow(score, T.StructType([*kept, T.StructField("scores", T.ArrayType(T.DoubleType()))]))


def out_of_fold(rows: DataFrame, row_id: str, features: list[str], classes: dict[str, Column], fold: str, folds: int, settings: Settings = Settings()) -> DataFrame:
    """``row_id, fold, class, score``: every row scored by trees that have not seen its fold; all classes and folds are grown together."""
    heads = {f"{name}|{k}": (label, F.col(fold) != k) for name, label in classes.items() for k in range(folds)}
    model = fit(rows, row_id, features, heads, settings)
    found = scored(rows, model, [row_id, fold])
    own = F.array(*[F.struct(F.lit(name).alias("class"), F.element_at("scores", (F.lit(k * folds + 1) + F.col(fold)).cast("int")).alias("score")) for k, name in enumerate(classes)])
    return found.select(row_id, fold, F.explode(own).alias("_s")).select(row_id, fold, "_s.*")
