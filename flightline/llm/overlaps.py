"""Groups of sets in which every pair is decided by the sets themselves, without a pair being emitted that is no link.

Rows (band, node) say which sets may be near each other.  Bands whose nodes lie in one component already
need nothing.  The others are cut into blocks of bounded bytes, each pair of blocks is one group of a
task, and there the overlaps of all sets of different components are products of their incidence
matrices.  What is found does not depend on the size of a band or of a block; the work grows with the
square of a band's sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Sets and bytes of sets in a block.
BLOCK_SETS, BLOCK_BYTES = 1024, 32 << 20


def linked_inside(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """One link for each two components among pairs of ``left`` and ``right`` (indices into ``sets``) that the limit holds for."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set is in no intersection.
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    in_left, in_right = np.full(len(sets), -1), np.full(len(sets), -1)
    in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
    overlap = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [low, low + columns])
        x = np.zeros((len(left), columns), np.float32)
        y = np.zeros((len(right), columns), np.float32)
        own, at = owner[a:b], column[a:b] - low
        mine, theirs = in_left[own] >= 0, in_right[own] >= 0
        x[in_left[own[mine]], at[mine]] = 1
        y[in_right[own[theirs]], at[theirs]] = 1
        overlap += x @ y.T
    out_left, out_right = [], []
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        common = overlap[k : k + 256].astype(np.int64)
        ok = (100 * common >= percent * (size[rows][:, None] + size[right][None, :] - common)) & (roots[rows][:, None] != roots[right][None, :])
        i, j = np.nonzero(ok)
        if len(i):
            x, y = roots[rows[i]], roots[right[j]]
            _, one = np.unique(np.minimum(x, y) * (roots.max() + 1) + np.maximum(x, y), return_index=True)
            out_left.append(rows[i[one]])
            out_right.append(right[j[one]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_left]), np.concatenate([none, *out_right])


def undecided(rows: DataFrame, roots: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """``band, node, root, blocks``: the bands of ``least`` sets or more whose sets lie in several components, equal memberships once."""
    known = stored(rows.join(roots, "node", "left").join(sizes, "node").select("band", "node", F.coalesce("root", "node").alias("root"), "n_shingles"), "overlaps-rooted")
    bands = known.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("_all"), F.min("root").alias("_low"), F.max("root").alias("_high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_who"))
    several = bands.where((F.col("n") >= least) & (F.col("_low") != F.col("_high")))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("_all") * 8 / BLOCK_BYTES)).cast("int")
    once = several.groupBy("n", "_who").agg(F.min_by(F.struct("band", blocks.alias("blocks")), "band").alias("_one")).select("_one.*")
    return known.join(once, "band").select("band", "node", "root", "blocks")


def decided(open_rows: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """``a, b``: links between components inside the undecided bands, every pair of different components tried; ``kind`` is the type of nodes."""
    node_type = pa.binary() if kind == "binary" else pa.int64()
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = open_rows.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("_own", "_other").cast("int").alias("i"), F.greatest("_own", "_other").cast("int").alias("j"), "_own", "node", "root").join(sets, "node")

    def groups(batches):
        """Groups come sorted; a group can go on in the next batch."""
        key, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for k, now in enumerate(keys):
                if now != key:
                    if rows:
                        yield key, rows
                    key, rows = now, []
                rows.append((batch.column(3)[k].as_py(), batch.column(4)[k].as_py(), batch.column(5)[k].as_py(), np.frombuffer(batch.column(6)[k].as_buffer(), np.uint64).copy()))
        if rows:
            yield key, rows

    def decide(batches):
        for (_, i, j), rows in groups(batches):
            own = np.array([r[0] for r in rows])
            roots = np.unique(np.array([r[2] for r in rows], object), return_inverse=True)[1]
            x, y = linked_inside([r[3] for r in rows], roots, np.flatnonzero(own == i), np.flatnonzero(own == j), percent)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in x], node_type), pa.array([rows[k][1] for k in y], node_type)], ["a", "b"])

    keys = ["band", "i", "j"]
    ordered = dealt.select(*keys, "_own", "node", "root", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(decide, f"a {kind}, b {kind}")
