"""Holdouts and folds that keep label shares and, where asked, whole groups together.

A row's labels are its signature.  Every fold gets its share of every signature, rounded down, and what
the rounding leaves of a signature (fewer rows than there are folds) goes where its labels are wanted
most, the rarest label first: iterative stratification (Sechidis, Tsoumakas and Vlahavas 2011) on counts
of signatures instead of rows.  The driver sees those counts only; rows are ranked inside their
signature in the order of a hash and cut at its quotas.  A signature's rows are ranked in hash buckets,
so a signature that most rows share is not one task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Signatures whose counts are dealt at the driver: all there can be of 16 labels.
MOST_SIGNATURES = 1 << 16


def _ranked(df: DataFrame, signature: list[str], row_id: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their place ``_inside`` a bucket of their signature, and what each bucket's signature has ``_before`` it."""
    keyed = df.withColumn("_hash", F.xxhash64(*row_id, F.lit(seed))).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
    sizes = keyed.groupBy(*signature, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*signature).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*signature, "_bucket").orderBy("_hash", *row_id)
    return keyed.withColumn("_inside", F.row_number().over(inside) - 1), offsets


def deal(df: DataFrame, signature: list[str], row_id: list[str], folds: int, seed: int = 0) -> DataFrame:
    """Add ``fold``: 0 ... folds - 1, round-robin within each signature, whatever its columns hold.

    Signatures begin at folds of their own, so small ones do not all land in the first fold.
    """
    ranked, offsets = _ranked(df, signature, row_id, seed)
    on = [ranked[c].eqNullSafe(offsets[c]) for c in signature] + [ranked["_bucket"] == offsets["_bucket"]]
    joined = ranked.join(offsets, on)
    start = F.pmod(F.xxhash64(*[ranked[c] for c in signature], F.lit(seed)), F.lit(folds))
    return joined.select(*[ranked[c] for c in df.columns], F.pmod(F.col("_inside") + F.col("_before") + start, F.lit(folds)).cast("int").alias("fold"))


def whole_shares(n: int, shares: np.ndarray) -> np.ndarray:
    """``n`` in whole parts of the given shares, by largest remainders."""
    exact = n * shares
    out = np.floor(exact + 1e-9).astype(np.int64)
    short = np.argsort(out - exact, kind="stable")[: n - out.sum()]
    out[short] += 1
    return out


def quotas(counts: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Rows of each signature for each fold, shape (signatures, folds); fold sizes are exactly ``whole_shares``.

    ``labels`` (signatures, labels) is 0 or 1.  A signature's quota is its exact share rounded down or up
    (further only where fold sizes ask for it).
    """
    counts, labels = counts.astype(np.int64), labels.astype(np.int64)
    exact = counts[:, None] * shares[None, :]
    out = np.floor(exact + 1e-9).astype(np.int64)
    left = counts - out.sum(axis=1)
    wanted = labels.T @ (exact - out)
    room = whole_shares(int(counts.sum()), shares) - out.sum(axis=0)
    waiting = labels.T @ left
    todo = left > 0

    def give(s: int, label: int | None) -> None:
        order = np.lexsort((np.arange(len(shares)), -room, *(() if label is None else (-np.round(wanted[label], 9),))))
        took = order[: left[s]]
        out[s, took] += 1
        room[took] -= 1
        wanted[np.ix_(labels[s] > 0, took)] -= 1
        waiting[labels[s] > 0] -= left[s]
        todo[s] = False

    while (waiting > 0).any():
        rarest = int(np.where(waiting > 0, waiting, np.iinfo(np.int64).max).argmin())
        for s in np.flatnonzero(todo & (labels[:, rarest] > 0)).tolist():
            give(s, rarest)
    for s in np.flatnonzero(todo).tolist():
        give(s, None)
    def move(a: int, b: int) -> tuple[int, float]:
        """Take the row of a signature from fold ``a`` to fold ``b`` that labels mind least, and say how much they do."""
        may = np.flatnonzero((out[:, a] - exact[:, a] > 1e-9) & (out[:, b] - exact[:, b] < -1e-9))  # both stay within one row of their share
        may = may if len(may) else np.flatnonzero(out[:, a] > 0)
        minded = labels[may] @ ((wanted[:, a] - wanted[:, b] + 1) * weight)
        s = int(may[minded.argmin()])
        return shift(s, a, b), float(minded.min())

    def shift(s: int, a: int, b: int) -> int:
        out[s, a] -= 1
        out[s, b] += 1
        wanted[labels[s] > 0, a] += 1
        wanted[labels[s] > 0, b] -= 1
        return s

    weight = 1 / np.maximum(1, labels.T @ counts)  # a row weighs more in a rare label
    while room.any():
        a, b = int(room.argmin()), int(room.argmax())
        move(a, b)
        room[a] += 1
        room[b] -= 1
    # Rows change places between two folds as long as labels gain by it.
    better = len(counts) > 0 and labels.shape[1] > 0
    while better:
        better = False
        for a, b in permutations(range(len(shares)), 2):
            if not out[:, a].any():
                continue
            there, cost = move(a, b)
            back, more = move(b, a)
            if cost + more < -1e-12:
                better = True
            else:
                shift(back, a, b)
                shift(there, b, a)
    return out


def stratify(df: DataFrame, labels: list[str], row_id: list[str], shares: list[float], seed: int = 0) -> DataFrame:
    """Add ``fold``: the parts of all rows have the sizes of ``shares`` and even shares of every label.

    ``labels`` are columns that are 1 for positives; anything else, null too, is none.  Rows that share
    an id are rows of their own.  Beyond ``MOST_SIGNATURES`` different signatures (more than 16 labels)
    there is a ``ValueError``: :func:`deal` takes any number.
    """
    shares = np.array(shares, np.float64) / sum(shares)
    names = [f"_label{k}" for k in range(len(labels))]
    marked = df.withColumns({name: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)) for name, c in zip(names, labels, strict=True)})
    ranked, offsets = _ranked(marked, names, row_id, seed)
    found = offsets.groupBy(*names).agg(F.sum("_n").alias("n")).limit(MOST_SIGNATURES + 1).collect()
    if len(found) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} signatures of labels")
    found.sort(key=lambda r: tuple(r[c] for c in names))
    table = np.array([[r[c] for c in names] for r in found], np.int64).reshape(len(found), len(names))
    ends = np.cumsum(quotas(np.array([r["n"] for r in found], np.int64), table, shares), axis=1)
    schema = ", ".join([*(f"{c} int" for c in names), "_ends array<long>"])
    cuts = F.broadcast(df.sparkSession.createDataFrame([(*map(int, row), own) for row, own in zip(table, ends.tolist(), strict=True)], schema))  # MOST_SIGNATURES rows at most
    placed = ranked.join(offsets.drop("_n").join(cuts, names), [*names, "_bucket"])
    place = F.col("_inside") + F.col("_before")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], F.size(F.filter("_ends", lambda end: end <= place)).alias("fold"))


def folds(df: DataFrame, labels: list[str], row_id: list[str], n: int, seed: int = 0) -> DataFrame:
    """Add ``fold``: 0 ... n - 1, of equal size and with even shares of every label."""
    return stratify(df, labels, row_id, [1.0] * n, seed)


def holdout(df: DataFrame, labels: list[str], row_id: list[str], size: int | None = None, share: float | None = None, parts: int = 5, seed: int = 0) -> DataFrame:
    """Add ``held_out``: as many rows as :func:`holdout_size` says, with even shares of every label."""
    n = df.count()
    size = holdout_size(n, size, share, parts)
    if n and size >= n:
        raise ValueError(f"a holdout of {size} leaves nothing of {n} rows")
    return stratify(df, labels, row_id, [size, max(1, n - size)], seed).withColumn("held_out", F.col("fold") == 0).drop("fold")


def holdout_size(n: int, explicit: int | None = None, share: float | None = None, folds: int = 5) -> int:
    """Explicit size, else a share, else 1 / (folds + 1); rounded down, one at least."""
    size = explicit if explicit is not None else int(n * share) if share is not None else n // (folds + 1)
    return max(1, size)


def primary_label(labels: list[str]) -> Column:
    """Name of the first positive label column; 'none' for rows without any."""
    out = F.lit("none")
    for name in reversed(labels):
        out = F.when(F.col(name) == 1, name).otherwise(out)
    return out


def merge_rare(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Keys with fewer than ``least`` rows become 'rare'."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, key, "left").withColumn(key, F.when(F.col("_n") < least, "rare").otherwise(F.col(key))).drop("_n")


def deal_groups(df: DataFrame, group: str, labels: list[str], folds: int, seed: int = 0) -> DataFrame:
    """Folds that never part a group: groups are stratified by the union of their labels, then joined back."""
    folded = stratify(_collapsed(df, group, labels), labels, [group], [1.0] * folds, seed).select(F.col(group).alias("_group"), "fold")
    return df.join(folded, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def hold_out_groups(df: DataFrame, group: str, labels: list[str], size: int, seed: int = 0) -> DataFrame:
    """Add ``held_out``: whole groups, as many as make up about ``size`` rows, one at least and not all."""
    collapsed = _collapsed(df, group, labels)
    n_rows, n_groups = df.count(), collapsed.count()
    if n_groups < 2:
        raise ValueError(f"a holdout of groups needs two at least, not {n_groups}")
    take = max(1, min(round(size * n_groups / n_rows), n_groups - 1))
    held = holdout(collapsed, labels, [group], take, seed=seed).select(F.col(group).alias("_group"), "held_out")
    return df.join(held, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _collapsed(df: DataFrame, group: str, labels: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in labels])


def audit(df: DataFrame, labels: list[str], folds: int) -> DataFrame:
    """``label, fold`` for every fold that has no positive of a label."""
    counts = df.groupBy("fold").agg(*[F.sum(c).alias(c) for c in labels]).unpivot("fold", labels, "label", "n").where("n > 0")
    every = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold")).withColumn("label", F.explode(F.array(*[F.lit(c) for c in labels])))
    return every.join(counts, ["fold", "label"], "left_anti").select("label", "fold")
