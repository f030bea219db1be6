"""Bootstrap intervals of rank metrics: all replicates of AUROC and average precision in two passes over sorted rows.

A replicate gives each row a Poisson weight from a hash of its id, so it is the same however rows are
dealt.  Rows are sorted by key and score in ranges that Spark samples, equal scores too are cut over
tasks.  The first pass sums each range's weights of positives and negatives, for all replicates at once;
a prefix over a key's ranges tells each what lies above it; the second pass goes down the scores of a
range with matrices (rows x replicates) and adds up both metrics.  Scores at which ranges meet are added
in the prefix, from both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.functions.filters import runs_of
from flightline.functions.metrics import poisson_weights
from flightline.sources.scratch import stored

#: Rows whose weights are held at once.
ROWS = 512
METRICS = ("auroc", "average_precision")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of ``part, key`` in sorted batches, a few rows at a time: (part, key), scores, labels, hashes."""
    for batch in batches:
        for a, b in runs_of([batch.column(0), batch.column(1)]):
            key = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
            score, label, hashes = (batch.column(k).to_numpy(zero_copy_only=False)[a:b] for k in (2, 3, 4))
            for c in range(0, b - a, ROWS):
                yield key, score[c : c + ROWS], label[c : c + ROWS], hashes[c : c + ROWS].view(np.uint64)


class _Groups:
    """Weights of positives and negatives at each score in turn; a score can go on in the next rows."""

    def __init__(self, replicates: int):
        self.replicates, self.score, self.open = replicates, None, None

    def closed(self, score: np.ndarray, label: np.ndarray, hashes: np.ndarray) -> tuple[list[float], np.ndarray]:
        """Scores that are over, and their weights (scores, 2, replicates)."""
        weights = poisson_weights(hashes, self.replicates)
        start = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        every = np.add.reduceat(weights, start, axis=0)
        weights[label != 1] = 0.0
        positive = np.add.reduceat(weights, start, axis=0)
        both = np.stack([positive, every - positive], axis=1)
        scores = score[start].tolist()
        if self.open is not None:
            if scores[0] == self.score:
                both[0] += self.open
            else:
                scores, both = [self.score, *scores], np.concatenate([self.open[None], both])
        self.score, self.open = scores[-1], both[-1]
        return scores[:-1], both[:-1]


def metric_terms(p: np.ndarray, n: np.ndarray, above_p: np.ndarray, above_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scores in falling order (scores, replicates): sums of positives times negatives above (its own by half), and of positives times precision."""
    tp, fp = above_p + np.cumsum(p, axis=0), above_n + np.cumsum(n, axis=0)
    lost = (p * (fp - n / 2)).sum(axis=0)
    gained = (p * tp / np.maximum(tp + fp, 1e-300)).sum(axis=0)
    return lost, gained


def bootstrap_ranks(df: DataFrame, keys: list[str], truth: Column, score: Column, row_hash: Column | None = None, replicates: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """``keys, metric, low, high, mean, used``: percentile intervals of AUROC and of average precision.

    Replicates without a positive (for AUROC: or without a negative) are left out; ``used`` are those that
    remain, and with fewer than two the interval is NULL.  Rows with a NULL score or label don't count.
    ``row_hash`` tells rows apart (a long; unless given, a hash of the column ``id`` and the seed).
    """
    held = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = df.where(score.isNotNull() & truth.isNotNull()).select(held.alias("key"), score.cast("double").alias("score"), (truth == 1).cast("int").alias("label"), (F.xxhash64("id", F.lit(seed)) if row_hash is None else row_hash).cast("long").alias("hash"))
    order = ["key", F.desc("score"), "hash"]
    placed = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "bootstrap-rows").select("part", "key", "score", "label", "hash")
    ready = placed.repartition("part").sortWithinPartitions("part", *order)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range and key: the weights in all, at its first score and at its last."""
        key, groups, total, first = None, None, None, None

        def row():
            whole, last = total + groups.open, groups.open
            begin, begun = first if first is not None else (groups.score, groups.open)
            ends = [np.concatenate(x) for x in (whole, begun, last)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([begin]), pa.array([groups.score]), *(pa.array([x.tolist()]) for x in ends)], ["part", "key", "first", "last", "total", "at_first", "at_last"])

        for now, score, label, hashes in _stretches(batches):
            if now != key:
                if key is not None:
                    yield row()
                key, groups, total, first = now, _Groups(replicates), np.zeros((2, replicates)), None
            scores, both = groups.closed(score, label, hashes)
            if scores:
                total += both.sum(axis=0)
                first = first if first is not None else (scores[0], both[0])
        if key is not None:
            yield row()

    ends = stored(ready.mapInArrow(sums, "part int, key string, first double, last double, total array<double>, at_first array<double>, at_last array<double>"), "bootstrap-sums")

    def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each range what is above its second score; and the terms of the scores at which ranges begin and end."""
        pdf = pdf.sort_values("part")
        shape = lambda x: np.asarray(x).reshape(2, replicates)
        above, out = np.zeros((2, replicates)), []
        lost, gained = np.zeros(replicates), np.zeros(replicates)
        waiting = None  # the score that the last range ended with, and its weights so far

        def settle():
            nonlocal above, lost, gained
            more = metric_terms(waiting[1][:1], waiting[1][1:], above[0], above[1])
            lost, gained, above = lost + more[0], gained + more[1], above + waiting[1]

        for r in pdf.itertuples(index=False):
            total, begin, end = shape(r.total), shape(r.at_first), shape(r.at_last)
            if waiting is not None and waiting[0] != r.first:
                settle()
                waiting = None
            waiting = (r.first, begin.copy() if waiting is None else waiting[1] + begin)
            if r.first == r.last:
                out.append(np.zeros((2, replicates)))  # nothing in between
                continue
            settle()
            out.append(above.copy())
            above = above + total - begin - end
            waiting = (r.last, end)
        settle()
        return pd.DataFrame({"part": pdf["part"], "key": pdf["key"], "above": [a.ravel().tolist() for a in out], "whole": [above.ravel().tolist()] * len(out), "lost": [lost.tolist(), *([[]] * (len(out) - 1))], "gained": [gained.tolist(), *([[]] * (len(out) - 1))]})

    lists = ", ".join(f"{c} array<double>" for c in ("above", "whole", "lost", "gained"))
    # A group is one key's ranges, a few numbers for each replicate.
    begins = stored(ends.groupBy("key").applyInPandas(prefix, f"part int, key string, {lists}"), "bootstrap-begins")
    heads = begins.select("part", "key", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("long").alias("hash"), "above")
    both = placed.withColumn("above", F.lit(None).cast("array<double>")).unionByName(heads)
    # The head of a range sorts before its rows.
    mixed = both.repartition("part").sortWithinPartitions("part", "key", F.desc_nulls_first("score"), "hash")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, above, begun = None, None, None, False
        lost = gained = None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[1]]), pa.array([lost.tolist()]), pa.array([gained.tolist()])], ["key", "lost", "gained"])

        for batch in batches:
            at = 0
            for head in [*np.flatnonzero(batch.column(5).is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
                part = batch.slice(at, head - at)
                for _, score, label, hashes in _stretches([part]) if part.num_rows else ():
                    scores, own = groups.closed(score, label, hashes)
                    if scores and not begun:
                        scores, own, begun = scores[1:], own[1:], True  # the first score is in the prefix, and so is the last
                    if scores:
                        more = metric_terms(own[:, 0], own[:, 1], above[0], above[1])
                        lost, gained, above = lost + more[0], gained + more[1], above + own.sum(axis=0)
                if head < batch.num_rows:
                    if key is not None:
                        yield row()
                    key = (batch.column(0)[head].as_py(), batch.column(1)[head].as_py())
                    groups, begun, above = _Groups(replicates), False, np.array(batch.column(5)[head].as_py()).reshape(2, replicates)
                    lost, gained = np.zeros(replicates), np.zeros(replicates)
                at = head + 1
        if key is not None:
            yield row()

    found = mixed.mapInArrow(terms, "key string, lost array<double>, gained array<double>")
    every = found.unionByName(begins.where(F.size("lost") > 0).select("key", "lost", "gained"))
    tail = (1 - confidence) / 2

    def finish(key: tuple, terms: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        pos, neg = np.asarray(whole["whole"].iloc[0]).reshape(2, replicates)
        lost, gained = (np.sum(np.stack(terms[c].tolist()), axis=0) for c in ("lost", "gained"))
        out = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for metric, value, good in (("auroc", 1 - lost / (pos * neg), (pos > 0) & (neg > 0)), ("average_precision", gained / pos, pos > 0)):
                v = value[good]
                low, high = np.quantile(v, [tail, 1 - tail]) if len(v) > 1 else (np.nan, np.nan)
                out.append((key[0], metric, low, high, v.mean() if len(v) > 1 else np.nan, len(v)))
        return pd.DataFrame(out, columns=["key", "metric", "low", "high", "mean", "used"])

    per = every.groupBy("key").cogroup(begins.groupBy("key").agg(F.first("whole").alias("whole")).groupBy("key")).applyInPandas(finish, "key string, metric string, low double, high double, mean double, used long")
    clean = per.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high", "mean")})
    if not keys:
        return clean.drop("key")
    parsed = clean.withColumn("_k", F.from_json("key", df.select(*keys).schema))
    return parsed.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "metric", "low", "high", "mean", "used")
