"""Classification metrics as grouped aggregates: one pass over scores, no collection of rows.

Undefined values (one class only, empty denominators of a ratio that has no convention) are NULL;
ratios of the count battery are 0 where their denominator is.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions import ranks
from flightline.sources.scratch import stored


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, keys: list[str], truth: Column, score: Column, threshold: Column) -> DataFrame:
    """``tp, fp, fn, tn`` of each key; a score at the threshold counts as positive."""
    yes, hit = truth == 1, score >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*keys).agg(n(yes & hit).alias("tp"), n(~yes & hit).alias("fp"), n(yes & ~hit).alias("fn"), n(~yes & ~hit).alias("tn"))


def battery(counts: DataFrame) -> DataFrame:
    """Ratios of a table with ``tp, fp, fn, tn``."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.withColumns(
        {
            "sensitivity": sens, "specificity": spec, "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "balanced_accuracy": (sens + spec) / 2, "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "support": (F.col("tp") + F.col("fn")).cast("long"),
        }
    )


def by_score(df: DataFrame, keys: list[str], truth: Column, score: Column) -> DataFrame:
    """Positives and negatives at each distinct score, and in all at or above it (``tp``, ``fp``), and of the key (``pos``, ``neg``).

    Everything that follows from the ranking follows from this table, which has a row for each distinct
    score only.
    """
    tied = df.where(score.isNotNull() & truth.isNotNull()).groupBy(*keys, score.alias("score")).agg(F.sum(F.when(truth == 1, 1).otherwise(0)).cast("double").alias("p"), F.sum(F.when(truth == 1, 0).otherwise(1)).cast("double").alias("n"))
    found = ranks.running(tied, keys, ["score"], ["p", "n"], descending=True)
    return found.select(*keys, "score", "p", "n", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"), F.col("p_all").alias("pos"), F.col("n_all").alias("neg"))


def auroc(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    won = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("n") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(won, F.first("pos") * F.first("neg")).alias("auroc"))


def average_precision(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over distinct scores of the gain in recall times the precision."""
    return ranked.groupBy(*keys).agg(F.sum(F.try_divide(F.col("p"), F.col("pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def partial_auroc(ranked: DataFrame, keys: list[str], max_fpr: float = 0.1) -> DataFrame:
    """Area under the ROC curve up to ``max_fpr``, scaled to 0.5 (chance) ... 1 (perfect)."""
    x0, x1 = (F.col("fp") - F.col("n")) / F.col("neg"), F.col("fp") / F.col("neg")
    y0, y1 = (F.col("tp") - F.col("p")) / F.col("pos"), F.col("tp") / F.col("pos")
    right = F.least(x1, F.lit(max_fpr))
    top = F.when(x1 > x0, y0 + (y1 - y0) * (right - x0) / (x1 - x0)).otherwise(y1)
    area = F.sum(F.when(x0 < max_fpr, (right - x0) * (y0 + top) / 2).otherwise(0.0))
    least, most = max_fpr**2 / 2, max_fpr
    return ranked.where("pos > 0 and neg > 0").groupBy(*keys).agg((0.5 * (1 + (area - least) / (most - least))).alias("partial_auroc"))


def roc_points(ranked: DataFrame) -> DataFrame:
    """``fpr, tpr, recall, precision`` at each distinct score."""
    return ranked.withColumns({"fpr": F.try_divide(F.col("fp"), F.col("neg")), "tpr": F.try_divide(F.col("tp"), F.col("pos")), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))})


def curves(df: DataFrame, keys: list[str], truth: Column, score: Column) -> DataFrame:
    """``keys, curve, x, y, threshold``: both curves of each key as a chart draws them; nothing for keys with one class only.

    ``roc`` (false-positive rate, sensitivity) begins at (0, 0), whose threshold 'call nothing' is written as
    1, and leaves out points that lie between two equal steps.  ``pr`` (recall, precision) has every
    distinct score and ends with recall 0 and precision 1, which no threshold has.
    """
    tied = df.where(score.isNotNull() & truth.isNotNull()).groupBy(*keys, score.cast("double").alias("score")).agg(F.sum(F.when(truth == 1, 1).otherwise(0)).cast("double").alias("p"), F.sum(F.when(truth == 1, 0).otherwise(1)).cast("double").alias("n"))
    placed = stored(ranks.running(tied, keys, ["score"], ["p", "n"], descending=True, following=True).where("p_all > 0 and n_all > 0"), "curve-points")
    # A point stays if the step to it and the step from it differ; the first and the last always do.
    first = (F.col("p_upto") == F.col("p")) & (F.col("n_upto") == F.col("n"))
    bend = first | F.col("p_next").isNull() | (F.col("p_next") != F.col("p")) | (F.col("n_next") != F.col("n"))
    roc = placed.where(bend).select(*keys, F.lit("roc").alias("curve"), (F.col("n_upto") / F.col("n_all")).alias("x"), (F.col("p_upto") / F.col("p_all")).alias("y"), F.col("score").alias("threshold"))
    pr = placed.select(*keys, F.lit("pr").alias("curve"), (F.col("p_upto") / F.col("p_all")).alias("x"), (F.col("p_upto") / (F.col("p_upto") + F.col("n_upto"))).alias("y"), F.col("score").alias("threshold"))
    ends = F.array(F.struct(F.lit("roc").alias("curve"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("threshold")), F.struct(F.lit("pr").alias("curve"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(None).cast("double").alias("threshold")))
    # The step from 'call nothing' to the first score, told by its counts.
    added = placed.where(first).select(*keys, F.explode(ends).alias("_end")).select(*keys, "_end.*")
    return roc.unionByName(pr).unionByName(added)


def brier(df: DataFrame, keys: list[str], truth: Column, score: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(score - truth, 2)).alias("brier"))


def threshold_sweep(df: DataFrame, keys: list[str], truth: Column, score: Column, steps: int = 100) -> DataFrame:
    """The confusion counts at thresholds 0, 1/steps, ... 1, from one histogram (each score is counted once)."""
    cell = F.floor(score * steps + 1e-9).cast("int")
    cells = df.groupBy(*keys, cell.alias("cell")).agg(F.sum(F.when(truth == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(truth == 1, 0).otherwise(1)).alias("n"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("cell"))
    full = grid.join(cells, [*keys, "cell"], "left").fillna(0, ["p", "n"])
    above = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    tp, fp = F.sum("p").over(above), F.sum("n").over(above)
    return full.select(*keys, (F.col("cell") / steps).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.sum("p").over(every) - tp).alias("fn"), (F.sum("n").over(every) - fp).alias("tn"))


def over_time(scores: DataFrame, time: str, class_: str, truth: Column, score: Column, thresholds: DataFrame, least: int = 5, at: list[float] | None = None) -> DataFrame:
    """Averages over classes at each time: ``time, classes, support, macro_<ratio>, micro_<ratio>, macro_auroc, macro_average_precision``.

    A row of ``scores`` is a run, a time and a class; ``truth`` is 1 where the failure shows by then.  Each
    class is called at its own threshold (``thresholds``: class, threshold).  Classes with fewer than
    ``least`` positives at a time don't count there, and times at which none does have no row.  ``at``
    names the times wanted; all of them come out of the same aggregates.
    """
    per = by_time(scores, time, class_, truth, score, thresholds, at).where(F.col("support") >= least)
    cells = ("tp", "fp", "fn", "tn")
    macro = [F.avg(r).alias(f"macro_{r}") for r in (*RATIOS, "auroc", "average_precision")]
    sums = per.groupBy(time).agg(F.count(F.lit(1)).alias("classes"), *macro, *[F.sum(c).alias(c) for c in cells])
    pooled = battery(sums)
    return pooled.select(time, "classes", "support", *[F.col(f"macro_{r}") for r in RATIOS], *[F.col(r).alias(f"micro_{r}") for r in RATIOS], "macro_auroc", "macro_average_precision")


def by_time(scores: DataFrame, time: str, class_: str, truth: Column, score: Column, thresholds: DataFrame, at: list[float] | None = None) -> DataFrame:
    """The record of each class at each time, at the class's own threshold (see :func:`per_class`)."""
    wanted = scores if at is None else scores.where(F.col(time).isin(at))
    limits = thresholds.select(F.col(class_).alias("_class"), F.col("threshold").alias("_threshold"))
    met = stored(wanted.join(limits, F.col(class_) == F.col("_class")), "scores-at-times")
    return per_class(met, [time, class_], truth, score, F.col("_threshold"))


RATIOS = ("sensitivity", "specificity", "ppv", "npv", "f1", "balanced_accuracy", "mcc")


def averages(per_class: DataFrame, value: str, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted mean over classes; NULL values and classes without weight are left out of both."""
    use = F.col(value).isNotNull() & (F.col(weight) > 0)
    v, w = F.when(use, F.col(value)), F.when(use, F.col(weight).cast("double"))
    return per_class.groupBy(*(keys or [])).agg(F.avg(v).alias("macro"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted"))


def aggregated(per_class: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Macro, support-weighted and micro average of one ratio of the count battery in one aggregate: ``macro, weighted, micro``.

    ``per_class`` is a battery with its counts; micro is the ratio of the pooled counts.
    """
    cells = ("tp", "fp", "fn", "tn")
    use = F.col(value).isNotNull() & (F.col("support") > 0)
    v, w = F.when(use, F.col(value)), F.when(use, F.col("support").cast("double"))
    sums = per_class.groupBy(*(keys or [])).agg(F.avg(v).alias("macro"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted"), *[F.sum(c).alias(c) for c in cells])
    return battery(sums).select(*(keys or []), "macro", "weighted", F.col(value).alias("micro"))


def averages_of(records: DataFrame, how: str, metrics: tuple[str, ...], pooled: DataFrame | None = None) -> DataFrame:
    """One row of averages over classes, ``how`` being macro, weighted or micro; classes whose value is undefined are left out of it.

    Micro takes the count ratios from pooled counts, and ``auroc`` and ``average_precision`` from
    ``pooled`` (one row with both, of all decisions ranked together), or NULL without it.
    """
    if how not in ("macro", "weighted", "micro"):
        raise ValueError(f"how must be macro, weighted or micro, not {how!r}")
    scored = F.count("auroc").alias("n_scored")
    head = [F.lit(how).alias("how"), F.count(F.lit(1)).alias("n_classes"), scored, F.sum("support").alias("support")]
    if how == "micro":
        cells = records.agg(*head, *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
        ratios = battery(cells.withColumnRenamed("support", "_support")).drop("support").withColumnRenamed("_support", "support")
        ranks = ("auroc", "average_precision")
        with_ranks = ratios.crossJoin(F.broadcast(pooled.select(*ranks))) if pooled is not None else ratios.withColumns({c: F.lit(None).cast("double") for c in ranks})
        return with_ranks.select("how", "n_classes", "n_scored", "support", *metrics)
    weight = F.col("support").cast("double") if how == "weighted" else F.lit(1.0)

    def mean(c: str) -> Column:
        w = F.when(F.col(c).isNotNull() & (weight > 0), weight)
        return F.try_divide(F.sum(F.col(c) * w), F.sum(w)).alias(c)

    return records.agg(*head, *[mean(c) for c in metrics])


def per_class(df: DataFrame, keys: list[str], truth: Column, score: Column, threshold: Column, max_fpr: float = 0.1) -> DataFrame:
    """One record for each class: counts, their ratios, and the rank metrics (NULL where undefined)."""
    ranked = by_score(df, keys, truth, score)
    found = battery(confusion(df, keys, truth, score, threshold))
    for table in (auroc(ranked, keys), average_precision(ranked, keys), partial_auroc(ranked, keys, max_fpr)):
        found = found.join(table, keys, "left")
    return found


#: Numerator and denominator cells of the ratios that have a Wilson interval.
PROPORTIONS = {"sensitivity": ("tp", ("tp", "fn")), "specificity": ("tn", ("tn", "fp")), "ppv": ("tp", ("tp", "fp")), "npv": ("tn", ("tn", "fn"))}


def confidence_interval(counts: DataFrame, keys: list[str], metric: str, confidence: float = 0.95) -> DataFrame:
    """``low, high, n_positive`` of a proportion from ``tp, fp, fn, tn``; rank metrics have :func:`bootstrap` instead."""
    if metric not in PROPORTIONS:
        raise ValueError(f"no interval from counts for {metric!r}; there is one for {', '.join(PROPORTIONS)}")
    top, parts = PROPORTIONS[metric]
    low, high = wilson(F.col(top), sum((F.col(c) for c in parts[1:]), F.col(parts[0])), confidence)
    return counts.select(*keys, F.lit(metric).alias("metric"), low.alias("low"), high.alias("high"), (F.col("tp") + F.col("fn")).cast("long").alias("n_positive"))


def micro(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The count battery of all classes' cells pooled."""
    return battery(counts.groupBy(*(keys or [])).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval, within 0 and 1; NULL for no trials."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    s, n = successes.cast("double"), n.cast("double")
    p = F.try_divide(s, n)
    centre = F.try_divide(p + z * z / (2 * n), 1 + z * z / n)
    half = F.try_divide(z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def higher_quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The element at the 0-based place ``ceil((n - 1) q)`` of the sorted values, as ``quantile``, and ``n``.

    Values are counted before they are ranked, so ties cost one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    placed = ranks.running(counts, keys, [value], ["c"])
    place = F.ceil((F.col("c_all") - 1) * F.lit(q) - 1e-9)
    return placed.where(F.col("c_upto") > place).groupBy(*keys).agg(F.min(value).alias("quantile"), F.first("c_all").alias("n"))


def budget_threshold(negatives: DataFrame, keys: list[str], peak: str, budget: float, low: float = 0.05, high: float = 0.995) -> DataFrame:
    """The threshold that at most a share ``budget`` of the negatives' peak scores passes, within ``low ... high``."""
    return higher_quantile(negatives, keys, peak, 1 - budget).withColumn("threshold", F.greatest(F.lit(low), F.least(F.lit(high), F.col("quantile") + 1e-4)))


def bootstrap(df: DataFrame, keys: list[str], per_row: list[Column], statistic, replicates: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic of sums, by Poisson weights drawn from hashes of (row, replicate).

    ``per_row`` are columns to be summed, named ``s0, s1, ...`` for ``statistic`` (Column from Columns);
    rows need an ``id``.  Weights depend on the row and the replicate alone, so partitioning doesn't
    matter.  Each batch of rows becomes its sums by one matrix product; no row is ever repeated.
    """
    rows = df.select(F.to_json(F.struct(*keys)).alias("_key") if keys else F.lit("").alias("_key"), F.xxhash64("id", F.lit(seed)).alias("_hash"), *[c.cast("double").alias(f"s{k}") for k, c in enumerate(per_row)])
    names = [f"s{k}" for k in range(len(per_row))]

    def sums(batches):
        for batch in batches:
            which = batch.column(0).dictionary_encode()
            codes, known = which.indices.to_numpy(), which.dictionary.to_pylist()
            hashes = batch.column(1).to_numpy().view(np.uint64)
            values = np.stack([np.nan_to_num(batch.column(2 + k).to_numpy(zero_copy_only=False)) for k in range(len(names))], axis=1)
            for code, key in enumerate(known):
                own = codes == code
                totals = poisson_weights(hashes[own], replicates).T @ values[own]
                yield pa.RecordBatch.from_arrays([pa.array([key] * replicates), pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(totals[:, k]) for k in range(len(names)))], ["_key", "replicate", *names])

    drawn = rows.mapInArrow(sums, "_key string, replicate int" + "".join(f", {n} double" for n in names)).groupBy("_key", "replicate").agg(*[F.sum(n).alias(n) for n in names])
    value = drawn.withColumn("value", statistic(*[F.col(n) for n in names]))
    tail = (1 - confidence) / 2
    found = value.groupBy("_key").agg(F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"), F.avg("value").alias("mean"))
    if not keys:
        return found.drop("_key")
    parsed = found.withColumn("_k", F.from_json("_key", df.select(*keys).schema))
    return parsed.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "low", "high", "mean")


#: Where a number of 53 bits passes to the next Poisson(1) weight; and the weight by its first 16 bits, one of them short where it passes inside.
_EDGES = np.ceil(np.exp(-1.0) * np.cumsum(1 / np.cumprod(np.append(1.0, np.arange(1.0, 13.0)))) * (1 << 53)).astype(np.uint64)
_BY_BITS = np.searchsorted(_EDGES, np.arange(1 << 16, dtype=np.uint64) << np.uint64(37), "right").astype(np.uint8)
_PASSES = np.zeros(1 << 16, bool)
_PASSES[(_EDGES[_EDGES < 1 << 53] >> np.uint64(37)).astype(np.int64)] = True
_UNSURE = np.uint8(255)
_BY_BITS[_PASSES] = _UNSURE


def poisson_weights(hashes: np.ndarray, replicates: int, rows: int = 32) -> np.ndarray:
    """Poisson(1) weights, shape (rows, replicates), from a mixture of each row's hash with the replicate's number.

    A few ``rows`` at a time stay in the processor's cache; a weight is looked up by 16 bits, where these leave it open by all.
    """
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((len(hashes), replicates))
    for a in range(0, len(hashes), rows):
        x = hashes[a : a + rows, None] + steps
        moved = x >> np.uint64(30)
        for shift, factor in ((27, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB)):
            x ^= moved
            x *= np.uint64(factor)
            np.right_shift(x, np.uint64(shift), out=moved)
        x ^= moved
        found = _BY_BITS[x >> np.uint64(48)]
        open_ = found == _UNSURE
        found[open_] = np.searchsorted(_EDGES, x[open_] >> np.uint64(11), "right")
        out[a : a + rows] = found
    return out
