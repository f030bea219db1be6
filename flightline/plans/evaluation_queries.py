"""Evaluation of scores: intervals of rank metrics, curves, thresholds from a budget of false alarms, and metrics over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import metrics, resampling
from flightline.operators import decisions
from flightline.plans import agent_queries, label_queries
from flightline.plans.book import Book, r6

BOOK = Book()
MASK = "18446744073709551615::UHUGEINT"


def _mixed(x: str, shift: int, factor: int) -> str:
    return f"((xor({x}, {x} >> {shift}) * {factor}::UHUGEINT) & {MASK})"


def _bootstrap_sql(replicates: int) -> str:
    edges, term, total = [], 1.0, 0.0
    for k in range(13):
        term = term / max(1, k)
        total += term
        edges.append(total)
    weight = " + ".join(f"(u >= exp(-1.0) * {e!r}::DOUBLE)::INT" for e in edges)
    return f"""WITH {label_queries.SCORES}, h0 AS (
  SELECT class, p AS score, y, r, ((id::UHUGEINT + (r + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) & {MASK}) AS x FROM sc, range({replicates}) AS t(r)
), h1 AS (SELECT class, score, y, r, {_mixed('x', 30, 0xBF58476D1CE4E5B9)} AS x FROM h0), h2 AS (SELECT class, score, y, r, {_mixed('x', 27, 0x94D049BB133111EB)} AS x FROM h1),
h3 AS (SELECT class, score, y, r, (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992 AS u FROM h2), w AS (
  SELECT class, r, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS pp, sum(CASE WHEN y = 1 THEN 0 ELSE w END)::DOUBLE AS nn FROM (SELECT *, {weight} AS w FROM h3) GROUP BY 1, 2, 3
), k AS (
  SELECT *, sum(pp) OVER o AS tp, sum(nn) OVER o AS fp, sum(pp) OVER e AS pos, sum(nn) OVER e AS neg FROM w WINDOW o AS (PARTITION BY class, r ORDER BY score DESC), e AS (PARTITION BY class, r)
), v AS (
  SELECT class, r, 'auroc' AS metric, sum(pp * (neg - fp + nn / 2)) / any_value(pos * neg) AS value FROM k WHERE pos > 0 AND neg > 0 GROUP BY 1, 2
  UNION ALL SELECT class, r, 'average_precision', sum(CASE WHEN pp > 0 THEN pp / pos * tp / (tp + fp) ELSE 0 END) FROM k WHERE pos > 0 GROUP BY 1, 2)
SELECT class, metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg(value), 6) AS mean, count(*) AS used FROM v GROUP BY 1, 2"""


@BOOK.enter(_bootstrap_sql(1000))
def bootstrap_rank_metrics(spark, sf_dir):
    """Intervals of AUROC and average precision of each priority's scores, 1,000 replicates (weights mixed from the order's key)."""
    rows = label_queries.scores(spark, sf_dir)
    found = resampling.bootstrap_ranks(rows, ["class"], F.col("y"), F.col("p"), row_hash=F.col("id"))
    return found.select("class", "metric", *[r6(F.col(c)).alias(c) for c in ("low", "high", "mean")], "used")


@BOOK.enter(
    f"""WITH {label_queries.SCORES}, q AS (SELECT *, lead(pp) OVER w AS pn, lead(nn) OVER w AS nx, row_number() OVER w AS i FROM ranked WHERE pos > 0 AND neg > 0 WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT class, 'roc' AS curve, round(fp / neg, 6) AS x, round(tp / pos, 6) AS y, score AS threshold FROM q WHERE i = 1 OR pn IS NULL OR pn <> pp OR nx <> nn UNION ALL SELECT class, 'pr', round(tp / pos, 6), round(tp / (tp + fp), 6), score FROM q
UNION ALL SELECT DISTINCT class, 'roc', 0.0, 0.0, 1.0 FROM q UNION ALL SELECT DISTINCT class, 'pr', 0.0, 1.0, NULL FROM q"""
)
def curve_points(spark, sf_dir):
    """ROC and precision-recall curves with their end points, points between equal steps left out of the first."""
    found = metrics.curves(label_queries.scores(spark, sf_dir), ["class"], F.col("y"), F.col("p"))
    return found.select("class", "curve", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "threshold")


#: Thresholds from the runs of four fifths of the users; the others are evaluated.
BUDGET = 0.05
THRESHOLDS = f"""{agent_queries.DECIDED}, pk AS (SELECT user_id, mode AS class, max(held) AS peak FROM dc WHERE user_id % 5 <> 0 GROUP BY 1, 2
), ng AS (SELECT class, peak, row_number() OVER (PARTITION BY class ORDER BY peak) - 1 AS i, count(*) OVER (PARTITION BY class) AS n FROM pk ANTI JOIN tr ON tr.user_id = pk.user_id AND tr.class = pk.class
), th AS (SELECT class, least(0.995, greatest(0.05, peak + 1e-4)) AS threshold FROM ng WHERE i = CAST(ceil((n - 1) * {1 - BUDGET!r}::DOUBLE - 1e-9) AS BIGINT)
), ob AS (SELECT dc.k, dc.mode AS class, dc.p, coalesce((manifest <= dc.t)::INT, 0) AS y FROM dc LEFT JOIN tr ON tr.user_id = dc.user_id AND tr.class = dc.mode WHERE dc.user_id % 5 = 0
), cf AS (SELECT k, class, count(*) FILTER (y = 1 AND p >= threshold)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p >= threshold)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p < threshold)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p < threshold)::DOUBLE AS tn FROM ob JOIN th USING (class) GROUP BY 1, 2
), ti AS (SELECT k, class, p, sum(y)::DOUBLE AS pp, sum(1 - y)::DOUBLE AS nn FROM ob GROUP BY 1, 2, 3
), ri AS (SELECT *, sum(pp) OVER o AS cp, sum(nn) OVER o AS cn, sum(pp) OVER e AS pos, sum(nn) OVER e AS neg FROM ti WINDOW o AS (PARTITION BY k, class ORDER BY p DESC), e AS (PARTITION BY k, class)
), au AS (SELECT k, class, CASE WHEN any_value(pos * neg) > 0 THEN sum(pp * (neg - cn + nn / 2)) / any_value(pos * neg) END AS auroc, CASE WHEN any_value(pos) > 0 THEN sum(pp / nullif(pos, 0) * cp / (cp + cn)) END AS ap FROM ri GROUP BY 1, 2
), rc AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sensitivity FROM cf JOIN au USING (k, class))"""


def thresholds(spark, sf_dir, x: DataFrame | None = None) -> DataFrame:
    """``class, threshold``: what at most a share of the runs without the class pass (their peak debounced score)."""
    decided = agent_queries.decided(spark, sf_dir, x).where("user_id % 5 <> 0")
    peaks = decided.groupBy("user_id", F.col("mode").alias("class")).agg(F.max("held").alias("peak"))
    quiet = peaks.join(agent_queries.truth(spark, sf_dir, x), ["user_id", "class"], "left_anti")
    return metrics.budget_threshold(quiet, ["class"], "peak", BUDGET)


def observed(spark, sf_dir, x: DataFrame | None = None) -> DataFrame:
    """Scores of the other runs at every tick, with whether the failure shows by then."""
    scores = agent_queries.decided(spark, sf_dir, x).where("user_id % 5 = 0").select("user_id", "k", "t", F.col("mode").alias("class"), "p")
    shown = F.coalesce((F.col("manifest") <= F.col("t")).cast("int"), F.lit(0))
    return scores.join(agent_queries.truth(spark, sf_dir, x), ["user_id", "class"], "left").withColumn("y", shown)


@BOOK.enter(f"WITH {THRESHOLDS} SELECT class, round(threshold, 6) AS threshold FROM th")
def budget_thresholds(spark, sf_dir):
    return thresholds(spark, sf_dir).select("class", r6(F.col("threshold")).alias("threshold"))


@BOOK.enter(f"WITH {THRESHOLDS} SELECT k, class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(f1, 6) AS f1, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM rc")
def class_records_over_time(spark, sf_dir):
    """The record of every class at every tick, at its own threshold."""
    x = agent_queries.kept_signals(spark, sf_dir)
    found = metrics.by_time(observed(spark, sf_dir, x), "k", "class", F.col("y"), F.col("p"), thresholds(spark, sf_dir, x))
    return found.select("k", "class", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("f1", "auroc", "average_precision")])


@BOOK.enter(
    f"""WITH {THRESHOLDS} SELECT k, CAST(count(*) AS BIGINT) AS classes, CAST(sum(tp + fn) AS BIGINT) AS support, round(avg(f1), 6) AS macro_f1, round(avg(sensitivity), 6) AS macro_sensitivity, round(avg(auroc), 6) AS macro_auroc,
round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM rc WHERE tp + fn >= 5 GROUP BY k"""
)
def metrics_over_time(spark, sf_dir):
    """Macro and micro averages at every tick over the classes with five positives or more there."""
    x = agent_queries.kept_signals(spark, sf_dir)
    found = metrics.over_time(observed(spark, sf_dir, x), "k", "class", F.col("y"), F.col("p"), thresholds(spark, sf_dir, x))
    return found.select("k", "classes", "support", *[r6(F.col(c)).alias(c) for c in ("macro_f1", "macro_sensitivity", "macro_auroc", "micro_f1")])


@BOOK.enter(
    f"""WITH {THRESHOLDS}, fa AS (SELECT user_id, mode AS class, min(t) AS alert_at FROM dc JOIN th ON th.class = dc.mode WHERE user_id % 5 = 0 AND held >= th.threshold GROUP BY 1, 2), rn AS (SELECT count(DISTINCT user_id) AS total FROM x WHERE user_id % 5 = 0
), po AS (SELECT tr.user_id, tr.class, manifest, alert_at, CASE WHEN tr.class = 'LEVEL' THEN -1.0 WHEN tr.class = 'MEAN' AND manifest <= 6.5 THEN 6.5 END AS gate FROM tr LEFT JOIN fa ON fa.user_id = tr.user_id AND fa.class = tr.class WHERE tr.user_id % 5 = 0
), d AS (SELECT class, count(*) AS n, avg((alert_at IS NOT NULL)::INT) AS detection, avg((alert_at IS NOT NULL AND (gate IS NULL OR alert_at <= gate))::INT) AS in_time, quantile_cont(alert_at - manifest, 0.5) AS late FROM po GROUP BY 1
), wrong AS (SELECT class, count(*) AS n FROM fa ANTI JOIN tr ON tr.user_id = fa.user_id AND tr.class = fa.class GROUP BY 1)
SELECT d.class, CAST(d.n AS BIGINT) AS n, round(detection, 6) AS detection, round(in_time, 6) AS in_time, round(late, 6) AS median_latency, round(1000.0 * coalesce(wrong.n, 0) / greatest(total - d.n, 1), 6) AS false_per_1000 FROM d LEFT JOIN wrong USING (class), rn"""
)
def streaming_metrics(spark, sf_dir):
    """Detection, in time at each class's gate (one of them only where it shows by then), latency and false alerts, without exclusion."""
    x = agent_queries.kept_signals(spark, sf_dir)
    held = agent_queries.decided(spark, sf_dir, x).where("user_id % 5 = 0").withColumnRenamed("mode", "class").drop("threshold")
    over = held.join(thresholds(spark, sf_dir, x).select("class", "threshold"), "class").where(F.col("held") >= F.col("threshold"))
    first = over.groupBy("user_id", "class").agg(F.min("t").alias("alert_at"))
    runs = held.agg(F.countDistinct("user_id").alias("total"))
    truth = agent_queries.truth(spark, sf_dir, x).where("user_id % 5 = 0")
    gated = truth.withColumn("gate", decisions.gate_of(F.col("class"), F.col("manifest"), ["LEVEL"], [], ["MEAN"]))
    found = decisions.evaluation(gated, first, runs, ["user_id"])
    return found.select("class", "n", *[r6(F.col(c)).alias(c) for c in ("detection", "in_time", "median_latency", "false_per_1000")])
