"""Time-series operators over ``events``: each user is an entity, ordered by (ts, event_id).

Errors are lost samples (NULL); the score of a tick is its held value over 200, at most 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.functions import timeseries as ts
from flightline.operators import decisions
from flightline.plans.book import Book, r6, table

BOOK = Book()
SERIES = ts.Series(("user_id",), ("k",))
THRESHOLD = 0.3

BASE = """
s AS (
  SELECT user_id, event_id, ts, event_type, value, CASE WHEN event_type <> 'error' THEN value END AS v,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k
  FROM events
), f AS (
  SELECT *, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS h
  FROM s
)"""
SCORED = (
    BASE
    + """, p AS (
  SELECT *, least(1.0, h / 200.0) AS p FROM f WHERE h IS NOT NULL
), d AS (
  SELECT *, CASE WHEN k >= 1 THEN min(p) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) ELSE 0.0 END AS held FROM p
)"""
)
CALLED = (
    SCORED
    + """, l AS (
  SELECT *, max(CASE WHEN held >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latched,
            max(CASE WHEN held >= 0.45 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raised,
            max(CASE WHEN held >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS severe
  FROM d
), c AS (
  SELECT *, (k - 20) / 2.0 AS t, CASE WHEN k < 20 THEN CASE WHEN latched = 1 THEN 'HOLD' ELSE 'GO' END
                 WHEN k < 34 THEN CASE WHEN latched = 1 THEN 'ABORT' WHEN k >= 33 THEN 'COMMIT' ELSE 'ENGINE_START' END
                 WHEN severe = 1 THEN 'CRITICAL' WHEN raised = 1 THEN 'WARNING' WHEN latched = 1 THEN 'ADVISORY' ELSE 'NOMINAL' END AS call
  FROM l
)"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    order = ts.Series(("user_id",), ("ts", "event_id"))
    return events.withColumns({"v": F.when(F.col("event_type") != "error", ts.missing_as_null(F.col("value"))), "k": order.index()})


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("h", SERIES.forward_fill(F.col("v")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = held(spark, sf_dir).where("h is not null").withColumn("p", F.least(F.lit(1.0), F.col("h") / 200.0))
    return p.withColumn("held", F.when(F.col("k") >= 1, F.min("p").over(SERIES.trailing(2))).otherwise(F.lit(0.0)))


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick lasts half a second and the twentieth is ignition; three levels of one score stand for the latched modes."""
    levels = {"latched": THRESHOLD, "raised": 1.5 * THRESHOLD, "severe": 2 * THRESHOLD}
    latched = scored(spark, sf_dir).withColumns({name: SERIES.latched(F.col("held") >= level) for name, level in levels.items()})
    return latched.withColumn("t", (F.col("k") - 20) / 2.0).withColumn("call", decisions.call(F.col("t"), F.col("latched"), F.col("severe"), F.col("raised")))


@BOOK.enter(f"WITH {SCORED} SELECT user_id, min(CASE WHEN held >= 0.3 THEN k END) AS first_k, min(CASE WHEN held >= 0.3 THEN ts END) AS first_ts FROM d GROUP BY user_id")
def first_alert(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("user_id").agg(*[F.min(F.when(F.col("held") >= THRESHOLD, F.col(c))).alias(f"first_{c}") for c in ("k", "ts")])


@BOOK.enter(f"WITH {BASE} SELECT user_id, event_id, k, h FROM f")
def ffill_hold_last(spark, sf_dir):
    return held(spark, sf_dir).select("user_id", "event_id", "k", "h")


@BOOK.enter(f"WITH {BASE} SELECT user_id, event_id, CASE WHEN k >= 3 THEN lag(h, 3) OVER w ELSE first_value(h) OVER w END AS lagged, round((h - lag(h, 3) OVER w) / 5.0, 6) AS rate FROM f WINDOW w AS (PARTITION BY user_id ORDER BY k)")
def lag_with_fill(spark, sf_dir):
    return held(spark, sf_dir).select("user_id", "event_id", SERIES.lagged(F.col("h"), 3).alias("lagged"), r6(SERIES.rate(F.col("h"), 3, 5.0)).alias("rate"))


@BOOK.enter(f"WITH {BASE} SELECT user_id, event_id, round(avg(h) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mean20 FROM f")
def trailing_mean_growing(spark, sf_dir):
    return held(spark, sf_dir).select("user_id", "event_id", r6(SERIES.trailing_mean(F.col("h"), 20)).alias("mean20"))


@BOOK.enter(f"WITH {BASE} SELECT user_id, event_id, round(sqrt(avg(h * h) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), 6) AS rms20 FROM f")
def trailing_rms(spark, sf_dir):
    return held(spark, sf_dir).select("user_id", "event_id", r6(SERIES.trailing_rms(F.col("h"), 20)).alias("rms20"))


@BOOK.enter(f"WITH {BASE}, x AS (SELECT user_id, abs(h - lag(h, 10) OVER (PARTITION BY user_id ORDER BY k)) AS step FROM f) SELECT user_id, round(max(step), 6) AS step_max, count(*) FILTER (step > 40) AS n_steps FROM x GROUP BY user_id")
def step_change(spark, sf_dir):
    steps = held(spark, sf_dir).select("user_id", F.abs(F.col("h") - F.lag("h", 10).over(SERIES.ordered)).alias("step"))
    return steps.groupBy("user_id").agg(r6(F.max("step")).alias("step_max"), F.count_if(F.col("step") > 40).alias("n_steps"))


@BOOK.enter(f"WITH {BASE}, x AS (SELECT user_id, CASE WHEN h = lag(h) OVER (PARTITION BY user_id ORDER BY k) THEN 1 ELSE 0 END AS same FROM f) SELECT user_id, round(avg(same), 6) AS flat_fraction FROM x GROUP BY user_id")
def flat_fraction(spark, sf_dir):
    return held(spark, sf_dir).select("user_id", SERIES.unchanged(F.col("h")).alias("same")).groupBy("user_id").agg(r6(F.avg("same")).alias("flat_fraction"))


@BOOK.enter(
    f"""WITH {BASE}, g AS (SELECT *, CASE WHEN k >= 5 AND k < 45 THEN v END AS x FROM s), a AS (
  SELECT user_id, k, count(x) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd, min(x) OVER w AS lo, max(x) OVER w AS hi
  FROM g WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, k, CASE WHEN n >= 10 THEN round(m, 6) END AS mean, CASE WHEN n >= 10 THEN round(sd, 6) END AS std, CASE WHEN n >= 10 THEN lo END AS low, CASE WHEN n >= 10 THEN hi END AS high FROM a"""
)
def windowed_stat_gated(spark, sf_dir):
    v, gate = F.col("v"), (F.col("k") >= 5) & (F.col("k") < 45)
    columns = {"mean": r6(SERIES.gated(F.avg, v, gate, 10)), "std": r6(SERIES.gated(F.stddev_pop, v, gate, 10)), "low": SERIES.gated(F.min, v, gate, 10), "high": SERIES.gated(F.max, v, gate, 10)}
    return samples(spark, sf_dir).withColumns(columns).select("user_id", "k", *columns)


@BOOK.enter(
    f"""WITH {BASE}, a AS (SELECT user_id, k, coalesce(min(CASE WHEN k >= 5 AND k < 45 AND h >= 100 THEN k END) OVER w, max(CASE WHEN k >= 5 AND k < 45 THEN k END) OVER w) - 5 AS crossing
  FROM f WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT user_id, k, crossing FROM a"""
)
def censored_crossing_time(spark, sf_dir):
    crossing = SERIES.first_crossing(F.col("h"), 100.0, F.col("k"), (F.col("k") >= 5) & (F.col("k") < 45)) - 5
    return held(spark, sf_dir).withColumn("crossing", crossing).select("user_id", "k", "crossing")


@BOOK.enter(
    f"""WITH {BASE}, t AS (SELECT *, avg(h) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5 FROM f)
SELECT user_id, round(max(CASE WHEN k >= 10 THEN m5 END) - avg(CASE WHEN k < 10 THEN h END), 6) AS rise FROM t GROUP BY user_id"""
)
def plateau_rise(spark, sf_dir):
    smooth = held(spark, sf_dir).withColumn("m5", SERIES.trailing_mean(F.col("h"), 5))
    return smooth.groupBy("user_id").agg(r6(F.max(F.when(F.col("k") >= 10, F.col("m5"))) - F.avg(F.when(F.col("k") < 10, F.col("h")))).alias("rise"))


@BOOK.enter(
    f"""WITH {BASE}, x AS (SELECT user_id, k, h, lag(h, 1) OVER (PARTITION BY user_id ORDER BY k) AS g FROM f), y AS (
  SELECT user_id, k, CASE WHEN k >= 3 AND h IS NOT NULL AND g IS NOT NULL THEN h END AS a, CASE WHEN k >= 3 AND h IS NOT NULL AND g IS NOT NULL THEN g END AS b FROM x), z AS (
  SELECT user_id, k, count(a) OVER w AS n, stddev_pop(a) OVER w AS sa, stddev_pop(b) OVER w AS sb, corr(a, b) OVER w AS c FROM y WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, k, CASE WHEN n >= 10 THEN CASE WHEN sa < 1e-9 OR sb < 1e-9 THEN 0.0 ELSE round(c, 6) END END AS correlation FROM z"""
)
def windowed_corr(spark, sf_dir):
    both = held(spark, sf_dir).withColumn("g", F.lag("h", 1).over(SERIES.ordered))
    return both.withColumn("correlation", r6(SERIES.correlation(F.col("h"), F.col("g"), F.col("k") >= 3, 10))).select("user_id", "k", "correlation")


@BOOK.enter(f"WITH {SCORED} SELECT user_id, k, round(held, 6) AS held FROM d")
def tick_debounce(spark, sf_dir):
    return scored(spark, sf_dir).select("user_id", "k", r6(F.col("held")).alias("held"))


@BOOK.enter(f"WITH {CALLED} SELECT user_id, k, latched = 1 AS latched, raised = 1 AS raised, severe = 1 AS severe, call FROM c")
def latch_calls(spark, sf_dir):
    return called(spark, sf_dir).select("user_id", "k", "latched", "raised", "severe", "call")


@BOOK.enter(f"WITH {CALLED}, x AS (SELECT user_id, k, call, lag(call) OVER (PARTITION BY user_id ORDER BY k) AS before FROM c) SELECT user_id, k, call FROM x WHERE k = 0 OR before IS DISTINCT FROM call")
def call_change_events(spark, sf_dir):
    return decisions.call_changes(called(spark, sf_dir), SERIES).select("user_id", "k", "call")


@BOOK.enter(f"WITH {BASE}, x AS (SELECT user_id, k, sum(CASE WHEN h > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM f) SELECT user_id, min(CASE WHEN n = 5 THEN k END) AS tripped_at FROM x GROUP BY user_id")
def run_length_persistence(spark, sf_dir):
    flagged = held(spark, sf_dir).withColumn("trip", SERIES.persisted(F.col("h") > 20, 5))
    return ts.first_true(flagged, ["user_id"], F.col("trip"), F.col("k"), "tripped_at")


@BOOK.enter(f"WITH {CALLED}, x AS (SELECT *, coalesce(max(CASE WHEN call IN ('HOLD', 'ABORT') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM c) SELECT user_id, k, call FROM x WHERE stopped = 0")
def stop_truncation(spark, sf_dir):
    return ts.cut_at_stop(called(spark, sf_dir), SERIES, F.col("call"), ["HOLD", "ABORT"]).select("user_id", "k", "call")


ENVELOPE = f"{BASE}, e AS (SELECT user_id, CAST(floor(k / 10) AS BIGINT) AS bin, min(h) AS low, max(h) AS high, avg(h) AS mean FROM f GROUP BY 1, 2 HAVING count(*) = 10)"


@BOOK.enter(f"WITH {ENVELOPE} SELECT user_id, bin, low, high, round(mean, 6) AS mean FROM e")
def envelope_bins(spark, sf_dir):
    return ts.envelope(held(spark, sf_dir), ["user_id"], F.col("k"), F.col("h"), 10).withColumn("mean", r6(F.col("mean")))


@BOOK.enter(f"WITH {ENVELOPE} SELECT bin, round(quantile_cont(mean, 0.05), 6) AS p05, round(quantile_cont(mean, 0.95), 6) AS p95 FROM e GROUP BY bin")
def percentile_band(spark, sf_dir):
    bins = ts.envelope(held(spark, sf_dir), ["user_id"], F.col("k"), F.col("h"), 10)
    return ts.percentile_band(bins, ["bin"], "mean").select("bin", r6(F.col("low")).alias("p05"), r6(F.col("high")).alias("p95"))


@BOOK.enter(
    """WITH ref AS (SELECT event_type, date_trunc('day', ts) + INTERVAL 1 DAY AS ref_ts, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY 1, 2), m AS (
  SELECT e.event_id, e.value, r.mean, r.sd, row_number() OVER (PARTITION BY e.event_id ORDER BY r.ref_ts DESC NULLS LAST) AS place FROM events e LEFT JOIN ref r ON e.event_type = r.event_type AND r.ref_ts <= e.ts)
SELECT event_id, CASE WHEN sd >= 1e-6 THEN round((value - mean) / sd, 6) END AS z FROM m WHERE place = 1"""
)
def asof_reference_zscore(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    reference = events.groupBy("event_type", (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("ref_ts")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    met = ts.backward_asof(events, reference, "ts", "ref_ts", ["mean", "sd"], ("event_type",), bucket=lambda t: F.date_trunc("day", t))
    return met.select("event_id", F.when(F.col("sd") >= 1e-6, r6((F.col("value") - F.col("mean")) / F.col("sd"))).alias("z"))


@BOOK.enter(
    f"""WITH {BASE}, x AS (SELECT user_id, k, h > 60 AND k >= 5 AS hot, h < 5 AND k < 60 AS cold FROM f), y AS (
  SELECT user_id, k, sum(hot::INT) OVER w AS n_hot, sum(cold::INT) OVER w AS n_cold FROM x WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)), z AS (
  SELECT user_id, 0 AS limit_id, 'over_60' AS "limit", 'ABORT' AS call, min(CASE WHEN n_hot = 2 THEN k END) AS tripped_at FROM y GROUP BY user_id UNION ALL SELECT user_id, 1, 'under_5', 'HOLD', min(CASE WHEN n_cold = 2 THEN k END) FROM y GROUP BY user_id)
SELECT * FROM z WHERE tripped_at IS NOT NULL"""
)
def redline_trips(spark, sf_dir):
    h, k = F.col("h"), F.col("k")
    limits = [("over_60", (h > 60) & (k >= 5), "ABORT"), ("under_5", (h < 5) & (k < 60), "HOLD")]
    return decisions.limit_trips(held(spark, sf_dir), SERIES, limits, "k", persistence=2)


@BOOK.enter(
    f"""WITH {SCORED}, a AS (SELECT user_id, min(CASE WHEN held >= 0.3 THEN k END) AS alert_at FROM d GROUP BY user_id), t AS (SELECT user_id, min(CASE WHEN value > 100 THEN k END) AS manifest FROM f GROUP BY user_id)
SELECT count(*) AS n, round(avg((alert_at IS NOT NULL)::INT), 6) AS detection, round(avg(coalesce(alert_at <= 40, false)::INT), 6) AS in_time, round(quantile_cont(alert_at - manifest, 0.5), 6) AS median_latency FROM t JOIN a USING (user_id) WHERE manifest IS NOT NULL"""
)
def latency_summary(spark, sf_dir):
    alerts = ts.first_true(scored(spark, sf_dir), ["user_id"], F.col("held") >= THRESHOLD, F.col("k"), "alert_at")
    truth = ts.first_true(samples(spark, sf_dir), ["user_id"], F.col("value") > 100, F.col("k"), "manifest").where("manifest is not null").withColumn("class", F.lit("high"))
    found = decisions.detection(truth, alerts, ["user_id"], F.lit(40))
    return found.select("n", *[r6(F.col(c)).alias(c) for c in ("detection", "in_time", "median_latency")])


@BOOK.enter(
    f"""WITH {SCORED}, a AS (SELECT user_id, min(CASE WHEN held >= 0.3 THEN k END) AS alert_at FROM d GROUP BY user_id), t AS (SELECT DISTINCT user_id FROM f WHERE value > 250)
SELECT user_id, alert_at FROM a WHERE alert_at IS NOT NULL AND user_id NOT IN (SELECT user_id FROM t)"""
)
def false_alerts(spark, sf_dir):
    alerts = ts.first_true(scored(spark, sf_dir), ["user_id"], F.col("held") >= THRESHOLD, F.col("k"), "alert_at").where("alert_at is not null")
    return decisions.false_alerts(alerts, samples(spark, sf_dir).where("value > 250").select("user_id").distinct(), ["user_id"])


@BOOK.enter(
    f"""WITH {SCORED}, q AS (SELECT user_id, max(held) AS peak FROM d GROUP BY user_id), r AS (SELECT peak, row_number() OVER (ORDER BY peak) AS i, count(*) OVER () AS n FROM q)
SELECT n, round(greatest(0.05, least(0.995, min(peak) + 1e-4)), 6) AS threshold FROM r WHERE i - 1 >= ceil((n - 1) * 0.9 - 1e-9) GROUP BY n"""
)
def budget_threshold_higher_quantile(spark, sf_dir):
    from flightline.functions import metrics

    peaks = scored(spark, sf_dir).groupBy("user_id").agg(F.max("held").alias("peak"))
    return metrics.budget_threshold(peaks, [], "peak", 0.1).select("n", r6(F.col("threshold")).alias("threshold"))
