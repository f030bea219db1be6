"""Replays of an agent over ``events``: three modes scored at each tick, alerts, calls, limits, evidence and their evaluation.

A user is a run; tick k is at (k - 20) / 2 seconds from ignition.  LEVEL and MEAN exclude each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions import timeseries as ts
from flightline.operators import decisions, graph, reports, universe
from flightline.plans import series_queries
from flightline.plans.book import Book, r6, table
from flightline.plans.series_queries import SERIES
from flightline.sources import scratch
from flightline.streaming import alerts as streams
from flightline.streaming import replays

BOOK = Book()
RUN_MODE = ts.Series(("user_id", "mode"), ("k",))
CRITICAL, WARNING = ["LEVEL"], ["MEAN"]
THRESHOLDS = {"LEVEL": 0.3, "MEAN": 0.45, "STEP": 0.5}
GATES = {"LEVEL": -1.0, "MEAN": 6.5, "STEP": 1e9}

SIGNALS = (
    series_queries.BASE
    + """, x AS (
  SELECT user_id, event_id, k, (k - 20) / 2.0 AS t, v, h, coalesce(abs(h - lag(h) OVER w), 0) AS step, avg(h) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5
  FROM f WHERE h IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY k)
)"""
)
DECIDED = (
    SIGNALS
    + """, pm AS (
  SELECT user_id, k, t, 'LEVEL' AS mode, 'heat' AS grp, 0.3 AS threshold, least(1.0, h / 200) AS p FROM x
  UNION ALL SELECT user_id, k, t, 'MEAN', 'heat', 0.45, least(1.0, mean5 / 120) FROM x
  UNION ALL SELECT user_id, k, t, 'STEP', NULL, 0.5, least(1.0, step / 150) FROM x
), hd AS (
  SELECT *, CASE WHEN row_number() OVER w > 1 THEN least(p, lag(p) OVER w) ELSE 0.0 END AS held FROM pm WINDOW w AS (PARTITION BY user_id, mode ORDER BY k)
), ac AS (
  SELECT *, held >= threshold AND (grp IS NULL OR row_number() OVER (PARTITION BY user_id, k, grp ORDER BY (held >= threshold) DESC, held DESC, mode) = 1) AS active FROM hd
), dc AS (
  SELECT *, bool_or(active) OVER (PARTITION BY user_id, mode ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latched FROM ac
), cl AS (
  SELECT user_id, k, t, CASE WHEN t < 0 THEN CASE WHEN bool_or(latched) THEN 'HOLD' ELSE 'GO' END WHEN t < 7 THEN CASE WHEN bool_or(latched) THEN 'ABORT' WHEN t >= 6.5 THEN 'COMMIT' ELSE 'ENGINE_START' END
    WHEN bool_or(latched AND mode = 'LEVEL') THEN 'CRITICAL' WHEN bool_or(latched AND mode = 'MEAN') THEN 'WARNING' WHEN bool_or(latched) THEN 'ADVISORY' ELSE 'NOMINAL' END AS call FROM dc GROUP BY user_id, k, t
), al AS (
  SELECT user_id, mode AS class, min(t) AS alert_at FROM ac WHERE active GROUP BY 1, 2
), tr AS (
  SELECT user_id, 'LEVEL' AS class, min(t) AS manifest FROM x WHERE v > 100 GROUP BY 1 UNION ALL SELECT user_id, 'MEAN', min(t) FROM x WHERE mean5 > 70 GROUP BY 1 UNION ALL SELECT user_id, 'STEP', min(t) FROM x WHERE step > 200 GROUP BY 1
), gated AS (
  SELECT *, CASE class WHEN 'LEVEL' THEN -1.0 WHEN 'MEAN' THEN 6.5 ELSE 1e9 END AS gate FROM tr
)"""
)
LIMITS = (
    DECIDED
    + """, br AS (
  SELECT user_id, k, t, h > 150 AND t >= -8 AND t < 0 AS b0, h > 120 AND t >= 0 AND t < 7 AS b1, mean5 > 60 AND t >= 7 AS b2 FROM x
), pe AS (
  SELECT user_id, t, sum(b0::INT) OVER w AS n0, sum(b1::INT) OVER w AS n1, sum(b2::INT) OVER w AS n2 FROM br WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
), lt AS (
  SELECT * FROM (SELECT user_id, 0 AS limit_id, 'HOLD' AS call, min(t) FILTER (n0 = 2) AS tripped_at FROM pe GROUP BY 1 UNION ALL SELECT user_id, 1, 'ABORT', min(t) FILTER (n1 = 2) FROM pe GROUP BY 1
  UNION ALL SELECT user_id, 2, 'ALARM', min(t) FILTER (n2 = 2) FROM pe GROUP BY 1) WHERE tripped_at IS NOT NULL
)"""
)


def signals(spark, sf_dir) -> DataFrame:
    h = F.col("h")
    rows = series_queries.held(spark, sf_dir).where("h is not null").withColumn("t", (F.col("k") - 20) / 2.0)
    return rows.withColumns({"step": F.coalesce(F.abs(h - F.lag("h").over(SERIES.ordered)), F.lit(0.0)), "mean5": SERIES.trailing_mean(h, 5)}).select("user_id", "event_id", "k", "t", "v", "h", "step", "mean5")


def kept_signals(spark, sf_dir) -> DataFrame:
    """:func:`signals` in a table, for queries that derive scores, truth and limits from them."""
    return scratch.stored(signals(spark, sf_dir), "signals")


def decided(spark, sf_dir, x: DataFrame | None = None) -> DataFrame:
    p = {"LEVEL": F.col("h") / 200, "MEAN": F.col("mean5") / 120, "STEP": F.col("step") / 150}
    group = {"LEVEL": "heat", "MEAN": "heat", "STEP": None}
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(group[m]).cast("string").alias("grp"), F.lit(THRESHOLDS[m]).alias("threshold"), F.least(F.lit(1.0), c).alias("p")) for m, c in p.items()])
    x = signals(spark, sf_dir) if x is None else x
    rows = x.select("user_id", "k", "t", F.explode(modes).alias("m")).select("user_id", "k", "t", "m.*")
    return decisions.decide(rows, RUN_MODE, "p", "threshold", "grp")


def calls(spark, sf_dir) -> DataFrame:
    return decisions.calls(decided(spark, sf_dir), RUN_MODE, "t", CRITICAL, WARNING)


def alerts(spark, sf_dir, x: DataFrame | None = None) -> DataFrame:
    return decided(spark, sf_dir, x).where("active").groupBy("user_id", F.col("mode").alias("class")).agg(F.min("t").alias("alert_at"))


def truth(spark, sf_dir, x: DataFrame | None = None) -> DataFrame:
    """``user_id, class, manifest``: when each failure shows."""
    signs = {"LEVEL": F.col("v") > 100, "MEAN": F.col("mean5") > 70, "STEP": F.col("step") > 200}
    x = signals(spark, sf_dir) if x is None else x
    first = x.groupBy("user_id").agg(*[F.min(F.when(s, F.col("t"))).alias(c) for c, s in signs.items()])
    return first.unpivot("user_id", list(signs), "class", "manifest").where("manifest is not null")


def gate() -> F.Column:
    return F.create_map(*[F.lit(x) for pair in GATES.items() for x in pair])[F.col("class")]


def trips(spark, sf_dir, x: DataFrame | None = None) -> DataFrame:
    t = F.col("t")
    limits = [("hot before ignition", decisions.within(F.col("h") > 150, t, -8.0, 0.0), "HOLD"), ("hot at the start", decisions.within(F.col("h") > 120, t, 0.0, 7.0), "ABORT"), ("warm in flight", (F.col("mean5") > 60) & (t >= 7), "ALARM")]
    return decisions.limit_trips(signals(spark, sf_dir) if x is None else x, SERIES, limits, "t", 2)


@BOOK.enter(f"WITH {DECIDED} SELECT user_id, k, mode, round(held, 6) AS held, active, latched FROM dc")
def agent_decide(spark, sf_dir):
    """Debounce, threshold, exclusion in the group, latch."""
    return decided(spark, sf_dir).select("user_id", "k", "mode", r6(F.col("held")).alias("held"), "active", "latched")


@BOOK.enter(f"WITH {DECIDED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY held DESC, mode) AS place FROM ac WHERE active AND grp = 'heat') SELECT user_id, k, mode, round(held, 6) AS held FROM r WHERE place = 1")
def exclusive_argmax(spark, sf_dir):
    """Which mode of the exclusive group stands at a tick at which any does: never more than one."""
    return decided(spark, sf_dir).where("active and grp = 'heat'").select("user_id", "k", "mode", r6(F.col("held")).alias("held"))


@BOOK.enter(f"WITH {DECIDED} SELECT user_id, k, t, call FROM cl")
def call_policy(spark, sf_dir):
    return calls(spark, sf_dir).select("user_id", "k", "t", "call")


@BOOK.enter(
    f"""WITH {DECIDED}, w AS (SELECT user_id, k, list(round(held, 6) ORDER BY mode) AS held, list(active ORDER BY mode) AS active, list(latched ORDER BY mode) AS latched FROM dc GROUP BY 1, 2)
SELECT w.user_id, w.k, cl.t, held, active, latched, call, call IS DISTINCT FROM lag(call) OVER (PARTITION BY w.user_id ORDER BY w.k) AS changed FROM w JOIN cl ON cl.user_id = w.user_id AND cl.k = w.k"""
)
def streaming_calls(spark, sf_dir):
    """Debounce, exclusion, latches, calls and their changes over a stream of the scores in five stretches of time."""
    x = signals(spark, sf_dir)
    p = {"LEVEL": F.col("h") / 200, "MEAN": F.col("mean5") / 120, "STEP": F.col("step") / 150}
    rows = x.select("user_id", "k", "t", F.timestamp_seconds(replays.EPOCH + F.col("k") / 2).alias("ts"), *[F.least(F.lit(1.0), c).alias(m) for m, c in p.items()])
    stream = streams.in_stretches(rows, "k", 5, scratch.new_path(spark, "stream-scores"))
    groups = replays.groups_of(table(spark, sf_dir, "events"), "user_id")
    found = streams.drained(replays.call_stream(stream, THRESHOLDS, [["LEVEL", "MEAN"]], CRITICAL, WARNING, run="user_id", number="k", late="1 day", groups=groups), scratch.new_path(spark, "stream-calls"), "append")
    return found.withColumn("held", F.transform("held", r6))


@BOOK.enter(f"WITH {DECIDED} SELECT user_id, class, alert_at, CASE WHEN alert_at < 0 THEN 'HOLD' WHEN alert_at < 7 THEN 'ABORT' WHEN class = 'LEVEL' THEN 'CRITICAL' WHEN class = 'MEAN' THEN 'WARNING' ELSE 'ADVISORY' END AS level FROM al")
def alert_level(spark, sf_dir):
    return alerts(spark, sf_dir).withColumn("level", decisions.alert_level(F.col("class"), F.col("alert_at"), CRITICAL, WARNING))


SUMMARY = """, st AS (SELECT *, min(t) FILTER (call IN ('HOLD', 'ABORT')) OVER (PARTITION BY user_id) AS stop FROM cl), sm AS (
  SELECT user_id, min(t) FILTER (call = 'HOLD') AS hold_at, min(t) FILTER (call = 'ABORT') AS abort_at, min(t) FILTER (call IN ('WARNING', 'CRITICAL')) AS warning_at FROM st WHERE stop IS NULL OR t <= stop GROUP BY user_id)"""


@BOOK.enter(f"WITH {DECIDED}{SUMMARY} SELECT * FROM sm")
def run_summary(spark, sf_dir):
    """First hold, abort and warning of each run; calls after a stop do not count."""
    return reports.run_summary(calls(spark, sf_dir), ["user_id"])


@BOOK.enter(
    f"""WITH {DECIDED}, d AS (SELECT class, count(*) AS n, avg((alert_at IS NOT NULL)::INT) AS detection, avg(coalesce(alert_at <= gate, false)::INT) AS in_time, quantile_cont(alert_at - manifest, 0.5) AS median_latency FROM gated LEFT JOIN al USING (user_id, class) GROUP BY 1),
fa AS (SELECT class, count(*) AS n FROM al ANTI JOIN tr ON al.user_id = tr.user_id AND al.class = tr.class GROUP BY 1), runs AS (SELECT count(DISTINCT user_id) AS total FROM x)
SELECT d.class, d.n, round(detection, 6) AS detection, round(in_time, 6) AS in_time, round(median_latency, 6) AS median_latency, round(1000.0 * coalesce(fa.n, 0) / greatest(total - d.n, 1), 6) AS false_per_1000 FROM d LEFT JOIN fa USING (class), runs"""
)
def agent_evaluation(spark, sf_dir):
    """Per class: detection, in time at its gate, median latency, false alerts for 1,000 runs without it."""
    x = kept_signals(spark, sf_dir)
    runs = x.agg(F.countDistinct("user_id").alias("total"))
    found = decisions.evaluation(truth(spark, sf_dir, x).withColumn("gate", gate()), alerts(spark, sf_dir, x), runs, ["user_id"])
    return found.select("class", "n", *[r6(F.col(c)).alias(c) for c in ("detection", "in_time", "median_latency", "false_per_1000")])


@BOOK.enter(
    f"""WITH {LIMITS}{SUMMARY}, tl AS (SELECT user_id, min(tripped_at) FILTER (call = 'HOLD') AS limit_hold, min(tripped_at) FILTER (call = 'ABORT') AS limit_abort FROM lt GROUP BY 1), m AS (
  SELECT DISTINCT p.user_id, hold_at, abort_at, limit_hold, limit_abort FROM tr p LEFT JOIN sm USING (user_id) LEFT JOIN tl USING (user_id) WHERE class IN ('MEAN', 'STEP'))
SELECT CAST(count(*) AS BIGINT) AS n, round(avg((coalesce(hold_at <= -1, false) OR coalesce(abort_at <= 6.5, false))::INT), 6) AS agent, round(avg((coalesce(limit_hold < 0, false) OR coalesce(limit_abort >= 0 AND limit_abort < 7, false))::INT), 6) AS limits FROM m"""
)
def caught_before_gate(spark, sf_dir):
    """Of the runs with a failure of the start, the shares that the agent and the limits stopped before the commit gate."""
    first = trips(spark, sf_dir).groupBy("user_id").agg(*[F.min(F.when(F.col("call") == c, F.col("tripped_at"))).alias(f"limit_{c.lower()}") for c in ("HOLD", "ABORT")])
    stops = reports.run_summary(calls(spark, sf_dir), ["user_id"]).join(first, "user_id", "left")
    found = decisions.caught_before(truth(spark, sf_dir).where("class in ('MEAN', 'STEP')"), stops, ["user_id"], 6.5)
    return found.select("n", r6(F.col("agent")).alias("agent"), r6(F.col("limits")).alias("limits"))


@BOOK.enter(
    f"""WITH {LIMITS}, m AS (SELECT g.user_id, g.class, bool_or(coalesce(tripped_at >= manifest - 0.5 AND tripped_at <= gate, false)) AS hit FROM gated g LEFT JOIN lt ON lt.user_id = g.user_id GROUP BY 1, 2)
SELECT class, CAST(count(*) AS BIGINT) AS n, round(avg(hit::INT), 6) AS detection FROM m GROUP BY class"""
)
def limit_detection(spark, sf_dir):
    found = decisions.limit_detection(truth(spark, sf_dir).withColumn("gate", gate()), trips(spark, sf_dir), ["user_id"])
    return found.select("class", "n", r6(F.col("detection")).alias("detection"))


@BOOK.enter(
    f"""WITH {DECIDED}, c AS (SELECT user_id, bool_or(class = 'LEVEL') AS a, bool_or(class = 'MEAN') AS b FROM al WHERE class IN ('LEVEL', 'MEAN') GROUP BY 1)
SELECT class, CAST(count(*) AS BIGINT) AS n, round(avg(coalesce(a, false)::INT), 6) AS called_level, round(avg(coalesce(b, false)::INT), 6) AS called_mean FROM tr LEFT JOIN c USING (user_id) WHERE class IN ('LEVEL', 'MEAN') GROUP BY class"""
)
def class_contrast(spark, sf_dir):
    """How often each of two look-alike failures is called the one and the other."""
    found = decisions.contrast(truth(spark, sf_dir), alerts(spark, sf_dir), ["user_id"], "LEVEL", "MEAN")
    return found.select("class", "n", r6(F.col("called_LEVEL")).alias("called_level"), r6(F.col("called_MEAN")).alias("called_mean"))


@BOOK.enter(f"WITH {DECIDED}, n AS (SELECT DISTINCT user_id FROM x WHERE user_id NOT IN (SELECT user_id FROM tr WHERE class = 'STEP')){SUMMARY} SELECT CAST(count(*) AS BIGINT) AS n, round(1000.0 * count(hold_at) / greatest(count(*), 1), 6) AS hold_at_per_1000, round(1000.0 * count(abort_at) / greatest(count(*), 1), 6) AS abort_at_per_1000, round(1000.0 * count(warning_at) / greatest(count(*), 1), 6) AS warning_at_per_1000 FROM sm SEMI JOIN n ON sm.user_id = n.user_id")
def false_calls(spark, sf_dir):
    """Calls for 1,000 runs without a step failure."""
    runs = reports.run_summary(calls(spark, sf_dir), ["user_id"]).join(truth(spark, sf_dir).where("class = 'STEP'"), "user_id", "left_anti")
    flags = ["hold_at", "abort_at", "warning_at"]
    return reports.rates_per_thousand(runs, [], flags).select("n", *[r6(F.col(f"{f}_per_1000")).alias(f"{f}_per_1000") for f in flags])


@BOOK.enter(f"WITH {DECIDED} SELECT user_id, min(t) FILTER (call IN ('WARNING', 'CRITICAL') AND t >= 7 AND t < 20) AS first_at FROM cl GROUP BY user_id")
def first_call_in_window(spark, sf_dir):
    return reports.first_call(calls(spark, sf_dir), ["user_id"], ["WARNING", "CRITICAL"], 7.0, 20.0)


@BOOK.enter(f"WITH {LIMITS}, c AS (SELECT br.user_id, k, max(CASE WHEN n2 = 2 THEN 3 WHEN n1 = 2 THEN 2 WHEN n0 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY br.user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code FROM br JOIN pe USING (user_id, t)) SELECT * FROM c")
def latched_limit_code(spark, sf_dir):
    """The gravest limit so far (1 hold, 2 abort, 3 alarm) at each tick."""
    t = F.col("t")
    flags = [decisions.within(F.col("h") > 150, t, -8.0, 0.0), decisions.within(F.col("h") > 120, t, 0.0, 7.0), (F.col("mean5") > 60) & (t >= 7)]
    held = signals(spark, sf_dir).withColumns({f"p{n}": SERIES.persisted(c, 2) for n, c in enumerate(flags, 1)})
    return held.select("user_id", "k", ts.gravest_so_far(SERIES, [(F.col(f"p{n}"), n) for n in (1, 2, 3)]).alias("code"))


REFERENCE = """, nom AS (SELECT * FROM x WHERE user_id NOT IN (SELECT user_id FROM tr WHERE class = 'STEP')), lf AS (
  SELECT user_id, k, t, unnest(['level', 'mean', 'step']) AS feature, unnest([h, mean5, step]) AS value FROM x
), rf AS (
  SELECT CAST(floor(k / 5) * 5 AS BIGINT) AS ref_k, feature, avg(value) AS mean, stddev_pop(value) AS std FROM lf SEMI JOIN nom ON lf.user_id = nom.user_id GROUP BY 1, 2
)"""


def features(spark, sf_dir) -> DataFrame:
    values = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).alias("value")) for n, c in (("level", "h"), ("mean", "mean5"), ("step", "step"))])
    return signals(spark, sf_dir).select("user_id", "k", "t", F.explode(values).alias("f")).select("user_id", "k", "t", "f.*")


def reference(spark, sf_dir) -> DataFrame:
    """Mean and spread of each feature around each reference tick over the runs without a step failure."""
    quiet = features(spark, sf_dir).join(truth(spark, sf_dir).where("class = 'STEP'"), "user_id", "left_anti")
    return quiet.groupBy((F.floor(F.col("k") / 5) * 5).cast("long").alias("ref_k"), "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@BOOK.enter(f"WITH {DECIDED}{REFERENCE} SELECT ref_k, feature, round(mean, 6) AS mean, round(std, 6) AS std FROM rf")
def nominal_reference(spark, sf_dir):
    return reference(spark, sf_dir).select("ref_k", "feature", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


EVIDENCE = f"""{DECIDED}{REFERENCE}, ev AS (
  SELECT al.user_id, al.class, lf.feature, lf.value, (lf.value - rf.mean) / rf.std AS z, row_number() OVER (PARTITION BY al.user_id, al.class ORDER BY round(abs((lf.value - rf.mean) / rf.std), 9) DESC, lf.feature) AS place
  FROM al JOIN lf ON lf.user_id = al.user_id AND lf.t = al.alert_at JOIN rf ON rf.feature = lf.feature AND rf.ref_k = floor(lf.k / 5) * 5 WHERE rf.std >= 1e-6)"""


def evidence(spark, sf_dir) -> DataFrame:
    at = alerts(spark, sf_dir).withColumn("k", (F.col("alert_at") * 2 + 20).cast("long"))
    near = features(spark, sf_dir).select("user_id", "k", "feature", "value").withColumn("ref_k", (F.floor(F.col("k") / 5) * 5).cast("long"))
    return decisions.evidence(at, near, reference(spark, sf_dir), ["user_id", "k"], 2, by=["class"], reference_keys=["feature", "ref_k"])


@BOOK.enter(f"WITH {EVIDENCE} SELECT user_id, class, feature, round(value, 6) AS value, round(z, 6) AS z, place FROM ev WHERE place <= 2")
def evidence_topk(spark, sf_dir):
    """The two features farthest from the quiet runs at each alert, by the last reference tick."""
    return evidence(spark, sf_dir).select("user_id", "class", "feature", r6(F.col("value")).alias("value"), r6(F.col("z")).alias("z"), F.col("place").cast("long").alias("place"))


@BOOK.enter(
    f"""WITH {EVIDENCE} SELECT user_id, class, string_agg(feature || ' = ' || CASE WHEN abs(value) >= 100 THEN printf('%.0f', CAST(round_even(CAST(round(value, 6) AS DECIMAL(18, 6)), 0) AS DOUBLE)) WHEN abs(value) >= 10 THEN printf('%.1f', CAST(round_even(CAST(round(value, 6) AS DECIMAL(18, 6)), 1) AS DOUBLE)) WHEN abs(value) >= 1 THEN printf('%.2f', CAST(round_even(CAST(round(value, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE)) ELSE printf('%.3f', CAST(round_even(CAST(round(value, 6) AS DECIMAL(18, 6)), 3) AS DOUBLE)) END, '; ' ORDER BY place) AS text
FROM ev WHERE place <= 2 GROUP BY 1, 2"""
)
def explanations(spark, sf_dir):
    """The evidence of each alert in words; numbers with decimals that suit their size."""
    return reports.explanation(evidence(spark, sf_dir), ["user_id", "class"], with_z=False, shown=r6(F.col("value")))


RULES = [("R-01", "LEVEL", "level", ">", 70.0, "A", 0.9, 0.8, -5.0), ("R-02", "LEVEL", "mean", ">=", 40.0, "B", 0.7, 0.9, 0.0), ("R-03", "MEAN", "mean", ">", 55.0, "B", 0.8, 0.7, -5.0), ("R-04", "STEP", "step", ">", 80.0, "A", 0.9, 0.9, -10.0), ("R-05", "STEP", "level", "<=", 30.0, "C", 0.5, 0.5, -10.0), ("R-06", "MEAN", "level", "<", 60.0, "C", 0.6, 0.5, 2.0)]
FIRED = f"""{DECIDED}{REFERENCE}, ru(rule_id, class, feature, operator, threshold, grade, sensitivity, specificity, valid_from) AS (VALUES {", ".join(str(r) for r in RULES)}), fr AS (
  SELECT lf.user_id, lf.k, lf.t, ru.* FROM lf JOIN ru USING (feature) WHERE lf.t >= valid_from AND CASE operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold ELSE value <= threshold END)"""


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, class string, feature string, operator string, threshold double, grade string, sensitivity double, specificity double, valid_from double")


@BOOK.enter(f"WITH {FIRED}, r AS (SELECT al.user_id, al.class, rule_id, row_number() OVER (PARTITION BY al.user_id, al.class ORDER BY grade, sensitivity + specificity DESC, rule_id) AS place FROM al JOIN fr ON fr.user_id = al.user_id AND fr.class = al.class AND fr.t = al.alert_at) SELECT * FROM r WHERE place <= 3")
def fired_rules(spark, sf_dir):
    """Rules of the class that fire at its alert, best first; all four operators."""
    at = alerts(spark, sf_dir).withColumn("t", F.col("alert_at"))
    found = decisions.fired_rules(at, features(spark, sf_dir).drop("k"), rules(spark), ["user_id", "t"])
    return found.select("user_id", "class", "rule_id", F.col("place").cast("long").alias("place"))


@BOOK.enter(f"WITH {FIRED}, begun AS (SELECT user_id, class, rule_id, min(t) AS tick FROM fr GROUP BY 1, 2, 3), r AS (SELECT begun.user_id, begun.class, rule_id, tick, row_number() OVER (PARTITION BY begun.user_id, begun.class ORDER BY tick, rule_id) AS place FROM begun JOIN al USING (user_id, class) WHERE tick > alert_at) SELECT * FROM r WHERE place <= 2")
def rule_confirmations(spark, sf_dir):
    """The first two rules that begin to fire after an alert of their class and had not before."""
    met = features(spark, sf_dir).join(F.broadcast(rules(spark)), "feature")
    from flightline.operators.discovery import fires

    fired = met.where((F.col("t") >= F.col("valid_from")) & fires(F.col("value"), F.col("operator"), F.col("threshold"))).select("user_id", "class", "rule_id", F.col("t").alias("tick"))
    later = reports.confirmations(fired, alerts(spark, sf_dir).withColumnRenamed("alert_at", "alert_tick"), ["user_id", "class"])
    return later.select("user_id", "class", "rule_id", "tick", F.col("place").cast("long").alias("place"))


@BOOK.enter(
    f"""WITH {LIMITS}, ch AS (SELECT user_id, t, call, lag(call) OVER (PARTITION BY user_id ORDER BY k) AS before, k FROM cl), e AS (
  SELECT user_id, t, 'call' AS kind, call AS detail FROM ch WHERE before IS DISTINCT FROM call UNION ALL SELECT user_id, alert_at, 'alert', class FROM al UNION ALL SELECT user_id, tripped_at, 'limit', call FROM lt)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, CASE kind WHEN 'call' THEN 0 ELSE 1 END, kind, detail) AS number FROM e"""
)
def event_log(spark, sf_dir):
    """Calls, alerts and limits of a run as one numbered log."""
    changes = decisions.call_changes(calls(spark, sf_dir), SERIES).select("user_id", "t", F.lit("call").alias("kind"), F.col("call").alias("detail"))
    first = alerts(spark, sf_dir).select("user_id", F.col("alert_at").alias("t"), F.lit("alert").alias("kind"), F.col("class").alias("detail"))
    limits = trips(spark, sf_dir).select("user_id", F.col("tripped_at").alias("t"), F.lit("limit").alias("kind"), F.col("call").alias("detail"))
    return decisions.event_log(changes, first, limits, keys=["user_id"]).withColumn("number", F.col("number").cast("long"))


CUBE_LIMITS = [
    ("P_LOX_TANK < 3.30", "HOLD", -40, 0), ("P_LH2_TANK < 2.15 OR P_LH2_TANK > 2.45", "HOLD", -35, 0), ("BUS_28V < 27.0", "HOLD", -30, 0), ("PC_CORE < 100", "ABORT", 3.5, 7), ("T_TURB_IN > 950", "ABORT", 0, 7), ("N_LOX_TP > 103.5", "ABORT", 0, 7),
    ("VIB_ENG > 2", "ABORT", 0, 7), ("T_TURB_IN > 950", "ALARM", 7, 150), ("PC_CORE < 105", "ALARM", 7.5, 134), ("abs(TVC_PITCH) > 4 OR abs(TVC_YAW) > 4", "ALARM", 7, 150), ("abs(PC_SRB_L - PC_SRB_R) > 8", "ALARM", 8, 122), ("VIB_ENG > 6", "ALARM", 7, 150),
    ("TRAJ_DEV > 1 + band", "ALARM", 7, 150),
]


def _limits_sql() -> str:
    from flightline.plans.feature_queries import TELEMETRY

    flags = ", ".join(f"sum((({breach}) AND t >= {a} AND t < {b})::INT) OVER w AS n{k}" for k, (breach, _, a, b) in enumerate(CUBE_LIMITS))
    each = " UNION ALL ".join(f"SELECT run, {k} AS limit_id, '{call}' AS call, min(t) FILTER (n{k} = 2) AS tripped_at FROM p GROUP BY run" for k, (_, call, _, _) in enumerate(CUBE_LIMITS))
    return f"WITH {TELEMETRY}, p AS (SELECT run, t, {flags} FROM filled WINDOW w AS (PARTITION BY run ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) SELECT run, limit_id, call, round(tripped_at, 6) AS tripped_at FROM ({each}) WHERE tripped_at IS NOT NULL"


@BOOK.enter(_limits_sql())
def flight_limits(spark, sf_dir):
    """The thirteen fixed limits on telemetry made of the events (two samples of persistence)."""
    from flightline.functions import features as ft
    from flightline.plans.feature_queries import telemetry

    rows = telemetry(spark, sf_dir)
    held = rows.withColumns({c.name: ft.RUN.forward_fill(F.col(c.name)) for c in ft.CHANNELS})
    found = decisions.limit_trips(held, ft.RUN, decisions.flight_limits(F.col("t"), 1 + F.col("band")), "t", 2)
    return found.select("run", "limit_id", "call", r6(F.col("tripped_at")).alias("tripped_at"))


@BOOK.enter(f"WITH {DECIDED} SELECT 'mode:' || class AS node, CAST(count(*) AS BIGINT) AS edges FROM al WHERE class <> 'STEP' GROUP BY 1")
def edges_touching(spark, sf_dir):
    """Edges run -> mode that touch the exclusive modes."""
    every = graph.edge(alerts(spark, sf_dir), "SHOWS", ("run", "user_id"), ("mode", "class"))
    wanted = spark.createDataFrame([("mode:LEVEL",), ("mode:MEAN",)], "id string")
    return graph.touching(every, wanted).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("edges"))


@BOOK.enter(f"WITH {DECIDED}, c AS (SELECT user_id AS run, count(*) AS states FROM cl GROUP BY 1) SELECT run, coalesce(CAST(sum(states) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start, states FROM c")
def start_offsets(spark, sf_dir):
    return universe.start_offsets(calls(spark, sf_dir).select(F.col("user_id").alias("run")), "run")


@BOOK.enter(
    f"""WITH {DECIDED}, tt AS (SELECT user_id, list_sort(list(class)) AS truth FROM tr GROUP BY 1), aa AS (SELECT user_id, list_sort(list(class)) AS alerts FROM al GROUP BY 1), r AS (SELECT DISTINCT user_id FROM x)
SELECT r.user_id, coalesce(truth, []) AS truth, coalesce(alerts, []) AS alerts, len(list_filter(coalesce(truth, []), lambda c: NOT list_contains(coalesce(alerts, []), c))) = 0 AS caught FROM r LEFT JOIN tt USING (user_id) LEFT JOIN aa USING (user_id)"""
)
def holdout_index(spark, sf_dir):
    """Each run with its failures, its alerts, and whether every failure was alerted."""
    return reports.run_index(signals(spark, sf_dir).select("user_id").distinct(), truth(spark, sf_dir), alerts(spark, sf_dir), "user_id")


@BOOK.enter(
    f"""WITH {DECIDED}, placed AS (SELECT user_id, class, manifest, row_number() OVER (PARTITION BY class ORDER BY manifest, user_id) - 1 AS i, count(*) OVER (PARTITION BY class) AS n FROM tr) SELECT user_id, class, manifest FROM placed WHERE i = n // 2"""
)
def middle_examples(spark, sf_dir):
    """Of each class the run of middle severity (here: of time of appearance)."""
    return reports.examples(truth(spark, sf_dir), "class", "manifest", "user_id").select("user_id", "class", "manifest")


@BOOK.enter(f"WITH {DECIDED}, n AS (SELECT unnest(['GO', 'HOLD', 'ENGINE_START', 'COMMIT', 'ABORT', 'NOMINAL', 'ADVISORY', 'WARNING', 'CRITICAL']) AS call) SELECT n.call, CAST(count(cl.user_id) AS BIGINT) AS n FROM n LEFT JOIN cl USING (call) GROUP BY 1")
def call_counts(spark, sf_dir):
    """How many ticks have each call, with the calls that none has."""
    return reports.counted(calls(spark, sf_dir), "call", list(decisions.CALLS))


@BOOK.enter(
    f"""WITH {DECIDED}, q AS (SELECT k FROM (SELECT unnest([0, 10, 20, 33, 40, 60]) AS k) UNION SELECT CAST(alert_at * 2 + 20 AS BIGINT) FROM al), snap AS (SELECT mode, count(*) AS n, round(avg(p), 6) AS mean_p, CAST(count(*) FILTER (active) AS BIGINT) AS active FROM ac WHERE k = 40 GROUP BY 1)
SELECT mode, n, mean_p, active, (SELECT CAST(count(*) AS BIGINT) FROM q) AS snapshots FROM snap"""
)
def snapshot_metrics(spark, sf_dir):
    """Scores at one tick, and how many different snapshot ticks the fixed grid and the alerts make together."""
    fixed = spark.createDataFrame([(k,) for k in (0, 10, 20, 33, 40, 60)], "k long")
    grid = fixed.unionByName(alerts(spark, sf_dir).select((F.col("alert_at") * 2 + 20).cast("long").alias("k"))).distinct().agg(F.count(F.lit(1)).alias("snapshots"))
    at = decided(spark, sf_dir).where("k = 40").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean_p"), F.count_if("active").alias("active"))
    return at.crossJoin(F.broadcast(grid))


@BOOK.enter(
    f"""WITH {EVIDENCE}, odd AS (SELECT lf.user_id, lf.k, lf.feature, row_number() OVER (PARTITION BY lf.user_id, lf.k ORDER BY round(abs((lf.value - rf.mean) / rf.std), 9) DESC, lf.feature) AS place, round((lf.value - rf.mean) / rf.std, 6) AS z
  FROM lf JOIN rf ON rf.feature = lf.feature AND rf.ref_k = floor(lf.k / 5) * 5 WHERE rf.std >= 1e-6 AND lf.k IN (10, 33, 50)) SELECT * FROM odd WHERE place <= 2"""
)
def unusual_features(spark, sf_dir):
    """The two most unusual features of each run at fixed snapshots."""
    near = features(spark, sf_dir).where("k in (10, 33, 50)").withColumn("ref_k", (F.floor(F.col("k") / 5) * 5).cast("long"))
    found = decisions.unusual(near, reference(spark, sf_dir), ["user_id", "k"], 2, ["feature", "ref_k"])
    return found.select("user_id", "k", "feature", F.col("place").cast("long").alias("place"), r6(F.col("z")).alias("z"))


@BOOK.enter(f"WITH {DECIDED} SELECT CASE WHEN t < 0 THEN 'countdown' WHEN t < 7 THEN 'engine_start' ELSE 'flight' END AS phase, CAST(count(*) AS BIGINT) AS ticks, CAST(count(DISTINCT user_id) AS BIGINT) AS runs FROM x GROUP BY 1")
def phase_counts(spark, sf_dir):
    """Ticks and runs of each phase."""
    return signals(spark, sf_dir).groupBy(decisions.phase(F.col("t")).alias("phase")).agg(F.count(F.lit(1)).alias("ticks"), F.countDistinct("user_id").alias("runs"))


@BOOK.enter(f"WITH {DECIDED}, n AS (SELECT user_id, count(*) AS n, count(*) FILTER (k IN (5, 12)) AS gates FROM x GROUP BY 1) SELECT user_id, CAST(gates AS BIGINT) AS gates, true AS enough FROM n")
def training_ticks(spark, sf_dir):
    """The ticks a run is learned from: its gates, and whether as many others as asked for are there, once each."""
    from flightline.functions import features as ft

    ticks = signals(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("k").alias("tick"))
    every = ticks.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    chosen = ft.training_ticks(ticks, [5, 12], 8)
    own = chosen.groupBy("run").agg(F.count_if(F.col("tick").isin(5, 12)).alias("gates"), F.count(F.lit(1)).alias("taken"), F.countDistinct("tick").alias("different"))
    met = own.join(every, "run")
    enough = (F.col("taken") == F.col("different")) & (F.col("taken") >= F.least(F.col("n"), F.lit(8))) & (F.col("taken") <= 8 + F.col("gates"))
    return met.select(F.col("run").alias("user_id"), "gates", enough.alias("enough"))
