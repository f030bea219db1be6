"""From scores to calls: debounce, threshold, exclusion, latch, phase call, evidence and event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.functions.timeseries import Series, first_true

# When each phase begins, from when an engine start is committed, and the calls.
IGNITION, COMMIT, FLIGHT, IGNITION_GATE = 0.0, 6.5, 7.0, -1.0
CALLS = ("GO", "HOLD", "ENGINE_START", "COMMIT", "ABORT", "NOMINAL", "ADVISORY", "WARNING", "CRITICAL")


def phase(t: Column) -> Column:
    return F.when(t < IGNITION, "countdown").when(t < FLIGHT, "engine_start").otherwise("flight")


def alert_level(mode: Column, t: Column, critical: list[str], warning: list[str]) -> Column:
    """The call that an alert on ``mode`` raises when first confirmed at ``t``."""
    return F.when(t < IGNITION, "HOLD").when(t < FLIGHT, "ABORT").when(mode.isin(critical), "CRITICAL").when(mode.isin(warning), "WARNING").otherwise("ADVISORY")


def decide(scores: DataFrame, series: Series, score: str, threshold: str, group: str | None = None, member: str = "mode", ticks: int = 2) -> DataFrame:
    """Add ``held`` (debounced score), ``active`` and ``latched``.

    ``series`` is one mode of one run.  In each exclusive ``group`` only the mode with the greatest held
    score can be active at a tick, ties to the first member.
    """
    held = scores.withColumn("held", series.debounced(F.col(score), ticks))
    over = F.col("held") >= F.col(threshold)
    if group:
        rivals = Window.partitionBy(*[k for k in series.entity if k != member], *series.order, group).orderBy(F.desc(over), F.desc("held"), member)
        first = F.row_number().over(rivals) == 1
        over = over & (F.col(group).isNull() | first)
    active = held.withColumn("active", over)
    return active.withColumn("latched", series.latched(F.col("active")))


def call(t: Column, any_on: Column, critical: Column, warning: Column) -> Column:
    """The call of a tick from what is latched at it: any mode, one of the critical ones, one of the warning ones."""
    start = F.when(any_on, "ABORT").when(t >= COMMIT, "COMMIT").otherwise("ENGINE_START")
    flight = F.when(critical, "CRITICAL").when(warning, "WARNING").when(any_on, "ADVISORY").otherwise("NOMINAL")
    return F.when(t < IGNITION, F.when(any_on, "HOLD").otherwise("GO")).when(t < FLIGHT, start).otherwise(flight)


def calls(decided: DataFrame, series: Series, time: str, critical: list[str], warning: list[str], member: str = "mode") -> DataFrame:
    """From :func:`decide` (a row for each mode): the call of each tick."""
    on = F.col("latched")
    keys = [k for k in series.entity if k != member]
    ticks = decided.groupBy(*keys, *series.order, time).agg(F.bool_or(on).alias("_any"), F.bool_or(on & F.col(member).isin(critical)).alias("_critical"), F.bool_or(on & F.col(member).isin(warning)).alias("_warning"))
    return ticks.select(*keys, *series.order, time, call(F.col(time), F.col("_any"), F.col("_critical"), F.col("_warning")).alias("call"))


def call_changes(calls: DataFrame, series: Series) -> DataFrame:
    return calls.withColumn("_changed", series.changed(F.col("call"))).where("_changed").drop("_changed")


def evidence(alerts: DataFrame, features: DataFrame, reference: DataFrame, keys: list[str], k: int = 3, by: list[str] | None = None, reference_keys: list[str] | None = None) -> DataFrame:
    """The ``k`` features farthest from their reference for each alert: z from ``mean, std``; hardly varying references are skipped.

    An alert is told by ``keys`` and ``by``; features are met on ``keys``, references on ``reference_keys`` (the feature).
    """
    z = (F.col("value") - F.col("mean")) / F.col("std")
    met = alerts.join(features, keys).join(reference, reference_keys or ["feature"]).where("std >= 1e-6").withColumn("z", z)
    place = F.row_number().over(Window.partitionBy(*keys, *(by or [])).orderBy(F.desc(F.round(F.abs("z"), 9)), "feature"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def unusual(features: DataFrame, reference: DataFrame, keys: list[str], k: int = 8, reference_keys: list[str] | None = None) -> DataFrame:
    """The ``k`` features of each snapshot (``keys``) that lie farthest from their reference, by ``z``; hardly varying references are skipped."""
    z = (F.col("value") - F.col("mean")) / F.col("std")
    met = features.join(reference, reference_keys or ["feature"]).where("std >= 1e-6 and value is not null").withColumn("z", z)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("z"), 9)), "feature"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def limit_trips(samples: DataFrame, series: Series, limits: list[tuple[str, Column, str]], time: str, persistence: int = 5) -> DataFrame:
    """First time each fixed limit has been broken ``persistence`` samples on end, with its call: ``limits`` are (name, breach, call)."""
    names = [f"_{k}" for k in range(len(limits))]
    flags = samples.select(*series.entity, *series.order, F.col(time).alias("_t"), *[series.persisted(breach, persistence).alias(n) for n, (_, breach, _) in zip(names, limits, strict=True)])
    trips = flags.groupBy(*series.entity).agg(*[F.min(F.when(F.col(n), F.col("_t"))).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(k).alias("limit_id"), F.lit(name).alias("limit"), F.lit(said).alias("call"), F.col(n).alias("tripped_at")) for k, (n, (name, _, said)) in enumerate(zip(names, limits, strict=True))])
    return trips.select(*series.entity, F.explode(rows).alias("_trip")).select(*series.entity, "_trip.*").where("tripped_at is not null")


def within(breach: Column, time: Column, start: float, stop: float) -> Column:
    """A limit that holds in [start, stop) only."""
    return breach & (time >= start) & (time < stop)


def flight_limits(t: Column, corridor: Column) -> list[tuple[str, Column, str]]:
    """The thirteen fixed limits on the channels, with their windows and calls (fixed values); ``corridor`` is the width allowed to the deviation."""
    c = F.col
    rows = [
        ("lox_low", "HOLD", -40.0, 0.0, c("P_LOX_TANK") < 3.30),
        ("lh2_off", "HOLD", -35.0, 0.0, (c("P_LH2_TANK") < 2.15) | (c("P_LH2_TANK") > 2.45)),
        ("bus_low", "HOLD", -30.0, 0.0, c("BUS_28V") < 27.0),
        ("chamber_slow", "ABORT", 3.5, 7.0, c("PC_CORE") < 100.0),
        ("turbine_hot_at_start", "ABORT", 0.0, 7.0, c("T_TURB_IN") > 950.0),
        ("pump_fast", "ABORT", 0.0, 7.0, c("N_LOX_TP") > 103.5),
        ("shaking_at_start", "ABORT", 0.0, 7.0, c("VIB_ENG") > 2.0),
        ("turbine_hot_in_flight", "ALARM", 7.0, 150.0, c("T_TURB_IN") > 950.0),
        ("chamber_low", "ALARM", 7.5, 134.0, c("PC_CORE") < 105.0),
        ("nozzle_far", "ALARM", 7.0, 150.0, (F.abs(c("TVC_PITCH")) > 4.0) | (F.abs(c("TVC_YAW")) > 4.0)),
        ("boosters_apart", "ALARM", 8.0, 122.0, F.abs(c("PC_SRB_L") - c("PC_SRB_R")) > 8.0),
        ("shaking_in_flight", "ALARM", 7.0, 150.0, c("VIB_ENG") > 6.0),
        ("off_path", "ALARM", 7.0, 150.0, c("TRAJ_DEV") > corridor),
    ]
    return [(name, within(breach, t, start, stop), said) for name, said, start, stop, breach in rows]


def event_log(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Events of several kinds as one table ``keys, t, kind, detail``, numbered in order (calls first at equal times)."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("t", F.when(F.col("kind") == "call", 0).otherwise(1), "kind", "detail")))


def detection(truth: DataFrame, alerts: DataFrame, keys: list[str], gate: Column) -> DataFrame:
    """For each class: positives, share detected, share in time, median latency; where the ``gate`` is NULL any alert is in time."""
    met = truth.join(alerts, keys, "left")
    seen = F.col("alert_at").isNotNull()
    late = F.col("alert_at") - F.col("manifest")
    return met.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.avg(seen.cast("double")).alias("detection"), F.avg((seen & (gate.isNull() | F.coalesce(F.col("alert_at") <= gate, F.lit(False)))).cast("double")).alias("in_time"), F.percentile(F.when(seen, late), F.lit(0.5)).alias("median_latency")
    )


def gate_of(mode: Column, manifest: Column, before_ignition: list[str], before_commit: list[str], by_manifest: list[str]) -> Column:
    """The time by which an alert must be out: at the ignition gate, at the commit gate, or NULL for any time.

    Modes ``by_manifest`` have the commit gate only in runs in which they show by then.
    """
    commit = mode.isin(before_commit) | (mode.isin(by_manifest) & (manifest <= COMMIT))
    return F.when(mode.isin(before_ignition), IGNITION_GATE).when(commit, COMMIT)


def evaluation(truth: DataFrame, alerts: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`detection` of each class (``truth`` with its ``gate``), and false alerts for 1,000 runs without it; ``runs`` is one row with ``total``."""
    found = detection(truth, alerts, [*keys, "class"], F.col("gate"))
    wrong = false_alerts(alerts, truth, [*keys, "class"]).groupBy("class").agg(F.count(F.lit(1)).alias("_wrong"))
    rate = 1000.0 * F.coalesce("_wrong", F.lit(0)) / F.greatest(F.col("total") - F.col("n"), F.lit(1))
    return found.join(wrong, "class", "left").crossJoin(F.broadcast(runs)).withColumn("false_per_1000", rate).drop("_wrong", "total")


def false_alerts(alerts: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    return alerts.join(truth.select(*keys), keys, "left_anti")


def fired_rules(alerts: DataFrame, features: DataFrame, rules: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` best rules of each alert's class that fire at it: by grade, then by sensitivity and specificity together.

    ``features`` are ``keys, feature, value``; rules hold from their ``valid_from`` on.
    """
    from flightline.operators.discovery import fires

    met = alerts.join(F.broadcast(rules), "class").join(features, [*keys, "feature"])
    hit = met.where((F.col("t") >= F.col("valid_from")) & fires(F.col("value"), F.col("operator"), F.col("threshold")))
    place = F.row_number().over(Window.partitionBy(*keys, "class").orderBy("grade", F.desc(F.col("sensitivity") + F.col("specificity")), "rule_id"))
    return hit.withColumn("place", place).where(F.col("place") <= k)


def caught_before(truth: DataFrame, stops: DataFrame, keys: list[str], gate: float, ignition_gate: float = -1.0) -> DataFrame:
    """Of the runs with a failure of the group (``truth``: ``keys``), the shares that were stopped in time.

    ``stops`` has ``keys, hold_at, abort_at`` (the calls) and ``limit_hold, limit_abort`` (the limits' first trips).
    A hold counts before ignition; an abort up to the gate, a limit's up to half a second after it.
    """
    met = truth.select(*keys).distinct().join(stops, keys, "left")
    agent = F.coalesce(F.col("hold_at") <= min(gate, ignition_gate), F.lit(False)) | F.coalesce(F.col("abort_at") <= gate, F.lit(False))
    limits = F.coalesce(F.col("limit_hold") < 0, F.lit(False))
    if gate > 0:
        limits = limits | F.coalesce((F.col("limit_abort") >= 0) & (F.col("limit_abort") < gate + 0.5), F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    return met.agg(F.count(F.lit(1)).alias("n"), share(agent).alias("agent"), share(limits).alias("limits"))


def limit_detection(truth: DataFrame, trips: DataFrame, keys: list[str], early: float = 0.5) -> DataFrame:
    """For each class, the share of its runs (``keys, class, manifest, gate``) in which any limit tripped from ``early`` before the failure shows up to the gate."""
    met = truth.join(trips.select(*keys, "tripped_at"), keys, "left")
    hit = F.coalesce((F.col("tripped_at") >= F.col("manifest") - early) & (F.col("tripped_at") <= F.col("gate")), F.lit(False))
    runs = met.groupBy(*keys, "class").agg(F.bool_or(hit).alias("hit"))
    return runs.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("detection"))


def contrast(truth: DataFrame, alerts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Two classes that are mistaken for each other: for runs of each, the shares that were called the one and the other."""
    called = alerts.where(F.col("class").isin(a, b)).groupBy(*keys).agg(F.bool_or(F.col("class") == a).alias("as_a"), F.bool_or(F.col("class") == b).alias("as_b"))
    met = truth.where(F.col("class").isin(a, b)).join(called, keys, "left")
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return met.groupBy("class").agg(F.count(F.lit(1)).alias("n"), share("as_a").alias(f"called_{a}"), share("as_b").alias(f"called_{b}"))


__all__ = [
    "alert_level", "call", "call_changes", "calls", "caught_before", "contrast", "decide", "detection", "event_log", "evidence", "false_alerts", "fired_rules", "first_true", "flight_limits", "limit_detection", "limit_trips",
    "phase", "unusual", "within",
]
