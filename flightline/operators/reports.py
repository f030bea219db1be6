"""Reports over rules, alerts and runs: documents, consistency, hand-off, explanations, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightline.operators import discovery

GRADE_RANK = {"A": 1, "B": 2, "C": 3, "D": 4}


def at_least(grade: Column, cut: str) -> Column:
    """Whether a grade is as good as ``cut``."""
    rank = F.create_map(*[F.lit(x) for pair in GRADE_RANK.items() for x in pair])
    return rank[grade] <= GRADE_RANK[cut]


def rules_document(rules: DataFrame, cut: str = "B") -> DataFrame:
    """One JSON document for each class: its rules of grade ``cut`` or better, best first, rounded to 4 places."""
    kept = rules.where(at_least(F.col("grade"), cut))
    entry = F.struct((-F.col("f1")).alias("_order"), "feature", "operator", F.round("threshold", 4).alias("threshold"), F.round("sensitivity", 4).alias("sensitivity"), F.round("specificity", 4).alias("specificity"), F.round("f1", 4).alias("f1"), "grade")
    listed = kept.groupBy("class").agg(F.array_sort(F.collect_list(entry)).alias("rules"))
    return listed.select("class", F.to_json(F.struct("class", F.transform("rules", lambda r: r.dropFields("_order")).alias("rules"))).alias("document"))


def catalogue(labels: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """For each class of ``run, class, severity``: positives, prevalence over all runs (``runs``: one row with ``total``), median severity, and whether positives are enough."""
    found = labels.groupBy("class").agg(F.count(F.lit(1)).alias("positives"), F.percentile("severity", F.lit(0.5)).alias("median_severity"))
    met = found.crossJoin(F.broadcast(runs))
    return met.select("class", "positives", (F.col("positives") / F.col("total")).alias("prevalence"), "median_severity", (F.col("positives") >= least).alias("enough"))


def failure_counts(labels: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: runs without any failure, and runs with two or more."""
    per = labels.groupBy("run").agg(F.countDistinct("class").alias("k"))
    return per.agg(F.count(F.lit(1)).alias("some"), F.count_if(F.col("k") >= 2).alias("several")).crossJoin(F.broadcast(runs)).select((F.col("total") - F.col("some")).alias("nominal"), "several")


def listed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The sorted distinct values of each key."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(value))


def duplicates(rules: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once."""
    return rules.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlapping(groups: DataFrame) -> DataFrame:
    """Pairs of groups (``id, members``) that share a member: met through the shared member, not by a cross join."""
    member = groups.select("id", F.explode("members").alias("member"))
    other = member.select(F.col("id").alias("other"), "member")
    return member.join(other, "member").where("id < other").groupBy("id", "other").agg(F.array_sort(F.collect_set("member")).alias("shared"))


def hand_off(rules: DataFrame) -> DataFrame:
    """For each class, rule ids to deploy (A, B), to review (C) and to drop (D)."""
    bucket = F.when(F.col("grade").isin("A", "B"), "deploy").when(F.col("grade") == "C", "review").otherwise("drop")
    return rules.groupBy("class", bucket.alias("bucket")).agg(F.array_sort(F.collect_list("rule_id")).alias("rules"))


def validation_summary(validated: DataFrame) -> DataFrame:
    """Number of rules, how many fell too far on other rows, and mean and median of their F1 there."""
    return validated.agg(F.count(F.lit(1)).alias("n_rules"), F.count_if("overfit").alias("n_overfit"), F.avg("valid_f1").alias("mean_f1"), F.percentile("valid_f1", F.lit(0.5)).alias("median_f1"))


def uncovered(classes: DataFrame, rules: DataFrame) -> DataFrame:
    return classes.join(rules.select("class").distinct(), "class", "left_anti")


def rule_set_f1(rules: DataFrame, obs: DataFrame, row_id: str) -> DataFrame:
    """F1 of each class's rules taken together (any of them fires)."""
    # A few rules of each class: they are broadcast, as an exchange by class and feature would bring all rows of one to one task.
    met = obs.join(F.broadcast(rules.select("class", "feature", "operator", "threshold")), ["class", "feature"])
    fired = met.groupBy("class", row_id).agg(F.max(discovery.fires(F.col("value"), F.col("operator"), F.col("threshold")).cast("int")).alias("hit"), F.max("y").alias("y"))
    tp, hit, pos = F.sum(F.col("hit") * F.col("y")), F.sum("hit"), F.sum("y")
    return fired.groupBy("class").agg(F.coalesce(F.try_divide(2 * tp, hit + pos), F.lit(0.0)).alias("f1"))


def regression(now: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Each class's F1 against an earlier one (``class, f1``): ``class, f1, baseline, delta, regressed``; a class without an earlier one has NULLs."""
    met = now.join(baseline.select("class", F.col("f1").alias("baseline")), "class", "left").withColumn("delta", F.col("f1") - F.col("baseline"))
    return met.withColumn("regressed", F.coalesce(F.col("delta") < -tolerance, F.lit(False)))


def contradictions(exclusive: DataFrame, equivalent: DataFrame) -> DataFrame:
    """Pairs of classes (``a, b``) that are both in an exclusive group and called equivalent."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair(exclusive).join(pair(equivalent), ["a", "b"], "left_semi").distinct()


def summary(correlations: DataFrame, rules: DataFrame, most: int = 200) -> DataFrame:
    """One row: how many correlations, rules and rules of each grade there are, and the strongest correlations (``most`` at most)."""
    strongest = correlations.orderBy(F.desc(F.abs("r")), "class", "feature").limit(most)
    listed = strongest.agg(F.count(F.lit(1)).alias("kept"), F.max(F.abs("r")).alias("strongest_r"))
    sizes = rules.agg(F.count(F.lit(1)).alias("n_rules"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in GRADE_RANK])
    return correlations.agg(F.count(F.lit(1)).alias("n_correlations")).crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(sizes))


def magnitude(value: Column, shown: Column | None = None) -> Column:
    """A number with decimals that suit its size; ``shown`` is the number spelled, if another (the value rounded, say) than the one whose size counts."""
    size = F.abs(value)
    spelled = lambda n: F.format_string(f"%.{n}f", F.bround(value if shown is None else shown, n))
    digits = F.when(size >= 100, spelled(0)).when(size >= 10, spelled(1)).when(size >= 1, spelled(2)).otherwise(spelled(3))
    return F.coalesce(F.when(F.isnan(value) | (size == float("inf")), "n/a").otherwise(digits), F.lit("n/a"))


def explanation(evidence: DataFrame, keys: list[str], with_z: bool = True, shown: Column | None = None) -> DataFrame:
    """One sentence for each alert from its evidence rows (``feature, value, z, place``), with ``shown`` spelled for the value, as :func:`magnitude` does."""
    part = [F.col("feature"), F.lit(" = "), magnitude(F.col("value"), shown)] + [F.format_string(" (z %+.1f)", F.col("z"))] * with_z
    parts = evidence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.concat(*part).alias("part")))).alias("parts"))
    return parts.select(*keys, F.concat_ws("; ", F.transform("parts", lambda p: p["part"])).alias("text"))


def confirmations(fired: DataFrame, alerts: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """The first ``most`` rules that fire after an alert and had not fired before it: ``fired`` has ``rule_id, tick``."""
    first = fired.groupBy(*keys, "rule_id").agg(F.min("tick").alias("tick"))
    later = first.join(alerts.select(*keys, "alert_tick"), keys).where("tick > alert_tick")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("tick", "rule_id"))
    return later.withColumn("place", place).where(F.col("place") <= most)


def run_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    """First hold, abort and warning (or worse) of each run from ``call, t``; calls after the first stop do not count."""
    stop = F.min(F.when(F.col("call").isin("HOLD", "ABORT"), F.col("t"))).over(Window.partitionBy(*keys))
    live = calls.withColumn("_stop", stop).where("_stop is null or t <= _stop")
    first = lambda *names: F.min(F.when(F.col("call").isin(*names), F.col("t")))
    return live.groupBy(*keys).agg(first("HOLD").alias("hold_at"), first("ABORT").alias("abort_at"), first("WARNING", "CRITICAL").alias("warning_at"))


def first_call(calls: DataFrame, keys: list[str], names: list[str], start: float, stop: float) -> DataFrame:
    """First time in [start, stop) at which a run has one of the calls (NULL: never)."""
    return calls.groupBy(*keys).agg(F.min(F.when(F.col("call").isin(names) & (F.col("t") >= start) & (F.col("t") < stop), F.col("t"))).alias("first_at"))


def rates_per_thousand(summary: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(1000 * F.count(f) / n).alias(f"{f}_per_1000") for f in flags])


def counted(rows: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """How many rows have each of the ``codes``, those that none has too."""
    every = rows.sparkSession.createDataFrame([(c,) for c in codes], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def run_index(runs: DataFrame, truth: DataFrame, alerts: DataFrame, run: str) -> DataFrame:
    """``run, truth, alerts, caught``: each run's failures and alerts as sorted lists, and whether all failures were alerted."""
    listed = lambda df, name: df.groupBy(run).agg(F.array_sort(F.collect_set("class")).alias(name))
    none = F.array().cast("array<string>")
    met = runs.join(listed(truth, "truth"), run, "left").join(listed(alerts, "alerts"), run, "left").withColumns({c: F.coalesce(c, none) for c in ("truth", "alerts")})
    return met.withColumn("caught", F.size(F.array_except("truth", "alerts")) == 0)


def examples(runs: DataFrame, group: str, severity: str, key: str) -> DataFrame:
    """The run of middle severity of each group."""
    ordered = Window.partitionBy(group).orderBy(severity, key)
    placed = runs.withColumns({"_place": F.row_number().over(ordered) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(group))})
    return placed.where(F.col("_place") == F.floor(F.col("_n") / 2)).drop("_place", "_n")


def significant(value: Column, digits: int = 6) -> Column:
    """A number rounded to so many significant digits (0, NaN and infinities as they are)."""
    place = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - place)
    return F.when((value == 0) | F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(F.bround(value * scale) / scale)


def clean_json(columns: list[str], decimals: int = 4) -> Column:
    """A row as JSON with NaN and infinities as null and numbers rounded."""
    good = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(None)).otherwise(F.round(c, decimals))
    return F.to_json(F.struct(*[good(c).alias(c) for c in columns]), {"ignoreNullFields": "false"})


def side_by_side(agent: DataFrame, limits: DataFrame) -> DataFrame:
    """The agent's figures of each class (:func:`decisions.evaluation`) beside the share that the fixed limits caught."""
    left = agent.select("class", "n", F.col("detection").alias("agent_detection"), F.col("in_time").alias("agent_in_time"), F.col("median_latency").alias("agent_latency"), F.col("false_per_1000").alias("agent_false_per_1000"))
    return left.join(limits.select("class", F.col("detection").alias("limit_detection")), "class", "left")
