"""Finding and grading clear-text threshold rules.

Input is a long table ``(row_id, feature, value)`` (NULLs absent) and labels ``(row_id, class, y)``;
``observations`` makes the one table that the rest aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.  Rules: least sensitivity, specificity and number of positives of each grade; exclusive groups: greatest
# share of violations; equivalent classes: least substitution rate and cosine.  Everything else is a D.
RULE_GRADES = (("A", 0.80, 0.80, 50), ("B", 0.60, 0.60, 20), ("C", 0.40, 0.40, 10))
EXCLUSIVE_GRADES = (("A", 0.01), ("B", 0.05), ("C", 0.10))
EQUIVALENCE_GRADES = (("A", 0.80, 0.95), ("B", 0.60, 0.90), ("C", 0.40, 0.85))


def unpivot(wide: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    return wide.select(row_id, *[F.col(f).cast("double") for f in features]).unpivot(row_id, features, "feature", "value").where("value is not null")


def observations(wide: DataFrame, row_id: str, features: list[str], labels: dict[str, Column]) -> DataFrame:
    """``row_id, class, feature, value, y``: each present feature of a row with each class's label of it.

    Features and labels (0/1 columns by class) stand in one row, so this is one projection without a join.
    """
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    marks = F.array(*[F.struct(F.lit(c).alias("class"), y.cast("double").alias("y")) for c, y in labels.items()])
    each = wide.select(row_id, F.explode(values).alias("f"), marks.alias("labels")).where("f.value is not null")
    return each.select(row_id, "f.feature", "f.value", F.explode("labels").alias("l")).select(row_id, "l.class", "feature", "value", "l.y")


def associations(obs: DataFrame, least: int = 10) -> DataFrame:
    """Point-biserial r, its p-value and Cohen's d for each class and feature; classes with under ``least`` of either label are skipped."""
    v = F.col("value")
    sums = obs.groupBy("class", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"), F.avg(F.when(F.col("y") == 1, v)).alias("m1"), F.avg(F.when(F.col("y") == 0, v)).alias("m0"),
        F.stddev_samp(v).alias("sd"), F.coalesce(F.var_samp(F.when(F.col("y") == 1, v)), F.lit(0.0)).alias("v1"), F.coalesce(F.var_samp(F.when(F.col("y") == 0, v)), F.lit(0.0)).alias("v0"),
    ).withColumn("n0", F.col("n") - F.col("n1")).where((F.col("n1") >= least) & (F.col("n0") >= least))
    n, n1, n0 = F.col("n"), F.col("n1"), F.col("n0")
    r = F.when(F.col("sd") < 1e-12, 0.0).otherwise((F.col("m1") - F.col("m0")) / F.col("sd") * F.sqrt(n1 * n0 / (n * n)))
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n - 2))
    with_r = sums.withColumn("r", r)
    t = F.abs(F.col("r")) * F.sqrt((n - 2) / (1 - F.col("r") * F.col("r")))
    p = F.when(F.col("sd") < 1e-12, 1.0).when(F.abs("r") > 0.9999, 0.0).otherwise(2 * normal_tail(t))
    return with_r.select("class", "feature", "n", n1.cast("long").alias("n1"), "r", p.alias("p"), F.when(pooled < 1e-12, 0.0).otherwise((F.col("m1") - F.col("m0")) / pooled).alias("d"))


def normal_tail(x: Column) -> Column:
    """Upper tail of the standard normal for x >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly


def strongest(assoc: DataFrame, k: int) -> DataFrame:
    """The ``k`` features of each class with the greatest absolute r, ties by name."""
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc(F.abs("r")), "feature"))
    return assoc.withColumn("place", place).where(F.col("place") <= k)


def family(feature: Column, parts: int = 3) -> Column:
    return F.substring_index(feature, "_", parts)


def sweep(obs: DataFrame, points: int = 50) -> DataFrame:
    """The best rule ``value > t`` or ``value < t`` of each class and feature by F1.

    Thresholds are the interior points of an even grid over the feature's range; ties go to the lowest
    threshold and to ``>`` before ``<``.  Each value falls in one cell of the grid and only counts of
    cells go through the exchange, so the sweep costs one pass, not one for each threshold.
    """
    scale = obs.groupBy("class", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).where((F.col("hi") - F.col("lo") >= 1e-10) & (F.col("pos") >= 2))
    t = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points + 1)
    guess = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (points + 1)).cast("int")
    # Thresholds strictly below the value, and those at or below it; rounding is settled by comparing with the grid.
    near = [guess - 1, guess, guess + 1]
    below = F.greatest(*[F.when((i >= 1) & (i <= points) & (F.col("value") > t(i)), i).otherwise(0) for i in near])
    reached = F.greatest(*[F.when((i >= 1) & (i <= points) & (F.col("value") >= t(i)), i).otherwise(0) for i in near])
    # One row for each class and feature: a catalogue, so it may be broadcast.
    placed = obs.join(F.broadcast(scale.select("class", "feature", "lo", "hi")), ["class", "feature"]).withColumns({"below": below, "reached": reached})
    cells = placed.groupBy("class", "feature", "below", "reached").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    grid = scale.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(points))))
    total = lambda flag, c: F.sum(F.when(flag, F.col(c)).otherwise(0))
    # A feature's cells are at most 2 * points + 1, so this join is small for each key.
    counts = grid.join(cells, ["class", "feature"]).groupBy("class", "feature", "i", "lo", "hi", "pos", "n").agg(
        total(F.col("below") >= F.col("i"), "p").alias("tp_gt"), total(F.col("below") >= F.col("i"), "c").alias("hit_gt"), total(F.col("reached") < F.col("i"), "p").alias("tp_lt"), total(F.col("reached") < F.col("i"), "c").alias("hit_lt")
    )
    either = counts.select("class", "feature", "i", "lo", "hi", "pos", "n", F.explode(F.array(F.struct(F.lit(0).alias("op_ix"), F.lit(">").alias("operator"), F.col("tp_gt").alias("tp"), F.col("hit_gt").alias("hit")), F.struct(F.lit(1).alias("op_ix"), F.lit("<").alias("operator"), F.col("tp_lt").alias("tp"), F.col("hit_lt").alias("hit")))).alias("x")).select("*", "x.*")
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("pos") + F.col("hit")), F.lit(0.0))
    scored = either.withColumn("f1", f1)
    place = F.row_number().over(Window.partitionBy("class", "feature").orderBy(F.desc("f1"), "i", "op_ix"))
    sens, spec = F.col("tp") / F.col("pos"), 1 - F.coalesce(F.try_divide(F.col("hit") - F.col("tp"), F.col("n") - F.col("pos")), F.lit(0.0))
    return scored.withColumn("place", place).where("place = 1 and f1 > 0").select("class", "feature", "operator", t(F.col("i")).alias("threshold"), sens.alias("sensitivity"), spec.alias("specificity"), "f1", F.col("pos").cast("long").alias("n_positive"))


def _graded(cases: list[tuple[str, Column]]) -> Column:
    out = F.lit("D")
    for name, good in reversed(cases):
        out = F.when(good, name).otherwise(out)
    return out


def grade(sensitivity: Column, specificity: Column, n_positive: Column) -> Column:
    """Grade of a rule; limits are inclusive."""
    return _graded([(g, (sensitivity >= a) & (specificity >= b) & (n_positive >= n)) for g, a, b, n in RULE_GRADES])


def grade_exclusive(violation_rate: Column) -> Column:
    return _graded([(g, violation_rate <= most) for g, most in EXCLUSIVE_GRADES])


def grade_equivalence(substitution_rate: Column, similarity: Column) -> Column:
    return _graded([(g, (substitution_rate >= a) & (similarity >= b)) for g, a, b in EQUIVALENCE_GRADES])


def candidate_rules(obs: DataFrame, top: int = 5, points: int = 50) -> DataFrame:
    """The best threshold rule on each of a class's ``top`` features by correlation, with a ``candidate_id``.

    Ids count a class's features in order of their correlation, before rules are put in order of F1.
    """
    chosen = strongest(associations(obs), top).select("class", "feature", "r", "place")
    # At most ``top`` rows for each class of the catalogue.
    own = obs.join(F.broadcast(chosen.select("class", "feature")), ["class", "feature"])
    found = sweep(own, points).join(chosen, ["class", "feature"])
    number = F.row_number().over(Window.partitionBy("class").orderBy("place"))
    return found.withColumn("candidate_id", F.format_string("rule_%s_%d", F.col("class"), number))


def fires(value: Column, operator: Column, threshold: Column) -> Column:
    """Whether a rule fires; a missing value never does."""
    return F.coalesce(F.when(operator == ">", value > threshold).when(operator == "<", value < threshold).when(operator == ">=", value >= threshold).when(operator == "<=", value <= threshold), F.lit(False))


def validate(rules: DataFrame, obs: DataFrame, overfit: float = 0.05) -> DataFrame:
    """Each rule's F1 on other rows, and whether it fell by more than ``overfit``."""
    met = obs.join(F.broadcast(rules.select("class", "feature", "operator", "threshold", F.col("f1").alias("train_f1"))), ["class", "feature"])
    hit = fires(F.col("value"), F.col("operator"), F.col("threshold"))
    n = lambda c: F.sum(c.cast("double"))
    sums = met.groupBy("class", "feature", "train_f1").agg(n(hit & (F.col("y") == 1)).alias("tp"), n(hit).alias("hit"), F.sum("y").alias("pos"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("pos") + F.col("hit")), F.lit(0.0))
    return sums.select("class", "feature", "train_f1", f1.alias("valid_f1")).withColumn("overfit", F.col("train_f1") - F.col("valid_f1") > overfit)


def sentence(rules: DataFrame) -> DataFrame:
    """Number the rules R-01, R-02, ... by class and falling F1, and spell them out.

    Rules are few (a constant number for each class), so one window over all of them is small.
    """
    number = F.row_number().over(Window.orderBy("class", F.desc("f1"), "feature"))
    return rules.withColumn("rule_id", F.format_string("R-%02d", number)).withColumn("text", F.format_string("%s if %s %s %.3f", "class", "feature", "operator", "threshold"))


def pair_counts(positives: DataFrame, row_id: str) -> DataFrame:
    """From ``(row_id, class)`` of the positive labels: for each two classes ``a < b`` ``n_a, n_b, n_both``.

    Pairs are made inside each row's set of classes, which a class catalogue bounds.
    """
    sets = positives.groupBy(row_id).agg(F.array_sort(F.collect_set("class")).alias("classes"))
    pairs = sets.select(F.explode("classes").alias("a"), "classes").select("a", F.explode("classes").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    single = positives.distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    names = single.agg(F.array_sort(F.collect_list(F.struct(F.col("class"), "n"))).alias("all"))
    every = names.select(F.explode("all").alias("x"), "all").select(F.col("x.class").alias("a"), F.col("x.n").alias("n_a"), F.explode("all").alias("y")).select("a", "n_a", F.col("y.class").alias("b"), F.col("y.n").alias("n_b")).where("a < b")
    return every.join(pairs, ["a", "b"], "left").fillna(0, ["n_both"])


def exclusive(pairs: DataFrame, most: float, least: int = 5) -> DataFrame:
    """Pairs of classes (each with ``least`` positives) whose Jaccard overlap is at most ``most``."""
    overlap = F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return pairs.where((F.col("n_a") >= least) & (F.col("n_b") >= least)).withColumn("jaccard", overlap).where(F.col("jaccard") <= most)


def _log_factorial(k: Column) -> Column:
    """Logarithm of ``k!``: of the number itself up to 20, beyond that by Stirling's series (to a relative 1e-15)."""
    x = k + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(k <= 20, F.ln(F.factorial(F.least(k, F.lit(20))).cast("double"))).otherwise(series)


def lift(pairs: DataFrame, total: DataFrame | int, least_lift: float = 2.0, least_both: int = 10, level: float = 0.05) -> DataFrame:
    """Pairs that occur together more than chance: lift, and the Poisson tail of the count times the number of pairs.

    ``total`` is the number of rows, or a table of one row with it.
    """
    if isinstance(total, DataFrame):
        pairs = pairs.crossJoin(F.broadcast(total.toDF("_total")))
    else:
        pairs = pairs.withColumn("_total", F.lit(total))
    expected = F.col("n_a") * F.col("n_b") / F.col("_total").cast("double")
    n_pairs = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    counted = pairs.withColumn("expected", expected).withColumn("lift", F.col("n_both") / F.col("expected")).withColumn("_pairs", n_pairs)
    met = counted.where((F.col("lift") >= least_lift) & (F.col("n_both") >= least_both))
    # P(X >= both) = 1 - sum of the first terms, each from its logarithm: the very first one is 0 as a double where hundreds are expected.
    term = lambda k: F.exp(k * F.ln("expected") - F.col("expected") - _log_factorial(k))
    below = F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("n_both").cast("int")) - 1), F.lit(0.0), lambda acc, k: acc + term(k))
    scored = met.withColumn("p_adjusted", F.least(F.lit(1.0), F.when(F.col("n_both") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - below)) * F.col("_pairs")))
    return scored.where(F.col("p_adjusted") < level).drop("_total", "_pairs")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def equivalent(pairs: DataFrame, means: DataFrame, least_rows: int = 20, least_substitution: float = 0.15, least_similarity: float = 0.85) -> DataFrame:
    """Pairs of classes that stand in for each other: ``a, b, substitution_rate, similarity, grade``.

    The substitution rate is the share of rows with either class that have not both; the similarity is
    the cosine of the classes' mean features (``means``: ``class, mean`` arrays, a row for each class).
    """
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    enough = pairs.where((F.col("n_a") >= least_rows) & (F.col("n_b") >= least_rows)).withColumn("substitution_rate", F.try_divide(either - F.col("n_both"), either))
    own = lambda name, alias: F.broadcast(means.select(F.col("class").alias(name), F.col("mean").alias(alias)))
    met = enough.join(own("a", "_x"), "a").join(own("b", "_y"), "b").withColumn("similarity", F.coalesce(cosine(F.col("_x"), F.col("_y")), F.lit(0.0)))
    kept = met.where((F.col("substitution_rate") >= least_substitution) & (F.col("similarity") >= least_similarity))
    return kept.select("a", "b", "substitution_rate", "similarity", grade_equivalence(F.col("substitution_rate"), F.col("similarity")).alias("grade"))


def class_means(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """``class, mean``: the mean vector of each class, summed by place."""
    places = rows.select(F.col(label).alias("class"), F.posexplode(vector).alias("i", "e")).groupBy("class", "i").agg(F.avg("e").alias("e"))
    return places.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"]).alias("mean"))


def class_cosines(means: DataFrame) -> DataFrame:
    """``a, b, cosine`` of each two classes of a catalogue (``class, mean``; a row a class)."""
    listed = means.agg(F.array_sort(F.collect_list(F.struct("class", "mean"))).alias("all"))
    two = listed.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.class < y.class")
    return two.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), cosine(F.col("x.mean"), F.col("y.mean")).alias("cosine"))


def greedy_groups(pairs: list[tuple[str, str]], compatible: set[frozenset[str]] | None = None) -> list[set[str]]:
    """Merge pairs in order into groups all of whose members exclude each other (at most one row for each pair of classes).

    ``compatible`` are all pairs that overlap little enough, if there are others than ``pairs``.
    """
    allowed = {frozenset(p) for p in pairs} if compatible is None else compatible
    groups: list[set[str]] = []
    for a, b in pairs:
        home = next((g for g in groups if (a in g or b in g) and all(frozenset((x, y)) in allowed for x in g for y in (a, b) if x != y)), None)
        if home is None:
            groups.append({a, b})
        else:
            home |= {a, b}
    return groups


def exclusive_groups(positives: DataFrame, row_id: str, most: float, least: int = 5) -> DataFrame:
    """``group_name, members, violations, violation_rate, grade``: groups of classes that hardly occur together.

    The greedy merge is over the pairs of the class catalogue; violations (rows with two members or
    more) are counted over all rows.
    """
    pairs = pair_counts(positives, row_id)
    listed = exclusive(pairs, most, 0).orderBy("a", "b").collect()  # a row for each pair of classes at most
    enough = [(r["a"], r["b"]) for r in listed if r["n_a"] >= least and r["n_b"] >= least]
    groups = greedy_groups(enough, {frozenset((r["a"], r["b"])) for r in listed})
    named = positives.sparkSession.createDataFrame([(k, sorted(g)) for k, g in enumerate(groups)], "number int, members array<string>")
    own = positives.distinct().join(F.broadcast(named.select("number", F.explode("members").alias("class"))), "class").groupBy("number", row_id).agg(F.count(F.lit(1)).alias("n"))
    counted = own.groupBy("number").agg(F.count_if(F.col("n") > 1).alias("violations"), (F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("violation_rate"))
    met = named.join(counted, "number")
    return met.select(F.format_string("exclusive_%d", "number").alias("group_name"), "members", "violations", "violation_rate", grade_exclusive(F.col("violation_rate")).alias("grade"))


def exclusion_pairs(groups: DataFrame) -> DataFrame:
    """Each group's members two by two: ``group_name, a, b`` with ``a < b``."""
    return groups.select("group_name", F.explode("members").alias("a"), "members").select("group_name", "a", F.explode("members").alias("b")).where("a < b")
