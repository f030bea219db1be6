"""Catalogues, records, rule documents and splits: what is reported about classes, rules, graphs and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import metrics
from flightline.operators import discovery, graph, reports, splitting, universe
from flightline.plans import label_queries
from flightline.plans.book import Book, r6, table
from flightline.plans.label_queries import BATTERY, GRADE, ORDERS, RATIOS, SCORES, SWEEP, VALID, sweep_sql

BOOK = Book()

CLASSES = """
lb AS (
  SELECT o_custkey AS run, o_orderpriority AS class, max(o_totalprice) AS severity FROM orders WHERE o_totalprice > 400000 GROUP BY 1, 2
), n AS (
  SELECT count(*) AS total FROM customer
)"""


def run_classes(spark, sf_dir) -> DataFrame:
    """Customers as runs; their dear orders' priorities as failures, with the dearest as severity."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("class")).agg(F.max("o_totalprice").alias("severity"))


@BOOK.enter(f"WITH {CLASSES} SELECT class, CAST(count(*) AS BIGINT) AS positives, round(count(*) / CAST(any_value(total) AS DOUBLE), 6) AS prevalence, round(quantile_cont(severity, 0.5), 4) AS median_severity, count(*) >= 10 AS enough FROM lb, n GROUP BY class")
def label_catalogue(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("total"))
    found = reports.catalogue(run_classes(spark, sf_dir), runs, 10)
    return found.select("class", "positives", r6(F.col("prevalence")).alias("prevalence"), F.round("median_severity", 4).alias("median_severity"), "enough")


@BOOK.enter(f"WITH {CLASSES}, per AS (SELECT run, count(*) AS k FROM lb GROUP BY 1) SELECT CAST(total - count(*) AS BIGINT) AS nominal, CAST(count(*) FILTER (k >= 2) AS BIGINT) AS several FROM per, n GROUP BY total")
def failure_counts(spark, sf_dir):
    """Runs without any failure, and with two or more."""
    runs = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("total"))
    return reports.failure_counts(run_classes(spark, sf_dir), runs)


@BOOK.enter("SELECT p_brand AS category, list_sort(list(DISTINCT p_type)) AS classes FROM part GROUP BY 1")
def category_lists(spark, sf_dir):
    return reports.listed(table(spark, sf_dir, "part"), "p_brand", "p_type").toDF("category", "classes")


@BOOK.enter("SELECT 'edge' AS kind, 'LOCATED_IN' AS type, CAST(count(*) AS BIGINT) AS n FROM supplier UNION ALL SELECT 'edge', 'PART_OF', count(*) FROM nation UNION ALL SELECT 'node', 'supplier', count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'region', count(DISTINCT n_regionkey) FROM nation")
def graph_type_counts(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return graph.type_counts(graph.edges(graph.edge(t("supplier"), "LOCATED_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey")), graph.edge(t("nation"), "PART_OF", ("nation", "n_nationkey"), ("region", "n_regionkey"))))


RECORD = f"""{SCORES}, rec AS (
  SELECT c.class, tp, fp, fn, tn, {BATTERY}, round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6) AS balanced_accuracy, tp + fn AS support FROM counts c
), rk AS (
  SELECT class, sum(pp * (neg - fp + nn / 2)) / (any_value(pos) * any_value(neg)) AS auroc, sum(pp / pos * tp / (tp + fp)) AS average_precision FROM ranked GROUP BY class
)"""


def records(spark, sf_dir) -> DataFrame:
    return metrics.per_class(label_queries.scores(spark, sf_dir), ["class"], F.col("y"), F.col("p"), F.lit(0.5))


@BOOK.enter(f"WITH {RECORD} SELECT rec.*, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM rec JOIN rk USING (class)")
def per_class_record(spark, sf_dir):
    return records(spark, sf_dir).select("class", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in (*RATIOS, "balanced_accuracy")], "support", *[r6(F.col(c)).alias(c) for c in ("auroc", "average_precision")])


@BOOK.enter(
    f"""WITH {RECORD}, one AS (SELECT p AS score, CAST(sum(y) AS DOUBLE) AS pp, CAST(sum(1 - y) AS DOUBLE) AS nn FROM sc GROUP BY 1), oner AS (SELECT *, sum(pp) OVER (ORDER BY score DESC) AS tp, sum(nn) OVER (ORDER BY score DESC) AS fp, sum(pp) OVER () AS pos, sum(nn) OVER () AS neg FROM one), pooled AS (
  SELECT sum(pp * (neg - fp + nn / 2)) / (any_value(pos) * any_value(neg)) AS auroc, sum(pp / pos * tp / (tp + fp)) AS ap FROM oner), raw AS (SELECT rec.class, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, support, auroc, average_precision AS ap FROM rec JOIN rk USING (class)), t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp + fn) AS support FROM counts)
SELECT 'macro' AS how, CAST(count(*) AS BIGINT) AS n_classes, CAST(sum(support) AS BIGINT) AS support, round(avg(f1), 6) AS f1, round(avg(auroc), 6) AS auroc, round(avg(ap), 6) AS average_precision FROM raw
UNION ALL SELECT 'weighted', count(*), sum(support), round(sum(f1 * support) / sum(support), 6), round(sum(auroc * support) / sum(support), 6), round(sum(ap * support) / sum(support), 6) FROM raw
UNION ALL SELECT 'micro', (SELECT count(*) FROM raw), support, round(2.0 * tp / (2 * tp + fp + fn), 6), round(auroc, 6), round(ap, 6) FROM t, pooled"""
)
def aggregate_metrics(spark, sf_dir):
    """Macro, weighted and micro averages of F1, AUROC and average precision; micro ranks all decisions together."""
    rows = records(spark, sf_dir)
    one = metrics.by_score(label_queries.scores(spark, sf_dir).withColumn("all", F.lit(0)), ["all"], F.col("y"), F.col("p"))
    pooled = metrics.auroc(one, ["all"]).join(metrics.average_precision(one, ["all"]), "all")
    wanted = ("f1", "auroc", "average_precision")
    found = graph.edges(*[metrics.averages_of(rows, how, wanted, pooled) for how in ("macro", "weighted", "micro")])
    return found.select("how", "n_classes", F.col("support").cast("long").alias("support"), *[r6(F.col(c)).alias(c) for c in wanted])


def _wilson(metric: str, s: str, n: str) -> str:
    z = "1.959963984540054"
    p = f"({s} / CAST({n} AS DOUBLE))"
    half = f"{z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4.0 * ({n}) * ({n}))) / (1 + {z} * {z} / ({n}))"
    centre = f"({p} + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n}))"
    return f"SELECT class, '{metric}' AS metric, CASE WHEN {n} > 0 THEN round(greatest(0, {centre} - {half}), 6) END AS low, CASE WHEN {n} > 0 THEN round(least(1, {centre} + {half}), 6) END AS high, CAST(tp + fn AS BIGINT) AS n_positive FROM counts"


@BOOK.enter(f"WITH {SCORES} " + " UNION ALL ".join(_wilson(m, s, n) for m, s, n in (("sensitivity", "tp", "(tp + fn)"), ("specificity", "tn", "(tn + fp)"), ("ppv", "tp", "(tp + fp)"), ("npv", "tn", "(tn + fn)"))))
def confidence_intervals(spark, sf_dir):
    counts = label_queries.counts(spark, sf_dir)
    found = graph.edges(*[metrics.confidence_interval(counts, ["class"], m) for m in metrics.PROPORTIONS])
    return found.select("class", "metric", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n_positive")


CANDIDATES = f"""{label_queries.ASSOC}, chosen AS (
  SELECT class, feature, place FROM (SELECT class, feature, row_number() OVER (PARTITION BY class ORDER BY abs(r) DESC, feature) AS place FROM assoc) WHERE place <= 3
), own AS (
  SELECT obs.* FROM obs JOIN chosen USING (class, feature)
), {sweep_sql("own")}, cand AS (
  SELECT 'rule_' || class || '_' || row_number() OVER (PARTITION BY class ORDER BY place) AS candidate_id, r.*, {GRADE} AS grade FROM rules r JOIN chosen USING (class, feature)
)"""


def candidates(spark, sf_dir) -> DataFrame:
    found = discovery.candidate_rules(label_queries.observations(spark, sf_dir), 3)
    return found.withColumn("grade", discovery.grade(F.col("sensitivity"), F.col("specificity"), F.col("n_positive")))


@BOOK.enter(f"WITH {CANDIDATES} SELECT candidate_id, class, feature, operator, round(threshold, 6) AS threshold, round(f1, 6) AS f1, grade FROM cand")
def rule_candidates(spark, sf_dir):
    """Threshold rules on the three features of each class that go with it most, numbered by that."""
    return candidates(spark, sf_dir).select("candidate_id", "class", "feature", "operator", r6(F.col("threshold")).alias("threshold"), r6(F.col("f1")).alias("f1"), "grade")


@BOOK.enter(f"WITH {CANDIDATES} SELECT class, feature, operator, round(threshold, 4) AS threshold, round(f1, 4) AS f1, grade, CAST(row_number() OVER (PARTITION BY class ORDER BY f1 DESC, feature) AS INT) AS place FROM cand")
def rules_documents(spark, sf_dir):
    """The JSON document of each class's rules, read back: rules in its order, rounded."""
    rule = "feature string, operator string, threshold double, sensitivity double, specificity double, f1 double, grade string"
    documents = reports.rules_document(candidates(spark, sf_dir), "D").select(F.from_json("document", f"class string, rules array<struct<{rule.replace(' ', ':').replace(',:', ', ')}>>").alias("d"))
    each = documents.select(F.col("d.class").alias("class"), F.posexplode("d.rules").alias("place", "r"))
    return each.select("class", "r.feature", "r.operator", "r.threshold", "r.f1", "r.grade", (F.col("place") + 1).alias("place"))


@BOOK.enter(f"WITH {CANDIDATES} SELECT class, CASE WHEN grade IN ('A', 'B') THEN 'deploy' WHEN grade = 'C' THEN 'review' ELSE 'drop' END AS bucket, list_sort(list(candidate_id)) AS rules FROM cand GROUP BY 1, 2")
def hand_off(spark, sf_dir):
    return reports.hand_off(candidates(spark, sf_dir).withColumnRenamed("candidate_id", "rule_id"))


@BOOK.enter(f"WITH {CANDIDATES}, k AS (SELECT * FROM cand WHERE grade IN ('A', 'B', 'C')) SELECT c.class FROM (SELECT DISTINCT class FROM cand) c ANTI JOIN (SELECT * FROM k WHERE class <> 'F') u ON u.class = c.class")
def uncovered_classes(spark, sf_dir):
    """Classes without a rule of grade C or better (class F's are left out, so that it is one)."""
    rows = candidates(spark, sf_dir)
    return reports.uncovered(rows.select("class").distinct(), rows.where(reports.at_least(F.col("grade"), "C") & (F.col("class") != "F")))


@BOOK.enter(
    f"""WITH {CANDIDATES}, hit AS (SELECT o.class, o.id, max(CASE c.operator WHEN '>' THEN o.value > c.threshold ELSE o.value < c.threshold END::INT) AS hit, max(o.y) AS y FROM obs o JOIN cand c ON c.class = o.class AND c.feature = o.feature GROUP BY 1, 2), now AS (
  SELECT class, 2 * sum(hit * y) / (sum(hit) + sum(y)) AS f1 FROM hit GROUP BY 1), base AS (SELECT class, max(f1) AS baseline FROM rules GROUP BY 1)
SELECT class, round(f1, 6) AS f1, round(baseline, 6) AS baseline, round(f1 - baseline, 6) AS delta, f1 - baseline < -0.01 AS regressed FROM now JOIN base USING (class)"""
)
def rule_set_regression(spark, sf_dir):
    """F1 of each class's rules taken together against its best single rule."""
    rules = candidates(spark, sf_dir)
    now = reports.rule_set_f1(rules, label_queries.observations(spark, sf_dir), "id")
    found = reports.regression(now, rules.groupBy("class").agg(F.max("f1").alias("f1")), 0.01)
    return found.select("class", *[r6(F.col(c)).alias(c) for c in ("f1", "baseline", "delta")], "regressed")


@BOOK.enter(f"WITH {CANDIDATES} SELECT (SELECT count(*) FROM assoc) AS n_correlations, (SELECT count(*) FROM (SELECT * FROM assoc LIMIT 5)) AS kept, (SELECT round(max(abs(r)), 6) FROM assoc) AS strongest_r, count(*) AS n_rules, " + ", ".join(f"CAST(count(*) FILTER (grade = '{g}') AS BIGINT) AS grade_{g.lower()}" for g in "ABCD") + " FROM cand")
def discovery_summary(spark, sf_dir):
    found = reports.summary(discovery.associations(label_queries.observations(spark, sf_dir)), candidates(spark, sf_dir), 5)
    return found.withColumn("strongest_r", r6(F.col("strongest_r")))


@BOOK.enter(f"WITH {CANDIDATES}, twice AS (SELECT feature, count(*) AS n FROM cand GROUP BY 1 HAVING count(*) > 1) SELECT feature, CAST(n AS BIGINT) AS n FROM twice")
def duplicate_keys(spark, sf_dir):
    """Features that more than one rule uses (the check for ids that are given twice)."""
    return reports.duplicates(candidates(spark, sf_dir), "feature")


@BOOK.enter(f"WITH {SWEEP} SELECT array_to_string(list_slice(string_split(feature, '_'), 1, 1), '_') AS family, CAST(count(*) AS BIGINT) AS rules, round(max(f1), 6) AS best FROM rules GROUP BY 1")
def feature_families(spark, sf_dir):
    """Rules by the first part of their feature's name."""
    return label_queries.rules(spark, sf_dir).groupBy(discovery.family(F.col("feature"), 1).alias("family")).agg(F.count(F.lit(1)).alias("rules"), r6(F.max("f1")).alias("best"))


@BOOK.enter(
    """WITH pos AS (SELECT doc_id AS id, 'lang ' || lang AS class FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 3000), single AS (SELECT class, count(*) AS n FROM pos GROUP BY 1), met AS (SELECT x.class AS a, y.class AS b, count(*) AS n FROM pos x JOIN pos y ON x.id = y.id AND x.class < y.class GROUP BY 1, 2),
pairs AS (SELECT p.class AS a, q.class AS b, p.n AS n_a, q.n AS n_b, coalesce(met.n, 0) AS n_both FROM single p JOIN single q ON p.class < q.class LEFT JOIN met ON met.a = p.class AND met.b = q.class)
SELECT a, b FROM pairs WHERE n_a >= 5 AND n_b >= 5 AND n_both / CAST(n_a + n_b - n_both AS DOUBLE) <= 0.02 AND (n_a + n_b - 2 * n_both) / CAST(n_a + n_b - n_both AS DOUBLE) >= 0.98"""
)
def contradictory_pairs(spark, sf_dir):
    """Classes that are called exclusive and equivalent at once: languages, where being seldom together is taken for standing in for each other."""
    documents = table(spark, sf_dir, "documents")
    mark = lambda c, where: documents.where(where).select(F.col("doc_id").alias("id"), c.alias("class"))
    pairs = discovery.pair_counts(mark(F.concat(F.lit("lang "), "lang"), "lang is not null").unionByName(mark(F.lit("long"), "n_chars > 3000")), "id")
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    alike = pairs.where((F.col("n_a") >= 5) & (F.col("n_b") >= 5) & ((either - F.col("n_both")) / either >= 0.98))
    return reports.contradictions(discovery.exclusive(pairs, 0.02), alike)


@BOOK.enter("WITH g AS (SELECT n_regionkey, list_sort(list(n_name)) AS members FROM nation GROUP BY 1) SELECT 'region ' || x.n_regionkey AS group_name, x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name")
def exclusion_pairs(spark, sf_dir):
    """Members of each group two by two."""
    groups = table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("region "), "n_regionkey").alias("group_name")).agg(F.array_sort(F.collect_list("n_name")).alias("members"))
    return discovery.exclusion_pairs(groups)


@BOOK.enter("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand AS label, CAST(1000 - n AS BIGINT) AS folds_without FROM c WHERE n < 1000")
def split_audit(spark, sf_dir):
    """Brands with fewer parts than folds: how many folds have none of them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = [r["p_brand"] for r in parts.select("p_brand").distinct().orderBy("p_brand").collect()]  # the catalogue of brands
    rows = parts.withColumns({b: (F.col("p_brand") == b).cast("int") for b in brands})
    missing = splitting.audit(splitting.deal(rows, ["p_brand"], ["p_partkey"], 1000), brands, 1000)
    return missing.groupBy("label").agg(F.count(F.lit(1)).alias("folds_without"))


@BOOK.enter("WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2) SELECT quality, toxic, CAST(n AS BIGINT) AS n, true AS even FROM c UNION ALL SELECT NULL, NULL, CAST(sum(n) // 6 AS BIGINT), true FROM c")
def stratified_holdout(spark, sf_dir):
    """Of each signature: its rows, and whether its share of them, within one row, is held out; in all, how many are."""
    split = splitting.holdout(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], ["doc_id"])
    per = split.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if("held_out").alias("held"))
    none = F.lit(None).cast("int")
    whole = per.agg(F.sum("held").alias("n")).select(none.alias("quality"), none.alias("toxic"), "n", F.lit(True).alias("even"))
    share = per.agg((F.sum("held") / F.sum("n")).alias("share"))
    even = F.abs(F.col("held") - F.col("n") * F.col("share")) <= 1
    return per.crossJoin(F.broadcast(share)).select("quality", "toxic", "n", even.alias("even")).unionByName(whole)  # one number to each row


@BOOK.enter("WITH q AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS v FROM orders) SELECT CASE WHEN v IS NULL THEN 0 ELSE CAST(1 + round_even(least(greatest((v - 1000) / 399000, 0), 1) * 65534, 0) AS INT) END AS code, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1")
def quantized_with_missing(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(universe.quantized_with_missing(v, 1000.0, 400000.0).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@BOOK.enter("SELECT o_orderkey, CAST(printf('%.5e', sqrt(o_totalprice) * 1000) AS DOUBLE) AS rounded FROM orders")
def significant_digits(spark, sf_dir):
    """Numbers as the JSON sink writes them: six significant digits."""
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.significant(F.sqrt("o_totalprice") * 1000).alias("rounded"))


NEAR = """l AS (SELECT vec_id AS landmark, embedding AS e, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings) WHERE q <= 2), d AS (
  SELECT v.vec_id, l.landmark, l.label, list_sum(list_transform(list_zip(v.embedding, l.e), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d FROM embeddings v, l), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), landmark) AS place FROM d)"""


@BOOK.enter(
    f"""WITH {NEAR}, w AS (SELECT vec_id, landmark, label, sqrt(round(d, 9)) AS dist FROM r WHERE place <= 4), p AS (
  SELECT vec_id, CASE WHEN min(dist) < 1e-12 THEN max(CASE WHEN dist < 1e-12 THEN label END) ELSE sum(label / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12)) END AS x, CASE WHEN min(dist) < 1e-12 THEN max(CASE WHEN dist < 1e-12 THEN landmark END) ELSE sum(landmark / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12)) END AS y FROM w GROUP BY 1),
m AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p) SELECT vec_id, round((x - (hx + lx) / 2) / greatest((hx - lx) / 2, (hy - ly) / 2), 5) AS x, round((y - (hy + ly) / 2) / greatest((hx - lx) / 2, (hy - ly) / 2), 5) AS y FROM p, m"""
)
def placed_and_scaled(spark, sf_dir):
    """Vectors placed among their nearest landmarks (whose coordinates are their label and number), scaled to the widest axis."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    marks = universe.landmarks(vectors, "label", "vec_id", 2)
    near = universe.nearest(vectors, marks, "vec_id", "embedding", 4)
    at = marks.select(F.col("vec_id").alias("landmark"), F.col("label").cast("double").alias("x"), F.col("vec_id").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return universe.scaled(universe.placed(near, at, "vec_id")).select("vec_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@BOOK.enter("WITH q AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings), c AS (SELECT * FROM q WHERE place <= 3), m AS (SELECT greatest(0, 50 - count(*)) AS n FROM c), o AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i FROM q WHERE place > 3) SELECT vec_id, label FROM c UNION ALL SELECT vec_id, label FROM o, m WHERE i <= n")
def landmark_quota(spark, sf_dir):
    """Three landmarks of each class, and others up to fifty in all."""
    return universe.landmarks(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 3, 50)


@BOOK.enter(
    """WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, value FROM events), m AS (SELECT run, min(tick) FILTER (value > 100) AS hot, min(tick) FILTER (value < 2) AS cold FROM e GROUP BY 1)
SELECT e.run, e.tick, coalesce((hot <= tick)::INT, 0) AS hot, coalesce((cold <= tick)::INT, 0) AS cold FROM e JOIN m USING (run)"""
)
def row_labels(spark, sf_dir):
    """Labels of ticks: 1 from the time a failure shows."""
    from flightline.functions import features
    from flightline.plans import series_queries

    ticks = series_queries.samples(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("k").alias("tick"), F.col("k").cast("double").alias("t_now"), F.col("ts"), F.col("event_id"))
    values = table(spark, sf_dir, "events").select("event_id", "value")
    met = ticks.join(values, "event_id")
    shown = graph.edges(*[met.where(c).groupBy("run").agg(F.min("t_now").alias("manifest")).withColumn("class", F.lit(n)) for n, c in (("hot", "value > 100"), ("cold", "value < 2"))])
    return features.row_labels(ticks.select("run", "tick", "t_now"), shown, ["hot", "cold"]).select("run", "tick", "hot", "cold")


@BOOK.enter(f"WITH {VALID} SELECT r.class, r.feature, v.valid_f1 IS NOT NULL AS validated, round(v.valid_f1, 6) AS valid_f1 FROM rules r LEFT JOIN (SELECT * FROM valid WHERE class <> 'P') v USING (class, feature)")
def rules_with_validation(spark, sf_dir):
    """Every rule with its validation, where there is one."""
    found = label_queries.validated(spark, sf_dir).where("class <> 'P'").select("class", "feature", "valid_f1")
    rules = discovery.sweep(label_queries.observations(spark, sf_dir).where("id % 5 <> 0")).select("class", "feature")
    return rules.join(found, ["class", "feature"], "left").select("class", "feature", F.col("valid_f1").isNotNull().alias("validated"), r6(F.col("valid_f1")).alias("valid_f1"))


@BOOK.enter(f"WITH {ORDERS} SELECT split, CAST(count(*) AS BIGINT) AS n, round(avg(qty_sum), 6) AS mean FROM (SELECT *, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) THEN 'held' ELSE 'work' END AS split FROM wide) GROUP BY 1")
def holdout_membership(spark, sf_dir):
    """Orders in and out of a list of ids, by a semi and an anti join."""
    rows, listed = label_queries.wide(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("id")).distinct()
    both = rows.join(listed, "id", "left_semi").withColumn("split", F.lit("held")).unionByName(rows.join(listed, "id", "left_anti").withColumn("split", F.lit("work")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("qty_sum")).alias("mean"))
