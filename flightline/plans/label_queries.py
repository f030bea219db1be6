"""Rules, metrics, splits and graphs over orders, line items, embeddings and labels.

An order is a row; its features are aggregates of its line items, its classes the order's status and
priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import metrics
from flightline.operators import discovery, graph, preparing, reports, splitting
from flightline.plans.book import Book, r6, rounded, table

BOOK = Book()
FEATURES = ["qty_sum", "price_avg", "disc_avg", "n_lines"]

ORDERS = """
feat AS (
  SELECT l_orderkey AS id, sum(l_quantity) AS qty_sum, avg(l_extendedprice) AS price_avg, avg(l_discount) AS disc_avg, CAST(count(*) AS DOUBLE) AS n_lines
  FROM lineitem GROUP BY l_orderkey
), wide AS (
  SELECT o.o_orderkey AS id, o_orderstatus, o_orderpriority, o_totalprice, f.* EXCLUDE (id) FROM orders o LEFT JOIN feat f ON o.o_orderkey = f.id
), long AS (
  SELECT id, feature, value FROM (UNPIVOT wide ON qty_sum, price_avg, disc_avg, n_lines INTO NAME feature VALUE value)
), classes AS (
  SELECT DISTINCT o_orderstatus AS class FROM orders
), lab AS (
  SELECT w.id, c.class, CAST(w.o_orderstatus = c.class AS DOUBLE) AS y FROM wide w CROSS JOIN classes c
), obs AS (
  SELECT id, lab.class, long.feature, long.value, lab.y FROM long JOIN lab USING (id)
)"""
SCORES = """
sc AS (
  SELECT o_orderkey AS id, o_orderpriority AS class, CAST(o_orderstatus = 'F' AS INT) AS y, round(least(1.0, o_totalprice / 500000.0), 2) AS p FROM orders
), tied AS (
  SELECT class, p AS score, CAST(sum(y) AS DOUBLE) AS pp, CAST(sum(1 - y) AS DOUBLE) AS nn FROM sc GROUP BY 1, 2
), ranked AS (
  SELECT *, sum(pp) OVER (PARTITION BY class ORDER BY score DESC) AS tp, sum(nn) OVER (PARTITION BY class ORDER BY score DESC) AS fp, sum(pp) OVER (PARTITION BY class) AS pos, sum(nn) OVER (PARTITION BY class) AS neg FROM tied
), counts AS (
  SELECT class, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM sc GROUP BY class
)"""


def wide(spark, sf_dir) -> DataFrame:
    features = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("qty_sum"), F.avg("l_extendedprice").alias("price_avg"), F.avg("l_discount").alias("disc_avg"), F.count(F.lit(1)).cast("double").alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    return orders.join(features, "id", "left")


def observations(spark, sf_dir) -> DataFrame:
    rows = wide(spark, sf_dir)
    return discovery.observations(rows, "id", FEATURES, {c: (F.col("o_orderstatus") == c).cast("int") for c in "FOP"})


def scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), rounded(F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0), 2).alias("p"))


def ranked(spark, sf_dir) -> DataFrame:
    return metrics.by_score(scores(spark, sf_dir), ["class"], F.col("y"), F.col("p"))


def counts(spark, sf_dir) -> DataFrame:
    return metrics.confusion(scores(spark, sf_dir), ["class"], F.col("y"), F.col("p"), F.lit(0.5))


PREPARED = f"{ORDERS}, work AS (SELECT * FROM wide WHERE id % 5 <> 0), m AS (SELECT median(qty_sum) AS m, median(price_avg) AS mp FROM work), z AS (SELECT avg(coalesce(qty_sum, m)) AS a, stddev_pop(coalesce(qty_sum, m)) AS s, avg(coalesce(price_avg, mp)) AS ap, stddev_pop(coalesce(price_avg, mp)) AS sp FROM work, m)"


def holed(spark, sf_dir) -> DataFrame:
    """Orders with features missing here and there."""
    gone = F.col("id") % 7 == 3
    return wide(spark, sf_dir).withColumns({c: F.when(~gone, F.col(c)) for c in ("qty_sum", "price_avg")})


_HOLED = PREPARED.replace("f.* EXCLUDE (id) FROM", "CASE WHEN o.o_orderkey % 7 <> 3 THEN qty_sum END AS qty_sum, CASE WHEN o.o_orderkey % 7 <> 3 THEN price_avg END AS price_avg, disc_avg, n_lines FROM")


@BOOK.enter(f"WITH {_HOLED} SELECT id, round(coalesce(qty_sum, m), 6) AS qty_sum, round(coalesce(price_avg, mp), 6) AS price_avg FROM wide, m")
def median_impute(spark, sf_dir):
    """Medians of four fifths of the orders, filled in in all of them."""
    rows = holed(spark, sf_dir)
    fitted = preparing.fit(rows.where("id % 5 <> 0"), ["qty_sum", "price_avg"])
    return fitted.impute(rows).select("id", r6(F.col("qty_sum")).alias("qty_sum"), r6(F.col("price_avg")).alias("price_avg"))


@BOOK.enter(f"WITH {_HOLED} SELECT id, round((coalesce(qty_sum, m) - a) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z, round((coalesce(price_avg, mp) - ap) / CASE WHEN sp = 0 THEN 1 ELSE sp END, 6) AS z_price FROM wide, m, z")
def zscore(spark, sf_dir):
    """Scaled by mean and deviation of four fifths of the orders, after imputing."""
    rows = holed(spark, sf_dir)
    fitted = preparing.fit(rows.where("id % 5 <> 0"), ["qty_sum", "price_avg"])
    return fitted.scale(rows).select("id", r6(F.col("qty_sum")).alias("z"), r6(F.col("price_avg")).alias("z_price"))


ASSOC = f"""{ORDERS}, g AS (
  SELECT class, feature, count(*) AS n, sum(y) AS n1, count(*) - sum(y) AS n0, avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 0) AS m0, stddev_samp(value) AS sd,
         coalesce(var_samp(value) FILTER (y = 1), 0) AS v1, coalesce(var_samp(value) FILTER (y = 0), 0) AS v0 FROM obs GROUP BY 1, 2
), assoc AS (
  SELECT class, feature, n, CAST(n1 AS BIGINT) AS n1, (m1 - m0) / sd * sqrt(n1 * n0 / (CAST(n AS DOUBLE) * n)) AS r, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n - 2)) AS d FROM g WHERE n1 >= 10 AND n0 >= 10
)"""


@BOOK.enter(
    f"""WITH {ASSOC}, t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, row_number() OVER (PARTITION BY class ORDER BY abs(r) DESC, feature) AS place FROM assoc), u AS (SELECT *, 1 / (1 + 0.2316419 * t) AS u FROM t)
SELECT class, feature, n, n1, round(r, 6) AS r, round(2 * exp(-t * t / 2) / sqrt(2 * pi()) * u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))), 6) AS p, place FROM u WHERE place <= 2"""
)
def point_biserial_topk(spark, sf_dir):
    top = discovery.strongest(discovery.associations(observations(spark, sf_dir)), 2)
    return top.select("class", "feature", "n", "n1", r6(F.col("r")).alias("r"), r6(F.col("p")).alias("p"), "place")


@BOOK.enter(f"WITH {ASSOC} SELECT class, feature, round(d, 6) AS d FROM assoc")
def cohens_d(spark, sf_dir):
    return discovery.associations(observations(spark, sf_dir)).select("class", "feature", r6(F.col("d")).alias("d"))


def sweep_sql(obs: str) -> str:
    """The sweep over the table ``obs`` as further common table expressions, the last one ``rules``."""
    return f"""sc AS (
  SELECT class, feature, min(value) AS lo, max(value) AS hi, sum(y) AS pos, count(*) AS n FROM {obs} GROUP BY 1, 2 HAVING max(value) - min(value) >= 1e-10 AND sum(y) >= 2
), grid AS (
  SELECT sc.*, i, lo + (hi - lo) * i / 51 AS thr FROM sc, range(1, 51) AS r(i)
), hits AS (
  SELECT g.class, g.feature, g.i, g.thr, g.pos, g.n, sum(CASE WHEN o.value > g.thr THEN o.y ELSE 0 END) AS tp_gt, count(*) FILTER (o.value > g.thr) AS hit_gt, sum(CASE WHEN o.value < g.thr THEN o.y ELSE 0 END) AS tp_lt, count(*) FILTER (o.value < g.thr) AS hit_lt
  FROM grid g JOIN {obs} o ON g.class = o.class AND g.feature = o.feature GROUP BY ALL
), ops AS (
  SELECT class, feature, i, thr, pos, n, 0 AS op_ix, '>' AS operator, tp_gt AS tp, hit_gt AS hit FROM hits UNION ALL SELECT class, feature, i, thr, pos, n, 1, '<', tp_lt, hit_lt FROM hits
), best AS (
  SELECT *, 2 * tp / (pos + hit) AS f1, row_number() OVER (PARTITION BY class, feature ORDER BY round(2 * tp / (pos + hit), 12) DESC, i, op_ix) AS place FROM ops
), rules AS (
  SELECT class, feature, operator, thr AS threshold, tp / pos AS sensitivity, 1 - CASE WHEN n > pos THEN (hit - tp) / (n - pos) ELSE 0 END AS specificity, f1, CAST(pos AS BIGINT) AS n_positive FROM best WHERE place = 1 AND f1 > 0
)"""


SWEEP = f"{ORDERS}, {sweep_sql('obs')}"
GRADE = """CASE WHEN sensitivity >= 0.80 AND specificity >= 0.80 AND n_positive >= 50 THEN 'A' WHEN sensitivity >= 0.60 AND specificity >= 0.60 AND n_positive >= 20 THEN 'B'
WHEN sensitivity >= 0.40 AND specificity >= 0.40 AND n_positive >= 10 THEN 'C' ELSE 'D' END"""


def rules(spark, sf_dir) -> DataFrame:
    return discovery.sweep(observations(spark, sf_dir))


@BOOK.enter(f"WITH {SWEEP} SELECT class, feature, operator, round(threshold, 6) AS threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(f1, 6) AS f1 FROM rules")
def threshold_sweep(spark, sf_dir):
    return rules(spark, sf_dir).select("class", "feature", "operator", *[r6(F.col(c)).alias(c) for c in ("threshold", "sensitivity", "specificity", "f1")])


@BOOK.enter(
    f"""WITH {SWEEP} SELECT 'R-' || lpad(CAST(row_number() OVER (ORDER BY class, f1 DESC, feature) AS VARCHAR), 2, '0') AS rule_id, class, feature,
n_positive, {GRADE} AS grade,
printf('%s if %s %s %.3f', class, feature, operator, threshold) AS text FROM rules"""
)
def rule_grades(spark, sf_dir):
    graded = rules(spark, sf_dir).withColumn("grade", discovery.grade(F.col("sensitivity"), F.col("specificity"), F.col("n_positive")))
    return discovery.sentence(graded).select("rule_id", "class", "feature", "n_positive", "grade", "text")


HELD = f"{ORDERS}, work AS (SELECT * FROM obs WHERE id % 5 <> 0), hold AS (SELECT * FROM obs WHERE id % 5 = 0), {sweep_sql('work')}"
VALID = f"""{HELD}, m AS (
  SELECT r.class, r.feature, r.f1 AS train_f1, sum(CASE WHEN fire AND y = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN fire THEN 1.0 ELSE 0 END) AS hit, sum(y) AS pos
  FROM (SELECT o.*, r.f1, CASE r.operator WHEN '>' THEN o.value > r.threshold ELSE o.value < r.threshold END AS fire FROM hold o JOIN rules r ON o.class = r.class AND o.feature = r.feature) r GROUP BY 1, 2, 3
), valid AS (
  SELECT class, feature, train_f1, CASE WHEN pos + hit > 0 THEN 2 * tp / (pos + hit) ELSE 0 END AS valid_f1 FROM m
)"""


def validated(spark, sf_dir) -> DataFrame:
    """Rules swept on four fifths of the orders, held against the last fifth."""
    obs = observations(spark, sf_dir)
    return discovery.validate(discovery.sweep(obs.where("id % 5 <> 0")), obs.where("id % 5 = 0"))


@BOOK.enter(f"WITH {VALID} SELECT class, feature, round(train_f1, 6) AS train_f1, round(valid_f1, 6) AS valid_f1, train_f1 - valid_f1 > 0.05 AS overfit FROM valid")
def rule_validation(spark, sf_dir):
    return validated(spark, sf_dir).select("class", "feature", r6(F.col("train_f1")).alias("train_f1"), r6(F.col("valid_f1")).alias("valid_f1"), "overfit")


@BOOK.enter(f"WITH {VALID} SELECT CAST(count(*) AS BIGINT) AS n_rules, CAST(count(*) FILTER (train_f1 - valid_f1 > 0.05) AS BIGINT) AS n_overfit, round(avg(valid_f1), 6) AS mean_f1, round(quantile_cont(valid_f1, 0.5), 6) AS median_f1 FROM valid")
def validation_summary(spark, sf_dir):
    return reports.validation_summary(validated(spark, sf_dir)).select("n_rules", "n_overfit", r6(F.col("mean_f1")).alias("mean_f1"), r6(F.col("median_f1")).alias("median_f1"))


BATTERY = """round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS sensitivity, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity,
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS ppv, round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) AS npv, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST((tp + fp) AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc"""
RATIOS = ["sensitivity", "specificity", "ppv", "npv", "f1", "mcc"]


@BOOK.enter(f"WITH {SCORES} SELECT class, tp, fp, fn, tn, {BATTERY}, tp + fn AS support FROM counts")
def confusion_battery(spark, sf_dir):
    return metrics.battery(counts(spark, sf_dir)).select("class", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in RATIOS], "support")


@BOOK.enter(f"WITH {SCORES} SELECT class, round(avg((p - y) * (p - y)), 6) AS brier FROM sc GROUP BY class")
def brier(spark, sf_dir):
    return metrics.brier(scores(spark, sf_dir), ["class"], F.col("y"), F.col("p")).withColumn("brier", r6(F.col("brier")))


@BOOK.enter(f"WITH {SCORES} SELECT class, round(sum(pp * (neg - fp + nn / 2)) / (any_value(pos) * any_value(neg)), 6) AS auroc FROM ranked GROUP BY class")
def auroc_by_rank(spark, sf_dir):
    return metrics.auroc(ranked(spark, sf_dir), ["class"]).withColumn("auroc", r6(F.col("auroc")))


@BOOK.enter(f"WITH {SCORES} SELECT class, round(sum(pp / pos * tp / (tp + fp)), 6) AS average_precision FROM ranked GROUP BY class")
def average_precision(spark, sf_dir):
    return metrics.average_precision(ranked(spark, sf_dir), ["class"]).withColumn("average_precision", r6(F.col("average_precision")))


@BOOK.enter(
    f"""WITH {SCORES}, x AS (SELECT class, (fp - nn) / neg AS x0, fp / neg AS x1, (tp - pp) / pos AS y0, tp / pos AS y1 FROM ranked), y AS (
  SELECT class, (least(x1, 0.1) - x0) * (y0 + CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (least(x1, 0.1) - x0) / (x1 - x0) ELSE y1 END) / 2 AS a FROM x WHERE x0 < 0.1)
SELECT class, round(0.5 * (1 + (sum(a) - 0.005) / 0.095), 6) AS partial_auroc FROM y GROUP BY class"""
)
def partial_auroc(spark, sf_dir):
    return metrics.partial_auroc(ranked(spark, sf_dir), ["class"]).withColumn("partial_auroc", r6(F.col("partial_auroc")))


@BOOK.enter(f"WITH {SCORES} SELECT class, score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM ranked")
def roc_points(spark, sf_dir):
    return metrics.roc_points(ranked(spark, sf_dir)).select("class", "score", *[r6(F.col(c)).alias(c) for c in ("fpr", "tpr", "precision")])


@BOOK.enter(f"WITH {SCORES} SELECT class, i / 100 AS threshold, count(*) FILTER (y = 1 AND p >= i / 100 - 1e-9) AS tp, count(*) FILTER (y = 0 AND p >= i / 100 - 1e-9) AS fp, count(*) FILTER (y = 1 AND p < i / 100 - 1e-9) AS fn, count(*) FILTER (y = 0 AND p < i / 100 - 1e-9) AS tn FROM sc, range(0, 101) AS r(i) GROUP BY 1, 2")
def threshold_curve(spark, sf_dir):
    return metrics.threshold_sweep(scores(spark, sf_dir), ["class"], F.col("y"), F.col("p"))


@BOOK.enter(
    f"""WITH {SCORES}, f AS (SELECT class, tp + fn AS support, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM counts), t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts)
SELECT round(avg(f1), 6) AS macro, round(sum(f1 * support) / sum(support), 6) AS weighted, (SELECT round(2.0 * tp / (2 * tp + fp + fn), 6) FROM t) AS micro FROM f WHERE support > 0"""
)
def macro_micro_weighted(spark, sf_dir):
    return metrics.aggregated(metrics.battery(counts(spark, sf_dir)), "f1").select(*[r6(F.col(c)).alias(c) for c in ("macro", "weighted", "micro")])


@BOOK.enter(
    f"""WITH {SCORES}, w AS (SELECT class, tp AS s, tp + fn AS n, tp / (tp + fn) AS p, 1.959963984540054 AS z FROM counts)
SELECT class, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS high FROM w"""
)
def wilson_interval(spark, sf_dir):
    low, high = metrics.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts(spark, sf_dir).select("class", r6(low).alias("low"), r6(high).alias("high"))


MARKS = """
pos AS (
  SELECT doc_id AS id, 'lang ' || lang AS class FROM documents WHERE lang IS NOT NULL UNION SELECT doc_id, 'source ' || source FROM documents WHERE source IS NOT NULL UNION SELECT doc_id, 'long' FROM documents WHERE n_chars > 3000
  UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'good' FROM labels WHERE quality = 1
), single AS (
  SELECT class, count(*) AS n FROM pos GROUP BY class
), met AS (
  SELECT a.class AS a, b.class AS b, count(*) AS n_both FROM pos a JOIN pos b ON a.id = b.id AND a.class < b.class GROUP BY 1, 2
), pairs AS (
  SELECT x.class AS a, y.class AS b, x.n AS n_a, y.n AS n_b, coalesce(met.n_both, 0) AS n_both FROM single x JOIN single y ON x.class < y.class LEFT JOIN met ON met.a = x.class AND met.b = y.class
)"""


@BOOK.enter(
    f"""WITH {MARKS}, t AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM documents), x AS (SELECT pairs.*, n_a * n_b / total AS expected, count(*) OVER () AS n_pairs FROM pairs, t), y AS (
  SELECT *, CASE WHEN n_both = 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, n_both), lambda k: exp(k * ln(expected) - expected - lgamma(k + 1))))) END AS tail FROM x)
SELECT a, b, n_both, round(n_both / expected, 6) AS lift, round(least(1, tail * n_pairs), 6) AS p_adjusted FROM y WHERE n_both / expected >= 2.0 AND n_both >= 10 AND tail * n_pairs < 0.05"""
)
def cooccurrence_lift(spark, sf_dir):
    """Marks that documents have together more often than chance, by the Poisson tail over all pairs."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mark = lambda df, c, where: df.where(where).select(F.col("doc_id").alias("id"), c.alias("class"))
    parts = [mark(documents, F.concat(F.lit("lang "), "lang"), "lang is not null"), mark(documents, F.concat(F.lit("source "), "source"), "source is not null"), mark(documents, F.lit("long"), "n_chars > 3000"), mark(labels, F.lit("toxic"), "toxic = 1"), mark(labels, F.lit("good"), "quality = 1")]
    positives = graph.edges(*parts).distinct()
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    return discovery.lift(discovery.pair_counts(positives, "id"), total).select("a", "b", "n_both", r6(F.col("lift")).alias("lift"), r6(F.col("p_adjusted")).alias("p_adjusted"))


MEANS = "m AS (SELECT label, i, avg(e) AS e FROM (SELECT label, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2)"


@BOOK.enter(f"WITH {MEANS}, d AS (SELECT x.label AS a, y.label AS b, sum(x.e * y.e) AS xy, sum(x.e * x.e) AS xx, sum(y.e * y.e) AS yy FROM m x JOIN m y ON x.i = y.i AND x.label < y.label GROUP BY 1, 2) SELECT a, b, round(xy / sqrt(xx) / sqrt(yy), 5) AS cosine FROM d")
def equivalence_cosine(spark, sf_dir):
    """Cosine of the mean vectors of each two classes: means are summed by place, then one row for each class."""
    means = discovery.class_means(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return discovery.class_cosines(means).withColumn("cosine", rounded(F.col("cosine"), 5))


CUSTOMERS = """
pos AS (
  SELECT DISTINCT o_custkey AS id, o_orderpriority || ' ' || o_orderstatus AS class FROM orders WHERE o_totalprice > 420000
), single AS (
  SELECT class, count(*) AS n FROM pos GROUP BY class
), met AS (
  SELECT a.class AS a, b.class AS b, count(*) AS n_both FROM pos a JOIN pos b ON a.id = b.id AND a.class < b.class GROUP BY 1, 2
), pairs AS (
  SELECT x.class AS a, y.class AS b, x.n AS n_a, y.n AS n_b, coalesce(met.n_both, 0) AS n_both FROM single x JOIN single y ON x.class < y.class LEFT JOIN met ON met.a = x.class AND met.b = y.class
)"""


def customer_classes(spark, sf_dir) -> DataFrame:
    """Customers with a dear order of a priority and status, as (id, class)."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 420000").select(F.col("o_custkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("class")).distinct()


@BOOK.enter(f"WITH {CUSTOMERS} SELECT a, b, round(n_both / CAST(n_a + n_b - n_both AS DOUBLE), 6) AS jaccard FROM pairs WHERE n_a >= 5 AND n_b >= 5 AND n_both / CAST(n_a + n_b - n_both AS DOUBLE) <= 0.1")
def mutex_jaccard(spark, sf_dir):
    return discovery.exclusive(discovery.pair_counts(customer_classes(spark, sf_dir), "id"), 0.1).select("a", "b", r6(F.col("jaccard")).alias("jaccard"))


@BOOK.enter(
    f"""WITH {CUSTOMERS}, two AS (SELECT a, b FROM pairs WHERE n_a >= 5 AND n_b >= 5 AND n_both / CAST(n_a + n_b - n_both AS DOUBLE) <= 0.05), each AS (
  SELECT a, b, id, count(*) AS n FROM two JOIN pos ON class IN (a, b) GROUP BY 1, 2, 3), rate AS (SELECT a, b, CAST(count(*) FILTER (n > 1) AS BIGINT) AS violations, count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE) AS rate FROM each GROUP BY 1, 2)
SELECT a, b, violations, round(rate, 6) AS violation_rate, CASE WHEN rate <= 0.01 THEN 'A' WHEN rate <= 0.05 THEN 'B' WHEN rate <= 0.10 THEN 'C' ELSE 'D' END AS grade FROM rate"""
)
def mutex_grades(spark, sf_dir):
    """Each two classes that exclude each other, with the customers that have both."""
    two = discovery.exclusive(discovery.pair_counts(customer_classes(spark, sf_dir), "id"), 0.05)
    rate = F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return two.select("a", "b", F.col("n_both").alias("violations"), r6(rate).alias("violation_rate"), discovery.grade_exclusive(rate).alias("grade"))


@BOOK.enter(
    f"""WITH RECURSIVE {CUSTOMERS}, two AS (SELECT a, b, n_a >= 5 AND n_b >= 5 AS enough, row_number() OVER (ORDER BY n_a >= 5 AND n_b >= 5 DESC, a, b) AS i FROM pairs WHERE n_both / CAST(n_a + n_b - n_both AS DOUBLE) <= 0.05), fit AS (
  SELECT list(a || '|' || b) AS ok FROM two), last AS (SELECT coalesce(max(i), 0) AS n FROM two WHERE enough), merge AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[][]) AS groups
  UNION ALL
  SELECT merge.i + 1, CASE WHEN home = 0 THEN list_append(groups, [two.a, two.b]) ELSE list_transform(groups, lambda g, k: CASE WHEN k = home THEN list_sort(list_distinct(list_concat(g, [two.a, two.b]))) ELSE g END) END
  FROM merge JOIN two ON two.i = merge.i + 1 AND two.enough CROSS JOIN fit CROSS JOIN LATERAL (SELECT coalesce(list_position(list_transform(groups, lambda g: (list_contains(g, two.a) OR list_contains(g, two.b))
    AND len(list_filter(g, lambda m: m <> two.a AND NOT list_contains(ok, least(m, two.a) || '|' || greatest(m, two.a)))) = 0 AND len(list_filter(g, lambda m: m <> two.b AND NOT list_contains(ok, least(m, two.b) || '|' || greatest(m, two.b)))) = 0), true), 0) AS home)
), final AS (SELECT groups FROM merge, last WHERE merge.i = last.n), g AS (SELECT unnest(groups) AS members, unnest(range(0, len(groups))) AS k FROM final), each AS (
  SELECT k, id, count(*) AS n FROM g JOIN pos ON list_contains(members, class) GROUP BY 1, 2), rate AS (SELECT k, CAST(count(*) FILTER (n > 1) AS BIGINT) AS violations, count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE) AS rate FROM each GROUP BY 1)
SELECT 'exclusive_' || k AS group_name, list_sort(members) AS members, violations, round(rate, 6) AS violation_rate, CASE WHEN rate <= 0.01 THEN 'A' WHEN rate <= 0.05 THEN 'B' WHEN rate <= 0.10 THEN 'C' ELSE 'D' END AS grade FROM g JOIN rate USING (k)"""
)
def exclusive_groups(spark, sf_dir):
    """The greedy merge of excluding classes into groups, and each group's violations."""
    found = discovery.exclusive_groups(customer_classes(spark, sf_dir), "id", 0.05)
    return found.select("group_name", "members", "violations", r6(F.col("violation_rate")).alias("violation_rate"), "grade")


LABELLED = """
feat AS (
  SELECT o_custkey AS id, avg(l_quantity) AS f1, avg(l_discount) * 100 AS f2, avg(l_tax) * 100 - 4 AS f3 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
), pos AS (
  SELECT DISTINCT o_custkey AS id, o_orderpriority AS class FROM orders WHERE o_totalprice > 300000
), single AS (
  SELECT class, count(*) AS n FROM pos GROUP BY class
), met AS (
  SELECT a.class AS a, b.class AS b, count(*) AS n_both FROM pos a JOIN pos b ON a.id = b.id AND a.class < b.class GROUP BY 1, 2
), means AS (
  SELECT class, avg(f1) AS f1, avg(f2) AS f2, avg(f3) AS f3 FROM pos JOIN feat USING (id) GROUP BY 1
), pairs AS (
  SELECT x.class AS a, y.class AS b, x.n AS n_a, y.n AS n_b, coalesce(met.n_both, 0) AS n_both FROM single x JOIN single y ON x.class < y.class LEFT JOIN met ON met.a = x.class AND met.b = y.class
), two AS (
  SELECT p.a, p.b, n_a, n_b, (n_a + n_b - 2 * n_both) / CAST(n_a + n_b - n_both AS DOUBLE) AS rate, (x.f1 * y.f1 + x.f2 * y.f2 + x.f3 * y.f3) / sqrt(x.f1 * x.f1 + x.f2 * x.f2 + x.f3 * x.f3) / sqrt(y.f1 * y.f1 + y.f2 * y.f2 + y.f3 * y.f3) AS sim
  FROM pairs p JOIN means x ON x.class = p.a JOIN means y ON y.class = p.b
)"""


@BOOK.enter(f"""WITH {LABELLED} SELECT a, b, round(rate, 6) AS substitution_rate, round(sim, 6) AS similarity, CASE WHEN rate >= 0.8 AND sim >= 0.95 THEN 'A' WHEN rate >= 0.6 AND sim >= 0.9 THEN 'B' WHEN rate >= 0.4 AND sim >= 0.85 THEN 'C' ELSE 'D' END AS grade
FROM two WHERE n_a >= 20 AND n_b >= 20 AND rate >= 0.15 AND sim >= 0.85""")
def equivalence_grades(spark, sf_dir):
    """Priorities that stand in for each other among customers with like items."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_discount", "l_tax")
    features = orders.select("o_orderkey", F.col("o_custkey").alias("id")).join(items, "o_orderkey").groupBy("id").agg(F.avg("l_quantity").alias("f1"), (F.avg("l_discount") * 100).alias("f2"), (F.avg("l_tax") * 100 - 4).alias("f3"))
    positives = orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("class")).distinct()
    means = positives.join(features, "id").groupBy("class").agg(F.array(F.avg("f1"), F.avg("f2"), F.avg("f3")).alias("mean"))
    found = discovery.equivalent(discovery.pair_counts(positives, "id"), means)
    return found.select("a", "b", r6(F.col("substitution_rate")).alias("substitution_rate"), r6(F.col("similarity")).alias("similarity"), "grade")


@BOOK.enter("SELECT vec_id, CASE WHEN list_max(embedding) >= 0.2 THEN CAST(list_position(embedding, list_max(embedding)) AS INT) ELSE 0 END AS action FROM embeddings")
def most_probable_class(spark, sf_dir):
    """Number of the greatest component, the first among equals; 0 if it is too small."""
    from flightline.operators import universe

    return table(spark, sf_dir, "embeddings").select("vec_id", universe.most_probable(F.col("embedding"), 0.2).alias("action"))


@BOOK.enter(
    """WITH l AS (SELECT vec_id AS landmark, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings) WHERE q <= 2), d AS (
  SELECT v.vec_id, l.landmark, list_sum(list_transform(list_zip(v.embedding, l.e), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d FROM embeddings v, l), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), landmark) AS place FROM d) SELECT vec_id, landmark, place, round(sqrt(d), 5) AS distance FROM r WHERE place <= 3"""
)
def nearest_landmarks(spark, sf_dir):
    from flightline.operators import universe

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return universe.nearest(vectors, universe.landmarks(vectors, "label", "vec_id", 2), "vec_id", "embedding", 3).select("vec_id", "landmark", "place", rounded(F.col("distance"), 5).alias("distance"))


@BOOK.enter("SELECT quality, toxic, CAST(count(*) AS BIGINT) AS n, CAST(count(*) // 5 AS BIGINT) AS least, CAST((count(*) + 4) // 5 AS BIGINT) AS most FROM labels GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, count(*), NULL, NULL FROM labels")
def stratified_folds(spark, sf_dir):
    """Sizes of each signature's smallest and largest fold, and in all the rows that have one."""
    folded = splitting.folds(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], ["doc_id"], 5)
    sizes = folded.groupBy("quality", "toxic", "fold").count()
    per = sizes.groupBy("quality", "toxic").agg(F.sum("count").alias("n"), (F.when(F.count(F.lit(1)) == 5, F.min("count")).otherwise(0)).cast("long").alias("least"), F.max("count").alias("most"))
    whole = folded.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), "n", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most"))
    return per.unionByName(whole)


@BOOK.enter(
    """WITH g AS (SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS f, max((o_orderpriority = '1-URGENT')::INT) AS urgent, count(*) AS n FROM orders GROUP BY 1)
SELECT f, urgent, CAST(count(*) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS parted, CAST(count(*) // 5 AS BIGINT) AS least, CAST((count(*) + 4) // 5 AS BIGINT) AS most FROM g GROUP BY 1, 2"""
)
def group_atomic_split(spark, sf_dir):
    """For each union of labels: groups, their rows, groups whose rows are in more than one fold (none), and the smallest and largest fold."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("f"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    folded = splitting.deal_groups(orders, "o_custkey", ["f", "urgent"], 5)
    per = folded.groupBy("o_custkey").agg(F.max("f").alias("f"), F.max("urgent").alias("urgent"), F.count(F.lit(1)).alias("rows"), F.countDistinct("fold").alias("folds"), F.min("fold").alias("fold"))
    sizes = per.groupBy("f", "urgent", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.count_if(F.col("folds") > 1).alias("parted"))
    least = F.when(F.count(F.lit(1)) == 5, F.min("n")).otherwise(0).cast("long")
    return sizes.groupBy("f", "urgent").agg(F.sum("n").alias("groups"), F.sum("rows").alias("n_rows"), F.sum("parted").alias("parted"), least.alias("least"), F.max("n").alias("most"))


#: Twelve labels of an order that hardly depend on each other.
MANY = {
    **{f"priority{k}": f"o_orderpriority LIKE '{k}-%'" for k in range(1, 6)}, **{f"status_{c}": f"o_orderstatus = '{c}'" for c in "FOP"}, "dear": "o_totalprice > 250000", "third": "o_custkey % 3 = 0", "even_month": "month(o_orderdate) % 2 = 0", "rare": "o_totalprice > 420000",
}
_MANY_SQL = ", ".join(f"({c})::INT AS {name}" for name, c in MANY.items())
_UNPIVOT = f"UNPIVOT l ON {', '.join(MANY)} INTO NAME label VALUE y"


def many_labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *[F.expr(c).cast("int").alias(name) for name, c in MANY.items()])


def _shares(split: DataFrame, part: str, wanted) -> DataFrame:
    """Of each label: positives, and whether each part's number is within 2 % (or one row) of what is wanted."""
    long = split.unpivot([part], list(MANY), "label", "y")
    per = long.groupBy("label", part).agg(F.sum("y").alias("n"))
    every = per.groupBy("label").agg(F.sum("n").alias("n_positive"), F.collect_list(F.struct(F.col(part).cast("int").alias("part"), "n")).alias("parts"))
    return every.select("label", "n_positive", F.forall("parts", lambda p: F.abs(p["n"] - wanted(p["part"], F.col("n_positive"))) <= F.greatest(F.lit(1.0), 0.02 * wanted(p["part"], F.col("n_positive")))).alias("even"))


@BOOK.enter(f"WITH l AS (SELECT {_MANY_SQL} FROM orders) SELECT label, CAST(sum(y) AS BIGINT) AS n_positive, true AS even FROM ({_UNPIVOT}) GROUP BY 1 UNION ALL SELECT 'rows', count(*), true FROM orders")
def multilabel_folds(spark, sf_dir):
    """Five folds of orders with twelve labels: each label's share of each fold, and the folds' sizes (within one row), are even."""
    split = splitting.folds(many_labels(spark, sf_dir), list(MANY), ["o_orderkey"], 5).drop("o_orderkey", "o_custkey")
    sizes = split.groupBy("fold").count().agg(F.sum("count").alias("n_positive"), (F.max("count") - F.min("count") <= 1).alias("even")).select(F.lit("rows").alias("label"), "n_positive", "even")
    return _shares(split, "fold", lambda _, n: n / 5).unionByName(sizes)


@BOOK.enter(f"WITH l AS (SELECT {_MANY_SQL} FROM orders) SELECT label, CAST(sum(y) AS BIGINT) AS n_positive, true AS even FROM ({_UNPIVOT}) GROUP BY 1 UNION ALL SELECT 'held', CAST(count(*) // 6 AS BIGINT), true FROM orders")
def multilabel_holdout(spark, sf_dir):
    """A sixth of the orders, rounded down, with even shares of twelve labels."""
    orders = many_labels(spark, sf_dir)
    split = splitting.holdout(orders, list(MANY), ["o_orderkey"]).drop("o_orderkey", "o_custkey")
    held = split.agg(F.count_if("held_out").alias("n_positive")).select(F.lit("held").alias("label"), "n_positive", F.lit(True).alias("even"))
    return _shares(split, "held_out", lambda part, n: F.when(part == 1, n / 6).otherwise(n * 5 / 6)).unionByName(held)


@BOOK.enter(f"WITH l AS (SELECT o_orderkey, {_MANY_SQL} FROM orders), p AS (SELECT CASE {' '.join(f'WHEN {c} = 1 THEN {c!r}' for c in reversed(MANY))} ELSE 'none' END AS label FROM l), c AS (SELECT label, count(*) AS n FROM p GROUP BY 1) SELECT CASE WHEN n < 100 THEN 'rare' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def primary_labels(spark, sf_dir):
    """Orders by their first label (here the last of the list leads), labels of fewer than 100 orders taken together."""
    rows = many_labels(spark, sf_dir)
    named = rows.select("o_orderkey", splitting.primary_label(list(reversed(MANY))).alias("label"))
    return splitting.merge_rare(named, "label", 100).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@BOOK.enter("WITH g AS (SELECT count(DISTINCT o_custkey) AS n FROM orders) SELECT CAST(round_even(CAST(o.n // 6 AS DOUBLE) * g.n / o.n, 0) AS BIGINT) AS held_groups, CAST(g.n AS BIGINT) AS groups, CAST(0 AS BIGINT) AS parted, true AS near_size FROM g, (SELECT count(*) AS n FROM orders) o")
def group_holdout(spark, sf_dir):
    """Whole customers that make up about a sixth of the orders: groups held out, all, those in both parts, and whether the rows are within a tenth of the size."""
    orders = many_labels(spark, sf_dir)
    size = splitting.holdout_size(orders.count())
    split = splitting.hold_out_groups(orders, "o_custkey", list(MANY), size)
    per = split.groupBy("o_custkey").agg(F.count_if("held_out").alias("held"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("held") > 0).alias("held_groups"), F.count(F.lit(1)).alias("groups"), F.count_if((F.col("held") > 0) & (F.col("held") < F.col("n"))).alias("parted"), (F.abs(F.sum("held") - size) <= 0.1 * size).alias("near_size"))


@BOOK.enter(
    """WITH e AS (SELECT 'LOCATED_IN' AS type, 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'LOCATED_IN', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'PART_OF', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT DISTINCT 'SUPPLIES', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem) SELECT type, src, dst FROM e"""
)
def graph_edges_explode(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return graph.edges(
        graph.edge(t("supplier"), "LOCATED_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey")), graph.edge(t("customer"), "LOCATED_IN", ("customer", "c_custkey"), ("nation", "c_nationkey")),
        graph.edge(t("nation"), "PART_OF", ("nation", "n_nationkey"), ("region", "n_regionkey")), graph.edge(t("lineitem"), "SUPPLIES", ("supplier", "l_suppkey"), ("part", "l_partkey"), distinct=True),
    )


@BOOK.enter(
    """WITH e AS (SELECT 'supplier:' || s_suppkey AS n FROM supplier UNION ALL SELECT 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || n_regionkey FROM nation)
SELECT n AS node, CAST(count(*) AS BIGINT) AS degree FROM e GROUP BY n"""
)
def graph_degrees(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return graph.degrees(graph.edges(graph.edge(t("supplier"), "LOCATED_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey")), graph.edge(t("nation"), "PART_OF", ("nation", "n_nationkey"), ("region", "n_regionkey"))))


@BOOK.enter(
    """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(round_even(least(1.0, l_discount * 10) * 250, 0) AS INT) AS code FROM lineitem)
SELECT code, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY code"""
)
def quantized_counts(spark, sf_dir):
    from flightline.operators import universe

    return table(spark, sf_dir, "lineitem").select(universe.quantized(F.least(F.lit(1.0), F.col("l_discount") * 10)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@BOOK.enter(
    """WITH v AS (SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_quantity AS INT) AS q FROM lineitem), n AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus, q) - 1 AS vector FROM v)
SELECT n.vector, n.l_returnflag, n.l_linestatus, n.q, CAST(count(*) AS BIGINT) AS states FROM lineitem l JOIN n ON l.l_returnflag = n.l_returnflag AND l.l_linestatus = n.l_linestatus AND CAST(l.l_quantity AS INT) = n.q GROUP BY ALL"""
)
def distinct_vectors(spark, sf_dir):
    from flightline.operators import universe

    states = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"))
    return universe.dictionary(states, ["l_returnflag", "l_linestatus", "q"])
