"""Filters, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flightline.functions import filters, metrics
from flightline.operators import boosting, models, splitting
from flightline.plans import label_queries, series_queries
from flightline.plans.book import Book, r6, rounded, table
from flightline.streaming import alerts

BOOK = Book()


def _folder(spark, name: str) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _recurrence() -> str:
    """The two biquads, sample by sample, as a recursive query."""
    (b1, a1), (b2, a2) = filters.butterworth(2.0, 0.15, 0.5)
    n = lambda x: f"{float(x)!r}::DOUBLE"
    y1, y2 = f"{n(b1[0])} * x + p1", f"{n(b2[0])} * y + q1"
    return f"""WITH RECURSIVE {series_queries.BASE}, g AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS i, h - first_value(h) OVER (PARTITION BY user_id ORDER BY k) AS x FROM f WHERE h IS NOT NULL), r AS (
  SELECT CAST(-1 AS BIGINT) AS i, user_id, CAST(NULL AS BIGINT) AS k, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS z FROM (SELECT DISTINCT user_id FROM g)
  UNION ALL
  SELECT i, user_id, k, {n(b1[1])} * x - {n(a1[1])} * y + p2, {n(b1[2])} * x - {n(a1[2])} * y, {n(b2[1])} * y - {n(a2[1])} * z + q2, {n(b2[2])} * y - {n(a2[2])} * z, z
  FROM (SELECT *, {y2} AS z FROM (SELECT g.i, g.user_id, g.k, g.x, p1, p2, q1, q2, {y1} AS y FROM r JOIN g ON g.user_id = r.user_id AND g.i = r.i + 1))
) SELECT user_id, k, round(z, 6) AS h_filtered FROM r WHERE i >= 0"""


@BOOK.enter(_recurrence())
def iir_bandpass(spark, sf_dir):
    """A user's held values through a band-pass filter (one sample a tick of half a second), in blocks of 16 samples."""
    rows = series_queries.held(spark, sf_dir).where("h is not null").select("user_id", "k", "h")
    return filters.filtered(rows, "user_id", ["k"], ["h"], 2.0, 0.15, 0.5, F.floor(F.col("k") / 16)).select("user_id", "k", r6(F.col("h_filtered")).alias("h_filtered"))


@BOOK.enter()
def gbt_scores(spark, sf_dir):
    """Out-of-fold scores of 'finished' orders by boosted trees on their items' features."""
    rows = label_queries.wide(spark, sf_dir).select("id", *label_queries.FEATURES, (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    folded = splitting.deal(rows, ["label"], ["id"], 3)
    return models.out_of_fold(folded, label_queries.FEATURES, "label", 3).select("id", "fold", "label", "score")


@BOOK.enter("WITH c AS (SELECT o_orderkey AS id, unnest(['F', 'O', 'P']) AS class FROM orders) SELECT class, count(*) AS scored, count(DISTINCT id) AS orders, true AS between FROM c GROUP BY 1")
def boosted_scores(spark, sf_dir):
    """Histogram trees on features of which a fifth is missing, three classes out of fold, all grown together: orders scored, and whether all scores lie between 0 and 1."""
    classes = {c: (F.col("o_orderstatus") == c).cast("int") for c in "FOP"}
    gone = lambda c: F.when(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(5)) > 0, F.col(c)).alias(c)
    rows = label_queries.wide(spark, sf_dir).select("id", *[gone(c) for c in label_queries.FEATURES], *[label.alias(f"is_{c}") for c, label in classes.items()])
    folded = splitting.folds(rows, [f"is_{c}" for c in classes], ["id"], 3)
    found = boosting.out_of_fold(folded, "id", label_queries.FEATURES, {c: F.col(f"is_{c}") for c in classes}, "fold", 3)
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("scored"), F.countDistinct("id").alias("orders"), ((F.min("score") > 0) & (F.max("score") < 1)).alias("between"))


@BOOK.enter()
def pca_embedding(spark, sf_dir):
    return models.principal_axes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", *[r6(F.col(c)).alias(c) for c in "xyz"])


@BOOK.enter()
def bootstrap_ci(spark, sf_dir):
    """Interval of the Brier score of each priority's scores."""
    rows = label_queries.scores(spark, sf_dir)
    return metrics.bootstrap(rows, ["class"], [F.pow(F.col("p") - F.col("y"), 2), F.lit(1.0)], lambda s, n: s / n)


@BOOK.enter("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streaming_window_counts(spark, sf_dir):
    counts = alerts.windowed_counts(alerts.read_events(spark, sf_dir))
    done = alerts.drained(counts, _folder(spark, "stream-counts"), "update", ("start", "event_type"))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@BOOK.enter(
    """SELECT CAST(s AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total
FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS s FROM events) GROUP BY 1, 2"""
)
def streaming_sliding_counts(spark, sf_dir):
    """Windows of three days that begin every day."""
    counts = alerts.windowed_counts(alerts.read_events(spark, sf_dir), "3 days", "4 days", "1 day")
    done = alerts.drained(counts, _folder(spark, "stream-sliding"), "update", ("start", "event_type"))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@BOOK.enter(
    f"""WITH {series_queries.BASE}, g AS (SELECT user_id, k, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM s), c AS (SELECT *, CASE WHEN g IS NOT NULL THEN least(1.0, g / 200.0) END AS p FROM g), d AS (
  SELECT *, p >= 0.3 AND lag(p) OVER (PARTITION BY user_id ORDER BY k) >= 0.3 AS hit FROM c) SELECT user_id, min(k) AS first_k, min(ts) AS first_ts FROM d WHERE hit GROUP BY user_id"""
)
def streaming_first_alert(spark, sf_dir):
    """The strictly causal form: a leading gap stays open, as a stream cannot fill it from what has not come yet."""
    found = alerts.drained(alerts.alerting(alerts.read_events(spark, sf_dir)), _folder(spark, "stream-alerts"), "append")
    return found.select("user_id", "first_k", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"))
