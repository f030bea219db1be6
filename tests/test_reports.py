import json

import pytest
from pyspark.sql import functions as F

from flightline.operators import reports
from flightline.streaming import alerts


@pytest.fixture(scope="module")
def rules(spark):
    rows = [("a", "x", ">", 1.23456, 0.95, 0.99, 0.9, "A", "R-01"), ("a", "y", "<", 2.0, 0.7, 0.85, 0.95, "B", "R-02"), ("b", "x", ">", 3.0, 0.2, 0.5, 0.3, "D", "R-03")]
    return spark.createDataFrame(rows, "class string, feature string, operator string, threshold double, sensitivity double, specificity double, f1 double, grade string, rule_id string")


def test_documents_keep_good_rules_best_first(rules):
    docs = {r["class"]: json.loads(r["document"]) for r in reports.rules_document(rules).collect()}
    assert [r["feature"] for r in docs["a"]["rules"]] == ["y", "x"] and docs["a"]["rules"][1]["threshold"] == 1.2346 and "b" not in docs


def test_hand_off_and_consistency(spark, rules):
    assert {(r["class"], r["bucket"]): r["rules"] for r in reports.hand_off(rules).collect()} == {("a", "deploy"): ["R-01", "R-02"], ("b", "drop"): ["R-03"]}
    assert reports.duplicates(rules.unionByName(rules.limit(1)), "rule_id").count() == 1
    groups = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"])], "id int, members array<string>")
    assert [tuple(r) for r in reports.overlapping(groups).collect()] == [(1, 2, ["b"])]


def test_rule_sets_count_a_row_once(spark, rules):
    obs = spark.createDataFrame([(1, "a", "x", 2.0, 1.0), (1, "a", "y", 1.0, 1.0), (2, "a", "x", 0.0, 1.0), (3, "a", "y", 1.0, 0.0)], "id int, class string, feature string, value double, y double")
    assert reports.rule_set_f1(rules, obs, "id").first()["f1"] == pytest.approx(0.5)


def test_explanations_and_json(spark):
    rows = spark.createDataFrame([(1, "f", 123.4, -2.0, 2), (1, "g", 0.01, 3.0, 1)], "run int, feature string, value double, z double, place int")
    assert reports.explanation(rows, ["run"]).first()["text"] == "g = 0.010 (z +3.0); f = 123 (z -2.0)"
    odd = spark.createDataFrame([(float("nan"), float("inf"), 1.23456)], "a double, b double, c double")
    assert json.loads(odd.select(reports.clean_json(["a", "b", "c"])).first()[0]) == {"a": None, "b": None, "c": 1.2346}


def test_calls_after_a_stop_do_not_count(spark):
    calls = spark.createDataFrame([(1, 1.0, "GO"), (1, 2.0, "HOLD"), (1, 3.0, "ABORT"), (2, 1.0, "GO")], "run int, t double, call string")
    got = {r["run"]: (r["hold_at"], r["abort_at"]) for r in reports.run_summary(calls, ["run"]).collect()}
    assert got == {1: (2.0, None), 2: (None, None)}
    rates = reports.rates_per_thousand(reports.run_summary(calls, ["run"]), [], ["hold_at", "abort_at"]).first()
    assert rates["hold_at_per_1000"] == 500 and rates["abort_at_per_1000"] == 0


def test_stream_over_several_batches_equals_one(spark, sf, tmp_path):
    """State carries over from batch to batch: users' samples come in four files, in order of time."""
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(4):
        part = events.iloc[k * len(events) // 4 : (k + 1) * len(events) // 4]
        part.to_parquet(folder / f"part-{k}.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema(alerts.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    several = alerts.drained(alerts.alerting(stream), str(tmp_path / "a"), "append").collect()
    whole = alerts.drained(alerts.alerting(alerts.read_events(spark, sf)), str(tmp_path / "b"), "append").collect()
    assert sorted(several) == sorted(whole) and len(whole) > 0


def test_rule_sets_exchange_no_rows_by_class_and_feature(spark, rules):
    obs = spark.range(1000).selectExpr("id", "'a' AS class", "'x' AS feature", "cast(id AS double) AS value", "1.0D AS y")
    plan = reports.rule_set_f1(rules.where("sensitivity >= 0" if "sensitivity" in rules.columns else "true").distinct(), obs, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
