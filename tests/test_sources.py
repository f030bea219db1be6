import math

import pytest

from flightline.sources import spec, tables


def test_telemetry_round_trip_turns_nan_into_null_and_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, math.nan, 2.0), (1, 0, 1.0, 3.0)], "run long, k long, a double, b double")
    tables.write_telemetry(df, str(tmp_path / "t"))
    back = tables.read_telemetry(spark, str(tmp_path / "t"), ["a"])
    assert back.columns == ["run", "k", "t", "a"]
    assert [(r["t"], r["a"]) for r in back.orderBy("k").collect()] == [(-60.0, 1.0), (-59.98, None)]


def test_documents_and_scores(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"name": "x",\n "rules": [{"f": 1.5}]}')
    row = tables.read_documents(spark, str(tmp_path / "d.json"), "name string, rules array<struct<f: double>>").first()
    assert row["name"] == "x" and row["rules"][0]["f"] == 1.5
    tables.write_scores(spark.createDataFrame([(1, 0, "a", 0.5)], "run long, tick long, mode string, p double"), str(tmp_path / "s"))
    assert dict(spark.read.parquet(str(tmp_path / "s")).dtypes)["p"] == "float"
    assert [tuple(r) for r in tables.read_scores(spark, str(tmp_path / "s"), ["a"]).select("run", "tick", "mode", "p").collect()] == [(1, 0, "a", 0.5)]
    assert tables.read_scores(spark, str(tmp_path / "s"), ["b"]).count() == 0


def test_universe_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([(1, 0.5, 0.25, 1.0), (0, 1.0, 0.0, 0.0)], "vector long, x double, y double, z double")
    states = spark.createDataFrame([(2, 0, 1), (1, 0, 0)], "run long, tick long, vector long")
    tables.write_universe(vectors, states, str(tmp_path / "u"))
    back, own = tables.read_universe(spark, str(tmp_path / "u"))
    assert sorted(tuple(r) for r in back.collect()) == [(0, 1.0, 0.0, 0.0), (1, 0.5, 0.25, 1.0)] and own.count() == 2


GOOD = {
    "domain": "d", "version": "1", "database": {"total_patients": 10, "cohorts": {"a": {"role": "training"}, "b": {"role": "validation"}}}, "signal_processing": {"expected_feature_count": 3},
    "building_blocks": {"canonical_diagnosis_count": 2, "pipeline_stages": ["x"]}, "acceptance": {"overall_f1_target": 0.8, "inference_time_ms": 50, "validation_cohort": "b"},
}


def test_specifications_are_checked(tmp_path):
    import json

    assert spec.problems(GOOD) == [] and list(spec.by_role(GOOD, "training")) == ["a"]
    bad = GOOD | {"version": "", "acceptance": {"overall_f1_target": 1.2, "inference_time_ms": 0, "validation_cohort": "c"}, "database": {"total_patients": 0, "cohorts": {}}}
    assert len(spec.problems(bad)) == 7
    (tmp_path / "s.json").write_text(json.dumps(GOOD))
    assert spec.read(str(tmp_path / "s.json"))["domain"] == "d"
    (tmp_path / "t.toml").write_text('domain = "d"')
    with pytest.raises(ValueError, match="version is missing"):
        spec.read(str(tmp_path / "t.toml"))
