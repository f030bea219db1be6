"""Streams of features and calls against batch, over many micro-batches, out of order, with gaps, and over a restart."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flightline.functions import features as ft
from flightline.functions.timeseries import Series
from flightline.operators import decisions
from flightline.sources import scratch
from flightline.streaming import alerts, replays

RATE = 2.0
EPOCH = replays.EPOCH
CATALOGUE = ft.launch_catalogue(RATE).without_filters()
NAMES = [c.name for c in ft.CHANNELS]


def telemetry(runs=3, n=300, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for run in range(runs):
        pdf = pd.DataFrame({"run": f"r{run}", "k": np.arange(n), "t": -60 + np.arange(n) / RATE})
        for j, name in enumerate(NAMES):
            x = 10.0 * (j + 1) + rng.normal(0, 1, n).cumsum() / 5
            x[rng.random(n) < 0.05] = np.nan
            pdf[name] = x
        parts.append(pdf.assign(ref_vib=1.5, ref_lox=3.0 + pdf["k"] / 1000, band=0.3 + pdf["k"] / 50, drift=pdf["k"] / 50))
    return pd.concat(parts)


def written(spark, pdf, pieces, folder):
    for k, part in enumerate(pieces):
        spark.createDataFrame(pdf.iloc[part]).withColumn("ts", F.timestamp_seconds(EPOCH + F.col("k") / RATE)).coalesce(1).write.parquet(f"{folder}/stretch-{k}")
    return spark.read.parquet(f"{folder}/stretch-0").schema


def stream_of(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/stretch-*")


def same(got, expected, names):
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        for name in names:
            x, y = a[name], b[name]
            assert x is None if y is None else x == (pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else y), (name, a["run"], a["tick"])


def test_streamed_features_equal_batch_over_ten_batches_and_a_restart(spark):
    pdf = telemetry()
    rng = np.random.default_rng(5)
    # Ten stretches of time; rows near a border are in the neighbouring one, and rows in each come in any order.
    place = np.clip((pdf["k"].to_numpy() + rng.integers(-4, 5, len(pdf))) * 10 // 300, 0, 9)
    pieces = [rng.permutation(np.flatnonzero(place == k)) for k in range(10)]
    folder = scratch.new_path(spark, "test-features")
    schema = written(spark, pdf, pieces[:6], folder)
    out = scratch.new_path(spark, "test-out")
    first = alerts.drained(replays.feature_stream(stream_of(spark, schema, folder), CATALOGUE, tick=5, late="1 hour"), out, "append").count()
    for k, part in enumerate(pieces[6:], 6):
        spark.createDataFrame(pdf.iloc[part]).withColumn("ts", F.timestamp_seconds(EPOCH + F.col("k") / RATE)).coalesce(1).write.parquet(f"{folder}/stretch-{k}")
    done = alerts.drained(replays.feature_stream(stream_of(spark, schema, folder), CATALOGUE, tick=5, late="1 hour"), out, "append")
    got = sorted(done.collect(), key=lambda r: (r["run"], r["tick"]))
    expected = sorted(ft.feature_cube(spark.createDataFrame(pdf), CATALOGUE, 5, fill_leading=False).collect(), key=lambda r: (r["run"], r["tick"]))
    assert 0 < first < len(got)
    same(got, expected, ["run", "tick", "t_now", *[f.name for f in CATALOGUE.features()]])


def test_samples_that_never_come_are_passed_over_and_late_ones_dropped():
    order = replays.InOrder(3)
    rows = lambda *k: np.array([[x, 100.0 * x, x] for x in k]).reshape(-1, 3)
    assert order.take(rows(1, 0, 3), -1)[:, 0].tolist() == [0, 1]
    assert order.take(rows(5, 4), 150)[:, 0].tolist() == []
    assert order.take(rows(1, 4), 350)[:, 0].tolist() == [3, 4, 5]  # 2 is lost
    assert order.take(rows(2), 350)[:, 0].tolist() == [] and order.take(rows(6), 0)[:, 0].tolist() == [6]
    assert order.take(np.zeros((0, 3)), 10**6).tolist() == []


def test_streamed_calls_equal_batch(spark):
    rng = np.random.default_rng(1)
    modes, groups = {"a": 0.6, "b": 0.5, "c": 0.7}, [["a", "b"]]
    rows = [(f"r{run}", k, k / 2 - 10.0, *(float(x) for x in rng.random(3).round(2) ** (1 + 3 * run))) for run in range(12) for k in range(80)]
    pdf = pd.DataFrame(rows, columns=["run", "tick", "t", "a", "b", "c"])
    folder, out = scratch.new_path(spark, "test-scores"), scratch.new_path(spark, "test-calls")
    pieces = [np.flatnonzero((pdf["tick"] * 10 // 80 == k).to_numpy()) for k in range(10)]
    for k, part in enumerate(pieces):
        spark.createDataFrame(pdf.iloc[part]).withColumn("ts", F.timestamp_seconds(EPOCH + F.col("tick") / 2)).write.parquet(f"{folder}/stretch-{k}")
    stream = stream_of(spark, spark.read.parquet(f"{folder}/stretch-0").schema, folder)
    got = alerts.drained(replays.call_stream(stream, modes, groups, ["a"], ["b"], late="1 hour"), out, "append")
    got = {(r["run"], r["tick"]): r for r in got.collect()}
    series = Series(("run", "mode"), ("tick",))
    long = spark.createDataFrame(pdf).unpivot(["run", "tick", "t"], list(modes), "mode", "p").withColumn("threshold", F.expr("case mode when 'a' then 0.6 when 'b' then 0.5 else 0.7 end")).withColumn("grp", F.expr("case when mode in ('a', 'b') then 'x' end"))
    decided = decisions.decide(long, series, "p", "threshold", "grp")
    calls = {(r["run"], r["tick"]): r["call"] for r in decisions.calls(decided, series, "t", ["a"], ["b"]).collect()}
    assert set(got) == set(calls) and len(set(calls.values())) >= 6
    for r in decided.collect():
        g, k = got[r["run"], r["tick"]], list(modes).index(r["mode"])
        assert (g["held"][k], g["active"][k], g["latched"][k]) == (r["held"], r["active"], r["latched"])
    for (run, tick), call in calls.items():
        assert got[run, tick]["call"] == call and got[run, tick]["changed"] == (tick == 0 or calls[run, tick - 1] != call)
