"""Many runs in one group of a stream: they go on side by side, with the rows that each has by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.functions import features as ft
from flightline.sources import scratch
from flightline.streaming import alerts, replays

NAMES = [c.name for c in ft.CHANNELS]
REFERENCES = ["ref_vib", "ref_lox", "band", "drift"]


def run(rng, n, rate):
    k = np.arange(n)
    v = rng.random((n, len(NAMES))).round(2) * 100
    v[rng.random(v.shape) < 0.1] = np.nan
    v[: int(rng.integers(0, 20)), rng.random(len(NAMES)) < 0.3] = np.nan
    return k, -60 + k / rate, v, np.column_stack([np.full(n, 1.5), 3 + k / 100, 0.3 + k / 50, k / 50])


@pytest.mark.parametrize(("rate", "filtered"), [(0.3, False), (2.0, False), (5.0, True)])
def test_runs_side_by_side_are_as_one_by_one(rate, filtered):
    rng = np.random.default_rng(3)
    catalogue = ft.launch_catalogue(50.0) if filtered else ft.launch_catalogue(rate).without_filters()
    running = ft.Running(catalogue, 5)
    longest = 400 if filtered else int(210 * rate)
    runs = [run(rng, int(n), rate) for n in (*rng.integers(longest // 3, longest, 20), 1, longest, longest)]
    there = rng.random(len(runs[4][0])) > 0.3  # a run with samples that never came
    runs[4] = tuple(x[there] for x in runs[4])
    alone, together = [running.start() for _ in runs], [running.start() for _ in runs]
    cuts = [0, *sorted(rng.integers(1, longest, 3).tolist()), longest]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        parts = {i: tuple(x[(r[0] >= a) & (r[0] < b)] for x in r) for i, r in enumerate(runs) if ((r[0] >= a) & (r[0] < b)).any()}
        done = running.advance_all([together[i] for i in parts], list(parts.values()))
        for (i, part), (k, t, found, carry) in zip(parts.items(), done, strict=True):
            own_k, own_t, own_found, alone[i] = running.advance(alone[i], *part)
            together[i] = carry
            assert k.tolist() == own_k.tolist() == [x for x in part[0].tolist() if x % 5 == 0] and t.tolist() == own_t.tolist()
            assert np.allclose(found, own_found, rtol=1e-9, atol=1e-9, equal_nan=True)
            assert carry.tail_k.tolist() == alone[i].tail_k.tolist()


def progress_of(result, folder):
    query = result.writeStream.format("noop").outputMode("append").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def test_state_is_kept_by_groups_of_runs(spark):
    rows = spark.range(60 * 20).select((F.col("id") % 60).alias("run"), F.floor(F.col("id") / 60).alias("tick")).withColumns({"t": F.col("tick") / 2 - 4, "a": F.rand(1), "b": F.rand(2), "ts": F.timestamp_seconds(replays.EPOCH + F.col("tick"))})
    stream = alerts.in_stretches(rows, "tick", 2, scratch.new_path(spark, "test-groups"))
    seen = progress_of(replays.call_stream(stream, {"a": 0.5, "b": 0.5}, [["a", "b"]], ["a"], ["b"], late="1 hour", groups=4), scratch.new_path(spark, "test-progress"))
    assert sum(p["numInputRows"] for p in seen) == 1200
    assert {p["stateOperators"][0]["numRowsTotal"] for p in seen} == {4}


def test_a_stretch_in_many_files_is_one_batch(spark):
    rows = spark.range(0, 6000, 1, 8).select((F.col("id") % 600).alias("run"), F.floor(F.col("id") / 600).alias("k"))
    stored = rows.repartition(8, "run")
    # So small files are read by one task each.
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        stream = alerts.in_stretches(stored, "k", 5, scratch.new_path(spark, "test-stretches"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    seen = [p["numInputRows"] for p in progress_of(stream, scratch.new_path(spark, "test-progress"))]
    assert [n for n in seen if n] == [1200] * 5


def test_runs_without_a_name_and_with_great_numbers(spark):
    runs = [None, 2**53 + 1, 2**53 + 2, -1]
    rows = spark.createDataFrame([(r, k, k / 2 - 5.0, 0.25 * (i + 1), 0.1) for i, r in enumerate(runs) for k in range(20)], "run long, tick long, t double, a double, b double").withColumn("ts", F.timestamp_seconds(replays.EPOCH + F.col("tick")))
    stream = alerts.in_stretches(rows, "tick", 3, scratch.new_path(spark, "test-names"))
    got = alerts.drained(replays.call_stream(stream, {"a": 0.5, "b": 0.5}, [["a", "b"]], ["a"], ["b"], late="1 hour", groups=1), scratch.new_path(spark, "test-out"), "append").collect()
    assert len(got) == 80
    for i, name in enumerate(runs):
        own = sorted((r for r in got if r["run"] == name), key=lambda r: r["tick"])
        assert [r["tick"] for r in own] == list(range(20))
        assert [r["held"][0] for r in own] == [0.0] + [0.25 * (i + 1)] * 19
        assert [r["latched"][0] for r in own] == [False] + [i >= 1] * 19
        assert own[0]["call"] == "GO" and own[-1]["call"] == ("ABORT" if i else "ENGINE_START")


def test_calls_of_runs_in_one_group_are_those_of_runs_alone(spark):
    """Runs of different lengths, with rows out of order and some that never come, in one group and in many."""
    rows = spark.range(40 * 60).select((F.col("id") % 40).cast("string").alias("run"), F.floor(F.col("id") / 40).alias("tick")).where("tick < 20 + cast(run as int) and (tick + cast(run as int)) % 17 > 0")
    score = lambda n: F.round(F.pmod(F.xxhash64("run", "tick", F.lit(n)), F.lit(1000)) / 1000 * (0.5 + F.col("run").cast("int") / 50), 3)
    scores = rows.withColumns({"t": F.col("tick") / 2 - 5, "a": score(1), "b": score(2), "c": score(3), "ts": F.timestamp_seconds(replays.EPOCH + F.col("tick")), "turn": F.greatest(F.lit(0), F.col("tick") + F.pmod(F.xxhash64("tick", "run"), F.lit(9)) - 4)})
    found = []
    for groups in (1, 2048):
        stream = alerts.in_stretches(scores, "turn", 4, scratch.new_path(spark, "test-scores"))
        calls = replays.call_stream(stream, {"a": 0.6, "b": 0.5, "c": 0.7}, [["a", "b"]], ["a"], ["b"], late="5 seconds", groups=groups)
        found.append(sorted(tuple(r) for r in alerts.drained(calls, scratch.new_path(spark, "test-calls"), "append").collect()))
    assert found[0] == found[1] and len(found[0]) > 1000 and len({r[6] for r in found[0]}) >= 6
