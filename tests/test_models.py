"""Boosted trees, bootstrap and placement against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.functions import metrics
from flightline.operators import decisions, models, universe


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for k in range(240):
        a, b = rng.normal(size=2)
        out.append((k, None if k % 11 == 0 else float(a), float(b), float(a > 0.2), float(b < -0.3), k % 3))
    return spark.createDataFrame(out, "id long, a double, b double, high double, low double, fold int").cache()


def test_trees_learn_score_out_of_fold_and_survive_saving(rows, tmp_path):
    fitted = models.fit_all(rows, ["a", "b"], ["high", "low"], iterations=3)
    got = models.score_all(fitted, rows, ["a", "b"], ["id"])
    assert got.columns == ["id", "p_high", "p_low"] and got.where("p_high between 0 and 1").count() == 240
    met = got.join(rows, "id")
    right = met.where("a is not null").agg(F.avg(((F.col("p_high") >= 0.5) == (F.col("high") == 1)).cast("double"))).first()[0]
    assert right > 0.95
    models.save(fitted, str(tmp_path / "m"))
    again = models.score_all(models.load(str(tmp_path / "m"), ["high", "low"]), rows, ["a", "b"], ["id"])
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in got.collect())
    oof = models.out_of_fold(rows, ["a", "b"], "low", 3, iterations=3)
    assert oof.count() == 240 and oof.agg(F.avg(((F.col("score") >= 0.5) == (F.col("low") == 1)).cast("double"))).first()[0] > 0.95


def test_bootstrap_equals_its_weights(spark):
    rng = np.random.default_rng(8)
    data = [(k, "ab"[k % 2], float(v)) for k, v in enumerate(rng.normal(size=50))]
    df = spark.createDataFrame(data, "id long, class string, x double")
    hashes = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id", F.lit(0))).collect()], np.int64).view(np.uint64)
    weights = metrics.poisson_weights(hashes, 400)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    for parts in (1, 5):
        got = {r["class"]: (r["low"], r["high"]) for r in metrics.bootstrap(df.repartition(parts), ["class"], [F.col("x"), F.lit(1.0)], lambda s, n: s / n, replicates=400).collect()}
        for c in "ab":
            own = np.array([v[1] == c for v in data])
            x = np.array([v[2] for v in data])
            means = (weights[own] * x[own][:, None]).sum(axis=0) / weights[own].sum(axis=0)
            assert got[c] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_axes_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, v array<double>")
    got = np.array([[r["x"], r["y"], r["z"]] for r in models.principal_axes(df, "v").orderBy("id").collect()])
    _, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(abs(got), abs(x @ vectors[:, ::-1][:, :3]), atol=1e-6)


def test_landmarks_beyond_the_limit_are_searched_in_lots(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(0, 6, (80, 4)).astype(float)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>")
    marks = df.where("id < 40")
    d = ((x[:, None] - x[None, :40]) ** 2).sum(axis=2)
    expected = {(k, int(j), p + 1) for k in range(80) for p, j in enumerate(np.lexsort((np.arange(40), d[k]))[:3])}
    for most in (1000, 7):
        got = {(r["id"], r["landmark"], r["place"]) for r in universe.nearest(df, marks, "id", "v", 3, most).collect()}
        assert got == expected
    assert universe.nearest(df, marks.limit(0), "id", "v", 3).count() == 0


def test_calls_follow_phase_and_gravity(spark):
    rows = [(-5.0, True, True, True, "HOLD"), (-5.0, False, False, False, "GO"), (0.0, False, False, False, "ENGINE_START"), (6.5, False, False, False, "COMMIT"), (6.9, True, False, False, "ABORT"), (7.0, True, True, True, "CRITICAL"), (9.0, True, False, True, "WARNING"), (9.0, True, False, False, "ADVISORY"), (9.0, False, False, False, "NOMINAL")]
    df = spark.createDataFrame(rows, "t double, any boolean, critical boolean, warning boolean, expected string")
    assert df.where(decisions.call(F.col("t"), F.col("any"), F.col("critical"), F.col("warning")) != F.col("expected")).count() == 0
    levels = spark.createDataFrame([("X", -1.0, "HOLD"), ("X", 3.0, "ABORT"), ("X", 8.0, "CRITICAL"), ("Y", 8.0, "WARNING"), ("Z", 8.0, "ADVISORY")], "mode string, t double, expected string")
    assert levels.where(decisions.alert_level(F.col("mode"), F.col("t"), ["X"], ["Y"]) != F.col("expected")).count() == 0


def test_grades_are_inclusive_and_count_positives(spark):
    from flightline.operators import discovery

    rows = [(0.8, 0.8, 50, "A"), (0.8, 0.8, 49, "B"), (0.6, 0.6, 20, "B"), (0.95, 0.59, 100, "C"), (0.4, 0.4, 10, "C"), (0.4, 0.4, 9, "D"), (0.39, 0.9, 90, "D")]
    df = spark.createDataFrame(rows, "s double, p double, n long, expected string")
    assert df.where(discovery.grade(F.col("s"), F.col("p"), F.col("n")) != F.col("expected")).count() == 0
