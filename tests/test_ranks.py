"""Running sums in ranges, what is built on them, and resampled rank metrics, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.functions import metrics, ranks, resampling
from flightline.operators import preparing, universe


def scored(spark, n=6000, seed=0, ties=True):
    """A hot class with scores in [0, 0.001], two small ones, one with a single class of rows, one of null keys."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        kind = rng.choice(["hot", "a", "b", None], p=[0.8, 0.1, 0.05, 0.05])
        p = float(rng.random()) * (0.001 if kind == "hot" else 1)
        rows.append((k, kind, round(p, 6 if kind == "hot" else 2) if ties else p, int(rng.random() < 0.2 + 0.4 * (p > 0.0005))))
    rows += [(n + k, "one", 0.5, 1) for k in range(5)]
    return spark.createDataFrame(rows, "id long, class string, p double, y int"), rows


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("large", [40, 10**9])
def test_running_sums_do_not_depend_on_how_keys_are_cut(spark, large, descending):
    df, rows = scored(spark)
    tied = df.groupBy("class", "p").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("s"))
    got = {(r["class"], r["p"]): r for r in ranks.running(tied, ["class"], ["p"], ["c", "s"], descending, large, following=True).collect()}
    for kind in {r[1] for r in rows}:
        own = sorted({r[2] for r in rows if r[1] == kind}, reverse=descending)
        count = {p: sum(1 for r in rows if r[1] == kind and r[2] == p) for p in own}
        ones = {p: sum(r[3] for r in rows if r[1] == kind and r[2] == p) for p in own}
        for i, p in enumerate(own):
            r = got[kind, p]
            after = own[i + 1] if i + 1 < len(own) else None
            assert (r["c_upto"], r["s_upto"], r["c_all"], r["s_all"]) == (sum(count[q] for q in own[: i + 1]), sum(ones[q] for q in own[: i + 1]), sum(count.values()), sum(ones.values()))
            assert (r["c_next"], r["s_next"]) == (count.get(after), ones.get(after))
    assert len(got) == tied.count()


def test_skewed_scores_are_cut_evenly(spark):
    """All scores of a class in [0, 0.001]: no range holds much more than it should."""
    rows = spark.range(20_000).select(F.lit("c").alias("class"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e12).alias("p"))
    cut, any_cut = ranks.cut(rows, ["class"], ["p"], 1000)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert any_cut and len(sizes) > 20 and max(sizes) < 3000 and sum(sizes) == 20_000


def test_vectors_are_numbered_in_their_order(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [tuple(float(x) for x in r) for r in rng.integers(0, 4, (3000, 6))]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(6)))
    expected = {v: k for k, v in enumerate(sorted(set(rows)))}
    for large in (50, 10**9):
        monkeypatch.setattr(ranks.running, "__defaults__", (False, large, False))
        got = universe.dictionary(df, [f"c{k}" for k in range(6)]).collect()
        assert {tuple(r[:6]): r["vector"] for r in got} == expected and sum(r["states"] for r in got) == 3000


def test_higher_quantile_of_ties_and_ranges(spark, monkeypatch):
    df, rows = scored(spark)
    monkeypatch.setattr(ranks.running, "__defaults__", (False, 30, False))
    for q in (0.0, 0.3, 0.9985, 1.0):
        got = {r["class"]: (r["quantile"], r["n"]) for r in metrics.higher_quantile(df, ["class"], "p", q).collect()}
        for kind in {r[1] for r in rows}:
            own = np.array([r[2] for r in rows if r[1] == kind])
            assert got[kind] == (np.quantile(own, q, method="higher"), len(own))


def plain_metrics(y, p, w):
    order = np.argsort(-p, kind="stable")
    y, p, w = y[order], p[order], w[order]
    start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    pos, neg = np.add.reduceat(w * (y == 1), start), np.add.reduceat(w * (y != 1), start)
    tp, fp = np.cumsum(pos), np.cumsum(neg)
    auroc = (pos * (fp[-1] - fp + neg / 2)).sum() / (tp[-1] * fp[-1]) if tp[-1] and fp[-1] else np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        return auroc, np.nansum(pos / tp[-1] * tp / (tp + fp)) if tp[-1] else np.nan


@pytest.mark.parametrize("ties", [True, False])
def test_bootstrap_of_rank_metrics_equals_weighted_metrics(spark, ties):
    df, rows = scored(spark, 900, ties=ties)
    few = spark.createDataFrame([(10**6, "few", 0.1, 1), (10**6 + 1, "few", 0.2, 0), (10**6 + 2, "few", None, 1), (10**6 + 3, "few", 0.3, None)], df.schema)
    rows = rows + [tuple(r) for r in few.collect()]
    every = df.unionByName(few).repartition(3)
    got = {(r["class"], r["metric"]): r for r in resampling.bootstrap_ranks(every, ["class"], F.col("y"), F.col("p"), row_hash=F.col("id"), replicates=60).collect()}
    for kind in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == kind and r[2] is not None and r[3] is not None]
        ids, p, y = (np.array([r[k] for r in own]) for k in (0, 2, 3))
        weights = metrics.poisson_weights(ids.astype(np.int64).view(np.uint64), 60)
        values = np.array([plain_metrics(y, p, weights[:, r]) for r in range(60)])
        for number, metric in enumerate(resampling.METRICS):
            v, r = values[:, number][~np.isnan(values[:, number])], got[kind, metric]
            assert r["used"] == len(v), (kind, metric)
            if len(v) > 1:
                assert (r["low"], r["high"], r["mean"]) == pytest.approx((*np.quantile(v, [0.025, 0.975]), v.mean()), abs=1e-12)
            else:
                assert r["low"] is None and r["mean"] is None


def test_a_score_that_very_many_rows_share_goes_over_tasks(spark):
    rows = spark.range(4000).select("id", F.lit(0.5).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y")).unionByName(spark.createDataFrame([(9001, 0.9, 1), (9002, 0.1, 0)], "id long, p double, y int"))
    got = {r["metric"]: r for r in resampling.bootstrap_ranks(rows, [], F.col("y"), F.col("p"), row_hash=F.col("id"), replicates=20).collect()}
    data = rows.toPandas()
    weights = metrics.poisson_weights(data["id"].to_numpy().view(np.uint64), 20)
    values = np.array([plain_metrics(data["y"].to_numpy(), data["p"].to_numpy(), weights[:, r]) for r in range(20)])
    for number, metric in enumerate(resampling.METRICS):
        assert got[metric]["mean"] == pytest.approx(values[:, number].mean(), abs=1e-12)


def plain_curves(y, p):
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    ends = np.append(np.flatnonzero(np.diff(p)), len(p) - 1)
    tps, fps = np.cumsum(y)[ends].astype(float), (1 + ends - np.cumsum(y)[ends]).astype(float)
    keep = np.concatenate([[True], (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), [True]]) if len(ends) > 2 else np.ones(len(ends), bool)
    roc = {(0.0, 0.0, 1.0), *zip(fps[keep] / fps[-1], tps[keep] / tps[-1], p[ends][keep], strict=True)}
    return roc, {(0.0, 1.0, None), *zip(tps / tps[-1], tps / (tps + fps), p[ends], strict=True)}


@pytest.mark.parametrize("large", [20, 10**9])
def test_curves_have_their_ends_and_no_points_in_straight_runs(spark, monkeypatch, large):
    df, rows = scored(spark, 1500)
    monkeypatch.setattr(ranks.running, "__defaults__", (False, large, False))
    got = metrics.curves(df, ["class"], F.col("y"), F.col("p")).collect()
    for kind in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == kind]
        expected = plain_curves(np.array([r[3] for r in own]), np.array([r[2] for r in own])) if len({r[3] for r in own}) == 2 else (set(), set())
        for curve, points in zip(("roc", "pr"), expected, strict=True):
            found = [(r["x"], r["y"], r["threshold"]) for r in got if r["class"] == kind and r["curve"] == curve]
            assert len(found) == len(points) and set(found) == points


def test_preparation_is_fitted_on_the_work_set_alone(spark):
    work = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, 5.0, None), (float("nan"), 5.0, None), (10.0, None, None), (4.0, 5.0, None)], "a double, b double, c double")
    fitted = preparing.fit(work, ["a", "b", "c"])
    assert fitted.median == {"a": 3.5, "b": 5.0, "c": None} and fitted.deviation["b"] == 0.0
    filled = np.array([1, 3, 3.5, 3.5, 10, 4])
    other = spark.createDataFrame([(None, 7.0, 1.0), (100.0, None, None)], work.schema)
    got = fitted.scale(other).collect()
    assert got[0]["a"] == pytest.approx((3.5 - filled.mean()) / filled.std()) and got[0]["b"] == 2.0 and got[0]["c"] is None
    assert got[1]["b"] == 0.0 and fitted.impute(other).collect()[0]["a"] == 3.5
