"""Hand-made cases: golden micro-examples, ties, missing values, metamorphic properties."""

from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.functions import filters, metrics
from flightline.functions.timeseries import Series, cut_at_stop, envelope
from flightline.operators import decisions, discovery, graph, splitting, universe

S = Series(("e",), ("k",))


def series(spark, values, entity=1):
    return spark.createDataFrame([(entity, k, None if v is None else float(v)) for k, v in enumerate(values)], "e int, k long, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("e", "k").collect()]


def test_debounce_golden(spark):
    df = series(spark, [0.0, 0.9, 0.1, 0.9, 0.9]).withColumn("x", S.debounced(F.col("v")))
    assert column(df, "x") == [0.0, 0.0, 0.1, 0.1, 0.9]


def test_forward_fill_leading_gap_and_all_missing(spark):
    df = series(spark, [None, None, 3, None, 5]).unionByName(series(spark, [None, None], 2))
    assert column(df.withColumn("x", S.forward_fill(F.col("v"))), "x") == [3, 3, 3, 3, 5, None, None]
    assert column(df.withColumn("x", S.forward_fill(F.col("v"), fill_leading=False)), "x") == [None, None, 3, 3, 5, None, None]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_trailing_mean_equals_brute_force(spark, n):
    values = [float(x) for x in np.random.default_rng(1).normal(size=12)]
    got = column(series(spark, values).withColumn("x", S.trailing_mean(F.col("v"), n)), "x")
    assert np.allclose(got, [np.mean(values[max(0, k - n + 1) : k + 1]) for k in range(12)])


def test_persistence_of_exactly_n_and_split_runs(spark):
    flags = [1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0]
    got = column(series(spark, flags).withColumn("x", S.persisted(F.col("v") == 1, 5)), "x")
    assert [k for k, x in enumerate(got) if x] == [9]


def test_causal_columns_do_not_see_the_future(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(size=40)]
    made = {"m": S.trailing_mean(F.col("v"), 7), "g": S.gated(F.stddev_pop, F.col("v"), F.col("k") >= 3, 5), "c": S.first_crossing(F.col("v"), 1.0, F.col("k"), F.col("k") >= 2), "l": S.latched(F.col("v") > 1.5)}
    whole = series(spark, values).withColumns(made).where("k < 25")
    cut = series(spark, values[:25]).withColumns(made)
    for name in made:
        assert column(whole, name) == column(cut, name)


def test_stop_truncation_keeps_the_stop(spark):
    calls = spark.createDataFrame([(1, k, c) for k, c in enumerate(["GO", "GO", "HOLD", "GO", "HOLD"])], "e int, k long, call string")
    assert column(cut_at_stop(calls, S, F.col("call"), ["HOLD"]), "call") == ["GO", "GO", "HOLD"]


def test_envelope_drops_the_last_partial_bin(spark):
    df = envelope(series(spark, range(25)), ["e"], F.col("k"), F.col("v"), 10)
    assert [(r["bin"], r["low"], r["high"]) for r in df.orderBy("bin").collect()] == [(0, 0, 9), (1, 10, 19)]


@pytest.mark.parametrize("n,q", [(1, 0.5), (4, 0.5), (7, 0.9), (1000, 0.9985), (101, 0.99)])
def test_higher_quantile(spark, n, q):
    values = np.random.default_rng(n).integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert metrics.higher_quantile(df, [], "x", q).first()["quantile"] == np.quantile(values, q, method="higher")


def test_ranking_metrics_with_ties_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 12
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, p, strict=True)] + [("one", 1, 0.5)], "class string, y int, p double")
    ranked = metrics.by_score(df, ["class"], F.col("y"), F.col("p"))
    pos, neg = p[y == 1], p[y == 0]
    expected = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    got = {r["class"]: r["auroc"] for r in metrics.auroc(ranked, ["class"]).collect()}
    assert got["a"] == pytest.approx(expected) and got["one"] is None
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = (hit & (y == 1)).sum() / len(pos), (y[hit] == 1).mean()
        ap, last = ap + (recall - last) * precision, recall
    assert {r["class"]: r["average_precision"] for r in metrics.average_precision(ranked, ["class"]).collect()}["a"] == pytest.approx(ap)


def test_battery_of_nothing_is_zero(spark):
    r = metrics.battery(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")).first()
    assert r["f1"] == r["mcc"] == r["ppv"] == 0.0


def test_sweep_ties_go_to_the_lowest_threshold_and_to_greater(spark):
    rng = np.random.default_rng(7)
    value, y = rng.integers(0, 9, 80).astype(float), rng.integers(0, 2, 80).astype(float)
    obs = spark.createDataFrame([("c", "f", float(v), float(t)) for v, t in zip(value, y, strict=True)] + [("c", "flat", 1.0, 1.0)] * 3, "class string, feature string, value double, y double")
    got = discovery.sweep(obs).collect()
    best = None
    for i in range(1, 51):
        t = value.min() + (value.max() - value.min()) * i / 51
        for op, hit in ((">", value > t), ("<", value < t)):
            f1 = 2 * (hit & (y == 1)).sum() / (hit.sum() + y.sum())
            if best is None or f1 > best[0] + 1e-12:
                best = f1, t, op
    assert len(got) == 1 and (got[0]["operator"], got[0]["threshold"], got[0]["f1"]) == (best[2], pytest.approx(best[1]), pytest.approx(best[0]))


def test_missing_values_never_fire(spark):
    df = spark.createDataFrame([(None, ">", 1.0), (2.0, ">", 1.0), (2.0, "<", 1.0), (1.0, ">=", 1.0)], "v double, o string, t double")
    assert [r[0] for r in df.select(discovery.fires(F.col("v"), F.col("o"), F.col("t"))).collect()] == [False, True, False, True]


def test_poisson_tail(spark):
    from math import exp, factorial

    pairs = spark.createDataFrame([("a", "b", 40, 50, 12)], "a string, b string, n_a long, n_b long, n_both long")
    got = discovery.lift(pairs, 500, level=2.0).first()
    assert got["lift"] == pytest.approx(3.0) and got["p_adjusted"] == pytest.approx(1 - sum(exp(-4) * 4**k / factorial(k) for k in range(12)))


def test_greedy_groups_are_cliques():
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("d", "e")]
    assert discovery.greedy_groups(pairs) == [{"a", "b", "c"}, {"d", "e"}]
    assert discovery.greedy_groups([("a", "b"), ("b", "c")]) == [{"a", "b"}, {"b", "c"}]


def test_folds_are_even_and_groups_whole(spark):
    rows = spark.createDataFrame([(i, i // 3, int(i % 7 == 0)) for i in range(700)], "id long, g long, y int")
    sizes = [r["count"] for r in splitting.deal(rows, ["y"], ["id"], 5).groupBy("y", "fold").count().where("y = 1").collect()]
    assert sum(sizes) == 100 and max(sizes) - min(sizes) <= 1
    whole = splitting.deal_groups(rows, "g", ["y"], 4)
    assert whole.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert splitting.holdout_size(100, folds=4) == 20 and splitting.holdout_size(3, share=0.1) == 1


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(200)], "id long, y int")
    a = {(r["id"], r["fold"]) for r in splitting.deal(rows.repartition(1), ["y"], ["id"], 5).collect()}
    assert a == {(r["id"], r["fold"]) for r in splitting.deal(rows.repartition(7), ["y"], ["id"], 5).collect()}


def test_most_probable_golden(spark):
    rows = [[0.0] * 6, [0, 0, 0.6, 0, 0, 0], [0.5, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0.49]]
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "k int, p array<double>")
    assert [r[0] for r in df.orderBy("k").select(universe.most_probable(F.col("p"))).collect()] == [0, 3, 1, 0]


def test_exclusive_modes_keep_the_first_of_equals(spark):
    scores = spark.createDataFrame([(1, k, m, 0.9, 0.5, "g") for k in range(3) for m in ("a", "b")], "run int, k long, mode string, p double, t double, grp string")
    out = decisions.decide(scores, Series(("run", "mode"), ("k",)), "p", "t", "grp")
    assert {(r["k"], r["mode"]) for r in out.where("active").collect()} == {(1, "a"), (2, "a")}


@pytest.mark.parametrize("low,high", [(1.5, None), (0.15, 0.5), (0.9, 2.4), (10.0, 20.0)])
def test_filter_gain_at_its_edges(low, high):
    sections = filters.butterworth(50.0, low, high)
    for edge in filter(None, (low, high)):
        assert filters.gain_at(sections, edge, 50.0) == pytest.approx(0.70711, abs=1e-4)
    for _, a in sections:
        assert np.abs(np.roots(a)).max() < 1


def test_graph_has_no_dangling_edges(spark):
    e = graph.edges(graph.edge(spark.createDataFrame([(1, 2), (2, None)], "a int, b int"), "X", ("p", "a"), ("q", "b")))
    assert e.count() == 1 and graph.dangling(e, graph.nodes_of(e)).count() == 0


def test_trailing_mean_depends_on_its_own_samples_only(spark):
    values = [float(x) for x in np.random.default_rng(3).integers(0, 60_000, 400) / 100]
    got = column(series(spark, values).withColumn("x", S.trailing_mean(F.col("v"), 5)), "x")
    assert got == [reduce(add, values[max(0, k - 4) : k + 1]) / min(5, k + 1) for k in range(400)]


def test_rounding_is_that_of_the_sql(spark, tables):
    from flightline.plans.book import r6

    values = [k / 48_000 for k in range(24_000, 25_000)] + [-0.5183125, 54.0, 1e12 / 3]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(r6(F.col("v")).alias("x")).collect()]
    assert got == [tables.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]


def test_lift_where_a_thousand_are_expected(spark):
    pairs = spark.createDataFrame([("a", "b", 2000, 2000, 2000), ("a", "c", 1000, 40, 22)], "a string, b string, n_a long, n_b long, n_both long")
    got = {r["b"]: r["p_adjusted"] for r in discovery.lift(pairs, 4000).collect()}
    from math import exp, lgamma, log

    assert got["b"] == pytest.approx(0, abs=1e-9)
    assert got["c"] == pytest.approx(2 * (1 - sum(exp(k * log(10) - 10 - lgamma(k + 1)) for k in range(22))), abs=1e-12)
