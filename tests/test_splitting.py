"""Splits for many labels: even folds, even labels, exact sizes, whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.operators import splitting

LABELS = [f"l{k}" for k in range(12)]


def many(spark, n=3000, share=0.3, seed=0):
    y = (np.random.default_rng(seed).random((n, 12)) < share).astype(int)
    return spark.createDataFrame([(k, k // 4, *map(int, row)) for k, row in enumerate(y)], "id long, g long, " + ", ".join(f"{c} int" for c in LABELS))


def test_twelve_independent_labels_are_even_in_every_fold(spark):
    split = splitting.folds(many(spark), LABELS, ["id"], 5)
    per = split.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in LABELS]).collect()
    assert [r["n"] for r in per] == [600] * 5
    for c in LABELS:
        even = sum(r[c] for r in per) / 5
        assert all(abs(r[c] - even) <= 0.02 * even for r in per), c


@pytest.mark.parametrize(("arguments", "size"), [({}, 500), ({"size": 123}, 123), ({"share": 0.1}, 300), ({"parts": 9}, 300)])
def test_a_holdout_has_the_size_asked_for(spark, arguments, size):
    rows = many(spark)
    split = splitting.holdout(rows, LABELS, ["id"], **arguments)
    held = split.where("held_out")
    assert held.count() == size and split.count() == 3000
    total, own = (df.agg(*[F.sum(c).alias(c) for c in LABELS]).first() for df in (split, held))
    assert all(abs(own[c] - total[c] * size / 3000) <= 1.5 for c in LABELS)


def test_groups_stay_whole_and_even(spark):
    split = splitting.deal_groups(many(spark), "g", LABELS, 5)
    assert split.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    groups = split.groupBy("g").agg(F.first("fold").alias("fold"), *[F.max(c).alias(c) for c in LABELS])
    per = groups.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in LABELS]).collect()
    assert [r["n"] for r in per] == [150] * 5 and all(max(r[c] for r in per) - min(r[c] for r in per) <= 2 for c in LABELS)
    held = splitting.hold_out_groups(many(spark), "g", LABELS, 500).where("held_out")
    assert held.select("g").distinct().count() == 125 and held.count() == 500
    with pytest.raises(ValueError, match="two at least"):
        splitting.hold_out_groups(many(spark, 3), "g", LABELS, 1)


def test_quotas_keep_within_a_row_of_every_share():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, k, folds = int(rng.integers(1, 400)), int(rng.integers(1, 6)), int(rng.integers(2, 7))
        labels, counts = np.unique((rng.random((n, k)) < rng.random(k)).astype(int), axis=0, return_counts=True)
        shares = rng.dirichlet(np.ones(folds) * 5)
        q = splitting.quotas(counts, labels, shares)
        assert (q.sum(axis=1) == counts).all() and (q >= 0).all() and (q.sum(axis=0) == splitting.whole_shares(n, shares)).all()


def test_odd_rows_are_dealt_too(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 1, None), (None, 0, 1), (2, None, 1), (3, 1, 1)], "id long, a int, b int").withColumn("fold_", F.lit(0))
    split = splitting.folds(rows, ["a", "b"], ["id"], 2)
    assert split.columns == [*rows.columns, "fold"] and split.count() == 5 and {r["n"] for r in split.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()} == {2, 3}
    assert splitting.folds(rows.limit(0), ["a", "b"], ["id"], 2).count() == 0
    assert splitting.holdout(rows.limit(0), ["a"], ["id"]).count() == 0
    with pytest.raises(ValueError, match="leaves nothing"):
        splitting.holdout(rows, ["a"], ["id"], size=5)


def test_small_signatures_do_not_share_a_first_fold(spark):
    """Dealing round-robin by signatures of any kind: as many rows in every fold, nearly."""
    sizes = [r["count"] for r in splitting.deal(many(spark), LABELS, ["id"], 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 120


def test_rare_keys_merge_and_the_first_label_leads(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] + [("c",)], "key string")
    assert {(r["key"], r["n"]) for r in splitting.merge_rare(rows, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 3), ("rare", 2)}
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, 0, 1)], "x int, y int, z int")
    assert [r[0] for r in labels.select(splitting.primary_label(["x", "y", "z"])).collect()] == ["y", "none", "x"]
