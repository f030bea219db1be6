from pyspark.sql import functions as F

from flightline.operators import models


def test_rows_are_made_once_for_all_folds(spark):
    """Fits and scores read a table; what made the rows (here a grouping) is not run again for each fold."""
    rows = spark.range(240).groupBy((F.col("id") % 60).alias("id")).agg(F.sum("id").cast("double").alias("x")).withColumns({"label": (F.col("x") % 2).cast("double"), "fold": (F.col("id") % 3).cast("int")})
    found = models.out_of_fold(rows, ["x"], "label", 3, iterations=1, depth=1)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"] for r in found.select("id").collect()} == set(range(60)) and found.columns == ["id", "x", "label", "fold", "score"]
