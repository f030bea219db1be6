"""Imputation and scaling whose figures come from the work set alone and are applied to any rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.functions import ranks


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median of the present values of each column, all columns in one pass.

    Values are counted before they are ranked, and ranked in ranges where there are very many.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = values.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = ranks.running(counts, ["column"], ["value"], ["n"])
    low, high = F.floor((F.col("n_all") - 1) / 2), F.ceil((F.col("n_all") - 1) / 2)
    holds = lambda place: (F.col("n_upto") > place) & (F.col("n_upto") - F.col("n") <= place)
    found = placed.groupBy("column").agg(F.max(F.when(holds(low), F.col("value"))).alias("low"), F.max(F.when(holds(high), F.col("value"))).alias("high")).collect()  # a row a column
    known = {r["column"]: (r["low"] + r["high"]) / 2 for r in found}
    return {c: known.get(c) for c in columns}


@dataclass(frozen=True)
class Preparation:
    """Medians, and means and population deviations after imputing, of each column of the rows that were fitted on."""

    median: dict[str, float | None]
    mean: dict[str, float | None]
    deviation: dict[str, float | None]

    def imputed(self, column: str) -> Column:
        """The value, or else the median; a column without any value in the work set stays NULL where it is."""
        value = F.col(column).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(self.median[column]).cast("double"))

    def scaled(self, column: str) -> Column:
        """(value - mean) / deviation; a deviation of zero counts as one."""
        return (self.imputed(column) - F.lit(self.mean[column])) / F.lit(self.deviation[column] or 1.0)

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.imputed(c) for c in self.median})

    def scale(self, df: DataFrame) -> DataFrame:
        """Imputed and scaled: a projection with fixed numbers, no join and no exchange."""
        return df.withColumns({c: self.scaled(c) for c in self.median})


def fit(work: DataFrame, columns: list[str]) -> Preparation:
    middle = medians(work, columns)
    plain = Preparation(middle, {}, {})
    figures = work.agg(*[f(plain.imputed(c)).alias(f"{name}_{k}") for k, c in enumerate(columns) for name, f in (("mean", F.avg), ("deviation", F.stddev_pop))]).first()
    return Preparation(middle, {c: figures[f"mean_{k}"] for k, c in enumerate(columns)}, {c: figures[f"deviation_{k}"] for k, c in enumerate(columns)})
