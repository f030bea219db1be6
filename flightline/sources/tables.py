"""Reading and writing: telemetry, JSON documents, score tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from flightline.functions.timeseries import missing_as_null


def ingest(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, once; nothing behind this point meets a NaN."""
    return df.withColumns({f.name: missing_as_null(F.col(f.name)).cast("double") for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def read_telemetry(spark: SparkSession, path: str, channels: Iterable[str], rate: int = 50, start: float = -60.0) -> DataFrame:
    """``run, k, t`` and the channels asked for (others are not read); ``t`` follows from the sample number."""
    columns = list(channels)
    return ingest(spark.read.parquet(path).select("run", "k", *columns)).select("run", "k", (F.lit(start) + F.col("k") / rate).alias("t"), *columns)


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents, one in each file, with a stated schema (nothing is inferred from data)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_scores(scores: DataFrame, path: str, partition: str = "mode") -> None:
    """Scores as single precision, by class."""
    scores.withColumn("p", F.col("p").cast("float")).write.partitionBy(partition).parquet(path)


def write_telemetry(telemetry: DataFrame, path: str) -> None:
    """Samples of a run stand together and in order, so that filters on run and sample number skip row groups."""
    telemetry.repartition("run").sortWithinPartitions("run", "k").write.parquet(path)


def read_scores(spark: SparkSession, path: str, modes: Iterable[str] | None = None) -> DataFrame:
    """Scores as :func:`write_scores` left them, as doubles; ``modes`` prunes the folders that are read."""
    scores = spark.read.parquet(path)
    if modes is not None:
        scores = scores.where(F.col("mode").isin(list(modes)))
    return scores.withColumn("p", F.col("p").cast("double"))


def write_universe(vectors: DataFrame, states: DataFrame, path: str) -> None:
    """Distinct vectors with their places (``vector, x, y, z``), and the states that point at them (``run, tick, vector``).

    Both stand in order, so the same tables make the same rows in the same place.
    """
    vectors.repartitionByRange("vector").sortWithinPartitions("vector").withColumns({c: F.col(c).cast("float") for c in "xyz"}).write.parquet(f"{path}/vectors")
    states.repartitionByRange("run", "tick").sortWithinPartitions("run", "tick").write.parquet(f"{path}/states")


def read_universe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/states")
