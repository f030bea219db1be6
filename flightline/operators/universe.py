"""Distinct score vectors, their placement by landmarks, and the coordinates of both."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightline.functions import ranks


def quantized(p: Column, steps: int = 250) -> Column:
    """Probability as an integer 0 ... steps, halves to even."""
    return F.bround(p * steps).cast("int")


def quantized_with_missing(value: Column, low: float, high: float, levels: int = 65535) -> Column:
    """1 ... levels over the range (clipped, halves to even), 0 for missing."""
    share = (F.greatest(F.lit(low), F.least(F.lit(high), value)) - low) / (high - low)
    return F.when(value.isNull(), 0).otherwise(1 + F.bround(share * (levels - 1)).cast("int"))


def most_probable(p: Column, least: float = 0.5) -> Column:
    """1-based place of the greatest probability, the first among equals; 0 if it is under ``least``."""
    top = F.array_max(p)
    return F.when(top >= least, F.array_position(p, top).cast("int")).otherwise(0)


def dictionary(states: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with a number (``vector``, in their order) and how many states have each.

    Rows are counted first, so numbering sees distinct vectors only; very many of them are numbered in
    ranges of their order.
    """
    counts = states.groupBy(*columns).agg(F.count(F.lit(1)).alias("states")).withColumn("_one", F.lit(1).cast("long"))
    numbered = ranks.running(counts, [], columns, ["_one"])
    return numbered.select(*columns, "states", (F.col("_one_upto") - 1).alias("vector"))


def landmarks(vectors: DataFrame, label: str, key: str, quota: int, total: int | None = None) -> DataFrame:
    """The first ``quota`` vectors of each class; classes with fewer give all.

    With a ``total``, what the classes leave open is filled up with the first of the remaining vectors by key.
    """
    place = F.row_number().over(Window.partitionBy(label).orderBy(key))
    placed_ = vectors.withColumn("_place", place)
    chosen = placed_.where(F.col("_place") <= quota).drop("_place")
    if total is None:
        return chosen
    missing = total - chosen.count()
    return chosen.unionByName(placed_.where(F.col("_place") > quota).drop("_place").orderBy(key).limit(max(0, missing)))


def nearest(vectors: DataFrame, marks: DataFrame, key: str, vector: str, k: int, most_marks: int = 10_000) -> DataFrame:
    """The ``k`` landmarks nearest to each vector: ``key, landmark, place, distance``; ties to the lesser landmark.

    Landmarks are broadcast ``most_marks`` at a time as one matrix; each batch of vectors meets it in
    a matrix product, of which the best are computed anew exactly.  Where there are more landmarks
    than that, each lot gives its best and the best of all lots stand.
    """
    spark = vectors.sparkSession
    own = vectors.select(key, F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    n = marks.count()
    lots = max(1, -(-n // most_marks))
    dealt = marks.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("e")).withColumn("_lot", F.pmod(F.xxhash64("id"), F.lit(lots)))
    parts = []
    for lot in range(lots):
        rows = dealt.where(F.col("_lot") == lot).select("id", "e").collect()  # about most_marks rows
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), np.array([r["e"] for r in rows], np.float64)))

        def search(batches, held=held):
            ids, e = held.value
            norms = (e * e).sum(axis=1)
            take = min(k + 8, len(ids))
            for batch in batches:
                for first in range(0, batch.num_rows, 512):
                    part = batch.slice(first, 512)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    rough = norms[None, :] - 2 * v @ e.T
                    some = np.argpartition(rough, take - 1, axis=1)[:, :take]
                    exact = np.round(((v[:, None, :] - e[some]) ** 2).sum(axis=2), 9)
                    order = np.lexsort((ids[some], exact), axis=1)[:, :k]
                    marks_, d = np.take_along_axis(ids[some], order, 1), np.take_along_axis(exact, order, 1)
                    width = marks_.shape[1]
                    owner = np.repeat(np.arange(part.num_rows), width)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(marks_.ravel()), pa.array(d.ravel())], [key, "landmark", "_d"])

        schema = T.StructType([own.schema[key], T.StructField("landmark", T.LongType()), T.StructField("_d", T.DoubleType())])
        parts.append(own.mapInArrow(search, schema))
    if not parts:
        return spark.createDataFrame([], T.StructType([own.schema[key], T.StructField("landmark", T.LongType()), T.StructField("place", T.LongType()), T.StructField("distance", T.DoubleType())]))
    best = F.row_number().over(Window.partitionBy(key).orderBy("_d", "landmark")).cast("long")
    return reduce(DataFrame.unionByName, parts).withColumn("place", best).where(F.col("place") <= k).select(key, "landmark", "place", F.sqrt("_d").alias("distance"))


def start_offsets(states: DataFrame, run: str) -> DataFrame:
    """For each run, where its states begin when runs stand one after the other: ``run, start, states``.

    Runs are counted first; the running sum is taken in buckets of runs and shifted by what earlier buckets hold.
    """
    counts = states.groupBy(run).agg(F.count(F.lit(1)).alias("states")).withColumn("_bucket", F.floor(F.col(run) / 65_536))
    sums = counts.groupBy("_bucket").agg(F.sum("states").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_inside", F.coalesce(F.sum("states").over(inside), F.lit(0))).join(starts, "_bucket").select(run, (F.col("_start") + F.col("_inside")).alias("start"), "states")


def placed(near: DataFrame, coordinates: DataFrame, key: str) -> DataFrame:
    """Mean of the nearest landmarks' coordinates (``landmark, x, y, z``), weighted by inverse distance; a landmark is exactly itself."""
    met = near.join(coordinates, "landmark")
    exact = F.max(F.when(F.col("distance") < 1e-12, F.struct("x", "y", "z")))
    w = 1 / F.greatest("distance", F.lit(1e-12))
    sums = met.groupBy(key).agg(exact.alias("e"), *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in "xyz"])
    return sums.select(key, *[F.coalesce(F.col(f"e.{c}"), F.col(c)).alias(c) for c in "xyz"])


def scaled(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Centred and scaled to [-1, 1] by the widest axis."""
    m = points.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    half = max((m[f"hi_{c}"] - m[f"lo_{c}"]) / 2 for c in columns) or 1.0
    return points.withColumns({c: (F.col(c) - (m[f"hi_{c}"] + m[f"lo_{c}"]) / 2) / half for c in columns})
