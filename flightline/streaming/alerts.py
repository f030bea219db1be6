"""Structured Streaming forms: windowed aggregates, and the debounced alert with state for each user.

A stream gives what the batch operators give as long as each key's samples come in order; samples
later than the watermark are dropped, which batch has no counterpart for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flightline.sources.scratch import stored

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _in_store(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), own


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The ``events`` table, one file or a folder of part files, as a stream, with event time as a timestamp.

    Part files come in no order of time, so all of them make one batch unless ``files_per_trigger`` is given.
    """
    path = f"{sf_dir}/events.parquet"
    store, own = _in_store(spark, path)
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if not store.getFileStatus(own).isDirectory():  # a stream reads folders only
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def in_stretches(rows: DataFrame, number: str, n: int, folder: str) -> DataFrame:
    """A table as a stream of ``n`` batches: its rows by stretches of ``number`` (a whole number from 0 on), written one after the other.

    A batch takes as many files as a stretch can have, one of each task that writes it, so there are no more batches than ``n``.
    """
    spark = rows.sparkSession
    source = stored(rows, "stream-source")
    stop = (source.agg(F.max(number)).first()[0] or 0) + 1
    for k in range(n):  # files are taken in the order in which they were written
        source.where((F.col(number) * n >= k * stop) & (F.col(number) * n < (k + 1) * stop)).write.parquet(f"{folder}/stretch-{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", source.rdd.getNumPartitions()).parquet(f"{folder}/stretch-*")


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling windows, or in sliding ones that begin every ``slide``."""
    window = F.window("ts", width, slide)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def alerting(stream: DataFrame, threshold: float = 0.3, scale: float = 200.0) -> DataFrame:
    """``user_id, first_k, first_ts`` once for each user whose debounced score (least of two ticks) reaches the threshold.

    State: samples seen, the held value, the last score, whether the alert is out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, value, last, out = state.get if state.exists else (0, float("nan"), float("nan"), False)
        rows = []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, v, ts in zip(pdf["event_type"], pdf["value"], pdf["ts"], strict=True):
            value = v if kind != "error" else value
            score = min(value / scale, 1.0)  # NaN until the first sample that is there, and so never an alert
            if not out and seen and score >= threshold and last >= threshold:
                out = True
                rows.append((key[0], seen, ts))
            seen, last = seen + 1, score
        state.update((seen, value, last, out))
        yield pd.DataFrame(rows, columns=["user_id", "first_k", "first_ts"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, first_k long, first_ts timestamp", "seen long, value double, last double, out boolean", "append", GroupStateTimeout.NoTimeout)


def drained(result: DataFrame, folder: str, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run the stream over what there is and return what it left: all rows appended, or in ``update`` mode the last of each of ``keys``.

    Both keep only what the watermark leaves open as state; a batch that is run again overwrites its own rows.
    """
    spark = result.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    store, rows = _in_store(spark, f"{folder}/rows")
    if not store.exists(rows):  # no batch ran
        return spark.createDataFrame([], result.schema)
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
    if mode == "update":
        latest = F.max_by(F.struct(*[c for c in result.columns if c not in keys]), "batch").alias("_row")
        return rows.groupBy(*keys).agg(latest).select(*keys, "_row.*").select(*result.columns)
    return rows.select(*result.columns)
