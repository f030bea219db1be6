"""Membership filters of a fixed size, built on the cluster and broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .storage import free_name

#: Cells of the largest bitmap (32 MB); a fuller one lets more rows through to an exact join.
MOST_BITS = 1 << 28
#: Ids that are broadcast as they are (some 30 MB); more of them go through a bitmap.
BROADCAST_IDS = 1_000_000


def build_bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap in which the cell ``hash mod bits`` of every hash (the one column, longs) is set.

    It is made in chunks on the executors, so what reaches the driver is ``bits / 8`` bytes, whatever
    the number of hashes.
    """
    (name,) = hashes.columns
    chunk_bits = max(1 << 15, bits // 1024)

    def chunk_of(pdf):
        cells = np.zeros(chunk_bits, bool)
        cells[pdf["cell"].to_numpy() % chunk_bits] = True
        return pdf.iloc[:1][["chunk"]].assign(bits=[np.packbits(cells).tobytes()])

    cells = hashes.select(F.pmod(F.col(name), F.lit(bits)).cast("int").alias("cell")).distinct().withColumn("chunk", F.floor(F.col("cell") / chunk_bits).cast("int"))
    bitmap = np.zeros((bits // chunk_bits, chunk_bits // 8), np.uint8)
    for row in cells.groupBy("chunk").applyInPandas(chunk_of, "chunk int, bits binary").toLocalIterator():
        bitmap[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return bitmap.ravel()


def held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the cell of each hash (int64) is set."""
    cell = hashes % (len(bitmap) * 8)
    return ((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def bits_for(n: int) -> int:
    """Cells of a bitmap that ``n`` hashes fill by a thirty-second, within bounds."""
    bits = 1 << 20
    while bits < MOST_BITS and bits < 32 * n:
        bits *= 2
    return bits


def parted(rows: DataFrame, id_column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose id is certainly none of ``ids`` (the one column, longs without repetition), and the others, which may be: few, so that only they need a join.

    Null ids take part like any other.  Rows go through unchanged and stay out of exchanges; each part is
    a scan of its own.
    """
    (name,) = ids.columns
    spark = rows.sparkSession
    n = ids.count()
    if n <= BROADCAST_IDS:
        mark = free_name(rows, "_id_of")
        listed = F.broadcast(ids.select(F.col(name).cast("long").alias(mark)))
        met = F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col(mark))
        return rows.join(listed, met, "left_anti"), rows.join(listed, met, "left_semi")
    keys = ids.select(F.xxhash64(F.col(name).cast("long")).alias("key"))
    cells = spark.sparkContext.broadcast(build_bitmap(keys, bits_for(n)))
    key = free_name(rows, "_key")
    keyed = rows.withColumn(key, F.xxhash64(F.col(f"`{id_column}`").cast("long")))
    width = len(rows.columns)

    def part(wanted: bool):
        def scan(batches):
            for batch in batches:
                mask = pa.array(held(cells.value, kernel.ints(batch.column(width))) == wanted)
                kept = batch.filter(mask)
                yield pa.RecordBatch.from_arrays(kept.columns[:width], batch.schema.names[:width])

        return keyed.mapInArrow(scan, T.StructType(rows.schema.fields))

    return part(False), part(True)


def without(rows: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose id is none of ``ids`` (the one column, longs without repetition); only rows that a bitmap of the ids holds are exchanged."""
    (name,) = ids.columns
    untouched, touched = parted(rows, id_column, ids)
    mark = free_name(rows, "_listed")
    listed = ids.select(F.col(name).alias(mark))
    return untouched.unionByName(touched.join(listed, touched[id_column].cast("long").eqNullSafe(F.col(mark)), "left_anti"))
