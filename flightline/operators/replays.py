"""What a display needs of a replayed run: timeline events, snapshot times, the flight corridor, and a run packed into binary columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The timeline, the tails shown after a hold and after an abort, the delay of a shutdown.
TIMELINE = {"lox_pressurised": -58.0, "lh2_pressurised": -55.0, "onboard_power": -30.0, "ignition": 0.0, "boosters_lit": 7.0, "greatest_pressure": 60.0, "boosters_apart": 136.0}
HOLD_TAIL, ABORT_TAIL, SHUTDOWN_AFTER, END = 12.0, 8.0, 0.3, 150.0
# Knots of the mean axial acceleration in g, liftoff, standard gravity, the deviation of normal flights at booster separation, the
# tracking noise, and the corridor's margin (km) and width in normal deviations.
ACCELERATION = (
    (7.1, 1.50), (10.0, 1.57), (20.0, 1.72), (30.0, 1.81), (40.0, 1.80), (50.0, 1.67), (60.0, 1.77), (70.0, 1.91), (80.0, 2.28), (90.0, 2.60), (100.0, 2.85), (110.0, 3.13), (120.0, 3.34), (124.0, 3.42), (127.0, 2.93), (130.0, 1.93), (132.0, 1.19),
    (134.0, 0.76), (136.0, 0.73), (140.0, 0.77), (150.0, 0.79),
)
LIFTOFF, BAND_AT_SEPARATION, TRACKING_NOISE, CORRIDOR_MARGIN, CORRIDOR_BANDS = 7.1, 2.2, 0.03, 1.0, 2.5


def interpolated(x: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise linear through the knots, flat beyond them."""
    out = F.when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots[:-1], knots[1:], strict=True):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * (y1 - y0) / (x1 - x0))
    return out.otherwise(knots[-1][1])


def corridor_profile(spark: SparkSession, rate: float = 50.0, start: float = -60.0) -> DataFrame:
    """``k, t, drift, band, corridor``: normal deviation from the path at each sample of the record, and the width that is allowed.

    The drift is the double integral of the mean acceleration from liftoff, 1 at booster separation: a
    table of the record's length, whatever the number of runs.
    """
    n = round((END - start) * rate) + 1
    rows = spark.range(n).select(F.col("id").alias("k"), (F.lit(start) + F.col("id") / rate).alias("t"))
    upto = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    speed = rows.withColumn("speed", F.sum(F.when(F.col("t") >= LIFTOFF, interpolated(F.col("t"), ACCELERATION)).otherwise(0.0) / rate).over(upto))
    path = speed.withColumn("path", F.sum(F.col("speed") / rate).over(upto))
    unit = F.max(F.when(F.col("k") == round((TIMELINE["boosters_apart"] - start) * rate), F.col("path"))).over(Window.partitionBy(F.lit(0)))
    band = TRACKING_NOISE + BAND_AT_SEPARATION * F.col("drift")
    return path.withColumn("drift", F.col("path") / unit).select("k", "t", "drift", band.alias("band"), (CORRIDOR_MARGIN + CORRIDOR_BANDS * band).alias("corridor"))


def shown_until(stop: Column, stop_at: Column) -> Column:
    """When a replay ends: some seconds after a hold or an abort, else at the record's end."""
    return F.when(stop == "hold", F.least(stop_at + HOLD_TAIL, F.lit(END))).when(stop == "abort", F.least(stop_at + ABORT_TAIL, F.lit(END))).otherwise(F.lit(END))


def vehicle_events(runs: DataFrame, run: str) -> DataFrame:
    """``run, t, what`` of the timeline of each run (``run, stop, stop_at, liftoff``; stop is hold, abort or NULL), as far as it goes.

    After a hold nothing follows but the hold, after an abort the shutdown.
    """
    row = lambda t, what, when=None: F.struct((t if isinstance(t, Column) else F.lit(t)).cast("double").alias("t"), F.lit(what).alias("what"), (F.lit(True) if when is None else when).alias("shown"))
    held, gone = F.coalesce(F.col("stop") == "hold", F.lit(False)), F.coalesce(F.col("stop") == "abort", F.lit(False))
    flies = ~held & ~gone
    rows = [row(TIMELINE[w], w) for w in ("lox_pressurised", "lh2_pressurised", "onboard_power")]
    rows += [row(F.col("stop_at"), "held", held), row(TIMELINE["ignition"], "ignition", ~held), row(F.col("stop_at") + SHUTDOWN_AFTER, "shut_down", gone)]
    rows += [row(TIMELINE["boosters_lit"], "boosters_lit", flies), row(F.col("liftoff"), "liftoff", flies & F.col("liftoff").isNotNull())] + [row(TIMELINE[w], w, flies) for w in ("greatest_pressure", "boosters_apart")]
    each = runs.select(run, shown_until(F.col("stop"), F.col("stop_at")).alias("_end"), F.explode(F.array(*rows)).alias("_row"))
    return each.where(F.col("_row.shown") & (F.col("_row.t") <= F.col("_end"))).select(run, F.col("_row.t").alias("t"), F.col("_row.what").alias("what"))


def snapshot_grid(runs: DataFrame, moments: DataFrame, run: str) -> DataFrame:
    """``run, t``: every 5 s, every second through the engine start, and each run's own ``moments`` (``run, t``), once each, as far as the run is shown."""
    fixed = F.array_union(F.transform(F.sequence(F.lit(0), F.lit(41)), lambda k: F.lit(-55.0) + 5.0 * k), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: k.cast("double")))
    own = moments.groupBy(run).agg(F.collect_set(F.col("t").cast("double")).alias("_own"))
    met = runs.join(own, run, "left").withColumn("_end", shown_until(F.col("stop"), F.col("stop_at")))
    every = F.array_union(fixed, F.coalesce("_own", F.array().cast("array<double>")))
    return met.select(run, "_end", F.explode(every).alias("t")).where(F.col("t") <= F.col("_end") + 1e-9).select(run, "t")


def packed(codes: Column, width: int = 1) -> Column:
    """An array of whole numbers (0 ... 256 ** width - 1) as bytes, the lowest byte of each first."""
    byte = lambda c, k: F.lpad(F.hex(F.floor(c / F.lit(256**k)) % 256), 2, "0")
    return F.unhex(F.array_join(F.transform(codes, lambda c: F.concat(*[byte(c.cast("long"), k) for k in range(width)])), ""))


def unpacked(data: Column, width: int = 1) -> Column:
    """The array again."""
    n = (F.octet_length(data) / width).cast("int")
    byte = lambda i, k: F.conv(F.hex(F.substring(data, i * width + F.lit(k + 1), F.lit(1))), 16, 10).cast("int")
    whole = F.transform(F.sequence(F.lit(0), n - 1), lambda i: reduce(Column.__add__, [byte(i, k) * F.lit(256**k) for k in range(width)]))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<int>"))


def pack_runs(run: str, parts: dict[str, tuple[DataFrame, list[str], int]]) -> DataFrame:
    """One row a run: its number of rows (``n_<part>``) and their codes as one binary column for each part.

    A part is (rows with ``run`` and ``code``, the columns that order a run's rows, bytes a code).  Rows are
    ordered inside the aggregate, so nothing depends on how they come; a run is as long as its record.
    """
    out = None
    for name, (rows, order, width) in parts.items():
        listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "code"))), lambda r: r["code"])
        own = rows.groupBy(run).agg(F.count(F.lit(1)).alias(f"n_{name}"), packed(listed, width).alias(name))
        out = own if out is None else out.join(own, run, "full")
    return out
