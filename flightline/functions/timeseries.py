"""Column builders for causal time-series operators.

A :class:`Series` names the columns that tell entities apart and order each one's samples; its
methods turn columns into columns over one shared window, so one exchange and one sort by entity
serve any number of them.  Missing samples are NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


#: Trailing windows of up to this many samples are summed row by row.
SHORT = 64


def missing_as_null(column: Column) -> Column:
    """NaN becomes NULL; done once where data come in, as NaN compares as the greatest number in Spark."""
    return F.when(F.isnan(column), F.lit(None)).otherwise(column)


@dataclass(frozen=True)
class Series:
    entity: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.entity).orderBy(*self.order)

    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def whole(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def trailing(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(n - 1), Window.currentRow)

    def index(self) -> Column:
        return (F.row_number().over(self.ordered) - 1).cast("long")

    def forward_fill(self, value: Column, fill_leading: bool = True) -> Column:
        """The last present sample; a leading gap takes the first one that comes, unless strictly causal.

        In a leading gap the first sample that comes is the first of all, and a frame over the whole
        partition is computed once where one that shrinks would be computed anew for each row.
        """
        held = F.last(value, ignorenulls=True).over(self.so_far())
        return F.coalesce(held, F.first(value, ignorenulls=True).over(self.whole())) if fill_leading else held

    def lagged(self, value: Column, n: int, fill: Column | None = None) -> Column:
        """The sample ``n`` before; before the first one ``fill``, or else the first sample."""
        past = F.lag(value, n).over(self.ordered)
        return F.when(self.index() >= n, past).otherwise(F.first(value).over(self.so_far()) if fill is None else fill)

    def rate(self, value: Column, n: int, seconds: float) -> Column:
        return (value - F.lag(value, n).over(self.ordered)) / F.lit(float(seconds))

    def unchanged(self, value: Column) -> Column:
        """1 where a sample equals the one before it, 0 otherwise and at the first."""
        return F.coalesce((value == F.lag(value, 1).over(self.ordered)).cast("int"), F.lit(0))

    def trailing_mean(self, value: Column, n: int) -> Column:
        """Mean of the last ``n`` present samples' rows, of fewer at the beginning.

        A frame that slides is summed anew for each row: a short one is, so that its mean depends on its own
        samples only and comes out on a level it stands at; a long one is a difference of running sums.
        """
        if n <= SHORT:
            return F.avg(value).over(self.trailing(n))
        total, count = F.sum(value).over(self.so_far()), F.count(value).over(self.so_far())
        earlier = self.ordered.rowsBetween(Window.unboundedPreceding, -n)
        return F.try_divide(F.coalesce(total, F.lit(0.0)) - F.coalesce(F.sum(value).over(earlier), F.lit(0.0)), count - F.count(value).over(earlier))

    def trailing_rms(self, value: Column, n: int) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), self.trailing_mean(value * value, n)))

    def debounced(self, score: Column, ticks: int = 2) -> Column:
        """Least score of the last ``ticks`` samples; 0 until there are as many."""
        return F.when(self.index() >= ticks - 1, F.min(score).over(self.trailing(ticks))).otherwise(F.lit(0.0))

    def latched(self, flag: Column) -> Column:
        """Once true, true."""
        return F.max(F.coalesce(flag, F.lit(False))).over(self.so_far())

    def persisted(self, flag: Column, n: int) -> Column:
        """True where this and the ``n - 1`` samples before it are true."""
        return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(self.trailing(n)) == n

    def changed(self, value: Column) -> Column:
        """True at the first sample and wherever the value differs from the one before."""
        before = F.lag(value, 1).over(self.ordered)
        return (self.index() == 0) | ~value.eqNullSafe(before)

    def gated(self, aggregate, value: Column, gate: Column, least: int = 1) -> Column:
        """A cumulative aggregate of the samples so far for which ``gate`` holds; NULL until there are ``least``."""
        inside = F.when(gate, value)
        return F.when(F.count(inside).over(self.so_far()) >= least, aggregate(inside).over(self.so_far()))

    def first_crossing(self, value: Column, level: float, time: Column, gate: Column) -> Column:
        """Time of the first gated sample at or above ``level``; the last gated time so far where there is none."""
        crossed = F.min(F.when(gate & (value >= level), time)).over(self.so_far())
        return F.coalesce(crossed, F.max(F.when(gate, time)).over(self.so_far()))

    def correlation(self, a: Column, b: Column, gate: Column, least: int) -> Column:
        """Pearson correlation of the gated samples so far; 0 where either hardly varies."""
        both = gate & a.isNotNull() & b.isNotNull()
        x, y = F.when(both, a), F.when(both, b)
        frame = self.so_far()
        flat = (F.stddev_pop(x).over(frame) < 1e-9) | (F.stddev_pop(y).over(frame) < 1e-9)
        return F.when(F.count(x).over(frame) >= least, F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(x, y).over(frame), F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame))))


def first_true(df: DataFrame, keys: list[str], flag: Column, at: Column, name: str) -> DataFrame:
    """The least ``at`` for which ``flag`` holds, for each key (NULL: never)."""
    return df.groupBy(*keys).agg(F.min(F.when(flag, at)).alias(name))


def cut_at_stop(df: DataFrame, series: Series, call: Column, stops: list[str]) -> DataFrame:
    """Samples up to and including the first whose call is a stop."""
    stopped_before = F.max(F.coalesce(call.isin(stops), F.lit(False)).cast("int")).over(series.ordered.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_stopped", F.coalesce(stopped_before, F.lit(0))).where("_stopped = 0").drop("_stopped")


def envelope(df: DataFrame, keys: list[str], index: Column, value: Column, size: int) -> DataFrame:
    """Least, greatest and mean of each full bin of ``size`` samples; samples beyond the last full bin are left out."""
    binned = df.withColumn("bin", F.floor(index / size).cast("long"))
    return binned.groupBy(*keys, "bin").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size).drop("n")


def percentile_band(bins: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``keys, low, high``: the band between two percentiles across entities at each place (linear between values); a place has a value for each entity at most."""
    return bins.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))


def gravest_so_far(series: Series, flags: list[tuple[Column, int]]) -> Column:
    """The greatest code whose flag has been true at any sample so far (0: none)."""
    now = F.greatest(F.lit(0), *[F.when(flag, code).otherwise(0) for flag, code in flags])
    return F.max(now).over(series.so_far())


def backward_asof(left: DataFrame, right: DataFrame, time: str, reference_time: str, payload: list[str], keys: tuple[str, ...], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the last right row at or before it, by a union and windows instead of a range join.

    Each key is a partition, so keys are required.  A ``bucket`` of the time (it must not fall as time
    rises, such as the day) splits a key's rows: the window runs inside buckets, and a bucket begins
    with the last right row of those before it, which are carried over in a table of one row a bucket.
    """
    if not keys:
        raise ValueError("an as-of join needs at least one key")
    kind = right.select(F.struct(reference_time, *payload).alias("s")).schema["s"].dataType
    part = (lambda c: bucket(c)) if bucket else (lambda c: F.lit(0))
    tagged = left.withColumns({"_time": F.col(time), "_kind": F.lit(1), "_payload": F.lit(None).cast(kind)}).withColumn("_bucket", part(F.col("_time")))
    known = right.select(*[F.col(k) for k in keys], F.col(reference_time).alias("_time"), F.lit(0).alias("_kind"), F.struct(reference_time, *payload).alias("_payload")).withColumn("_bucket", part(F.col("_time")))
    both = tagged.unionByName(known, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_bucket").orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_payload", ignorenulls=True).over(order)).where("_kind = 1")
    if bucket:
        lasts = known.groupBy(*keys, "_bucket").agg(F.max_by("_payload", "_time").alias("_last"))
        every = lasts.unionByName(tagged.select(*keys, "_bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
        earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
        found = found.join(carried, [*keys, "_bucket"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select(*left.columns, F.col(f"_found.{reference_time}").alias(reference_time), *[F.col(f"_found.{p}").alias(p) for p in payload])
