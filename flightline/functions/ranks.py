"""Running sums in an order, without a window over all rows of a key.

Ranks, cumulative counts, places of quantiles and dense numbers are all running sums over rows in order.
Keys with few rows are a window each.  The others are cut into ranges of the order: splitters are the
rows whose hash falls on a multiple (so they follow the data however it is spread or skewed, and are the
same in every run), sums of the ranges give what is before each, and windows run inside ranges only.
Results are the same either way; a row of a table must be told by its keys and its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightline.sources.scratch import stored

#: Rows of a key beyond which it is cut, and ranges of one key at most (about).
LARGE, RANGES = 200_000, 1024


def _named(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """``columns`` renamed, so that they meet their like in a join under names of their own."""
    return df.withColumnsRenamed({c: c + suffix for c in columns})


def cut(rows: DataFrame, keys: list[str], order: list[str], large: int = LARGE) -> tuple[DataFrame, bool]:
    """``rows`` with ``_range``, which rises with the order, and whether any key was cut (else it is 0)."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > large)
    heavy = stored(sizes, "ranks-heavy")
    if heavy.isEmpty():
        return rows.withColumn("_range", F.lit(0)), False
    value = F.struct(*order)
    step = F.greatest(F.lit(large // 4), (F.col("_rows") / RANGES).cast("long"))
    few = _named(heavy, keys, "_cut")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_cut"))
    drawn = rows.join(few, on).where(F.pmod(F.xxhash64(*keys, *order), step) == 0)
    # At most about RANGES splitters a key.
    splitters = stored(drawn.groupBy(*[f"{k}_cut" for k in keys]).agg(F.array_sort(F.collect_set(value)).alias("_splitters")), "ranks-splitters")
    met = rows.join(splitters, on, "left")
    return met.withColumn("_range", F.coalesce(F.size(F.filter("_splitters", lambda s: s <= value)), F.lit(0))).select(*rows.columns, "_range"), True


def running(rows: DataFrame, keys: list[str], order: list[str], values: list[str], descending: bool = False, large: int = LARGE, following: bool = False) -> DataFrame:
    """Add ``<value>_upto`` (sum through this row in the order) and ``<value>_all`` (of the key) for each value.

    With ``following``, also ``<value>_next``: the value of the next row, NULL at a key's last.
    """
    rows = stored(rows, "ranks-rows")
    ranged, cuts = cut(rows, keys, order, large)
    place = [F.desc(c) if descending else F.asc(c) for c in order]
    inside = Window.partitionBy(*keys, "_range").orderBy(*place)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not cuts:
        every = Window.partitionBy(*keys, "_range")
        more = {f"{v}_next": F.lead(v).over(inside) for v in values} if following else {}
        return ranged.withColumns({f"{v}_upto": F.sum(v).over(upto) for v in values} | {f"{v}_all": F.sum(v).over(every) for v in values} | more).drop("_range")
    # A key has about RANGES rows here at most.
    first = F.max_by if descending else F.min_by
    sums = ranged.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_{v}") for v in values], first(F.struct(*values), F.struct(*order)).alias("_first"))
    along = Window.partitionBy(*keys).orderBy(F.desc("_range") if descending else F.asc("_range"))
    before, every = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    shifts = sums.select(*[F.col(k).alias(f"{k}_at") for k in keys], F.col("_range").alias("_range_at"), *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_before") for v in values], *[F.sum(f"_{v}").over(every).alias(f"{v}_all") for v in values], F.lead("_first").over(along).alias("_after"))
    on = F.col("_range") == F.col("_range_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_at"))
    met = ranged.withColumns({f"_{v}_in": F.sum(v).over(upto) for v in values} | {f"_{v}_lead": F.lead(v).over(inside) for v in values} | {"_last": F.lead(F.lit(True)).over(inside).isNull()}).join(shifts, on)
    out = [F.col(c) for c in rows.columns] + [(F.col(f"_{v}_in") + F.col(f"_{v}_before")).alias(f"{v}_upto") for v in values] + [F.col(f"{v}_all") for v in values]
    if following:
        out += [F.when(F.col("_last"), F.col(f"_after.{v}")).otherwise(F.col(f"_{v}_lead")).alias(f"{v}_next") for v in values]
    return met.select(*out)
