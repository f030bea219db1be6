"""The feature catalogue over telemetry made of ``events``, and what reports do with features and rules."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import features as ft
from flightline.functions import filters
from flightline.plans import series_queries
from flightline.plans.book import Book, r6, table
from flightline.sources import scratch
from flightline.streaming import alerts, replays

BOOK = Book()
#: Samples a second, so that a user's events span the whole record; windows are then a few samples each.
RATE = 0.3
CATALOGUE = ft.launch_catalogue(RATE).without_filters()
#: The features behind a filter, the bands scaled with the rate (so the filters are those of 50 samples a second).
_WHOLE = ft.launch_catalogue(RATE)
BEHIND = replace(
    _WHOLE, windows={}, engineered=tuple(f for f in _WHOLE.engineered if f.name not in {g.name for g in CATALOGUE.engineered}), filters=tuple((name, channel, low * RATE / 50, high and high * RATE / 50) for name, channel, low, high in _WHOLE.filters),
    channels=tuple(replace(c, windows=()) for c in _WHOLE.channels),
)

# A channel is a linear map of the value some events before (lost where that event is an error).
MAPS = {
    "PC_CORE": (0, 100.0, 0.25), "N_LOX_TP": (1, 95.0, 0.125), "T_TURB_IN": (2, 800.0, 2.0), "P_LOX_TANK": (0, 3.1, 0.004), "P_LH2_TANK": (1, 2.1, 0.004), "PC_SRB_L": (0, 60.0, 0.1), "PC_SRB_R": (1, 62.0, 0.0625), "TVC_PITCH": (0, -2.0, 0.04),
    "TVC_YAW": (1, -1.5, 0.03), "ACC_AX": (2, 1.0, 0.01), "VIB_ENG": (0, 0.0, 0.03), "BUS_28V": (2, 26.5, 0.02), "TRAJ_DEV": (1, 0.0, 0.05),
}
#: Reference curves, as text that Spark and DuckDB read alike.
CURVES = {"ref_vib": "1.0 + 0.02 * k", "ref_lox": "3.0 + 0.01 * k", "band": "0.5 + 0.03 * k", "drift": "0.03 * k"}


def telemetry(spark, sf_dir) -> DataFrame:
    rows = series_queries.samples(spark, sf_dir).select(F.col("user_id").alias("run"), "k", "v")
    channels = {name: F.lit(base) + F.lit(slope) * (F.lag("v", lag).over(ft.RUN.ordered) if lag else F.col("v")) for name, (lag, base, slope) in MAPS.items()}
    return rows.withColumns({"t": F.lit(-60.0) + F.col("k") / F.lit(RATE)} | channels).withColumns({n: F.expr(f"cast({c} as double)") for n, c in CURVES.items()}).drop("v")


TELEMETRY = (
    "s AS (SELECT user_id AS run, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), raw AS (SELECT run, k, -60.0::DOUBLE + k / 0.3::DOUBLE AS t, "
    + ", ".join(f"{base} + {slope} * {'v' if not lag else f'lag(v, {lag}) OVER (PARTITION BY run ORDER BY k)'} AS {name}" for name, (lag, base, slope) in MAPS.items())
    + ", "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, c in CURVES.items())
    + " FROM s), filled AS (SELECT run, k, t, "
    + ", ".join(f"coalesce(last_value({n} IGNORE NULLS) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({n} IGNORE NULLS) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {n}" for n in MAPS)
    + ", "
    + ", ".join(CURVES)
    + " FROM raw)"
)


def _trail(x: str, seconds: float) -> str:
    n = max(1, round(seconds * RATE))
    return f"avg({x}) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag(x: str, seconds: float, fill: str) -> str:
    n = max(1, round(seconds * RATE))
    return f"CASE WHEN k >= {n} THEN lag({x}, {n}) OVER (PARTITION BY run ORDER BY k) ELSE {fill} END"


def _k(t: float) -> int:
    return min(max(round((t + 60) * RATE), 0), round(210 * RATE))


def _plateau(x: str) -> str:
    gate = f"FILTER (k >= {round(64 * RATE)} AND k < {round(66.5 * RATE)}) OVER so"
    return f"CASE WHEN count(*) {gate} >= {max(1, round(66.5 * RATE) - round(64 * RATE))} THEN avg({x}) {gate} END"


def _first(x: str) -> str:
    return f"first_value({x}) OVER (PARTITION BY run ORDER BY k)"


#: Derived series in the order in which they need each other, level by level.
LEVELS = [
    {"pc_tm2": _trail("PC_CORE", 2), "n_tm2": _trail("N_LOX_TP", 2), "t_tm1": _trail("T_TURB_IN", 1), "t_tm02": _trail("T_TURB_IN", 0.2), "t_flat": "CASE WHEN T_TURB_IN = lag(T_TURB_IN) OVER so THEN 1.0 ELSE 0.0 END", "pc_ref": _plateau("PC_CORE"), "n_ref": _plateau("N_LOX_TP"), "t_ref": _plateau("T_TURB_IN"),
     "vib_tm1": _trail("VIB_ENG", 1), "vib_ratio": "VIB_ENG / ref_vib", "imb": "100.0 * (PC_SRB_L - PC_SRB_R) / greatest((PC_SRB_L + PC_SRB_R) / 2.0, 20.0)", "yaw_tm3": _trail("TVC_YAW", 3), "lox_deficit": "ref_lox - P_LOX_TANK", "traj_tm1": _trail("TRAJ_DEV", 1)},
    {"t_step": f"abs(t_tm02 - {_lag('t_tm02', 0.2, _first('t_tm02'))})", "t_spike": "T_TURB_IN - t_tm1", "pc_rise": "pc_tm2 - pc_ref", "n_rise": "n_tm2 - n_ref", "t_rise": "t_tm1 - t_ref", "vib_excess": "vib_tm1 / ref_vib", "imb_abs": "abs(imb)", "imb_tm5": _trail("imb", 5), "imb_tm3": _trail("imb", 3), "yaw_tm3_abs": "abs(yaw_tm3)",
     "traj_rate": f"(traj_tm1 - {_lag('traj_tm1', 5, _first('traj_tm1'))}) / 5.0", "traj_band": "traj_tm1 / band", "implied": "CASE WHEN t >= 30 THEN greatest(traj_tm1 - 0.019, 0) / greatest(drift, 1e-6) END"},
    {"t_unexplained": "t_rise - 40 * n_rise", "t_corroborated": "CASE WHEN t_rise IS NULL THEN 40 * n_rise WHEN n_rise IS NULL THEN t_rise ELSE least(t_rise, 40 * n_rise) END", "imb_abs_tm2": _trail("imb_abs", 2), "traj_rise": f"implied - {_lag('implied', 20, 'NULL')}"},
]


def _sql(f: ft.Feature) -> str:
    gate = f"FILTER (k >= {_k(f.start)} AND k < {_k(f.stop)}) OVER so"
    least = max(1, round(f.least * RATE))
    if f.how == "now":
        return f"CASE WHEN t >= {f.start} THEN {f.series} END"
    if f.how == "crossing":
        return f"coalesce(min(t) FILTER (k >= {_k(f.start)} AND k < {_k(f.stop)} AND {f.series} >= {f.level}) OVER so, max(t) {gate}) - ({f.start})"
    if f.how == "correlation":
        both = f"FILTER (k >= {_k(f.start)} AND k < {_k(f.stop)} AND {f.series} IS NOT NULL AND {f.other} IS NOT NULL) OVER so"
        return f"CASE WHEN count(*) {both} >= {least} THEN CASE WHEN stddev_pop({f.series}) {both} < 1e-9 OR stddev_pop({f.other}) {both} < 1e-9 THEN 0 ELSE corr({f.series}, {f.other}) {both} END END"
    if f.how == "last10":
        n, end = max(1, round(10 * RATE)), _k(f.stop)
        return f"CASE WHEN k <= {end} THEN CASE WHEN t >= {f.start} THEN avg({f.series}) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END ELSE avg({f.series}) FILTER (k >= {end - n} AND k < {end}) OVER so END"
    if f.how == "dip":
        part = lambda a, b, s, agg: f"CASE WHEN count(*) FILTER (k >= {_k(a)} AND k < {_k(b)}) OVER so >= {max(1, round(s * RATE))} THEN {agg}({f.series}) FILTER (k >= {_k(a)} AND k < {_k(b)}) OVER so END"
        return f"({part(f.start, f.start + 2, 1.0, 'avg')}) - ({part(f.start + 3, f.start + 13, 0.5, 'min')})"
    value = {
        "mean": f"avg({f.series}) {gate}", "std": f"stddev_pop({f.series}) {gate}", "min": f"min({f.series}) {gate}", "max": f"max({f.series}) {gate}", "rms": f"sqrt(avg({f.series} * {f.series}) {gate})",
        "above": f"count(*) FILTER (k >= {_k(f.start)} AND k < {_k(f.stop)} AND {f.series} > {f.level}) OVER so::DOUBLE", "below": f"count(*) FILTER (k >= {_k(f.start)} AND k < {_k(f.stop)} AND {f.series} < {f.level}) OVER so::DOUBLE", "last": f"last_value({f.series} IGNORE NULLS) {gate}",
    }
    if f.how == "last":  # value of the last sample in the window: the greatest k
        value["last"] = f"max_by({f.series}, k) {gate}"
    return f"CASE WHEN count(*) {gate} >= {least} THEN {value[f.how]} END"


def _cube(telemetry: str = TELEMETRY) -> str:
    parts, source = [telemetry], "filled"
    so = "WINDOW so AS (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    for n, level in enumerate(LEVELS):
        parts.append(f"d{n} AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in level.items())} FROM {source} {so})")
        source = f"d{n}"
    columns = ", ".join(f"{_sql(f)} AS {f.name}" for f in CATALOGUE.features())
    rounded = ", ".join(f"round({f.name}, 6) AS {f.name}" for f in CATALOGUE.features())
    return f"WITH {', '.join(parts)}, e AS (SELECT run, k, t AS t_now, {columns} FROM {source} {so}) SELECT run, CAST(k // 5 AS BIGINT) AS tick, round(t_now, 6) AS t_now, {rounded} FROM e WHERE k % 5 = 0"


#: The telemetry of a stream: a leading gap stays open.
CAUSAL = re.sub(r"coalesce\((last_value\(\w+ IGNORE NULLS\) OVER \(.*?\)), first_value\(\w+ IGNORE NULLS\) OVER \(.*?\)\) AS", r"\1 AS", TELEMETRY)


@BOOK.enter(_cube(CAUSAL))
def streaming_features(spark, sf_dir):
    """The 120 features over a stream of the telemetry in four files, each a stretch of time, by state instead of windows."""
    rows = telemetry(spark, sf_dir).withColumn("ts", F.timestamp_seconds(replays.EPOCH + F.col("k") / RATE))
    stream = alerts.in_stretches(rows, "k", 4, scratch.new_path(spark, "stream-telemetry"))
    groups = replays.groups_of(table(spark, sf_dir, "events"), "user_id")
    found = alerts.drained(replays.feature_stream(stream, CATALOGUE, tick=5, late="1 day", groups=groups), scratch.new_path(spark, "stream-features"), "append")
    return found.select("run", "tick", r6(F.col("t_now")).alias("t_now"), *[r6(F.col(f.name)).alias(f.name) for f in CATALOGUE.features()])


@BOOK.enter(_cube())
def feature_cube(spark, sf_dir):
    """The 120 features that need no filter, at every fifth sample."""
    cube = ft.feature_cube(telemetry(spark, sf_dir), CATALOGUE, 5)
    return cube.select("run", "tick", r6(F.col("t_now")).alias("t_now"), *[r6(F.col(f.name)).alias(f.name) for f in CATALOGUE.features()])


def _behind() -> str:
    """The filters sample by sample as one recursive query over all runs, then the features of their outputs."""
    n = lambda x: f"{float(x)!r}::DOUBLE"
    made = [(name, channel, filters.butterworth(RATE, low, high)) for name, channel, low, high in BEHIND.filters]
    states, steps, outputs = [], [], []
    for name, _, sections in made:
        x = f"x_{name}"
        for j, (b, a) in enumerate(sections):
            p, y = f"{name}_{j}", f"y_{name}_{j}"
            states += [f"{p}a", f"{p}b"]
            outputs.append((j, y, f"{n(b[0])} * {x} + {p}a"))
            steps += [f"{n(b[1])} * {x} - {n(a[1])} * {y} + {p}b AS {p}a", f"{n(b[2])} * {x} - {n(a[2])} * {y} AS {p}b"]
            x = y
        steps.append(f"{x} AS {name}")
    names, inputs = [m[0] for m in made], ", ".join(f"x_{m[0]}" for m in made)
    one = ", ".join(f"{e} AS {y}" for j, y, e in outputs if j == 0)
    two = ", ".join(f"{e} AS {y}" for j, y, e in outputs if j == 1)
    recursion = f"""g AS (SELECT run, k, {', '.join(f'{channel} - first_value({channel}) OVER (PARTITION BY run ORDER BY k) AS x_{name}' for name, channel, _ in made)} FROM filled), r AS (
  SELECT run, CAST(-1 AS BIGINT) AS k, {', '.join(f'0.0::DOUBLE AS {c}' for c in [*states, *names])} FROM (SELECT DISTINCT run FROM g)
  UNION ALL
  SELECT run, k, {', '.join([s for s in steps if not s.endswith(tuple(f' AS {m}' for m in names))] + [s for s in steps if s.endswith(tuple(f' AS {m}' for m in names))])}
  FROM (SELECT *, {two} FROM (SELECT g.run, g.k, {inputs}, {', '.join(states)}, {one} FROM r JOIN g ON g.run = r.run AND g.k = r.k + 1)))"""
    seconds = {"pc_hp_rms1": ("pc_hp", 1), "pc_hp_rms5": ("pc_hp", 5), "lh2_bp_rms5": ("lh2_bp", 5), "pitch_lc_rms10": ("pitch_lc", 10), "yaw_lc_rms10": ("yaw_lc", 10), "acc_pogo_rms5": ("acc_pogo", 5), "pc_pogo_rms5": ("pc_pogo", 5)}
    trails = ", ".join(f"sqrt({_trail(f'{name} * {name}', s)}) AS {out}" for out, (name, s) in seconds.items())
    so = "WINDOW so AS (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    columns = ", ".join(f"{_sql(f)} AS {f.name}" for f in BEHIND.features())
    rounded = ", ".join(f"round({f.name}, 6) AS {f.name}" for f in BEHIND.features())
    return f"WITH RECURSIVE {TELEMETRY}, {recursion}, d AS (SELECT *, {trails} FROM r WHERE k >= 0), e AS (SELECT run, k, {columns} FROM d {so}) SELECT run, CAST(k // 5 AS BIGINT) AS tick, {rounded} FROM e WHERE k % 5 = 0"


@BOOK.enter(_behind())
def feature_cube_behind_filters(spark, sf_dir):
    """The 17 features behind a filter, at every fifth sample."""
    cube = ft.feature_cube(telemetry(spark, sf_dir), BEHIND, 5)
    return cube.select("run", "tick", *[r6(F.col(f.name)).alias(f.name) for f in BEHIND.features()])
