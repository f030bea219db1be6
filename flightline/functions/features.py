"""Causal features of a telemetry table, from a catalogue.

A telemetry table has a row for each run and sample: ``run, k, t`` and one column for each channel
(NULL: lost). A feature is an aggregate of a derived series over the samples so far inside a window
``[start, stop)``; it is NULL until the window has enough samples.

Some hundreds of windows over one series are one pass: :class:`Running` goes through a run's samples in
blocks of NumPy arrays and carries running summaries (counts, sums, extrema, last values), the filters'
states and the last twenty seconds. Batches of a table and micro-batches of a stream go on from the same
carry, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightline.functions import filters
from flightline.functions.timeseries import SHORT, Series

RUN = Series(("run",), ("k",))


@dataclass(frozen=True)
class Channel:
    name: str
    unit: str
    #: Windows in which the generic statistics of the channel are taken.
    windows: tuple[str, ...] = ()


@dataclass(frozen=True)
class Feature:
    """A statistic of ``series`` over the samples so far inside [start, stop).

    ``how`` is mean, std, min, max, rms, above or below (samples beyond ``level``), last, now (the sample itself from
    ``start`` on), crossing (time from ``start`` until ``level`` is reached), correlation (with ``other``), last10 (mean of
    the ten seconds before the tick or ``stop``) or dip (mean of [start, start + 2) minus least of the ten seconds from
    3 s after ``start``).  It is NULL until the window has ``least`` seconds of samples.
    """

    name: str
    series: str
    how: str
    start: float
    stop: float
    least: float = 1.0
    level: float = 0.0
    other: str | None = None


@dataclass(frozen=True)
class Catalogue:
    """Channels, reference columns, filters ``(name, channel, low, high)`` in Hz (high None: high-pass), derived series, and features.

    ``rate`` is samples a second, ``origin`` the time of sample 0.  A derived series is a function of the
    :class:`Block` that it is computed in; none reaches back more than ``reach`` seconds.
    """

    channels: tuple[Channel, ...]
    windows: dict[str, tuple[float, float]]
    derived: dict[str, Callable[[Block], np.ndarray]]
    engineered: tuple[Feature, ...] = ()
    filters: tuple[tuple[str, str, float, float | None], ...] = ()
    references: tuple[str, ...] = ()
    reach: float = 21.5
    rate: float = 50.0
    origin: float = -60.0
    last: float = 150.0

    def generic(self) -> list[Feature]:
        """Mean, population standard deviation, least and greatest of each channel in each of its windows."""
        return [Feature(f"{w}__{c.name}__{how}", c.name, how, *self.windows[w]) for w in ("CD", "IGN", "ASC") for c in self.channels if w in c.windows for how in ("mean", "std", "min", "max")]

    def features(self) -> list[Feature]:
        return [*self.generic(), *self.engineered]

    def k_of(self, t: float) -> int:
        """Number of the sample at ``t``, within the record."""
        return min(max(round((t - self.origin) * self.rate), 0), round((self.last - self.origin) * self.rate))

    def samples(self, seconds: float) -> int:
        return max(1, round(seconds * self.rate))

    def without_filters(self) -> Catalogue:
        """What needs no filter: the catalogue less every feature of a filtered series."""
        behind = {name for name, *_ in self.filters}
        derived = {name: build for name, build in self.derived.items() if not any(f in name for f in behind)}
        return replace(self, filters=(), derived=derived, engineered=tuple(f for f in self.engineered if not any(b in f.series for b in behind)))


class Block:
    """A stretch of samples of runs side by side with those before it that its windows reach back to, as NumPy series (NaN: missing).

    A series has a row for each sample and a column for each run.  Derived series are computed when they are asked for, once.
    """

    def __init__(self, catalogue: Catalogue, k: np.ndarray, series: dict[str, np.ndarray], plateaus: dict[str, float]):
        self.catalogue, self.k, self.made, self.plateaus = catalogue, k, series, plateaus

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            with np.errstate(divide="ignore", invalid="ignore"):
                self.made[name] = self.catalogue.derived[name](self)
        return self.made[name]

    def _mean(self, v: np.ndarray, seconds: float, ahead: int = 0) -> np.ndarray:
        """Mean of the present ones of the last samples (``ahead`` 1: without the last one), of fewer at the beginning."""
        n, w = len(v), self.catalogue.samples(seconds)
        there = ~np.isnan(v)
        values = np.where(there, v, 0.0)
        total, count = np.zeros((n + 1, *v.shape[1:])), np.zeros((n + 1, *v.shape[1:]))
        np.cumsum(there, axis=0, out=count[1:])
        high = np.arange(n) + 1 - ahead
        low = np.maximum(0, high - w)
        if w <= SHORT:
            # Oldest first, and nothing of what lies before the window.
            inside = np.zeros(v.shape)
            for back in range(w - 1 + ahead, ahead - 1, -1):
                inside[back:] += values[: max(0, n - back)]
        else:
            np.cumsum(values, axis=0, out=total[1:])
            inside = total[high] - total[low]
        with np.errstate(divide="ignore", invalid="ignore"):
            return inside / (count[high] - count[low])

    def trailing(self, name: str, seconds: float) -> np.ndarray:
        return self._mean(self[name], seconds)

    def trailing_before(self, name: str, seconds: float) -> np.ndarray:
        return self._mean(self[name], seconds, 1)

    def trailing_rms(self, name: str, seconds: float) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self._mean(self[name] ** 2, seconds)))

    def delayed(self, name: str, seconds: float, fill: float | None = None) -> np.ndarray:
        """The samples so long ago; before the first one ``fill``, or else the first."""
        v, n = self[name], self.catalogue.samples(seconds)
        head = np.repeat(v[:1] if fill is None else np.full_like(v[:1], fill), min(n, len(v)), axis=0)
        return np.concatenate([head, v[: max(0, len(v) - n)]])

    def unchanged(self, name: str) -> np.ndarray:
        v = self[name]
        return np.concatenate([np.zeros_like(v[:1]), (v[1:] == v[:-1]).astype(np.float64)])

    def plateau(self, name: str) -> np.ndarray:
        """Mean over the plateau of a channel, known once it is over."""
        stop = round((PLATEAU[1] - self.catalogue.origin) * self.catalogue.rate)
        return np.where((self.k >= stop - 1)[:, None], self.plateaus[name], np.nan)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, np.nan, a / b)


@dataclass
class Carry:
    """What is known of a run up to a sample: enough to go on with it, however long it is (of runs side by side: with an axis of runs at the end of each array).

    ``tail`` are the last samples (as far back as any window reaches) of the filled channels, the
    references, the time and the filters' outputs; ``first`` the first value of each channel.  The running
    summaries are vectors in the order of :class:`Summaries`.
    """

    held: np.ndarray
    first: np.ndarray
    states: list[np.ndarray]
    tail: np.ndarray
    tail_k: np.ndarray
    plateau: np.ndarray
    add: np.ndarray
    low: np.ndarray
    high: np.ndarray
    last: np.ndarray


@dataclass
class Summaries:
    """The running summaries that a catalogue's features need: sums, least, greatest and last values over the gated samples so far.

    Each is ``(what, series, other series or level, first sample, stop)``; features that need the same one
    share it.
    """

    add: list[tuple] = field(default_factory=list)
    low: list[tuple] = field(default_factory=list)
    high: list[tuple] = field(default_factory=list)
    last: list[tuple] = field(default_factory=list)

    def place(self, kind: str, key: tuple) -> int:
        keys = getattr(self, kind)
        if key not in keys:
            keys.append(key)
        return keys.index(key)


#: Runs are taken side by side up to so many samples in all.
SIDE_BY_SIDE = 65_536


class Running:
    """Features of runs as their samples come: one pass over NumPy blocks, each going on from the one before."""

    def __init__(self, catalogue: Catalogue, tick: int = 25):
        self.catalogue, self.tick = catalogue, tick
        self.channels = [c.name for c in catalogue.channels]
        self.bands = [(name, self.channels.index(channel), filters.butterworth(catalogue.rate, low, high)) for name, channel, low, high in catalogue.filters]
        self.kept = [*self.channels, *catalogue.references, "t", *(name for name, *_ in self.bands)]
        self.reach = catalogue.samples(catalogue.reach) + 2
        self.summaries = Summaries()
        self.finish = [self._plan(f) for f in catalogue.features()]
        self.names = [f.name for f in catalogue.features()]

    def start(self) -> Carry:
        s, n = self.summaries, len(self.channels)
        return Carry(
            np.full(n, np.nan), np.full(n, np.nan), [filters.at_rest(sections) for _, _, sections in self.bands], np.zeros((0, len(self.kept))), np.zeros(0, np.int64), np.zeros((len(PLATEAU_CHANNELS), 2)),
            np.zeros(len(s.add)), np.full(len(s.low), np.inf), np.full(len(s.high), -np.inf), np.full(len(s.last), np.nan),
        )

    def _plan(self, f: Feature):
        """A function of the summaries at ticks (and the block there) that gives the feature, NaN where it has no value."""
        c, s = self.catalogue, self.summaries
        gate = (c.k_of(f.start), c.k_of(f.stop))

        def sums(what: str, series: str, other=None, own=gate) -> int:
            return s.place("add", (what, series, other, *own))

        if f.how == "now":
            return lambda at, block, rows: np.where(block["t"][rows] >= f.start, block[f.series][rows], np.nan)
        if f.how == "crossing":
            crossed, end = s.place("low", ("cross", f.series, f.level, *gate)), s.place("high", ("time", "t", None, *gate))
            return lambda at, block, rows: np.where(np.isinf(at[1][:, crossed]), np.where(np.isinf(at[2][:, end]), np.nan, at[2][:, end]), at[1][:, crossed]) - f.start
        if f.how == "correlation":
            n, x, y, xx, yy, xy = (sums(what, f.series, f.other) for what in ("both", "both_x", "both_y", "both_xx", "both_yy", "both_xy"))

            def correlation(at, block, rows):
                count = at[0][:, n]
                mx, my = at[0][:, x] / count, at[0][:, y] / count
                sx, sy = (np.sqrt(np.maximum(0.0, at[0][:, q] / count - m * m)) for q, m in ((xx, mx), (yy, my)))
                value = np.where((sx < 1e-9) | (sy < 1e-9), 0.0, (at[0][:, xy] / count - mx * my) / (sx * sy))
                return np.where(count >= c.samples(f.least), value, np.nan)

            return correlation
        if f.how == "last10":
            place = s.place("last", ("last10", f.series, f.start, 0, c.k_of(f.stop) + 1))
            return lambda at, block, rows: at[3][:, place]
        if f.how == "dip":
            before, after = (c.k_of(f.start), c.k_of(f.start + 2)), (c.k_of(f.start + 3), c.k_of(f.start + 13))
            n, count, total = (sums(what, f.series, own=before) for what in ("rows", "count", "sum"))
            m, low = sums("rows", f.series, own=after), s.place("low", ("min", f.series, None, *after))

            def dip(at, block, rows):
                value = at[0][:, total] / at[0][:, count] - np.where(np.isinf(at[1][:, low]), np.nan, at[1][:, low]) + self._shift(block, f.series)
                return np.where((at[0][:, n] >= c.samples(1.0)) & (at[0][:, m] >= c.samples(0.5)), value, np.nan)

            return dip
        rows_seen = sums("rows", f.series)
        if f.how in ("mean", "std"):
            # A mean is that of the values themselves, so that it comes out where theirs does; squares are of differences.
            count, total = sums("count", f.series), sums("sum" if f.how == "std" else "plain", f.series)
            square = sums("square", f.series) if f.how == "std" else None

            def value(at, block):
                mean = at[0][:, total] / at[0][:, count]
                return mean if square is None else np.sqrt(np.maximum(0.0, at[0][:, square] / at[0][:, count] - mean * mean))
        elif f.how == "rms":
            count, total = sums("count", f.series), sums("power", f.series)

            def value(at, block):
                return np.sqrt(at[0][:, total] / at[0][:, count])
        elif f.how in ("above", "below"):
            count = sums(f.how, f.series, f.level)

            def value(at, block):
                return at[0][:, count]
        elif f.how == "last":
            place = s.place("last", ("last", f.series, None, *gate))

            def value(at, block):
                return at[3][:, place]
        else:
            kind, number = ("low", 1) if f.how == "min" else ("high", 2)
            place = s.place(kind, (f.how, f.series, None, *gate))

            def value(at, block):
                v = at[number][:, place]
                return np.where(np.isinf(v), np.nan, v)

        return lambda at, block, rows: np.where(at[0][:, rows_seen] >= c.samples(f.least), value(at, block), np.nan)

    def _shift(self, block: Block, series: str) -> np.ndarray | float:
        """Sums of a channel are taken from its first value on, so that squares keep their digits."""
        return block.plateaus["_first"].get(series, 0.0)

    def _contribution(self, key: tuple, block: Block, own: slice) -> np.ndarray:
        what, series, other, *_ = key
        if what == "time":
            return block["t"][own]
        v = block[series][own]
        if what == "rows":
            return np.ones(v.shape)
        if what == "count":
            return ~np.isnan(v)
        if what in ("sum", "square"):
            v = np.nan_to_num(v - self._shift(block, series))
            return v if what == "sum" else v * v
        if what == "plain":
            return np.nan_to_num(v)
        if what == "power":
            return np.nan_to_num(v * v)
        if what == "above":
            return v > other
        if what == "below":
            return v < other
        if what.startswith("both"):
            w = block[other][own]
            there = ~np.isnan(v) & ~np.isnan(w)
            x, y = np.where(there, v, 0.0), np.where(there, w, 0.0)
            return {"both": there, "both_x": x, "both_y": y, "both_xx": x * x, "both_yy": y * y, "both_xy": x * y}[what]
        if what == "cross":
            return np.where(v >= other, block["t"][own], np.inf)
        if what == "last10":
            return np.where(block["t"][own] >= other, block.trailing_before(series, 10.0)[own], np.nan)
        if what == "last":
            return v
        return np.where(np.isnan(v), np.inf if what == "min" else -np.inf, v)

    def advance(self, carry: Carry, k: np.ndarray, t: np.ndarray, channels: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Carry]:
        """Go on with a run by the samples ``k`` (ascending): the ticks' ``k`` and ``t``, their features (ticks, features; NaN: none), and the new carry.

        ``channels`` (samples, channels) may have NaN: the last value is held.  A gap at the run's very
        beginning stays open; whoever knows the first value that comes fills it in ``channels`` before.
        """
        return self.advance_all([carry], [(k, t, channels, references)])[0]

    def advance_all(self, carries: list[Carry], blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, Carry]]:
        """:meth:`advance` for many runs, each with its carry and its ``(k, t, channels, references)``; those at the same place go on side by side."""
        out: list = [None] * len(blocks)
        for members in self._alike(carries, blocks):
            for i, done in zip(members, self._side_by_side([carries[i] for i in members], [blocks[i] for i in members]), strict=True):
                out[i] = done
        return out

    def _alike(self, carries: list[Carry], blocks: list[tuple]) -> Iterator[list[int]]:
        """Places of runs that have the same samples before and whose own begin alike, the longest last.

        A shorter one takes part as far as it goes (features look back only), but for filters, whose states are those
        after the last sample of all.
        """
        groups: dict[tuple, list[int]] = {}
        for i, (carry, (k, *_)) in enumerate(zip(carries, blocks, strict=True)):
            whole = not self.bands and len(k) and k[-1] - k[0] == len(k) - 1
            groups.setdefault((carry.tail_k.tobytes(), int(k[0]) if whole else k.tobytes()), []).append(i)
        for members in groups.values():
            members.sort(key=lambda i: len(blocks[i][0]))
            begin = 0
            for end, i in enumerate(members):
                n = len(blocks[i][0])
                if end > begin and (n > 2 * len(blocks[members[begin]][0]) + 32 or (n + self.reach) * (end - begin + 1) > SIDE_BY_SIDE):
                    yield members[begin:end]
                    begin = end
            yield members[begin:]

    def _side_by_side(self, carries: list[Carry], blocks: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Carry]]:
        """:meth:`advance` for runs as :meth:`_alike` gives them: arrays are (samples, columns, runs), filled up behind the shorter ones."""
        lengths = np.array([len(k) for k, *_ in blocks])
        k, tail_k = blocks[-1][0], carries[0].tail_k
        n, runs, columns = len(k), len(blocks), np.arange(len(blocks))
        own = np.arange(n)[:, None] < lengths

        def beside(name: str) -> np.ndarray:
            return np.stack([getattr(c, name) for c in carries], axis=-1)

        def filled_up(place: int) -> np.ndarray:
            out = np.full((n, *blocks[-1][place].shape[1:], runs), np.nan)
            for j, b in enumerate(blocks):
                out[: lengths[j], ..., j] = b[place]
            return out

        t, channels, references = filled_up(1), filled_up(2), filled_up(3)
        held, first, tail, plateau = (beside(name) for name in ("held", "first", "tail", "plateau"))
        filled = np.concatenate([held[None], channels])
        there = np.where(np.isnan(filled), 0, np.arange(n + 1)[:, None, None])
        filled = np.take_along_axis(filled, np.maximum.accumulate(there, axis=0), axis=0)
        known = ~np.isnan(filled[1:])
        begun_at = np.take_along_axis(filled[1:], known.argmax(axis=0)[None], axis=0)[0] if n else first
        first = np.where(np.isnan(first), begun_at, first)
        states, bands = [[] for _ in blocks], []
        for number, (_, j, sections) in enumerate(self.bands):
            # Before its first value a channel stands still for the filter.
            y, after = filters.run_on(sections, np.nan_to_num(filled[1:, j] - first[j]), np.concatenate([c.states[number] for c in carries], axis=2))
            bands.append(y[:, None])
            for i, kept in enumerate(states):
                kept.append(after[:, :, i : i + 1].copy())
        rows = np.concatenate([tail, np.concatenate([filled[1:], references, t[:, None], *bands], axis=1)])
        every_k = np.concatenate([tail_k, k])
        before = len(tail_k)
        low, high = (round((x - self.catalogue.origin) * self.catalogue.rate) for x in PLATEAU)
        inside = (k >= low) & (k < high)
        means = {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for number, name in enumerate(PLATEAU_CHANNELS):
                if name in self.channels:
                    v = np.where(own, filled[1:, self.channels.index(name)], np.nan)[inside]
                    plateau[number] += np.nansum(v, axis=0), own[inside].sum(axis=0)
                    means[name] = np.where(plateau[number, 1] >= max(1, high - low), plateau[number, 0] / plateau[number, 1], np.nan)
        means["_first"] = dict(zip(self.channels, np.where(np.isnan(first), 0.0, first), strict=True))
        block = Block(self.catalogue, every_k, {name: rows[:, j] for j, name in enumerate(self.kept)}, means)

        at_tick = np.flatnonzero(k % self.tick == 0)
        running, ends = [], {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for kind, gather in (("add", np.add), ("low", np.minimum), ("high", np.maximum), ("last", None)):
                keys = getattr(self.summaries, kind)
                out, end = np.empty((len(at_tick), len(keys), runs)), np.empty((len(keys), runs))
                begun = beside(kind)
                for place, key in enumerate(keys):
                    a, b = np.searchsorted(k, key[-2:])
                    if a == b:
                        out[:, place] = end[place] = begun[place]
                        continue
                    part = self._contribution(key, block, slice(before + a, before + b))
                    if gather is None:
                        seen = np.maximum.accumulate(np.where(np.isnan(part), 0, np.arange(1, len(part) + 1)[:, None]), axis=0)
                        value = np.take_along_axis(np.concatenate([begun[place][None], part]), np.concatenate([np.zeros((1, runs), np.int64), seen]), axis=0)
                    else:
                        value = gather.accumulate(np.concatenate([begun[place][None], part.astype(np.float64)]), axis=0)
                    # The samples that each tick has seen, and all that a run has.
                    out[:, place], end[place] = value[np.clip(at_tick + 1 - a, 0, b - a)], value[np.clip(lengths - a, 0, b - a), columns]
                running.append(out)
                ends[kind] = end
            found = np.empty((len(at_tick), len(self.names), runs))
            for j, finish in enumerate(self.finish):
                found[:, j] = finish(running, block, before + at_tick)
        for i, length in enumerate(lengths.tolist()):
            ticks, keep = at_tick[: np.searchsorted(at_tick, length)], slice(max(0, before + length - self.reach), before + length)
            after = Carry(filled[length, :, i].copy(), first[:, i].copy(), states[i], rows[keep, :, i].copy(), every_k[keep].copy(), plateau[:, :, i].copy(), *(ends[kind][:, i].copy() for kind in ("add", "low", "high", "last")))
            yield k[ticks], t[ticks, i], found[: len(ticks), :, i], after


def feature_cube(telemetry: DataFrame, catalogue: Catalogue, tick: int = 25, fill_leading: bool = True) -> DataFrame:
    """``run, tick, t_now`` and one column for each feature, at every ``tick``-th sample.

    The table has the channels and the reference columns that derived series name; leading gaps take the
    first sample that is there, unless ``fill_leading`` is off.  Runs are dealt over tasks and sorted once; a
    task goes through its runs in Arrow batches with :class:`Running`, so it holds one batch and one carry
    (a run that begins with a gap, until the gap is over).
    """
    running = Running(catalogue, tick)
    channels, references, names = running.channels, list(catalogue.references), running.names
    wanted = telemetry.select("run", F.col("k").cast("long"), F.col("t").cast("double"), *[F.col(c).cast("double") for c in (*channels, *references)])
    kind = telemetry.schema["run"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = Running(catalogue, tick)
        run = carry = None
        waiting: list[np.ndarray] = []

        def step(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carry, waiting
            data = np.concatenate(waiting) if len(waiting) > 1 else waiting[0]
            values = data[:, 2 : 2 + len(channels)]
            if fill_leading and np.isnan(carry.held).any():
                gap = np.isnan(carry.held) & np.isnan(values[0])
                firsts = [np.flatnonzero(~np.isnan(values[:, j])) if gap[j] else () for j in range(len(channels))]
                if not final and any(gap[j] and not len(firsts[j]) for j in range(len(channels))):
                    waiting = [data]
                    return
                values = values.copy()
                for j in np.flatnonzero(gap):
                    if len(firsts[j]):
                        values[: firsts[j][0], j] = values[firsts[j][0], j]
            waiting = []
            k, t, found, carry = running.advance(carry, data[:, 0].astype(np.int64), data[:, 1], values, data[:, 2 + len(channels) :])
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(k), filters._arrow(kind)), pa.array(k // tick), pa.array(t), *(pa.array(found[:, j], from_pandas=True) for j in range(len(names)))], ["run", "tick", "t_now", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64) for j in range(1, batch.num_columns)], axis=1)
            for a, b in filters.runs_of([batch.column(0)]):
                now = batch.column(0)[a].as_py()
                if carry is None or now != run:
                    if waiting:
                        yield from step(True)
                    run, carry = now, running.start()
                waiting.append(data[a:b])
                yield from step(False)
        if waiting:
            yield from step(True)

    schema = T.StructType([T.StructField("run", kind), T.StructField("tick", T.LongType()), T.StructField("t_now", T.DoubleType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    return wanted.repartition("run").sortWithinPartitions("run", "k").mapInArrow(scan, schema)


def row_labels(ticks: DataFrame, manifest: DataFrame, classes: list[str]) -> DataFrame:
    """Add a 0/1 column for each class: 1 from the time its failure is visible (``run, class, manifest``) on."""
    wide = manifest.groupBy("run").pivot("class", classes).agg(F.min("manifest"))
    joined = ticks.join(wide, "run", "left")
    return joined.withColumns({c: F.coalesce((F.col(c) <= F.col("t_now")).cast("int"), F.lit(0)) for c in classes})


def nearest_tick(t: Column, start: float, step: float) -> Column:
    return F.round((t - start) / step).cast("long")


def training_ticks(ticks: DataFrame, gates: list[int], n: int, seed: int = 0) -> DataFrame:
    """Fixed gates and ``n`` random ticks of each run, without repetition: ``run, tick``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("run").orderBy(F.xxhash64("run", "tick", F.lit(seed)), "tick"))
    return ticks.select("run", "tick").withColumn("_place", place).where((F.col("_place") <= n) | F.col("tick").isin(gates)).select("run", "tick").distinct()


# The channels with the windows of their generic statistics, the windows (CD countdown, IGN engine start, ASC
# boosted ascent, LATE late ascent, FLT flight), the bands in Hz and the levels below.
CHANNELS = (
    Channel("PC_CORE", "bar", ("IGN", "ASC")), Channel("N_LOX_TP", "%", ("IGN", "ASC")), Channel("T_TURB_IN", "K", ("IGN", "ASC")), Channel("P_LOX_TANK", "bar", ("CD", "ASC")), Channel("P_LH2_TANK", "bar", ("CD", "ASC")),
    Channel("PC_SRB_L", "bar", ("ASC",)), Channel("PC_SRB_R", "bar", ("ASC",)), Channel("TVC_PITCH", "deg", ("ASC",)), Channel("TVC_YAW", "deg", ("ASC",)), Channel("ACC_AX", "g", ("ASC",)), Channel("VIB_ENG", "g rms", ("IGN", "ASC")),
    Channel("BUS_28V", "V", ("CD", "ASC")), Channel("TRAJ_DEV", "km", ("ASC",)),
)
WINDOWS = {"CD": (-60.0, -1.0), "IGN": (0.0, 6.5), "ASC": (7.0, 136.0), "LATE": (100.0, 136.0), "FLT": (7.0, 150.0)}
FILTERS = (
    ("pc_hp", "PC_CORE", 1.5, None), ("n_hp", "N_LOX_TP", 1.5, None), ("lh2_bp", "P_LH2_TANK", 0.15, 0.5), ("pitch_lc", "TVC_PITCH", 0.9, 2.4), ("yaw_lc", "TVC_YAW", 0.9, 2.4), ("pitch_gust", "TVC_PITCH", 0.02, 0.5),
    ("acc_pogo", "ACC_AX", 10.0, 20.0), ("pc_pogo", "PC_CORE", 10.0, 20.0),
)
#: Seconds after ignition between which engine channels have their plateau, and the channels that rise from it.
PLATEAU, PLATEAU_CHANNELS = (4.0, 6.5), ("PC_CORE", "N_LOX_TP", "T_TURB_IN")
TEMPERATURE_PER_PUMP_PERCENT, READY_BAR, HALF_BAR, NINETY_BAR, NOISE_KM, IMPLIED_FROM, RATE_S, TREND_S = 40.0, 3.30, 57.5, 103.5, 0.019, 30.0, 5.0, 20.0


def launch_catalogue(rate: float = 50.0) -> Catalogue:
    """All 137 features.  The table needs the reference columns ``ref_vib``, ``ref_lox``, ``band`` and ``drift`` (the band's growth)."""
    derived: dict[str, Callable[[Block], np.ndarray]] = {
        "pc_tm2": lambda b: b.trailing("PC_CORE", 2.0), "n_tm2": lambda b: b.trailing("N_LOX_TP", 2.0), "t_tm1": lambda b: b.trailing("T_TURB_IN", 1.0), "t_tm02": lambda b: b.trailing("T_TURB_IN", 0.2),
        "t_step": lambda b: np.abs(b["t_tm02"] - b.delayed("t_tm02", 0.2)), "t_spike": lambda b: b["T_TURB_IN"] - b["t_tm1"], "t_flat": lambda b: b.unchanged("T_TURB_IN"),
        "pc_rise": lambda b: b["pc_tm2"] - b.plateau("PC_CORE"), "n_rise": lambda b: b["n_tm2"] - b.plateau("N_LOX_TP"), "t_rise": lambda b: b["t_tm1"] - b.plateau("T_TURB_IN"),
        "t_unexplained": lambda b: b["t_rise"] - TEMPERATURE_PER_PUMP_PERCENT * b["n_rise"], "t_corroborated": lambda b: np.fmin(b["t_rise"], TEMPERATURE_PER_PUMP_PERCENT * b["n_rise"]),
        "vib_tm1": lambda b: b.trailing("VIB_ENG", 1.0), "vib_excess": lambda b: ratio(b["vib_tm1"], b["ref_vib"]), "vib_ratio": lambda b: ratio(b["VIB_ENG"], b["ref_vib"]),
        "imb": lambda b: 100.0 * (b["PC_SRB_L"] - b["PC_SRB_R"]) / np.fmax((b["PC_SRB_L"] + b["PC_SRB_R"]) / 2.0, 20.0), "imb_abs": lambda b: np.abs(b["imb"]),
        "imb_abs_tm2": lambda b: b.trailing("imb_abs", 2.0), "imb_tm5": lambda b: b.trailing("imb", 5.0), "imb_tm3": lambda b: b.trailing("imb", 3.0), "yaw_tm3": lambda b: b.trailing("TVC_YAW", 3.0), "yaw_tm3_abs": lambda b: np.abs(b["yaw_tm3"]),
        "lox_deficit": lambda b: b["ref_lox"] - b["P_LOX_TANK"], "traj_tm1": lambda b: b.trailing("TRAJ_DEV", 1.0), "traj_rate": lambda b: (b["traj_tm1"] - b.delayed("traj_tm1", RATE_S)) / RATE_S, "traj_band": lambda b: ratio(b["traj_tm1"], b["band"]),
        "implied": lambda b: np.where(b["t"] >= IMPLIED_FROM, np.fmax(b["traj_tm1"] - NOISE_KM, 0.0) / np.fmax(b["drift"], 1e-6), np.nan), "traj_rise": lambda b: b["implied"] - b.delayed("implied", TREND_S, np.nan),
        "pc_hp_rms1": lambda b: b.trailing_rms("pc_hp", 1.0), "pc_hp_rms5": lambda b: b.trailing_rms("pc_hp", 5.0), "lh2_bp_rms5": lambda b: b.trailing_rms("lh2_bp", 5.0), "pitch_lc_rms10": lambda b: b.trailing_rms("pitch_lc", 10.0),
        "yaw_lc_rms10": lambda b: b.trailing_rms("yaw_lc", 10.0), "acc_pogo_rms5": lambda b: b.trailing_rms("acc_pogo", 5.0), "pc_pogo_rms5": lambda b: b.trailing_rms("pc_pogo", 5.0),
    }
    f, h = Feature, 0.5
    engineered = (
        f("CD__P_LOX_TANK__last10", "P_LOX_TANK", "last10", -30.0, -1.0), f("CD__P_LOX_TANK__ramp_deficit", "lox_deficit", "mean", -57.0, -1.0), f("CD__P_LOX_TANK__t_ready", "P_LOX_TANK", "crossing", -58.0, -1.0, level=READY_BAR),
        f("CD__P_LH2_TANK__osc_rms", "lh2_bp", "rms", -38.0, -1.0, 5.0), f("CD__P_LH2_TANK__osc_rms_max5", "lh2_bp_rms5", "max", -33.0, -1.0), f("CD__P_LH2_TANK__last10", "P_LH2_TANK", "last10", -30.0, -1.0),
        f("CD__BUS_28V__transfer_dip", "BUS_28V", "dip", -33.0, -20.0), f("CD__BUS_28V__post_transfer", "BUS_28V", "mean", -25.0, -1.0), f("CD__BUS_28V__min_post", "BUS_28V", "min", -28.0, -1.0),
        f("IGN__PC_CORE__t50", "PC_CORE", "crossing", 0.0, 6.5, level=HALF_BAR), f("IGN__PC_CORE__t90", "PC_CORE", "crossing", 0.0, 6.5, level=NINETY_BAR), f("IGN__PC_CORE__at2p5", "PC_CORE", "mean", 2.4, 2.6, 0.2),
        f("IGN__N_LOX_TP__at2p5", "N_LOX_TP", "mean", 2.4, 2.6, 0.2), f("IGN__PC_CORE__rough_max1", "pc_hp_rms1", "max", 3.0, 6.5, h), f("IGN__PC_CORE__dip_count", "pc_hp", "below", 3.0, 6.5, h, level=-2.0),
        f("IGN__N_LOX_TP__spike_max", "n_hp", "max", 2.5, 6.5, h), f("IGN__N_LOX_TP__spike_count", "n_hp", "above", 2.5, 6.5, h, level=1.0), f("IGN__T_TURB_IN__peak", "T_TURB_IN", "max", 0.0, 3.5),
        f("IGN__T_TURB_IN__plateau", "T_TURB_IN", "mean", 4.0, 6.5, h), f("IGN__VIB_ENG__max1", "vib_tm1", "max", 1.0, 6.5, h), f("IGN__VIB_ENG__mean_late", "VIB_ENG", "mean", 3.0, 6.5, h), f("IGN__P_LOX_TANK__mean", "P_LOX_TANK", "mean", 0.0, 6.5),
        f("ASC__PC_CORE__rough", "pc_hp", "rms", 8.0, 136.0), f("ASC__PC_CORE__rough_max5", "pc_hp_rms5", "max", 9.0, 136.0, h), f("ASC__PC_CORE__rise_max", "pc_rise", "max", 9.0, 136.0, h),
        f("ASC__N_LOX_TP__rise_max", "n_rise", "max", 9.0, 136.0, h), f("ASC__T_TURB_IN__rise_max", "t_rise", "max", 8.0, 136.0, h), f("ASC__T_TURB_IN__step_max", "t_step", "max", 8.0, 136.0, h),
        f("ASC__T_TURB_IN__spike_count", "t_spike", "above", 8.0, 136.0, h, level=40.0), f("ASC__T_TURB_IN__flat_frac", "t_flat", "mean", 8.0, 136.0), f("XC__T_unexplained_max", "t_unexplained", "max", 9.0, 136.0, h),
        f("XC__T_corroborated_max", "t_corroborated", "max", 9.0, 136.0, h), f("ASC__SRB__imbalance_mean", "imb_abs", "mean", 8.0, 122.0), f("ASC__SRB__imbalance_max", "imb_abs_tm2", "max", 8.0, 122.0, h),
        f("ASC__SRB__imbalance_now", "imb_tm5", "last", 8.0, 122.0, h), f("ASC__TVC_YAW__bias_absmax", "yaw_tm3_abs", "max", 9.0, 134.0, h), f("ASC__TVC_YAW__bias_mean", "TVC_YAW", "mean", 9.0, 134.0),
        f("XC__yaw_imbalance_corr", "yaw_tm3", "correlation", 12.0, 122.0, 10.0, other="imb_tm3"), f("ASC__TVC_PITCH__lc_rms", "pitch_lc", "rms", 10.0, 136.0), f("ASC__TVC_PITCH__lc_rms_max10", "pitch_lc_rms10", "max", 12.0, 136.0, h),
        f("ASC__TVC_YAW__lc_rms_max10", "yaw_lc_rms10", "max", 12.0, 136.0, h), f("ASC__TVC_PITCH__gust_rms", "pitch_gust", "rms", 10.0, 136.0), f("ASC__ACC_AX__pogo_rms_max5", "acc_pogo_rms5", "max", 10.0, 136.0, h),
        f("ASC__PC_CORE__pogo_rms_max5", "pc_pogo_rms5", "max", 10.0, 136.0, h), f("LATE__ACC_AX__pogo_rms", "acc_pogo", "rms", 100.0, 136.0), f("ASC__VIB_ENG__excess_max", "vib_excess", "max", 8.0, 136.0, h),
        f("ASC__VIB_ENG__excess_mean", "vib_ratio", "mean", 8.0, 136.0), f("ASC__N_LOX_TP__spike_count", "n_hp", "above", 8.0, 136.0, h, level=1.0), f("ASC__P_LH2_TANK__osc_rms", "lh2_bp", "rms", 8.0, 136.0),
        f("FLT__TRAJ_DEV__now", "traj_tm1", "now", 8.0, 150.0), f("FLT__TRAJ_DEV__max", "traj_tm1", "max", 7.0, 150.0, h), f("FLT__TRAJ_DEV__rate_now", "traj_rate", "now", 12.0, 150.0),
        f("FLT__TRAJ_DEV__rate_max", "traj_rate", "max", 12.0, 150.0, h), f("FLT__TRAJ_DEV__band_max", "traj_band", "max", 8.0, 150.0, h), f("FLT__TRAJ_DEV__band_rise_now", "traj_rise", "now", -60.0, 150.0),
        f("FLT__TRAJ_DEV__band_rise_max", "traj_rise", "max", 50.0, 150.0, h), f("CTX__t_now", "t", "now", -60.0, 150.0),
    )
    return Catalogue(CHANNELS, WINDOWS, derived, engineered, FILTERS, ("ref_vib", "ref_lox", "band", "drift"), rate=rate)
