"""Features and calls of runs as their samples come in, with the state that batch operators have in their windows.

A stream's rows are told by the run and a number (sample or tick) that counts up from 0.  Rows that come
out of order within the watermark wait until those before them are there; a number that has not come when
the watermark passes a later one is lost, as a row that a table does not have.  Rows of a number that has
gone by are dropped.  So over however many micro-batches, and over restarts from the checkpoint, a
stream gives the rows that the batch operators give (which see no leading gap filled from what comes later).

Runs are dealt by hash into ``groups``, each of which is a key of the stream: its state is that of its runs, and they go
on side by side in NumPy arrays.  A call costs the same whether it is for one run or for a hundred, so there should be
some hundred runs in a group (:func:`groups_of`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flightline.functions import features
from flightline.operators.decisions import COMMIT, FLIGHT, IGNITION

#: A moment to count event times from where samples have none of their own: a watermark begins at 1970, and what is not after it is late.
EPOCH = 1_000_000_000
#: One binary value: what :class:`InOrder` and the operator remember of each run of a group.
STATE = "held binary"
#: Groups at least, and runs in a group where there are more.
GROUPS, RUNS_IN_A_GROUP = 128, 128


def groups_of(rows: DataFrame, run: str) -> int:
    """Groups for a stream of these runs.  A stream keeps the number with which it began for as long as its checkpoint is gone on from."""
    return max(GROUPS, rows.agg(F.approx_count_distinct(run)).first()[0] // RUNS_IN_A_GROUP)


class InOrder:
    """Rows of one run as a matrix whose first columns are the number and the event time in milliseconds; those whose turn it is leave."""

    def __init__(self, width: int):
        self.next, self.waiting = 0, np.zeros((0, width))

    def take(self, rows: np.ndarray, watermark: float) -> np.ndarray:
        rows = np.concatenate([self.waiting, rows])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        number = rows[:, 0]
        fresh = (number >= self.next) & np.append(True, number[1:] != number[:-1])[: len(rows)]
        rows = rows[fresh]
        ready = int(np.cumprod(rows[:, 0] == self.next + np.arange(len(rows))).sum())
        passed = np.flatnonzero(rows[:, 1] <= watermark)
        ready = max(ready, int(passed[-1]) + 1 if len(passed) else 0)
        if ready:  # and those that go on from there
            ready += int(np.cumprod(np.diff(rows[ready - 1 :, 0]) == 1).sum())
        self.waiting = rows[ready:]
        if ready:
            self.next = int(rows[ready - 1, 0]) + 1
        return rows[:ready]


def ordered_stream(stream: DataFrame, run: str, number: str, time: str, columns: list[str], late: str, output: str, begin: Callable[[], object], step: Callable[[list, list[np.ndarray]], tuple[np.ndarray, pd.DataFrame, list]], groups: int = GROUPS) -> DataFrame:
    """Rows of each ``run`` in the order of ``number``, given in blocks to ``step(memories, blocks)``, which goes on with many runs at once.

    Each run of the call has its memory and its block of rows: the number, the event time and ``columns`` as doubles.  The
    step returns of each output row the place of its run, the rows (without the run), and the new memories.
    """
    width = 2 + len(columns)
    kind = stream.schema[run].dataType

    def go_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str | None, list] = pickle.loads(state.get[0]) if state.exists else {}
        names, came = [np.zeros(0, object)], [np.zeros((0, width))]
        for pdf in batches:
            stamp = pdf[time].astype("datetime64[us]").astype("int64").to_numpy() / 1000
            names.append(pdf["_run"].to_numpy(object))
            came.append(np.column_stack([pdf[number].to_numpy(np.float64), stamp, pdf[columns].to_numpy(np.float64)]))
        codes, own = pd.factorize(np.concatenate(names), use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        rows, ends = np.concatenate(came)[order], np.searchsorted(codes[order], np.arange(len(own) + 1))
        fresh = {None if pd.isna(name) else name: rows[ends[i] : ends[i + 1]] for i, name in enumerate(own)}
        watermark = state.getCurrentWatermarkMs()
        going, blocks = [], []
        for name in [*fresh, *(n for n, (waiting, _) in held.items() if n not in fresh and len(waiting.waiting))]:
            if name not in held:
                held[name] = [InOrder(width), begin()]
            ready = held[name][0].take(fresh.get(name, rows[:0]), watermark)
            if len(ready):
                going.append(name)
                blocks.append(ready)
        out = None
        if going:
            which, out, memories = step([held[name][1] for name in going], blocks)
            for name, memory in zip(going, memories, strict=True):
                held[name][1] = memory
        state.update((pickle.dumps(held, 5),))
        waiting = [o.waiting[:, 1].min() for o, _ in held.values() if len(o.waiting)]
        if waiting:
            state.setTimeoutTimestamp(max(int(watermark) + 1, int(min(waiting)) + 1))
        if out is not None and len(out):
            out.insert(0, "_run", np.array(going, object)[which])
            yield out

    # A run is told by its text: a whole number beside a null would come as a double.
    timed = stream.withWatermark(time, late).select(F.pmod(F.xxhash64(run), F.lit(groups)).alias("_group"), F.col(run).cast("string").alias("_run"), number, time, *columns)
    found = timed.groupBy("_group").applyInPandasWithState(go_on, f"_run string, {output}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("_run").cast(kind).alias(run), *[F.col(c) for c in found.columns if c != "_run"])


def feature_stream(telemetry: DataFrame, catalogue: features.Catalogue, time: str = "ts", tick: int = 25, late: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """``run, tick, t_now`` and the features, at every ``tick``-th sample, of a stream of telemetry with an event time.

    State of a run: the last twenty seconds of samples, the filters' memories, the running summaries.  It is kept by
    ``groups`` of runs.
    """
    made: list[features.Running] = []

    def running() -> features.Running:
        if not made:
            made.append(features.Running(catalogue, tick))
        return made[0]

    channels, references = [c.name for c in catalogue.channels], list(catalogue.references)
    names = [f.name for f in catalogue.features()]

    def step(carries: list, blocks: list[np.ndarray]):
        done = running().advance_all(carries, [(rows[:, 0].astype(np.int64), rows[:, 2], rows[:, 3 : 3 + len(channels)], rows[:, 3 + len(channels) :]) for rows in blocks])
        k, t, found = (np.concatenate([d[n] for d in done]) for n in range(3))
        out = pd.DataFrame(found, columns=names)
        out.insert(0, "t_now", t)
        out.insert(0, "tick", k // tick)
        return np.repeat(np.arange(len(done)), [len(d[0]) for d in done]), out, [d[3] for d in done]

    output = "tick long, t_now double, " + ", ".join(f"{n} double" for n in names)
    return ordered_stream(telemetry, "run", "k", time, ["t", *channels, *references], late, output, lambda: running().start(), step, groups)


def call_stream(scores: DataFrame, modes: dict[str, float], exclusive: list[list[str]], critical: list[str], warning: list[str], run: str = "run", number: str = "tick", at: str = "t", time: str = "ts", late: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """``run, tick, t, held, active, latched, call, changed`` of a stream with a column of scores for each of ``modes`` (name: threshold).

    ``held``, ``active`` and ``latched`` are arrays in the order of the modes.  Of each ``exclusive`` group
    only the mode with the greatest held score is active, ties to the first.  State of a run: the scores
    before, what is latched, and the last call.
    """
    names, thresholds = list(modes), np.array(list(modes.values()))
    rivals = [[names.index(m) for m in sorted(group)] for group in exclusive]
    grave, warned = (np.isin(names, own) for own in (critical, warning))

    def calls_of(t: np.ndarray, on: np.ndarray) -> np.ndarray:
        some = on.any(axis=1)
        start = np.where(some, "ABORT", np.where(t >= COMMIT, "COMMIT", "ENGINE_START"))
        flight = np.where((on & grave).any(axis=1), "CRITICAL", np.where((on & warned).any(axis=1), "WARNING", np.where(some, "ADVISORY", "NOMINAL")))
        return np.where(t < IGNITION, np.where(some, "HOLD", "GO"), np.where(t < FLIGHT, start, flight)).astype(object)

    def begin():
        return np.zeros(len(names)), np.zeros(len(names), bool), None

    def step(memories: list, blocks: list[np.ndarray]):
        rows, lengths = np.concatenate(blocks), np.array([len(b) for b in blocks])
        which, ends = np.repeat(np.arange(len(blocks)), lengths), np.cumsum(lengths)
        begins = ends - lengths
        p = rows[:, 3:]
        past = np.concatenate([p[:1], p[:-1]])
        past[begins] = [before for before, _, _ in memories]
        held = np.fmin(p, past)
        active = held >= thresholds
        for group in rivals:
            rank = np.where(active[:, group], held[:, group], -1.0)
            best, every = np.array(group)[rank.argmax(axis=1)], np.arange(len(rows))
            keep = np.zeros(active.shape, bool)
            keep[every, best] = active[every, best]
            active[:, group] = keep[:, group]
        # On from a sample at which it is active, or from before: active samples of the run so far, counted through all runs.
        seen = np.cumsum(active, axis=0)
        latched = (seen - (seen - active)[begins][which] > 0) | np.array([on for _, on, _ in memories])[which]
        calls = calls_of(rows[:, 2], latched)
        earlier = np.concatenate([calls[:1], calls[:-1]])
        earlier[begins] = [last for _, _, last in memories]
        out = pd.DataFrame({number: rows[:, 0].astype(np.int64), at: rows[:, 2], **{f"_{what}_{m}": v[:, m] for what, v in (("held", held), ("active", active), ("latched", latched)) for m in range(len(names))}, "call": calls, "changed": calls != earlier})
        return which, out, [(p[e - 1].copy(), latched[e - 1].copy(), calls[e - 1]) for e in ends]

    # Arrays are made of plain columns behind the state: a row of them would be three objects in Python.
    each = [(what, kind, [f"_{what}_{m}" for m in range(len(names))]) for what, kind in (("held", "double"), ("active", "boolean"), ("latched", "boolean"))]
    output = f"`{number}` long, `{at}` double, {', '.join(f'{c} {kind}' for _, kind, columns in each for c in columns)}, call string, changed boolean"
    found = ordered_stream(scores, run, number, time, [at, *names], late, output, begin, step, groups)
    return found.select(run, number, at, *[F.array(*columns).alias(what) for what, _, columns in each], "call", "changed")
