"""Butterworth filters of order 2 along a series, as two biquads, by a scan over blocks of time.

A recurrence over all earlier samples is no window function, but it is linear: what a block of samples
leaves in the filter is a matrix times what it found there, plus what its own samples alone would leave.
One pass gives the second part for every block, a prefix over blocks (a few numbers each) gives every
block its initial state, and a second pass filters.  So one long series is as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def butterworth(rate: float, low: float | None = None, high: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections ``(b, a)`` of a high-pass (``low`` only) or band-pass filter made from the 2nd-order prototype.

    The analog prototype's poles are moved to the pre-warped edges and mapped by the bilinear transform.
    """
    poles = np.exp(1j * np.pi * np.array([3, 5]) / 4)
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if high is None:
        if low is None:
            raise ValueError("an edge is needed")
        s_poles, s_zeros = warp(low) / poles, np.zeros(2)
    else:
        w0, width = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = poles * width / 2
        root = np.sqrt(half**2 - w0**2)
        s_poles, s_zeros = np.concatenate([half + root, half - root]), np.zeros(2)
    z_poles = (2 * rate + s_poles) / (2 * rate - s_poles)
    z_zeros = np.concatenate([(2 * rate + s_zeros) / (2 * rate - s_zeros), -np.ones(len(s_poles) - len(s_zeros))])
    upper = z_poles[z_poles.imag > 0]
    zeros = sorted(z_zeros.real)
    sections = []
    for k, p in enumerate(upper):
        own = [zeros[k], zeros[-1 - k]] if len(upper) > 1 else zeros
        sections.append((np.real(np.poly(own)), np.real(np.poly([p, np.conj(p)]))))
    # Unit gain in the middle of the band (at the top for a high-pass).
    at = np.exp(1j * np.pi) if high is None else np.exp(2j * np.arctan(np.sqrt(warp(low) * warp(high)) / (2 * rate)))
    gain = abs(np.prod([np.polyval(b, at) / np.polyval(a, at) for b, a in sections]))
    sections[0] = (sections[0][0] / gain, sections[0][1])
    return sections


def gain_at(sections: list[tuple[np.ndarray, np.ndarray]], frequency: float, rate: float) -> float:
    z = np.exp(2j * np.pi * frequency / rate)
    return float(abs(np.prod([np.polyval(b, z) / np.polyval(a, z) for b, a in sections])))


#: Samples that a section handles by one matrix product.
BLOCK = 64


def _block(b: np.ndarray, a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A biquad over ``n`` samples as matrices: outputs from inputs and from the state, the next state from inputs and from the state."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    gain = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(n):
        powers.append(powers[-1] @ step)
    response = np.array([b[0], *(powers[k][0] @ gain for k in range(n - 1))])
    lag = np.subtract.outer(np.arange(n), np.arange(n))
    outputs = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    return outputs, np.stack([powers[k][0] for k in range(n)]), np.stack([powers[n - 1 - k] @ gain for k in range(n)], axis=1), powers[n]


Sections = list[tuple[np.ndarray, np.ndarray]]


def run_on(sections: Sections, x: np.ndarray, state: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Filter ``x`` (samples, columns) from ``state`` (sections, 2, columns): outputs and the state after them.

    Whole blocks of samples are matrix products, so what is left to a loop is one step a block, over
    all columns at once.
    """
    n, columns = x.shape
    state, y = state.copy(), x
    for number, (b, a) in enumerate(sections):
        done, out = 0, np.empty((n, columns))
        while done < n:
            size = min(block, n - done)
            outputs, from_state, inward, carried = _matrices(b, a, size)
            part, held = y[done : done + size], state[number]
            out[done : done + size] = outputs @ part + from_state @ held
            state[number] = inward @ part + carried @ held
            done += size
        y = out
    return y, state


_known: dict[tuple, tuple] = {}


def _matrices(b: np.ndarray, a: np.ndarray, n: int) -> tuple:
    key = (*b.tolist(), *a.tolist(), n)
    if key not in _known:
        if len(_known) > 4096:
            _known.clear()
        _known[key] = _block(b, a, n)
    return _known[key]


def at_rest(sections: Sections, columns: int = 1) -> np.ndarray:
    return np.zeros((len(sections), 2, columns))


def run_sections(sections: Sections, x: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Filter the columns of ``x`` from rest, starting each at its first sample."""
    return run_on(sections, x - x[:1], at_rest(sections, x.shape[1]), block)[0]


def transfer(sections: Sections, n: int) -> np.ndarray:
    """What ``n`` samples of nothing make of a state, as a matrix over the states of all sections on end."""
    size = 2 * len(sections)
    step = np.zeros((size, size))
    reaching = np.zeros(size)  # the input of a section, from the states of those before it
    for k, (b, a) in enumerate(sections):
        own = slice(2 * k, 2 * k + 2)
        inward = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        step[own] = np.outer(inward, reaching)
        step[own, own] += np.array([[-a[1], 1.0], [-a[2], 0.0]])
        reaching = b[0] * reaching
        reaching[2 * k] += 1.0
    return np.linalg.matrix_power(step, n)


def runs_of(columns: list[pa.Array]) -> list[tuple[int, int]]:
    """Stretches of rows whose values in all ``columns`` are equal."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        if isinstance(c, pa.DictionaryArray):
            c = c.cast(c.type.value_type)
        differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        both_null = np.logical_and(*(pc.is_null(x).to_numpy(zero_copy_only=False) for x in (c[1:], c[:-1])))
        new[1:] |= differs & ~both_null
    start = np.flatnonzero(new)
    return list(zip(start.tolist(), np.append(start[1:], n).tolist(), strict=True))


def filtered_bands(df: DataFrame, entity: str, order: list[str], bands: list[tuple[str, str, float, float | None]], rate: float, block: Column | None = None) -> DataFrame:
    """Add a column for each band ``(name, column, low, high)``; missing samples must have been filled.

    ``block`` cuts an entity's series into stretches of time that are filtered in parallel; it must not
    fall as ``order`` rises (such as ``floor(k / 4096)``).  Without it an entity is one stretch.
    """
    made = [(name, column, butterworth(rate, low, high)) for name, column, low, high in bands]
    inputs = [column for _, column, _ in made]
    cut = df.withColumn("_block", F.lit(0).cast("long") if block is None else block.cast("long"))
    placed = cut.repartition(entity, "_block").sortWithinPartitions(entity, "_block", *order)
    entity_type = df.schema[entity].dataType

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block: samples, first sample of each band's column, and the states that the samples, and ones in their place, leave."""
        key, held = None, None

        def row():
            n, first, states = held
            flat = np.concatenate([s[:, :, c].ravel() for s in states for c in range(2)])
            return pa.RecordBatch.from_arrays([pa.array([key[0]], _arrow(entity_type)), pa.array([key[1]]), pa.array([n]), pa.array([first.tolist()]), pa.array([flat.tolist()])], ["entity", "block", "n", "first", "states"])

        for batch in batches:
            for a, b in runs_of([batch.column(0), batch.column(1)]):
                now = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                x = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False)[a:b] for k in range(len(inputs))], axis=1).astype(np.float64)
                if now != key:
                    if key is not None:
                        yield row()
                    key, held = now, (0, x[0].copy(), [at_rest(s, 2) for _, _, s in made])
                n, first, states = held
                # The samples and a column of ones side by side.
                held = n + len(x), first, [run_on(s, np.stack([x[:, k], np.ones(len(x))], axis=1), state)[1] for k, ((_, _, s), state) in enumerate(zip(made, states, strict=True))]
        if key is not None:
            yield row()

    kind = T.StructType([T.StructField("entity", entity_type)]).simpleString()[len("struct<entity:") : -1]
    ends = placed.select(entity, "_block", *inputs).mapInArrow(left, f"entity {kind}, block long, n long, first array<double>, states array<double>")

    def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state in which each block of an entity begins: one row a block."""
        pdf = pdf.sort_values("block")
        first = np.asarray(pdf["first"].iloc[0])
        begin = [np.zeros(2 * len(s)) for _, _, s in made]
        out = []
        for n, states in zip(pdf["n"], pdf["states"], strict=True):
            out.append(np.concatenate(begin).tolist())
            at = 0
            for k, (_, _, s) in enumerate(made):
                size = 2 * len(s)
                own, ones = np.asarray(states[at : at + size]), np.asarray(states[at + size : at + 2 * size])
                begin[k] = transfer(s, n) @ begin[k] + own - first[k] * ones
                at += 2 * size
        return pd.DataFrame({"_entity": pdf["entity"], "_at": pdf["block"], "_first": [first.tolist()] * len(pdf), "_begin": out})

    begins = ends.groupBy("entity").applyInPandas(prefix, f"_entity {kind}, _at long, _first array<double>, _begin array<double>")
    known = cut.join(begins, cut[entity].eqNullSafe(begins["_entity"]) & (cut["_block"] == begins["_at"])).drop("_entity", "_at")
    ready = known.repartition(entity, "_block").sortWithinPartitions(entity, "_block", *order)
    names = df.columns
    where = [names.index(column) for column in inputs]
    own = names.index(entity)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            made_here = np.empty((batch.num_rows, len(made)))
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in set(where)}
            for a, b in runs_of([batch.column(own), batch.column(len(names))]):
                now = (batch.column(own)[a].as_py(), batch.column(len(names))[a].as_py())
                if now != key:
                    key, begin, at, states = now, np.asarray(batch.column(len(names) + 2)[a].as_py()), 0, []
                    first = batch.column(len(names) + 1)[a].as_py()
                    for _, _, s in made:
                        states.append(begin[at : at + 2 * len(s)].reshape(len(s), 2, 1))
                        at += 2 * len(s)
                for k, (_, _, s) in enumerate(made):
                    y, states[k] = run_on(s, columns[where[k]][a:b, None] - first[k], states[k])
                    made_here[a:b, k] = y[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(made_here[:, k]) for k in range(len(made)))], [*names, *(name for name, _, _ in made)])

    return ready.select(*names, "_block", "_first", "_begin").mapInArrow(outputs, T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name, _, _ in made)]))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def filtered(df: DataFrame, entity: str, order: list[str], columns: list[str], rate: float, low: float | None = None, high: float | None = None, block: Column | None = None) -> DataFrame:
    """Add ``<column>_filtered`` for each column; missing samples must have been filled."""
    return filtered_bands(df, entity, order, [(f"{c}_filtered", c, low, high) for c in columns], rate, block)
