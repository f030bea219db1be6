"""Vectorised word work on Arrow string columns.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 continuation bytes never fall in that
set, so splitting bytes splits characters correctly.  Everything is done on the byte buffer of an
Arrow column with NumPy, a few megabytes at a time, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEED = np.random.default_rng(20240229)
_BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
WINDOW_CODE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


@dataclass
class Texts:
    """A slice of texts: ``data`` are their bytes on end, ``offsets`` where each begins (and the last ends)."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Word ``i`` is ``data[start[i]:end[i]]`` of text ``doc[i]`` in the slice."""

    texts: Texts
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.texts))

    def firsts(self) -> np.ndarray:
        """Index of the first word of each text, and at the end the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of rows of about ``limit`` bytes; a longer text is a slice of its own.  Null is the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def split_words(texts: Texts, lower: bool = False) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(texts, data, none, none, none)
    word = ~IS_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[texts.offsets] = True
    cut = begins[:n].copy()
    cut[1:] |= ~word[:-1]
    start = np.flatnonzero(word & cut)
    cut = begins[1:].copy()
    cut[:-1] |= ~word[1:]
    end = np.flatnonzero(word & cut) + 1
    doc = np.searchsorted(texts.offsets, start, "right") - 1
    return Words(texts, data, start, end, doc)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, by differences of one running polynomial."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    running = np.zeros(n + 1, np.uint64)
    codes = _BYTE_CODE[data]
    codes *= _power("up", _BASE, n)
    np.cumsum(codes, out=running[1:])
    del codes
    h = (running[end] - running[start]) * _power("down", _BASE_INVERSE, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def window_hashes(hashes: np.ndarray, doc: np.ndarray, n: int, places: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words inside one text and the index of each one's first word.

    ``places`` names the positions of the window that count; the others are ignored.
    """
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(m, n, np.uint64)
    for k in range(n) if places is None else places:
        total += hashes[k : k + m] * WINDOW_CODE[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(total[at]), at


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it stands in ``keys`` at least twice."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def seen_before(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an earlier place of ``keys`` has it."""
    order = np.argsort(keys, kind="stable")
    flag = np.zeros(len(keys), bool)
    flag[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return flag


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``n`` that begins at one of ``starts``."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + n, size), -1)
    return np.cumsum(change[:size]) > 0


def ints(column: pa.Array) -> np.ndarray:
    """A column of integers as int64; nulls become the least value."""
    column = column.cast(pa.int64())
    if column.null_count:
        column = column.fill_null(np.iinfo(np.int64).min)
    return column.to_numpy(zero_copy_only=False)
