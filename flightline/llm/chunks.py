"""Tables that remember a value list for each distinct piece of text, inside a Python worker.

Tokenizers spend most of their time on pieces seen before.  A table maps the 64-bit hash of a piece
to a run of small integers (its token ids, or its prefix counts), so a slice of texts costs one sort
of its piece hashes and a gather; only new pieces are computed.  A table is emptied once it holds
``LIMIT`` pieces or ``VALUES`` integers (long pieces have many), which bounds a worker's memory;
that changes time, never results.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

LIMIT = 1_000_000
VALUES = 8_000_000


class PieceTable:
    """``compute`` gives, for a list of new pieces (bytes), one sequence of integers each."""

    def __init__(self, compute: Callable[[list[bytes]], list], dtype):
        self.compute = compute
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.values = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        runs = self.compute(pieces)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter(chain.from_iterable(runs), self.dtype, int(sizes.sum()))
        if self.used + len(flat) > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(max(len(flat), len(self.values)), self.dtype)])
        self.values[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        into = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, into, keys)
        self.at = np.insert(self.at, into, at)
        self.size = np.insert(self.size, into, sizes)

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length, in ``values``, of the run of each piece ``data[start:end]``."""
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > LIMIT or self.used > VALUES:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        if not known.all():
            fresh = np.flatnonzero(~known)
            raw = data.tobytes()
            self._add(distinct[fresh], [raw[s:e] for s, e in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, distinct)
        return self.at[place][which], self.size[place][which]

    def gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The runs on end."""
        total = int(size.sum())
        first = np.cumsum(size) - size
        return self.values[np.repeat(at - first, size) + np.arange(total)]
