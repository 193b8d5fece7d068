"""Words of many texts as rows of a table that is filled once for each distinct word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quillspan.llm import common
from quillspan.llm.textnum import span_hashes
from quillspan.llm.token_store import LETTER, code_classes


class WordTable:
    """Rows (of ``width`` floats) of words, by hash; ``fill`` makes them of strings. Starts anew beyond ``limit`` words."""

    def __init__(self, fill: Callable[[list[str]], np.ndarray], width: int, limit: int = 1_000_000) -> None:
        self.fill, self.width, self.limit = fill, width, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.rows = np.empty((0, self.width), np.float32)
        self.used = 0

    def look(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rows of the words ``joined[start:end]``."""
        if not len(starts):
            return np.empty((0, self.width), np.float32)
        distinct, where, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self.clear()
        to = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[to] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            lo, hi = starts[where[new]].tolist(), ends[where[new]].tolist()
            made = self.fill([joined[a:b] for a, b in zip(lo, hi, strict=True)])
            if self.used + len(made) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.empty((max(len(made), len(self.rows), 65_536), self.width), np.float32)])
            self.rows[self.used : self.used + len(made)] = made
            put = np.searchsorted(self.keys, distinct[new])
            self.at = np.insert(self.at, put, np.arange(self.used, self.used + len(made)))
            self.keys = np.insert(self.keys, put, distinct[new])
            self.used += len(made)
        return self.rows[self.at[np.searchsorted(self.keys, distinct)]][inverse]


_KEPT: dict[str, WordTable] = {}


def kept_table(model: str, fill: Callable[[list[str]], np.ndarray], width: int) -> WordTable:
    """The table of a model in this process: tasks of one worker go on with what earlier ones filled. One model's at a time."""
    common.only_cache("words", _KEPT.clear)
    if model not in _KEPT:
        _KEPT.clear()
        _KEPT[model] = WordTable(fill, width)
    _KEPT[model].fill = fill
    return _KEPT[model]


def points_of(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def letters(points: np.ndarray) -> np.ndarray:
    return code_classes()[points] == LETTER
