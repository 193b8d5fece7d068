"""Induced suffix sorting with disk-backed bucket queues.

Suffixes are L (greater than the next) or S (smaller); those of the leftmost S of a run (S*) are sorted first, all others
follow by induction: scanning the sorted ones from the smallest, each suffix tells the place of the L suffix before it,
and from the largest that of the S suffix before it. The scan's frontier is a monotone priority queue of suffix tuples with
a bucket for each first letter; a bucket is written to a file in the shared folder when the queue's memory is full and read when
the scan gets there. The S* suffixes are named by an induction over their substrings; if names repeat, the reduced
string of names is sorted by doubling, which stops when it tells ``depth`` letters apart.
"""

from __future__ import annotations

import uuid

import numpy as np

from quillspan.llm import common


class BucketQueue:
    """Arrays of suffixes by first letter, in order of arrival; beyond ``memory`` bytes the fullest bucket goes to a file of the folder ``spill``, which may be in any store."""

    def __init__(self, letters: int, spill: str, memory: int) -> None:
        self.held: list[list[np.ndarray]] = [[] for _ in range(letters)]
        self.files: dict[int, list[str]] = {}
        self.size, self.memory, self.folder = 0, memory, f"{spill}/{uuid.uuid4().hex}"

    def push(self, letter: int, items: np.ndarray) -> None:
        self.held[letter].append(items)
        self.size += items.nbytes
        if self.size > self.memory:
            self.spill(max(range(len(self.held)), key=lambda c: sum(a.nbytes for a in self.held[c])))

    def spill(self, letter: int) -> None:
        data = np.concatenate(self.held[letter])
        names = self.files.setdefault(letter, [])
        names.append(f"{self.folder}/{letter}-{len(names)}")
        common.put_file(names[-1], data.tobytes())
        self.size -= data.nbytes
        self.held[letter] = []

    def pop(self, letter: int, dtype: type) -> np.ndarray:
        """All items of a letter, in order of arrival."""
        parts = [np.frombuffer(common.get_file(name), dtype) for name in self.files.pop(letter, [])]
        parts += self.held[letter]
        self.size -= sum(a.nbytes for a in self.held[letter])
        self.held[letter] = []
        return np.concatenate(parts) if parts else np.empty(0, dtype)


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one counts as S."""
    n = len(t)
    differ = np.flatnonzero(t[1:] != t[:-1])  # a run's type is that of its end
    out = np.ones(n, bool)
    if len(differ):
        ends = t[differ] < t[differ + 1]
        out[: differ[-1] + 1] = np.repeat(ends, np.diff(differ, prepend=-1))
    return out


def deal(queue: BucketQueue, t: np.ndarray, items: np.ndarray, letters: int) -> None:
    """Push suffixes to the buckets of their first letters, keeping their order."""
    first = t[items]
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(letters + 1))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        queue.push(c, items[order[cuts[c] : cuts[c + 1]]])


def induce(t: np.ndarray, is_s: np.ndarray, stars: np.ndarray, letters: int, spill: str, memory: int) -> np.ndarray:
    """All suffixes sorted, given the S* ones in order."""
    dtype = stars.dtype.type
    cuts = np.searchsorted(t[stars], np.arange(letters + 1))
    queue = BucketQueue(letters, spill, memory)
    last = len(t) - 1
    l_part: list[np.ndarray] = []
    for c in range(letters):
        done, now = [], queue.pop(c, dtype)
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[~is_s[before]]
            same = t[before] == c
            now = before[same]
            if not same.all():
                deal(queue, t, before[~same], letters)
        l_part.append(np.concatenate(done) if done else np.empty(0, dtype))
        s = stars[cuts[c] : cuts[c + 1]]
        before = s[s > 0] - 1
        before = before[~is_s[before]]
        if len(before):
            deal(queue, t, before, letters)
    queue = BucketQueue(letters, spill, memory)
    out: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):
        done, now = [], queue.pop(c, dtype)
        if c == t[last]:
            now = np.append(now, dtype(last))
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[is_s[before]]
            same = t[before] == c
            now = before[same]
            if not same.all():
                deal(queue, t, before[~same], letters)
        big = l_part[c][::-1]
        before = big[big > 0] - 1
        before = before[is_s[before]]
        if len(before):
            deal(queue, t, before, letters)
        out += [*done, big]
    return np.concatenate(out)[::-1]


def suffix_array(t: np.ndarray, letters: int, depth: int, spill: str, memory: int = 64 << 20) -> np.ndarray:
    """Suffixes of ``t`` (small ints below ``letters``; the last one is 0 and the only 0) in order, as far as their first ``depth`` letters tell."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    dtype = np.int32 if n < 1 << 31 else np.int64
    is_s = types(t)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(dtype) + 1
    if len(star) > 1:
        # Induce from S* suffixes in order of their first letter alone: their substrings come out sorted.
        rough = induce(t, is_s, star[np.argsort(t[star], kind="stable")], letters, spill, memory)
        where = np.zeros(n, bool)
        where[star] = True
        star_order = rough[where[rough]]
        index = np.empty(n, dtype)
        index[star] = np.arange(len(star), dtype=dtype)
        length = np.append(np.diff(star), n - star[-1]) + 1  # up to the first letter of the next S*
        a, b = star_order[:-1], star_order[1:]
        size = length[index[a]]
        equal = size == length[index[b]]
        k, open_ = 0, np.flatnonzero(equal)
        while len(open_):
            x, y = a[open_] + k, b[open_] + k
            inside = np.maximum(x, y) < n
            ok = inside & (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)]) & (is_s[np.minimum(x, n - 1)] == is_s[np.minimum(y, n - 1)])
            equal[open_[~ok]] = False
            open_ = open_[ok]
            k += 1
            open_ = open_[size[open_] > k]
        rank = np.empty(len(star), np.int64)
        rank[index[star_order]] = np.cumsum(np.append([0], ~equal))
        step = 1  # names so far tell at least 2 * step letters
        while step <= depth and rank.max() < len(star) - 1:
            ahead = np.append(rank[step:], np.full(min(step, len(star)), -1))[: len(star)]
            key = rank * (len(star) + 1) + ahead + 1
            order = np.argsort(key)
            key = key[order]
            new = np.empty_like(rank)
            new[order] = np.cumsum(np.append([0], key[1:] != key[:-1]))
            rank, step = new, step * 2
        star = star[np.argsort(rank)]
    return induce(t, is_s, star, letters, spill, memory)
