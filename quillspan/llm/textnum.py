"""Vectorised hashing of words and word shingles over many texts at once (numpy, no loop over words).

A word's hash is the sum, modulo 2**64, of a pseudo-random number for each (place in the word, letter), taken from one
running sum over the whole chunk, then mixed with its length. The numbers have no structure that words could exploit (as a polynomial
modulo 2**64 has), so two different words or shingles share a hash with a chance of about 2**-64; where that must not
be trusted, :func:`same_spans` compares the words themselves.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place of an own array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all spans' values, one span after the other, and where each span begins in them."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes), first


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span; values are code points or bytes, spans aren't empty and rise."""
    if not len(starts):
        return np.empty(0, U)
    at, first = spread(starts, ends)
    sizes = ends - starts
    keys = (at - np.repeat(starts, sizes)).astype(U)
    keys <<= U(21)
    keys |= values[at].astype(U)
    keys *= U(BASE)
    keys += U(0xD1B54A32D192ED03)
    h = np.add.reduceat(mix(keys), first)
    h ^= sizes.astype(U) * U(0xD6E8FEB86659FD93)
    return mix(h)


def same_spans(a: np.ndarray, starts: np.ndarray, sizes: np.ndarray, b: np.ndarray, others: np.ndarray) -> bool:
    """Whether ``a[start : start + size]`` equals ``b[other : other + size]`` for all spans."""
    at, _ = spread(starts, starts + sizes)
    return bool((a[at] == b[at + np.repeat(others - starts, sizes)]).all())


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each; A-Z count as a-z, words end at \\x20 and \\x09-\\x0D."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edge = np.empty(len(data) + 1, bool)
    gap = SPACE[data]
    edge[1:-1] = gap[1:] != gap[:-1]
    edge[0] = not gap[0] if len(data) else False
    edge[-1] = False
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]  # the last byte is a gap
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.searchsorted(starts, np.cumsum(sizes))
    return span_hashes(LOWER[data], starts, ends), np.diff(stops, prepend=0)


def shingles_of(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; one of all its words if it has 1 to k-1, none without words."""
    out: list[np.ndarray] = []
    if len(hashes) >= k:
        n = len(hashes) - k + 1
        s = hashes[:n].copy()
        for j in range(1, k):
            s *= U(BASE)
            s += hashes[j : n + j]
        s = mix(s)
    at = 0
    for c in counts.tolist():
        if c >= k:
            x = np.sort(s[at : at + c - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif c:
            y = U(c)
            with np.errstate(over="ignore"):
                for w in hashes[at : at + c]:
                    y = y * U(BASE) + w
            out.append(mix(np.array([y], U)))
        else:
            out.append(np.empty(0, U))
        at += c
    return out


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    return shingles_of(*words_of(texts), k)
