"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into windows of ``WINDOW`` bytes, half overlapping. A window that occurs in a text with at
most e edits shares at least WINDOW + 1 - q - q * e of its q-grams with it, on diagonals (place in the text less
place in the item) within e of each other. So shared q-grams are counted in overlapping diagonal bands of width 2e;
bands that meet the bound are verified by banded alignment. A text that holds a window is contaminated.

A text may quote a part only. So an item's excerpts are looked for too, from every word on: ``WORDS`` words, or
the first ``LONGEST`` bytes of them, with proportionally fewer edits. They tell texts and items of which no window is found.

Texts and items are compared lower-cased, with each run of white space as one space. The items' index is sent to the
tasks in files of the shared folder, each of at most ``BLOCK_BYTES`` of items and loaded in turn; more items mean more searches, not larger tasks.

Edge cases: null and empty texts hold nothing; null and empty items, and items under q bytes, match nothing; an item shorter
than a window is one window with proportionally fewer edits; a word longer than ``LONGEST`` / 4 bytes, as where no spaces are
written, has excerpts from every such piece of it; excerpts under ``SHORTEST`` bytes are lengthened to that; repeated items are told each; repeated rows are judged
each by itself; an empty benchmark leaves all rows; a text is searched whole, however long.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm.textnum import U, spread

Q, WINDOW, EDITS = 8, 128, 12
#: An excerpt's words, and its bytes at most and at least.
WORDS, LONGEST, SHORTEST = 13, 80, 48
BLOCK_BYTES = 8 << 20
#: Bytes of text searched for one block of items, if there are several, before the next is loaded.
ROUND_BYTES = 32 << 20
#: Candidates aligned at a time.
ALIGNED = 2048
#: Bits of the table that tells most places without a q-gram at once.
TABLE = 22
_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def grams(data: bytes) -> np.ndarray:
    """The Q = 8 bytes from each place on, as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.empty(n, U)
    for off in range(min(Q, n)):
        part = np.frombuffer(data, "<u8", (len(data) - off) // Q, off)
        out[off::Q] = part[: len(out[off::Q])]
    return out


def banded(patterns: list[bytes], texts: list[bytes], width: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edits of each pattern with a piece of its text, the piece's end) by alignments within the diagonals 0 to width - 1; edits beyond ``most`` are told as most + 1.

    Row by row of the patterns, over the band's diagonals: column d of row i is the text's place i + d.
    """
    sizes, n = np.fromiter(map(len, patterns), np.int64, len(patterns)), max(map(len, patterns)) + width
    p = np.stack([np.frombuffer(x.ljust(int(sizes.max()), b"\0"), np.uint8) for x in patterns]).astype(np.int16)
    t = np.full((len(texts), n), -1, np.int16)
    for i, x in enumerate(texts):
        t[i, : min(n, len(x))] = np.frombuffer(x[:n], np.uint8)
    edits, ends = most + 1, np.zeros(len(texts), np.int64)
    at, row, ramp = np.arange(len(texts)), np.zeros((len(texts), width), np.int16), np.arange(width, dtype=np.int16)
    for i in range(p.shape[1]):
        there = t[:, i : i + width]
        new = row + (there != p[:, i, None])
        new[there < 0] = 9999  # beyond the text
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        least, last = row.min(1), sizes[at] == i + 1
        got = last & (least <= most[at])
        edits[at[got]], ends[at[got]] = least[got], row[got].argmin(1) + i + 1
        on = ~last & (least <= most[at])
        if not on.all():
            at, row, t, p = at[on], row[on], t[on], p[on]
        if not len(at):
            break
    return edits, ends


def scaled(size: int) -> tuple[int, int]:
    """(edits, least q-grams shared) of a window of so many bytes."""
    edits = EDITS * size // WINDOW
    while edits and size + 1 - Q - Q * edits < 1:
        edits -= 1
    return edits, size + 1 - Q - Q * edits


def excerpts(b: bytes) -> list[tuple[int, int]]:
    """(start, size) of the excerpts of an item, both ends rising."""
    words = [m.span() for m in re.finditer(rb"[^ ]+", b)]
    ends = [e for _, e in words]
    out = []
    for i, (first, end) in enumerate(words):
        for s in range(first, end, LONGEST // 4):
            to = ends[i + WORDS - 1] if i + WORDS <= len(words) else len(b) if len(b) - s >= LONGEST else 0
            if to and s + SHORTEST <= len(b):
                out.append((s, max(min(to - s, LONGEST), SHORTEST)))
    return out


def crowded(keys: np.ndarray, near: int, least: int) -> np.ndarray:
    """Which keys are, with those that are larger or smaller by ``near``, at least ``least``."""
    distinct, of, count = np.unique(keys, return_inverse=True, return_counts=True)
    next_to = np.append(distinct[1:] == distinct[:-1] + near, False)
    after = np.where(next_to, np.append(count[1:], 0), 0)
    before = np.append(0, np.where(next_to[:-1], count[:-1], 0))
    return (count + np.maximum(after, before) >= least)[of]


class Index:
    """q-grams of a block of benchmark items, their windows and, with ``parts``, their excerpts."""

    def __init__(self, items: list[tuple[int, str]], parts: bool = False) -> None:
        self.items = [(k, normal(t).encode("utf-8", "surrogatepass")) for k, t in items if t]
        self.items = [(k, b) for k, b in self.items if len(b) >= Q]
        base, at = [], 0
        windows: list[tuple[int, int, int, int, int]] = []  # item, start, size, edits, bound
        pieces: list[tuple[int, int, int, int, int]] = []
        first_window = []
        for i, (_, b) in enumerate(self.items):
            base.append(at)
            first_window.append(len(windows))
            size = min(WINDOW, len(b))
            starts = sorted({*range(0, len(b) - size + 1, max(1, size // 2)), len(b) - size})
            windows += [(i, s, size, *scaled(size)) for s in starts]
            if parts:
                pieces += [(i, s, n, *scaled(n)) for s, n in excerpts(b)]
            at += len(b) + Q
        self.base = np.array([*base, at], np.int64)
        self.windows = np.array(windows, np.int64).reshape(-1, 5)
        self.pieces = np.array(pieces, np.int64).reshape(-1, 5)
        self.first_window = np.array([*first_window, len(windows)], np.int64)
        joined = b"".join(b + b"\0" * Q for _, b in self.items)
        g = grams(joined)
        inside = np.zeros(len(g), bool)
        for s, (_, b) in zip(base, self.items, strict=True):
            inside[s : s + len(b) - Q + 1] = True
        place = np.flatnonzero(inside)
        order = np.argsort(g[place], kind="stable")
        self.place = place[order]
        self.gram, first = np.unique(g[self.place], return_index=True)
        self.cut = np.append(first, len(place))
        self.item_of = np.repeat(np.arange(len(self.items), dtype=np.int32), np.diff(self.base)) if len(self.items) else np.empty(0, np.int32)
        self.table = np.zeros(1 << TABLE, bool)
        self.table[self.slot(self.gram)] = True
        self.widest = max([1, *(int(w[:, 3].max()) for w in (self.windows, self.pieces) if len(w))])
        #: Least q-grams shared by what matches, and over how many places of the text: by windows, by excerpts.
        self.dense = [(int(w[:, 4].min()), int((w[:, 2] + w[:, 3]).max()) - Q) for w in (self.windows, self.pieces) if len(w)]

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g * U(0x9E3779B97F4A7C15)) >> U(64 - TABLE)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, edits, 1 or for an excerpt 0) of each window found, and of each excerpt if no window is; start and end are bytes of the normalised text."""
        if not len(self.gram):
            return
        plain = [normal(t).encode("utf-8", "surrogatepass") for t in texts]
        data = (b"\0" * Q).join(plain) + b"\0" * Q
        g = grams(data)
        at = np.flatnonzero(self.table[self.slot(g)])
        to = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        ok = self.gram[to] == g[at]
        at, to = at[ok], to[ok]
        # Places from which too few q-grams of the benchmark follow can't begin a window.
        mark = np.zeros(len(at) + 1, np.int64)
        for bound, span in self.dense:
            many = np.searchsorted(at, at + span, "right") - np.arange(len(at))
            dense = np.flatnonzero(many >= bound)
            np.add.at(mark, dense, 1)
            np.add.at(mark, dense + many[dense], -1)
        keep = np.cumsum(mark[:-1]) > 0
        at, to = at[keep], to[keep]
        n = self.cut[to + 1] - self.cut[to]
        if not len(n):
            return
        sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + Q
        stops = np.cumsum(sizes)
        begin = stops - sizes
        total = np.cumsum(n)
        there = self.place[np.arange(int(total[-1])) + np.repeat(self.cut[to] - (total - n), n)]
        here, text, item = np.repeat(at, n), np.repeat(np.searchsorted(stops, at, "right"), n), self.item_of[there]
        # A text and an item can't match whose q-grams are too few in every band of the widest.
        diagonal = here - there + int(self.base[-1])
        keep = crowded((item.astype(np.int64) << 40) + diagonal // self.widest, 1, min(b for b, _ in self.dense))
        here, there, text, item = here[keep], there[keep], text[keep], item[keep]
        done = np.empty(0, np.int64)
        for windows, whole in ((self.windows, 1), (self.pieces, 0)):
            if len(done):  # what windows have told
                keep = ~np.isin(text * len(self.items) + item, done)
                here, there, text, item = here[keep], there[keep], text[keep], item[keep]
            if not len(windows) or not len(here):
                continue
            told = []
            for t, i, s, e, edits in self.verified(windows, self.candidates(windows, here, there, text, item), plain, begin):
                told.append(t * len(self.items) + i)
                yield t, i, s, e, edits, whole
            done = np.append(done, np.array(told, np.int64))

    def candidates(self, windows: np.ndarray, here: np.ndarray, there: np.ndarray, text: np.ndarray, item: np.ndarray) -> np.ndarray:
        """(text, window, first diagonal in the chunk) that share enough q-grams in a band of twice the most edits of these windows; bands overlap by half."""
        width = max(1, int(windows[:, 3].max()))
        start = there - self.base[item]
        diagonal = here - start  # where the item's start would be
        span = int(np.diff(self.base).max())
        out = []
        for half in (0, width):
            # Band by band, its q-grams in order of their place in the item; a window's are counted between two places.
            band = (diagonal + half) // (2 * width)
            order = np.lexsort((start, band, item, text))
            groups = np.stack([text[order], item[order], band[order]])
            first = np.flatnonzero(np.append(True, (groups[:, 1:] != groups[:, :-1]).any(0)))
            size = np.diff(np.append(first, len(order)))
            many = size >= int(windows[:, 4].min())
            first, size = first[many], size[many]
            if not len(first):
                continue
            own = groups[1, first]
            k, _ = spread(*(np.searchsorted(windows[:, 0], own, side) for side in ("left", "right")))
            group = np.repeat(np.arange(len(first)), self.per_item(windows)[own])
            # All groups' places on one axis, so that one search serves all.
            axis = np.repeat(np.arange(len(first)) * span, size) + start[order[spread(first, first + size)[0]]]
            low = np.searchsorted(axis, group * span + windows[k, 1], "left")
            high = np.searchsorted(axis, group * span + windows[k, 1] + windows[k, 2] - Q, "right")
            on = high - low >= windows[k, 4]
            g = first[group[on]]
            out.append(np.stack([groups[0, g], k[on], groups[2, g] * 2 * width - half], 1))
        hits = np.concatenate(out) if out else np.empty((0, 3), np.int64)
        return hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]

    def per_item(self, windows: np.ndarray) -> np.ndarray:
        return np.bincount(windows[:, 0], minlength=len(self.items))

    def verified(self, windows: np.ndarray, hits: np.ndarray, plain: list[bytes], begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the candidates that align."""
        width = 2 * max(1, int(windows[:, 3].max()))
        done: set[tuple[int, int]] = set()
        for part in (hits[x : x + ALIGNED] for x in range(0, len(hits), ALIGNED)):
            told: dict[int, tuple[int, int, int, int, int]] = {}  # by the candidate's number, as the first in order counts
            exact, rest = set(), []
            starts = (part[:, 2] + windows[part[:, 1], 1] - begin[part[:, 0]]).tolist()
            for x, ((t, k, _), (i, s, size, edits, _), low) in enumerate(zip(part.tolist(), windows[part[:, 1]].tolist(), starts, strict=True)):
                if (t, k) in done or (t, k) in exact:
                    continue
                pad = max(0, -low)  # diagonals before the text's start
                lo = low + pad
                region, pattern = plain[t][lo : low + width + size], self.items[i][1][s : s + size]
                if (y := region.find(pattern)) >= 0:
                    exact.add((t, k))
                    told[x] = (t, i, lo + y, lo + y + size, 0)
                elif edits:
                    rest.append((x, t, i, lo, size, edits, pattern, region))
            if rest:
                found, ends = banded([r[6] for r in rest], [r[7] for r in rest], width, np.array([r[5] for r in rest]))
                told |= {x: (t, i, max(0, lo + end - size), lo + end, n) for (x, t, i, lo, size, edits, _, _), n, end in zip(rest, found.tolist(), ends.tolist(), strict=True) if n <= edits}
            for x in sorted(told):
                if (key := tuple(part[x, :2].tolist())) not in done:
                    done.add(key)
                    yield told[x]

    def found(self, texts: list[str]) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> [start, end, edits of the best window or excerpt, windows found (0: excerpts only)]."""
        out: dict[tuple[int, int], list[int]] = {}
        for t, i, s, e, edits, whole in self.search(texts):
            r = out.setdefault((t, i), [s, e, edits, 0])
            r[0], r[1], r[2], r[3] = min(r[0], s), max(r[1], e), min(r[2], edits), r[3] + whole
        return out


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> tuple[list[str], DataFrame | None]:
    """Files in the shared folder with indexes of parts of the benchmark, of at most about ``most`` bytes each, and further ids of repeated items.

    The driver holds one part at a time. Repeated items are indexed once, under their least id; the second result
    (None if there are none) has a row (rep, item_id) for each of their ids.
    """
    spark = benchmark.sparkSession
    common.small_batches(spark)
    src = benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    once = src.groupBy("t").agg(F.min("k").alias("k"), F.count("*").alias("c"))
    size, most_often = once.agg(F.sum(F.octet_length("t")), F.max("c")).first()
    n = max(1, -(-int(size or 0) // most))
    folder, files = common.scratch(spark, "benchmark"), []
    for b in range(n):
        part = once if n == 1 else once.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        index = Index(sorted(((r.k, r.t) for r in part.select("k", "t").toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), parts=True)
        files.append(f"{folder}/{b:06d}")
        common.put_file(files[-1], pickle.dumps(index))
    if (most_often or 1) == 1:
        return files, None
    return files, common.materialize(src.join(once.where("c > 1").withColumnRenamed("k", "rep"), "t").select("rep", F.col("k").alias("item_id")), "benchmark-ids")


@lru_cache(maxsize=1)
def read_index(uri: str) -> Index:
    return pickle.loads(common.get_file(uri))  # noqa: S301  written by this job


def loaded(uri: str) -> Index:
    common.only_cache("benchmark", read_index.cache_clear)
    return read_index(uri)


def rounds(batches: Iterator[pa.RecordBatch], several: bool, text: str) -> Iterator[list[tuple[pa.RecordBatch, int, int]]]:
    """Row ranges to search before the next index is loaded: one, or about ``ROUND_BYTES`` of text if there are several indexes."""
    held, size = [], 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for lo, hi in common.texts(batch, text):
            held.append((batch, lo, hi))
            size += batch.column(at).slice(lo, hi - lo).nbytes
            if not several or size > ROUND_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def hits(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """A row for each contaminated text and item: doc_id, item_id, start, end (bytes of the normalised text), edits, n_windows, share of the item's windows (0 and 0 where only excerpts are found). Narrow but for ids of repeated items."""
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    files, ids = blocks(benchmark, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rounds(batches, len(files) > 1, "text"):
            for uri in files:
                index = loaded(uri)
                total = np.diff(index.first_window)
                for batch, lo, hi in held:
                    rows = batch.slice(lo, hi - lo)
                    docs, got = rows.column(0).to_pylist(), index.found(rows.column(1).to_pylist())
                    if got:
                        v = [(docs[t], index.items[i][0], s, e, d, n, n / int(total[i])) for (t, i), (s, e, d, n) in got.items()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*v, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "start", "end", "edits", "n_windows", "share"])

    out = src.mapInArrow(common.lean(run), "doc_id long, item_id long, start long, end long, edits int, n_windows int, share double")
    if ids is None:
        return out
    more = ids.withColumnRenamed("item_id", "__id").withColumn("__more", F.lit(True))
    both = out.join(more, out.item_id.eqNullSafe(more.rep), "left")
    return both.select("doc_id", F.when(F.col("__more"), F.col("__id")).otherwise(F.col("item_id")).alias("item_id"), *out.columns[2:])


def without(df: DataFrame, benchmark: DataFrame, text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` whose text holds no window or excerpt of the benchmark, with all their columns; narrow.

    Rows with a null or empty text stay; ids play no part, so repeated and null ones are kept; an empty table stays empty.
    """
    at = df.columns.index(text)
    files, ids = blocks(benchmark, most=most)
    common.discard(df.sparkSession, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rounds(batches, len(files) > 1, text):
            left = [batch.slice(lo, hi - lo) for batch, lo, hi in held]
            for uri in files:
                index = loaded(uri)
                for x, rows in enumerate(left):
                    if len(rows):
                        bad = {t for t, _ in index.found([t or "" for t in rows.column(at).to_pylist()])}
                        left[x] = rows.filter(pa.array([i not in bad for i in range(len(rows))])) if bad else rows
            yield from left

    return df.mapInArrow(common.lean(run), df.schema)
