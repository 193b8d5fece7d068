"""Token-ID / binary output: directly addressable codes.

A shard file holds the token ids of consecutive documents. Each id is cut into chunks of 8 bits;
level 0 has the low chunk of every id, level k the next chunk of the ids that need more than
k chunks. A bitmap for each level tells which ids go on to the next one, with a directory of
ranks every ``BLOCK`` bits. Token i is found by one rank a level, without decoding a block.

Layout (little-endian): magic ``DAC1``; uint32 levels, documents; uint64 tokens; documents x
int64 keys; (documents + 1) x uint64 first tokens; then for each level uint64 n, n bytes of
chunks, and but for the last level ceil(n / 8) bytes of bitmap and ceil(n / BLOCK) + 1 uint32 ranks.

Edge cases: a null or empty text gives just the end id; equal keys are kept as they come, ordered
by text; a null key sorts first and is written as -2**63; an empty table writes no shard and gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm.textnum import same_spans, span_hashes

BLOCK = 512
NULL_KEY = -(1 << 63)


def dac_encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Levels of (chunks, bitmap, ranks) for unsigned ids; the last level has no bitmap."""
    rest, levels = ids.astype(np.uint32, copy=False), []
    while True:
        low = (rest & 0xFF).astype(np.uint8)
        more = rest > 0xFF
        if not more.any():
            levels.append((low, None, None))
            return levels
        bits = np.packbits(more, bitorder="little")
        per = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.int64)
        levels.append((low, bits, np.concatenate(([0], np.cumsum(per))).astype(np.uint32)))
        rest = rest[more] >> 8


class Shard:
    """A shard's codes, with random access and whole decoding."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"DAC1":
            raise ValueError("not a shard of directly addressable codes")
        n_levels, docs = np.frombuffer(data, "<u4", 2, 4).tolist()
        self.size = int(np.frombuffer(data, "<u8", 1, 12)[0])
        at = 20
        self.keys = np.frombuffer(data, "<i8", docs, at)
        self.first = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.levels = []
        for k in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            low = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k < n_levels - 1:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", -(-n // BLOCK) + 1, at)
                at += 4 * len(ranks)
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def token(self, i: int) -> int:
        """Token i: one chunk and one rank a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(ranks[block]) + int(inside.sum()), shift + 8
        return value

    def tokens(self) -> np.ndarray:
        """All ids, as uint32."""
        out = np.zeros(self.size, np.uint32)
        at = None
        for k, (low, bits, _) in enumerate(self.levels):
            if at is None:
                out |= low
            else:
                out[at] |= low.astype(np.uint32) << np.uint32(8 * k)
            if bits is not None:
                more = np.unpackbits(bits, count=len(low), bitorder="little").view(bool)
                at = np.flatnonzero(more) if at is None else at[more]
        return out

    def document(self, j: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(int(self.first[j]), int(self.first[j + 1]))], np.uint32)


def shard_bytes(keys: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
    levels = dac_encode(ids)
    parts = [b"DAC1", np.array([len(levels), len(keys)], "<u4").tobytes(), np.array([len(ids)], "<u8").tobytes(), np.array(keys, "<i8").tobytes(), np.concatenate(([0], np.cumsum(sizes))).astype("<u8").tobytes()]
    for low, bits, ranks in levels:
        parts += [np.array([len(low)], "<u8").tobytes(), low.tobytes()]
        if bits is not None:
            parts += [bits.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(parts)


# --- encoding -------------------------------------------------------------------------------

#: Classes of code points in the pre-tokenizer's pattern.
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: Suffixes that the pattern takes by themselves after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    import regex

    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[[ord(c) for c in m[0]]] = kind
    return kinds


def pretokens(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces into which the byte-level pattern cuts texts.

    ``points``: code points of all texts; ``first``: where a text starts. The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(points)
    kind = code_classes()[points]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    cut = head[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # A run of blanks before something else gives up its last one; a space joins what follows.
    blank = kind == BLANK
    before = np.flatnonzero(blank[:-1] & ~blank[1:] & ~head[1:n]) if n > 1 else np.empty(0, np.int64)
    cut[before] = True
    cut[before[points[before] == 32] + 1] = False
    mark = np.flatnonzero(cut & (points == 39))
    for q in mark[mark + 1 < n].tolist():  # only apostrophes that start a piece
        for s in SUFFIXES:
            e = q + 1 + len(s)
            if e <= n and not head[q + 1 : e].any() and all(points[q + 1 + j] == ord(c) for j, c in enumerate(s)):
                cut[q + 1] = False
                if e < n:
                    cut[e] |= kind[e] != BLANK and not (e > 0 and points[e - 1] == 32)
                break
    return np.flatnonzero(cut)


def cuts_alike(tokenizer: str) -> bool:
    """Whether a tokenizer (as JSON) cuts texts as :func:`pretokens` does, and changes nothing before or after."""
    d = json.loads(tokenizer)
    cut = d.get("pre_tokenizer") or {}
    whole = {k: cut.get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    return whole and d.get("normalizer") is None and not d.get("truncation") and not d.get("padding") and not (d["model"].get("dropout") or 0)


class Encoder:
    """Encodes texts by the tokenizer, each distinct piece once: pieces never share a token, so their ids can be kept and joined.

    Pieces are found by their hash and then compared letter by letter; should two share a hash, or the tokenizer cut
    otherwise, texts are encoded one by one.
    """

    #: Pieces kept, and their letters and ids; beyond it the store starts anew.
    LIMIT, LETTERS = 1_200_000, 30_000_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = cuts_alike(self.tokenizer.to_str())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)
        self.letters, self.letter_at, self.letter_n = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces; those of a space and a letter are encoded joined, as each starts a piece of its own."""
        ids: list[np.ndarray | None] = [None] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and p[1:].isalpha()]
        for lo in range(0, len(joined), 20_000):
            part = joined[lo : lo + 20_000]
            e = self.tokenizer.encode("".join([pieces[i] for i in part]), add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.array(e.word_ids))) + 1
            split = np.split(np.array(e.ids, np.uint32), cuts)
            if len(split) == len(part):
                for i, x in zip(part, split, strict=True):
                    ids[i] = x
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = np.array(self.plain(pieces[i]), np.uint32)
        if len(self.keys) + len(keys) > self.LIMIT:
            self.clear()
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.cumsum(n) - n + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        to = np.searchsorted(self.keys, keys)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(sizes) - sizes + len(self.letters)
        self.letters = np.append(self.letters, np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32))
        self.letter_at, self.letter_n = np.insert(self.letter_at, to, begin), np.insert(self.letter_n, to, sizes)
        self.at, self.n, self.keys = np.insert(self.at, to, at), np.insert(self.n, to, n), np.insert(self.keys, to, keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return to, (self.keys[to] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and the number of ids of each text."""
        odd = {i: self.plain(t) for i, t in enumerate(texts) if not self.by_piece or any(s in t for s in self.special)}
        use = [t if i not in odd else "" for i, t in enumerate(texts)]
        joined = "".join(use)
        if not joined:
            flat, per = np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        else:
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = np.fromiter(map(len, use), np.int64, len(use))
            first = np.cumsum(sizes) - sizes
            starts = pretokens(points, first[sizes > 0])
            ends = np.append(starts[1:], len(points))
            hashes = span_hashes(points, starts, ends)
            distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            _, known = self.find(distinct)
            if not known.all():
                if len(self.keys) + int((~known).sum()) > self.LIMIT or len(self.flat) + len(self.letters) > self.LETTERS:
                    self.clear()
                    known[:] = False
                new = np.flatnonzero(~known)
                lo, hi = starts[where[new]].tolist(), ends[where[new]].tolist()
                self.learn(distinct[new], [joined[a:b] for a, b in zip(lo, hi, strict=True)])
            to, known = self.find(distinct)
            sizes_of = ends - starts
            if not (known.all() and (sizes_of == sizes_of[where][inverse]).all() and (self.letter_n[to] == sizes_of[where]).all()
                    and same_spans(points, starts, sizes_of, points, starts[where][inverse]) and same_spans(self.letters, self.letter_at[to].astype(np.int64), self.letter_n[to].astype(np.int64), points, starts[where])):
                each = [np.array(self.plain(t), np.uint32) for t in texts]  # two pieces share a hash
                return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            n, at = self.n[to][inverse].astype(np.int64), self.at[to][inverse].astype(np.int64)
            total = np.cumsum(n)
            flat = self.flat[np.arange(int(total[-1])) + np.repeat(at - (total - n), n)]
            piece = np.searchsorted(starts, first + sizes)
            upto = np.concatenate(([0], total))[piece]
            per = np.diff(upto, prepend=0)
        if odd:
            parts = np.split(flat, np.cumsum(per)[:-1])
            parts = [np.array(odd[i], np.uint32) if i in odd else p for i, p in enumerate(parts)]
            flat, per = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, per


@lru_cache(maxsize=1)
def loaded(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    common.only_cache("pieces", loaded.cache_clear)
    return loaded(path)


# --- operators ------------------------------------------------------------------------------

FILES = "shard long, uri string, n_docs long, n_tokens long"


def write_shards(df: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_bytes_target: int = 16 << 20) -> DataFrame:
    """Write the token ids of ``df`` under ``out`` in ascending order of the key; returns a row for each file.

    Texts are dealt once, to ranges of keys of about ``shard_bytes_target`` bytes; each task
    sorts its range, encodes it and writes files of about that many bytes. Files are named by
    range and part, so that a repeated task writes the same.
    """
    keyed = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged, _, n = common.range_buckets(keyed, "key", "text", shard_bytes_target)
    placed = (ranged.repartitionById(n, "_bucket") if n > 1 else ranged.coalesce(1)).sortWithinPartitions("key", "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, enc, part = TaskContext.get().partitionId(), encoder(tokenizer), 0
        keys: list[int] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            uri = f"{out}/shard-{own:07d}-{part:04d}.dac"
            common.put_file(uri, shard_bytes(keys, sizes, ids))
            return pa.RecordBatch.from_pydict({"shard": pa.array([own << 24 | part], pa.int64()), "uri": [uri], "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})

        for batch in batches:
            for lo, hi in common.texts(batch, limit=common.CHUNK_BYTES // 2):
                rows = batch.slice(lo, hi - lo)
                flat, per = enc.encode(rows.column(1).to_pylist())
                flat = np.insert(flat, np.cumsum(per), end_id)
                keys += [NULL_KEY if k is None else k for k in rows.column(0).to_pylist()]
                sizes += (per + 1).tolist()
                held.append(flat)
                if sum(map(len, held)) * 2 > shard_bytes_target:
                    yield flush()
                    keys, sizes, held, part = [], [], [], part + 1
        if keys:
            yield flush()

    return placed.mapInArrow(common.lean(run), FILES)


def read_shards(files: DataFrame) -> DataFrame:
    """A row per document from the files: key, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    ``files`` is a materialised result of :func:`write_shards`. Only the count of tokens of each
    file is added up on the driver.
    """
    spark = files.sparkSession
    before, total = [], 0
    for r in files.orderBy("shard").select("shard", "uri", "n_tokens").toLocalIterator():
        before.append((r.shard, r.uri, total))
        total += r.n_tokens
    work = spark.createDataFrame(before, "shard long, uri string, before long")
    work = work.repartition(max(1, min(len(before), 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = Shard(common.get_file(r["uri"]))
                data, cut = s.tokens().astype("<u4").tobytes(), (4 * s.first).tolist()
                sums = [zlib.crc32(memoryview(data)[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"key": pa.array([None if k == NULL_KEY else k for k in s.keys.tolist()], pa.int64()), "start": s.first[:-1] + r["before"], "n_tokens": np.diff(s.first), "ids_crc32": pa.array(sums, pa.int64()), "shard": pa.array([r["shard"]] * len(sums), pa.int64())})

    return work.mapInArrow(common.lean(run), "key long, start long, n_tokens long, ids_crc32 long, shard long")


def encode_corpus(df: DataFrame, tokenizer: str, out: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write the corpus as shards, then read all of them back."""
    out = out or common.scratch(df.sparkSession, "tokens")
    files = common.materialize(write_shards(df, out, tokenizer, key, text, end_id), "token-files")
    return read_shards(files)
