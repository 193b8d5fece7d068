"""Suffix-array dedup: bytes of strings of ``MATCH`` bytes that also start in a document with a smaller id are removed.

1. Every string of MATCH bytes has an anchor: the least hash of its GRAM-byte pieces. Equal strings have equal anchors, so
   only strings whose anchor occurs in two documents can repeat. Anchors go to buckets, 7 bytes each, once a task's
   chunk; a bucket keeps those of several documents in a Bloom filter of bounded size, a file in the shared folder.
2. Neighbouring strings with one anchor make a snippet. Snippets with a shared anchor go to shards by their anchor; equal ones
   of a chunk travel once, with their places. An anchor at over ``HOT`` places (a line of most documents, each time in other
   surroundings) would fill its shard; its snippets are cut into their strings, which go to shards by their own hash.
3. A shard sorts the suffixes of its distinct snippets by external induced sorting (``suffix_sort``), compares neighbours over MATCH bytes,
   and so finds for each string its smallest document; places in larger documents are removed.
4. The places come together by document, with the texts of documents that have any.

Edge cases: a null text counts as empty; texts under MATCH bytes stay whole; rows with equal ids don't remove
each other's bytes; a null id counts as larger than all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm.decontaminate import grams
from quillspan.llm.suffix_sort import suffix_array
from quillspan.llm.textnum import U, mix

MATCH, GRAM = 50, 24
#: Strings of one snippet at most.
LONGEST = 4096
#: Bytes of all anchors' filters together at most; beyond it they let more pass.
FILTER_BYTES = 64 << 20
#: Places of an anchor beyond which its snippets are cut into strings: a shard would get over about 50 MB of them.
HOT = 1 << 19
NO_ID = (1 << 63) - 1


def anchors(data: bytes) -> np.ndarray:
    """The anchor of the string of MATCH bytes from each place on."""
    g = grams(data)
    n = len(data) - GRAM + 1
    h = mix(g[:n] * U(0x9E3779B97F4A7C15) + g[8 : n + 8] * U(0xC2B2AE3D27D4EB4F) + g[16 : n + 16] * U(0xD6E8FEB86659FD93))
    width = MATCH - GRAM + 1
    least, size = h, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(h) - width + 1], least[width - size :][: len(h) - width + 1])


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts, where each starts, and the places at which a string of MATCH bytes lies within one."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    data = b"".join(texts)
    inside = np.zeros(max(0, len(data) - MATCH + 1) + 1, np.int8)
    has = sizes >= MATCH
    np.add.at(inside, first[has], 1)
    np.add.at(inside, np.minimum(first[has] + sizes[has] - MATCH + 1, len(inside) - 1), -1)
    return data, first, np.cumsum(inside[:-1], dtype=np.int8) > 0


def encoded(col: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in col.to_pylist()]


def anchor_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors by bucket, 7 bytes each: 48 bits of each anchor of a chunk, the lowest tells whether two documents of the chunk have it; and at how many places, as a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                data, first, inside = joined(encoded(rows.column(1)))
                if not inside.any():
                    continue
                a = anchors(data)
                at = np.flatnonzero(inside & np.append(True, (a[1:] != a[:-1]) | ~inside[:-1]))
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                doc = ids[np.searchsorted(first, at, "right") - 1]  # of texts that start at one place, the last isn't empty
                order = np.lexsort((doc, a[at]))
                v, doc = a[at][order], doc[order]
                new = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                several = np.maximum.reduceat(np.append(False, (v[1:] == v[:-1]) & (doc[1:] != doc[:-1])), new)
                places = np.log2(np.diff(np.append(new, len(v)))).astype(U)
                v = v[new]
                word = ((v >> U(16)) & ~U(1) | several.astype(U)) << U(8) | places
                bucket = (v % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                word = np.ascontiguousarray(word[order].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "block": [word[cuts[b] : cuts[b + 1]].tobytes() for b in full]})

    return docs.mapInArrow(common.lean(run), "bucket int, block binary")


def filters(blocks: DataFrame, folder: str, buckets: int, hot: int) -> int:
    """Writes each bucket's filter of anchors of several documents, and which of them are at over ``hot`` places; returns how many anchors the filters hold."""
    parts = min(buckets, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 7)
            word = np.zeros((len(raw), 8), np.uint8)
            word[:, :7] = raw
            word = np.sort(word.view("<u8").ravel())
            value = word >> U(9)
            new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            shared = value[new][(np.diff(np.append(new, len(value))) > 1) | (np.bitwise_or.reduceat(word, new) & U(256) == U(256))]
            many = value[new][np.add.reduceat(U(1) << (word & U(255)), new) > U(hot)]
            if len(many):
                common.put_file(f"{folder}-hot/{now:06d}", many.astype("<u8").tobytes())
            bits = min(FILTER_BYTES * 8 // buckets, max(64, 12 * len(shared)))
            table = np.zeros(-(-bits // 8), np.uint8)
            for b in slots(shared, 8 * len(table)):
                np.bitwise_or.at(table, b >> 3, (1 << (b & 7)).astype(np.uint8))
            common.put_file(f"{folder}/{now:06d}", table.tobytes())
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()), "n": pa.array([len(shared)], pa.int64())})

        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and held:
                    yield flush()
                    held = []
                now = b
                held.append(block)
        if held:
            yield flush()

    placed = blocks.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    return int(common.materialize(placed.mapInArrow(common.lean(run), "bucket int, n long"), "anchor-counts").agg(F.sum("n")).first()[0] or 0)


def slots(v: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(v + U(i << 56)) % U(bits)).astype(np.int64) for i in (1, 2)]


def names_in(folder: str) -> list[str]:
    import pyarrow.fs as pfs

    fs, path = common.filesystem(folder)
    return sorted(i.base_name for i in fs.get_file_info(pfs.FileSelector(path, allow_not_found=True)) if not i.base_name.startswith("."))


@lru_cache(maxsize=1)
def hot_anchors(folder: str) -> np.ndarray:
    """The anchors (less their lowest bits) at many places, in order."""
    return np.sort(np.concatenate([np.empty(0, U), *[np.frombuffer(common.get_file(f"{folder}-hot/{x}"), "<u8") for x in names_in(f"{folder}-hot")]]))


@lru_cache(maxsize=1)
def loaded(folder: str, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All filters as one table, with where each starts and how many bits it has."""
    there = set(map(int, names_in(folder)))
    parts = [np.frombuffer(common.get_file(f"{folder}/{b:06d}"), np.uint8) if b in there else np.zeros(0, np.uint8) for b in range(buckets)]
    sizes = np.fromiter(map(len, parts), np.int64, buckets)
    return np.concatenate([*parts, np.zeros(1, np.uint8)]), np.cumsum(sizes) - sizes, 8 * sizes


def may_share(a: np.ndarray, folder: str, buckets: int) -> np.ndarray:
    table, start, bits = loaded(folder, buckets)
    bucket = (a % U(buckets)).astype(np.int64)
    value, size = a >> U(17), bits[bucket]
    ok = size > 0
    size = np.maximum(size, 1)
    for i in (1, 2):
        b = (mix(value + U(i << 56)) % size.astype(U)).astype(np.int64)
        ok &= (table[np.minimum(start[bucket] + (b >> 3), len(table) - 1)] >> (b & 7).astype(np.uint8)) & 1 == 1
    return ok


def is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among those in order."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def string_hashes(data: bytes, begin: np.ndarray) -> np.ndarray:
    """Hashes of the strings of MATCH bytes from places on."""
    raw = np.frombuffer(data, np.uint8)
    h = np.zeros(len(begin), U)
    for off in range(MATCH):
        h = (h ^ raw[begin + off]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    return mix(h)


SNIPPETS = "shard int, sizes binary, data binary, uses binary, docs binary, tags binary, starts binary"


def snippets(docs: DataFrame, folder: str, buckets: int, shards: int) -> DataFrame:
    """Distinct snippets of each chunk by shard, with the documents and places they are at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only_cache("anchors", lambda: (loaded.cache_clear(), hot_anchors.cache_clear()))
        for batch in batches:
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                raw = encoded(rows.column(1))
                data, first, inside = joined(raw)
                if not inside.any():
                    continue
                tags = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))  # rows of one id are told apart by them
                a = anchors(data)
                new = inside & np.append(True, (a[1:] != a[:-1]) | ~inside[:-1])
                begin = np.flatnonzero(new)
                stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
                ok = may_share(a[begin], folder, buckets)
                begin, stop = begin[ok], stop[ok]
                if not len(begin):
                    continue
                # Snippets of an anchor at very many places are cut into their strings, which go to shards each by itself.
                hot = is_in(a[begin] >> U(17), hot_anchors(folder))
                most = np.where(hot, 1, LONGEST)
                pieces = -(-(stop - begin) // most)
                step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                end, most, hot = np.repeat(stop, pieces), np.repeat(most, pieces), np.repeat(hot, pieces)
                begin = np.repeat(begin, pieces) + most * step
                stop = np.minimum(end, begin + most) + MATCH - 1
                place = a[begin] >> U(20)
                if hot.any():
                    place[hot] = string_hashes(data, begin[hot])
                text = np.searchsorted(first, begin, "right") - 1
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                doc, tag, at = ids[text], tags[text], begin - first[text]
                shard = (place % U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                out = {k: [] for k in ("shard", "sizes", "data", "uses", "docs", "tags", "starts")}
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[k] : cuts[k + 1]]
                    seen: dict[bytes, list[int]] = {}
                    for i, b, e in zip(own.tolist(), begin[own].tolist(), stop[own].tolist(), strict=True):
                        seen.setdefault(data[b:e], []).append(i)
                    flat = np.fromiter((i for x in seen.values() for i in x), np.int64, len(own))
                    out["shard"].append(k)
                    out["sizes"].append(np.fromiter(map(len, seen), "<u4", len(seen)).tobytes())
                    out["data"].append(b"".join(seen))
                    out["uses"].append(np.fromiter(map(len, seen.values()), "<u4", len(seen)).tobytes())
                    out["docs"].append(doc[flat].astype("<i8").tobytes())
                    out["tags"].append(tag[flat].astype("<u4").tobytes())
                    out["starts"].append(at[flat].astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict(out | {"shard": pa.array(out["shard"], pa.int32())})

    return docs.mapInArrow(common.lean(run), SNIPPETS)


def owners(contents: list[bytes], least: np.ndarray, spill: str, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For each string of MATCH bytes of the distinct contents, in order, the smallest document of equal ones; and where each content's strings start."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    text = np.frombuffer(b"\0".join([*contents, b""]), np.uint8).astype(np.uint16) + np.uint16(2)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text[begin[1:] - 1] = 1  # between contents
    text[-1] = 0
    count = sizes - MATCH + 1
    first = np.cumsum(count) - count
    order = suffix_array(text, 258, MATCH, spill, memory)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    inside = np.arange(len(text)) - begin[owner] < count[owner]
    order = order[inside[order]].astype(np.int64)
    raw = (text[:-1] - np.uint16(2)).astype(np.uint8).tobytes()
    g = np.append(grams(raw), np.zeros(8, U))
    same = np.ones(len(order) - 1, bool)  # neighbours that agree over MATCH bytes
    for off in [*range(0, MATCH - 8, 8), MATCH - 8]:
        at = np.flatnonzero(same)
        x, y = order[at] + off, order[at + 1] + off
        same[at] = g[x] == g[y]
    new = np.flatnonzero(np.append(True, ~same))
    best = np.minimum.reduceat(least[owner[order]], new)
    out = np.empty(len(order), np.int64)
    out[first[owner[order]] + order - begin[owner[order]]] = np.repeat(best, np.diff(np.append(new, len(order))))
    return out, first


def removed(parts: DataFrame, doc_buckets: int, spill: str) -> DataFrame:
    """Packed (document, start, end) of removed strings, by the document's bucket."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        which, docs, tags, starts = [], [], [], []
        for sizes, data, uses, d, t, s in held:
            cuts = np.append(0, np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)).tolist()
            ids = [index.setdefault(data[a:b], len(index)) for a, b in zip(cuts, cuts[1:], strict=False)]
            which.append(np.repeat(np.array(ids, np.int64), np.frombuffer(uses, "<u4")))
            docs.append(np.frombuffer(d, "<i8"))
            tags.append(np.frombuffer(t, "<u4").astype(np.int64))
            starts.append(np.frombuffer(s, "<u4").astype(np.int64))
        held.clear()
        which, docs, tags, starts = np.concatenate(which), np.concatenate(docs), np.concatenate(tags), np.concatenate(starts)
        least = np.full(len(index), NO_ID)
        np.minimum.at(least, which, docs)
        contents = list(index)
        index.clear()
        own, first = owners(contents, least, spill)
        lowest, highest = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        whole = highest[which] < docs
        a = [docs[whole]], [tags[whole]], [starts[whole]], [(starts + size[which])[whole]]
        some = np.flatnonzero(~whole & (lowest[which] < docs))
        for w, d, t, s in zip(which[some].tolist(), docs[some].tolist(), tags[some].tolist(), starts[some].tolist(), strict=True):
            hit = np.flatnonzero(own[first[w] : first[w] + size[w] - MATCH + 1] < d)
            cut = np.flatnonzero(np.diff(hit) > 1)
            lo, hi = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
            a[0].append(np.full(len(lo), d))
            a[1].append(np.full(len(lo), t))
            a[2].append(s + lo)
            a[3].append(s + hi + MATCH)
        doc, tag, lo, hi = (np.concatenate(x) for x in a)
        bucket = (doc.view(U) % U(doc_buckets)).astype(np.int64)
        order = np.lexsort((lo, doc, bucket))
        packed = np.stack([doc[order], tag[order], lo[order] << 32 | hi[order]], 1)
        cuts = np.searchsorted(bucket[order], np.arange(doc_buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            p = packed[cuts[b] : cuts[b + 1]]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "block": [p.tobytes()], "docs": pa.array([np.unique(p[:, 0])], pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and held:
                    yield from solve(held)
                now = shard
                held.append(tuple(row))
        if held:
            yield from solve(held)

    return parts.mapInArrow(common.lean(run), "bucket int, block binary, docs array<long>")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_text(data: bytes, spans: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the bytes, and the maximal runs that go; spans are (start, end) in order of start."""
    runs: list[list[int]] = []
    for s, e in spans.tolist():
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    kept, at = [], 0
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]]), [(s, e) for s, e in runs]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (the bytes left) if asked."""
    spark = df.sparkSession
    common.small_batches(spark)
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(1, -(-size // (48 << 20)))
    shards = max(1, -(-size // (5 << 20)))
    doc_buckets = max(1, -(-size // (24 << 20)))
    folder = common.scratch(spark, "anchors")
    filters(anchor_blocks(docs, buckets), folder, buckets, hot)
    parts = min(shards, 20_000)
    placed = snippets(docs, folder, buckets, shards).repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard")
    places = common.materialize(removed(placed, doc_buckets, f"{folder}-spill"), "removed")
    common.discard(spark, folder, f"{folder}-hot", f"{folder}-spill")
    once = places.groupBy("bucket").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))  # a document is in many shards
    hit = common.bloom(once.select(F.explode("docs").alias("id")), "id")
    schema = RESULT + (", kept binary" if with_text else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def result(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    def row(k: int, data: bytes, spans: np.ndarray) -> tuple:
        left, runs = cut_text(data, spans)
        out = (None if k == NO_ID else k, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest())
        return (*out, left) if with_text else out

    none = np.empty((0, 2), np.int64)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~common.may_hold(hit, batch.column(0))))
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                yield result([row(k, d, none) for k, d in zip(rows.column(0).to_pylist(), encoded(rows.column(1)), strict=True)])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(common.may_hold(hit, batch.column(0))))
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                ids = np.asarray(rows.column(0).to_numpy(zero_copy_only=False), np.int64)
                bucket = (ids.view(U) % U(doc_buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(len(rows), pa.binary()), rows.column(0), rows.column(1)], ["bucket", "block", "id", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        spans: dict[tuple[int, int], np.ndarray] = {}

        def known() -> None:
            p = np.frombuffer(b"".join(held), np.int64).reshape(-1, 3)
            p = p[np.lexsort((p[:, 2], p[:, 1], p[:, 0]))]
            first = np.flatnonzero(np.append(True, (p[1:, :2] != p[:-1, :2]).any(1)))
            both = np.stack([p[:, 2] >> 32, p[:, 2] & 0xFFFFFFFF], 1)
            for (k, t), x in zip(p[first, :2].tolist(), np.split(both, first[1:]), strict=True):
                spans[k, t] = x
            held.clear()

        for batch in batches:
            out = []
            for b, block, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    spans.clear()
                    held.clear()
                    now = b
                if block is not None:
                    held.append(block)  # a bucket's blocks come before its texts
                    continue
                if held:
                    known()
                data = (t or "").encode("utf-8", "surrogatepass")
                out.append(row(k, data, spans.get((k, zlib.crc32(data)), none)))
                if len(out) == 256:
                    yield result(out)
                    out = []
            if out:
                yield result(out)

    texts = docs.mapInArrow(common.lean(suspects), "bucket int, block binary, id long, text string")
    blocks = places.select("bucket", "block", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"))
    both = texts.unionByName(blocks)
    p = min(doc_buckets, 20_000)
    met = both.repartitionById(p, F.col("bucket") % p).sortWithinPartitions("bucket", F.col("block").isNull())
    return docs.mapInArrow(common.lean(clean), schema).unionByName(met.mapInArrow(common.lean(cut), schema))
