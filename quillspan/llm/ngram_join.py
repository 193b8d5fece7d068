"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form.

Sizes are cut into bands in which the largest is at most 1 / threshold of the smallest; a set signs for its
own band and the next, so that any two sets that can link sign for a common one. There their symmetric
difference has at most k elements. The domain of hashes is cut into n > k parts, of which at least n - k then
hold the same elements in both sets. Each subset of t of the parts (t = n - k, or fewer where n is
larger) that a set has elements in is a signature: the hash of the elements in these parts. Sets that link
share one; where parts are single, they share so many that a document with fewer shared ones can't link
and is left out. If so many parts of a set are empty that all common ones may be, it signs for empty ones also;
so no link is lost.

1. Texts are read once. A task's sets make chunks of about ``FLUSH`` signatures, each a file in the shared folder; equal
   sets of a chunk sign once. To a signature's bucket a chunk sends it once, 6 bytes, however many of its documents have it,
   so a bucket gets no more of a hot signature than there are chunks. Sets are grouped by their digests; of equal ones
   one signs for all, under the smallest id.
2. A bucket tells each chunk which signatures are shared (a bit each). The chunk leaves out what can't link, sends what is left,
   with the smallest document that has it, and hears each signature's leader (the smallest of all) and number of documents.
3. Links to leaders are found, the likeliest first, and contracted; pairs in one component aren't compared again.
   Where documents of a signature are still apart, those are compared with each other; of a document's signatures only
   the rarest count there, as many as must hold one that any linked pair shares.
   A pair is checked on its whole sets, behind an exact bound on the difference (parities of elements by cell).

Edge cases: null or empty texts and texts without words have no set, no link and their own id as
component; fewer words than a shingle make one shingle of all; rows that share an id are one node;
a null id gets a null component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm.components import contract
from quillspan.llm.textnum import U, mix, shingle_sets

#: Similarity as a ratio of whole numbers.
NUM, DEN = 80, 100
#: Words of parities of a set's elements, by cell.
PARITY_WORDS = 16
#: Signatures of a chunk, and buckets at most; these grow beyond ``bucket_bytes`` then, to 300 MB or so for 100 TB of text.
FLUSH, MOST_BUCKETS = 1 << 20, 200_000
#: Bits of a set's place in its chunk, and of a chunk's in its task.
SLOT_BITS, CHUNK_BITS = 21, 16


def band_ends(largest: int, num: int = NUM, den: int = DEN) -> list[int]:
    """The largest size of each band."""
    ends, low = [], 1
    while low <= largest:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return ends


@lru_cache(maxsize=None)
def plan(end: int, num: int = NUM, den: int = DEN) -> tuple[int, int, np.ndarray | None]:
    """(parts n, bound k on the difference, subsets of parts or None for single parts) of the band that ends with ``end``."""
    k = 2 * end * (den - num) // (den + num)
    if k == 0:
        return 1, 0, None
    if k <= 4:
        n = {1: 4, 2: 6, 3: 7, 4: 8}[k]
        return n, k, np.array(list(combinations(range(n), n - k)))
    if k <= 12:
        return k + 2, k, np.array(list(combinations(range(k + 2), 2)))
    return k + 3 + -(-15 * k // 100), k, None


@lru_cache(maxsize=1024)
def seeds(end: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(end * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))


_ENDS = np.array(band_ends(1 << 40))


def signatures(x: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, list[int]]:
    """Signatures of a set of sorted distinct hashes; and how many, of those of an even and of an odd band, any set that links shares at least.

    The lowest bit of a signature is its band's: of a set's two bands one is even.
    """
    ends = _ENDS if (num, den) == (NUM, DEN) else np.array(band_ends(1 << 40, num, den))
    i = int(np.searchsorted(ends, len(x)))
    deep = mix(x * U(0xA24BAED4963EE407) + U(1))
    top = x >> U(32)
    out, least = [], [1, 1]
    for band in (i, i + 1):
        end = int(ends[band])
        n, k, subsets = plan(end, num, den)
        part = ((top * U(n)) >> U(32)).astype(np.int64)  # rises with x
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums, full = np.add.reduceat(deep, first), part[first]
        empties = n - len(full) >= n - k  # then all parts in common may be empty
        if subsets is None:
            sig = mix(sums ^ seeds(end, n)[full])
            if empties and k:
                none = np.ones(n, bool)
                none[full] = False
                sig = np.concatenate([sig, mix(seeds(end, n)[none])])
            else:
                least[band & 1] = len(full) - k
        else:
            held = np.zeros(n, U)
            held[full] = sums
            weigh = seeds(end + (1 << 50), subsets.shape[1]) | U(1)
            sig = mix((mix(held)[subsets] * weigh).sum(1, dtype=U) ^ seeds(end, len(subsets)))
            sig = sig if empties else sig[(held[subsets] != 0).any(1)]
        out.append(sig & ~U(1) | U(band & 1))
    return np.concatenate(out), least


def parities(x: np.ndarray) -> np.ndarray:
    """A bit for each cell of elements: their number modulo 2. Sets that differ in h elements differ in at most h bits."""
    cells = (mix(x * U(0x8CB92BA72F3D8DD7)) % U(64 * PARITY_WORDS)).astype(np.int64)
    odd = np.bincount(cells, minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _encoded(col: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in col.to_pylist()]


def planes(codes: np.ndarray) -> bytes:
    """Numbers of 48 bits, the first bytes of all before the second ones: rising codes compress so."""
    return np.ascontiguousarray(codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view(">u8").ravel().astype(U)


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the code."""
    return (((codes >> U(16)) * U(buckets)) >> U(32)).astype(np.int64)


class Chunk:
    """Sets of one chunk: ids, sizes, parities, least shared signatures, and the signatures with the sets (slots) that have them."""

    def __init__(self, data: bytes) -> None:
        with np.load(io.BytesIO(data)) as f:
            self.codes = from_planes(f["codes"].tobytes())
            head = np.unpackbits(f["head"])[: len(f["slot"])]
            self.slot, self.ids, self.n, self.even, self.odd, self.parity = f["slot"].astype(np.int64), f["ids"], f["n"], f["even"], f["odd"], f["parity"]
        self.code = np.cumsum(head, dtype=np.int64) - 1  # by entry, its signature's place in codes
        self.is_odd = (self.codes & U(1) == 1)[self.code]

    @staticmethod
    def pack(sigs: list[np.ndarray], ids: list[int], n: list[int], least: list[list[int]], parity: list[np.ndarray]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(the file, distinct codes in order, which of them several sets have)."""
        sig = np.concatenate(sigs)
        code = (sig >> U(16)) & ~U(1) | sig & U(1)
        slot = np.repeat(np.arange(len(sigs)), list(map(len, sigs)))
        order = np.argsort(code, kind="stable")
        code, slot = code[order], slot[order]
        new = np.append(True, code[1:] != code[:-1])
        once = new | np.append(True, slot[1:] != slot[:-1])
        code, slot, new = code[once], slot[once], new[once]
        first = np.flatnonzero(new)
        codes = code[first]
        out = io.BytesIO()
        np.savez(out, codes=np.frombuffer(planes(codes), np.uint8), head=np.packbits(new), slot=slot.astype(np.uint16 if len(sigs) <= 1 << 16 else np.uint32), ids=np.array(ids, np.int64), n=np.array(n, np.int64), even=np.array([x[0] for x in least], np.int32), odd=np.array([x[1] for x in least], np.int32), parity=np.stack(parity))
        return out.getvalue(), codes, np.diff(np.append(first, len(code))) > 1


def chunk_uri(folder: str, chunk: int) -> str:
    return f"{folder}/{chunk >> CHUNK_BITS:07d}-{chunk & (1 << CHUNK_BITS) - 1:05d}"


SIGNED = "bucket int, chunk long, base long, codes binary, several binary, doc_id long, n long, hi long, lo long, place long"


def signed(df: DataFrame, folder: str, buckets: int, words: int, num: int, den: int) -> DataFrame:
    """Rows of documents (id, size, digest and place of its set) and of chunks' signatures by bucket; writes the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only_cache("sets", lambda: None)
        chunk = TaskContext.get().partitionId() << CHUNK_BITS
        seen: dict[tuple[int, int, int], int] = {}
        sigs: list[np.ndarray] = []
        ids, sizes, least, parity = [], [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            data, codes, several = Chunk.pack(sigs, ids, sizes, least, parity)
            common.put_file(chunk_uri(folder, chunk), data)
            cuts = np.searchsorted(bucket_of(codes, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            none = pa.nulls(len(full), pa.int64())
            spans = [(int(cuts[b]), int(cuts[b + 1])) for b in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([x for x, _ in spans], pa.int64()), pa.array([planes(codes[x:y]) for x, y in spans], pa.binary()), pa.array([np.packbits(several[x:y]).tobytes() for x, y in spans], pa.binary()), none, none, none, none, none], [c.split()[0] for c in SIGNED.split(", ")])

        for batch in batches:
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                docs = rows.column(0).to_pylist()
                sets = shingle_sets(_encoded(rows.column(1)), words)
                digests, places = [(0, 0)] * len(docs), [None] * len(docs)
                for i, (d, x) in enumerate(zip(docs, sets, strict=True)):
                    if not len(x) or d is None:
                        continue
                    digests[i] = int(mix(x).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(x).view(np.int64))
                    own = (len(x), *digests[i])
                    if own not in seen:
                        seen[own] = len(ids)
                        sig, t = signatures(x, num, den)
                        sigs.append(sig)
                        ids.append(d)
                        sizes.append(len(x))
                        least.append(t)
                        parity.append(parities(x))
                        held += len(sig)
                    places[i] = chunk << SLOT_BITS | seen[own]
                k, none, long = len(docs), pa.nulls(len(docs), pa.int64()), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k) * buckets // k, pa.int32()), none, none, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), rows.column(0), pa.array(map(len, sets), long), pa.array([h for h, _ in digests], long), pa.array([h for _, h in digests], long), pa.array(places, long)], [c.split()[0] for c in SIGNED.split(", ")])
                if held > FLUSH:
                    yield flush()
                    chunk += 1
                    seen, sigs, ids, sizes, least, parity, held = {}, [], [], [], [], [], 0
        if sigs:
            yield flush()

    return df.mapInArrow(common.lean(run), SIGNED)


def batch_of(schema: str, **cols: list | pa.Array) -> pa.RecordBatch:
    """Columns of a schema string, nulls for those that aren't given."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    n = len(next(iter(cols.values())))
    fields = [c.rsplit(" ", 1) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], kinds[k]) if c in cols else pa.nulls(n, kinds[k]) for c, k in fields], [c for c, _ in fields])


TOLD = "chunk long, base long, count long, bits binary, doc_id long, n long, hi long, lo long, place long"


def told(placed: DataFrame) -> DataFrame:
    """Documents as they are, and for each chunk and bucket (a task's) a bit a signature: whether several sets have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            docs = batch.filter(batch.column(1).is_null())
            if len(docs):
                yield batch_of(TOLD, **{c: docs.column(c) for c in ("doc_id", "n", "hi", "lo", "place")})
            frags = batch.filter(batch.column(1).is_valid())
            held += zip(*(frags.column(c).to_pylist() for c in ("chunk", "base", "codes", "several")), strict=True)
        if not held:
            return
        codes = [from_planes(x[2]) for x in held]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        several = np.concatenate([np.unpackbits(np.frombuffer(x[3], np.uint8), count=int(n)) for x, n in zip(held, sizes, strict=True)])
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        n = np.diff(np.append(first, len(code)))
        shared = np.empty(len(code), np.uint8)
        shared[order] = np.repeat((n > 1) | (np.maximum.reduceat(several[order], first) > 0), n)
        ends = np.cumsum(sizes)
        yield batch_of(TOLD, chunk=[x[0] for x in held], base=[x[1] for x in held], count=sizes, bits=[np.packbits(shared[e - k : e]).tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)])

    return placed.mapInArrow(common.lean(run), TOLD)


def by_chunk(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.pmod(F.hash("chunk"), F.lit(parts))).sortWithinPartitions("chunk")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(chunk, its rows) of rows that come by chunk, their first column."""
    now, held = None, []
    for batch in batches:
        for chunk, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk != now and held:
                yield now, held
                held = []
            now = chunk
            held.append(tuple(row))
    if held:
        yield now, held


#: Of a chunk: answers of buckets, and notes on sets that others equal (slot, node, whether this one signs for all).
HEARD = "chunk long, base long, count long, bits binary, slot long, node long, signs boolean"
ASKED = "bucket int, chunk long, pos binary, codes binary, least binary, count binary"


def noted(c: Chunk, rows: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The node of each slot, and whether it signs."""
    node, signs = c.ids.copy(), np.ones(len(c.ids), bool)
    for slot, k, on in rows:
        node[slot], signs[slot] = k, on
    return node, signs


def asked(heard: DataFrame, folder: str, buckets: int) -> DataFrame:
    """What chunks ask of buckets: signatures of sets that can link, with the smallest node and their number; and which sets these are (no codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in grouped(batches):
            c = Chunk(common.get_file(chunk_uri(folder, chunk)))
            shared = np.zeros(len(c.codes), bool)
            for base, count, bits, *_ in rows:
                if bits is not None:
                    shared[base : base + count] = np.unpackbits(np.frombuffer(bits, np.uint8), count=count)
            node, signs = noted(c, [r[3:] for r in rows if r[2] is None])
            on = shared[c.code] & signs[c.slot]
            # A set can only link if it shares, in one of its bands, as many signatures as any linking pair does.
            enough = [np.bincount(c.slot[on & (c.is_odd == odd)], minlength=len(node)) >= least for odd, least in ((False, c.even), (True, c.odd))]
            can = signs & (enough[0] | enough[1])
            on &= can[c.slot]
            at = c.code[on]
            if not len(at):
                continue
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            pos, least = at[first], np.minimum.reduceat(node[c.slot[on]], first)
            count, codes = np.diff(np.append(first, len(at))), c.codes[pos]
            cuts = np.searchsorted(bucket_of(codes, buckets), np.arange(buckets + 1))
            spans = [(b, slice(int(cuts[b]), int(cuts[b + 1]))) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            k = len(spans)
            yield batch_of(ASKED, bucket=[b for b, _ in spans], chunk=[chunk] * k, pos=[pos[x].astype("<u4").tobytes() for _, x in spans], codes=[planes(codes[x]) for _, x in spans], least=[least[x].astype("<i8").tobytes() for _, x in spans], count=[count[x].astype("<u4").tobytes() for _, x in spans])
            yield batch_of(ASKED, bucket=[chunk % buckets], chunk=[chunk], pos=[np.packbits(can).tobytes()])

    return heard.mapInArrow(common.lean(run), ASKED)


LED = "chunk long, pos binary, leader binary, count binary, slot long, node long, signs boolean"


def led(placed: DataFrame) -> DataFrame:
    """The leader and the number of sets of each signature of several, by chunk; and which sets of the chunk can link, as they come (no leader)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            can = batch.filter(batch.column(3).is_null())
            if len(can):
                yield batch_of(LED, chunk=can.column("chunk"), pos=can.column("pos"))
            frags = batch.filter(batch.column(3).is_valid())
            held += zip(*(c.to_pylist() for c in frags.columns[1:]), strict=True)
        if not held:
            return
        codes = [from_planes(x[2]) for x in held]
        frag = np.repeat(np.arange(len(held)), list(map(len, codes)))
        code = np.concatenate(codes)
        pos, least, count = (np.frombuffer(b"".join(x[i] for x in held), kind) for i, kind in ((1, "<u4"), (3, "<i8"), (4, "<u4")))
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        n = np.diff(np.append(first, len(code)))
        total, leader = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
        total[order] = np.repeat(np.add.reduceat(count[order].astype(np.int64), first), n)
        leader[order] = np.repeat(np.minimum.reduceat(least[order], first), n)
        on = np.flatnonzero(total > 1)
        cuts = np.searchsorted(frag[on], np.arange(len(held) + 1))
        spans = [(held[i][0], on[cuts[i] : cuts[i + 1]]) for i in np.flatnonzero(np.diff(cuts)).tolist()]
        if spans:
            yield batch_of(LED, chunk=[c for c, _ in spans], pos=[pos[x].astype("<u4").tobytes() for _, x in spans], leader=[leader[x].astype("<i8").tobytes() for _, x in spans], count=[total[x].astype("<i8").tobytes() for _, x in spans])

    return placed.mapInArrow(common.lean(run), LED)


#: kind 0: a document with a leader and their common signatures led by it; 1: a set's size and parities; 2: one of a document's rarest signatures, with its leader.
FOUND = "doc long, leader long, c long, n long, parity array<long>, sig long, kind int"


def found(answers: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in grouped(batches):
            by = [r for r in rows if r[1] is not None]
            if not by:
                continue
            c = Chunk(common.get_file(chunk_uri(folder, chunk)))
            can = np.unpackbits(np.frombuffer(next(r[0] for r in rows if r[0] is not None and r[1] is None), np.uint8), count=len(c.ids)).astype(bool)
            node, _ = noted(c, [r[3:] for r in rows if r[0] is None])
            leader, total = np.zeros(len(c.codes), np.int64), np.zeros(len(c.codes), np.int64)
            for pos, lead, count, *_ in by:
                at = np.frombuffer(pos, "<u4")
                leader[at], total[at] = np.frombuffer(lead, "<i8"), np.frombuffer(count, "<i8")
            on = np.flatnonzero((total[c.code] > 0) & can[c.slot])
            slot, code, odd = c.slot[on], c.code[on], c.is_odd[on]
            lead = leader[code]
            order = np.lexsort((lead, slot))
            s, l = slot[order], lead[order]
            first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (l[1:] != l[:-1]))) if len(s) else np.empty(0, np.int64)
            c_of = np.diff(np.append(first, len(s)))
            s, l = s[first], l[first]
            apart = node[s] != l
            yield batch_of(FOUND, doc=node[s][apart], leader=l[apart], c=c_of[apart], kind=[0] * int(apart.sum()))
            there = np.unique(slot)
            for lo in range(0, len(there), 20_000):
                x = there[lo : lo + 20_000]
                yield batch_of(FOUND, doc=node[x], n=c.n[x], parity=list(c.parity[x]), kind=[1] * len(x))
            # Of a set's m signatures of a band, a linked set shares t; so the m - t + 1 rarest hold a shared one, as do the other set's.
            order = np.lexsort((code, total[code], odd, slot))
            key = slot[order] * 2 + odd[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            m = np.diff(np.append(first, len(key)))
            t = np.where(key[first] & 1, c.odd[key[first] >> 1], c.even[key[first] >> 1])
            rank = np.arange(len(key)) - np.repeat(first, m)
            rare = order[rank < np.repeat(m - t + 1, m)]
            for lo in range(0, len(rare), 200_000):
                x = rare[lo : lo + 200_000]
                yield batch_of(FOUND, doc=node[slot[x]], leader=lead[x], sig=c.codes[code[x]].view(np.int64), kind=[2] * len(x))

    return answers.mapInArrow(common.lean(run), FOUND)


def items_of(docs: DataFrame, words: int, ids: np.ndarray) -> DataFrame:
    """(doc_id, items) of the documents that may be among ``ids`` (a Bloom filter of them); narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(common.may_hold(ids, batch.column(0))))
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                sets = shingle_sets(_encoded(rows.column(1)), words)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "items": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})

    return docs.mapInArrow(common.lean(run), "doc_id long, items array<long>")


def may_link(num: int, den: int):  # noqa: ANN201
    """Whether sizes (na, nb) and parities (pa, pb) allow a link: |difference| * (den + num) <= (na + nb) * (den - num)."""
    differ = sum((F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(1, PARITY_WORDS)), F.bit_count(F.col("pa")[0].bitwiseXOR(F.col("pb")[0])))
    sizes = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    return sizes


def ids_of(pairs: DataFrame) -> np.ndarray:
    return common.bloom(pairs.select(F.explode(F.array("u", "v")).alias("id")), "id")


def linked(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (u, v) that link, by their whole sets; a written table."""
    items = lambda x, y: whole.select(F.col("doc_id").alias(x), F.col("items").alias(y))
    both = pairs.join(items("u", "x"), "u").join(items("v", "y"), "v").withColumn("i", F.size(F.array_intersect("x", "y")))
    return common.materialize(both.where(F.col("i") * den >= (F.size("x") + F.size("y") - F.col("i")) * num).select("u", "v").distinct(), "links")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = NUM, den: int = DEN, bucket_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the smallest id that links of similarity num / den reach; a written table."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    common.small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-int(size * 0.45) // bucket_bytes)))
    folder = common.scratch(spark, "ngram-chunks")
    shared = common.materialize(told(signed(docs, folder, buckets, words, num, den).repartitionById(buckets, "bucket")), "ngram-told")
    every = shared.where("chunk is null").select("doc_id", "n", "hi", "lo", "place")

    # Equal sets: the place that signs for all of them, and the smallest id.
    places = every.where("place is not null").groupBy("n", "hi", "lo", "place").agg(F.min("doc_id").alias("node"), F.count("*").alias("c"))
    several = common.materialize(places.groupBy("n", "hi", "lo").agg(F.min("node").alias("node"), F.min("place").alias("home"), F.sum("c").alias("c")).where("c > 1").drop("c"), "ngram-equal")
    notes = places.drop("node").join(several, ["n", "hi", "lo"]).select(F.shiftright("place", SLOT_BITS).alias("chunk"), F.col("place").bitwiseAND((1 << SLOT_BITS) - 1).alias("slot"), "node", (F.col("place") == F.col("home")).alias("signs"))
    notes = common.materialize(notes, "ngram-notes")

    heard = shared.where("chunk is not null").select("chunk", "base", "count", "bits").unionByName(notes, allowMissingColumns=True)
    asks = asked(by_chunk(heard.select(*[c.split()[0] for c in HEARD.split(", ")]), buckets), folder, buckets)
    answers = common.materialize(led(asks.repartitionById(buckets, "bucket")).select("chunk", "pos", "leader", "count"), "ngram-led")
    answered = answers.unionByName(notes, allowMissingColumns=True).select(*[c.split()[0] for c in LED.split(", ")])
    got = common.materialize(found(by_chunk(answered, buckets), folder), "ngram-found", by="kind")
    common.discard(spark, folder, answers, notes)
    stars = got.where("kind = 0").select(F.col("leader").alias("u"), F.col("doc").alias("v"), "c")
    sets = got.where("kind = 1").select("doc", "n", "parity")

    def near(pairs: DataFrame) -> DataFrame:
        side = lambda x, y: sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{y}"), F.col("parity").alias(f"p{y}"))
        return common.materialize(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(may_link(num, den)).select(*pairs.columns), "near-pairs")

    # 1: each document with the leader of most of its signatures.
    stars_near = near(stars)
    whole = common.materialize(items_of(docs, words, ids_of(stars_near)), "ngram-items")
    best = stars_near.groupBy("v").agg(F.max_by("u", F.struct("c", -F.col("u"))).alias("u")).select("u", "v")
    links = linked(best, whole, num, den)
    labels = contract(None, links)
    spent = [links]

    def apart(pairs: DataFrame) -> DataFrame:
        label = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}r"))
        return pairs.join(label("u"), "u", "left").join(label("v"), "v", "left").where(F.coalesce("ur", "u") != F.coalesce("vr", "v"))

    def added(links: DataFrame) -> DataFrame:
        after = contract(labels, links)
        spent.extend((links, labels))
        return after

    # 2: with its other leaders, where not yet in one component.
    labels = added(linked(apart(stars_near).select("u", "v"), whole, num, den))
    common.discard(spark, whole, stars_near, *spent)
    spent.clear()
    # 3: members of signatures of which some are still apart from their leader.
    members = got.where("kind = 2").select("sig", F.col("leader").alias("u"), F.col("doc").alias("v"))
    open_sigs = members.join(apart(stars).select("u", "v"), ["u", "v"], "left_semi").select("sig").distinct()
    label = labels.select(F.col("node").alias("v"), "root")
    open_ = members.join(open_sigs, "sig", "left_semi").drop("u").join(label, "v", "left").join(sets.withColumnRenamed("doc", "v"), "v")
    open_ = common.materialize(open_.select("sig", "v", F.coalesce("root", "v").alias("root"), "n", "parity"), "ngram-open")
    side = lambda x, y: open_.select("sig", F.col("v").alias(x), F.col("root").alias(f"{x}r"), F.col("n").alias(f"n{y}"), F.col("parity").alias(f"p{y}"))
    left, right = side("u", "a"), side("v", "b")
    pairs = left.join(right, (left.sig == right.sig) & (F.col("u") < F.col("v")) & (F.col("ur") != F.col("vr")) & may_link(num, den)).select("u", "v").distinct()
    pairs = common.materialize(pairs, "open-pairs")
    if not pairs.isEmpty():
        whole = common.materialize(items_of(docs, words, ids_of(pairs)), "ngram-items")
        labels = added(linked(pairs, whole, num, den))
    # Rows that share an id are one node.
    named = every.where("place is not null").join(several.drop("home"), ["n", "hi", "lo"], "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    twice = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last").drop("last")
    twice = common.materialize(named.join(twice, "doc_id").where("u < node").select("u", F.col("node").alias("v")).distinct(), "ngram-twice")
    if not twice.isEmpty():
        labels = added(twice)

    node = F.when(F.col("place").isNotNull(), F.coalesce("node", "doc_id"))
    out = every.join(several.drop("home"), ["n", "hi", "lo"], "left").withColumn("node", node).join(labels, "node", "left")
    out = common.materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node", "doc_id").alias("component_id")), "ngram-components")
    common.discard(spark, shared, several, got, whole, open_, pairs, twice, labels, *spent)
    return out


def without_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``df`` but those that link to a smaller id, with all their columns.

    Rows that share an id stay or go together; rows with a null id, without words or with a null text stay; an empty table stays empty.
    """
    components = jaccard_components(df, key, text, words, num, den)
    gone = common.materialize(components.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "duplicates")
    common.discard(df.sparkSession, components)
    return df.join(gone, df[key].cast("long") == gone["__gone"], "left_anti")
