"""Document fingerprints: one-permutation MinHash.

Each word shingle is hashed once: the high bits choose a bin, the least hash of a bin is its value.
An empty bin takes the value of the first full bin in a random sequence of its own (optimal
densification). The low ``BITS`` bits of each bin are packed; equal low bits by chance are
taken out of the likeness: J = (f - C) / (1 - C) with C = 2**-BITS.

Edge cases: a null text counts as empty; a text without words has the fingerprint ``""``, is like an equal one
(1.0) and unlike all others (0.0); texts of 1 to 4 words have one shingle; rows with equal keys
follow each other in descending order of text, and a null key comes last; an empty table gives no rows; extra columns are
ignored. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm.textnum import U, mix, shingle_sets

BINS, BITS = 512, 4
NULL_KEY = -(1 << 63)
_TRIES = mix(np.arange(BINS * 64, dtype=U) * U(0x9E3779B97F4A7C15)) % U(BINS)
TRIES = _TRIES.astype(np.int64).reshape(64, BINS)


def signature(hashes: np.ndarray) -> np.ndarray | None:
    """Low bits of each bin (uint8) of sorted distinct hashes; None of no hashes."""
    if not len(hashes):
        return None
    bins = (hashes >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out, full = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    out[bins[first]] = hashes[first] & U((1 << BITS) - 1)
    full[bins[first]] = True
    empty, t = np.flatnonzero(~full), 0
    while len(empty):
        at = TRIES[t, empty] if t < len(TRIES) else (mix(empty.astype(U) * U(0xD6E8FEB86659FD93) + U(t)) % U(BINS)).astype(np.int64)
        ok = full[at]
        out[empty[ok]] = out[at[ok]]
        empty, t = empty[~ok], t + 1
    return out


def pack(sig: np.ndarray | None) -> str:
    return "" if sig is None else (sig[0::2] | sig[1::2] << 4).tobytes().hex()


def unpack(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([raw & 15, raw >> 4], 1).ravel()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    f, c = float((a == b).mean()), 2.0**-BITS
    return min(1.0, max(0.0, (f - c) / (1 - c)))


def signatures(texts: list[bytes], words: int = 5) -> list[np.ndarray | None]:
    return [signature(s) for s in shingle_sets(texts, words)]


def fingerprint_column(df: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """``df`` with its text's ``fingerprint``; no shuffle."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def f(s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([pack(x) for x in signatures([("" if t is None else t).encode("utf-8", "surrogatepass") for t in s], words)])

    return df.withColumn("fingerprint", f(F.col(text)))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is the start of the next document, in descending order of the key.

    Texts are dealt once to ranges of keys. The last row of a range needs the first row of the range
    below it, so that one row goes to both: no window over all rows, and no second shuffle of texts.
    """
    keyed = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.coalesce("id", F.lit(NULL_KEY)))
    ranged, _, n = common.range_buckets(keyed, "key", "text", 16 << 20)
    tops = {r[0]: r[1] for r in ranged.groupBy("_bucket").agg(F.max("key")).collect()}  # a row for each range
    full = sorted(tops)
    goes = dict(zip(full, [*full[1:], full[0]], strict=True)) if full else {}
    place = F.array("_bucket")
    if full:
        top = common.constant([tops.get(b, NULL_KEY) for b in range(n)], "bigint")
        to = common.constant([goes.get(b, -1) for b in range(n)], "int")
        at = F.col("_bucket") + 1
        place = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("ctx")), F.when(F.element_at(top, at) == F.col("key"), F.struct(F.element_at(to, at).alias("b"), F.lit(1).alias("ctx"))))
        dealt = ranged.select("id", "key", "text", F.explode(F.filter(place, lambda p: p.isNotNull())).alias("p")).select("id", "key", "text", "p.b", "p.ctx")
    else:
        dealt = ranged.select("id", "key", "text", F.lit(0).alias("b"), F.lit(0).alias("ctx"))
    placed = (dealt.repartitionById(n, "b") if n > 1 else dealt.coalesce(1)).sortWithinPartitions("b", "ctx", F.desc("key"), F.desc("text")).select("id", "text", "ctx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, done = 0, False

        def out(rows: list, after: str) -> pa.RecordBatch:
            texts = [t for _, t in rows]
            nexts = [*texts[1:], after]
            edited = []
            for t, x in zip(texts, nexts, strict=True):
                m = len(t) // 3
                edited.append((t[: len(t) - m] + x[:m]).encode("utf-8", "surrogatepass"))
            sigs = signatures([t.encode("utf-8", "surrogatepass") for t in [*texts, after]], words)
            new = signatures(edited, words)
            own = sigs[:-1]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([k for k, _ in rows], pa.int64()), "n_chars": pa.array(map(len, texts), pa.int64()),
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited], "fingerprint": list(map(pack, own)), "edited_fingerprint": list(map(pack, new)),
                "near_edited": list(map(likeness, own, new)), "near_next": list(map(likeness, own, sigs[1:])),
            })

        for batch in batches:
            for k, t, ctx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if done:
                    continue
                if size > common.CHUNK_BYTES or (ctx and held):
                    yield out(held, t)
                    held, size = [], 0
                if ctx:
                    done = True  # rows after it are ties of the same key
                    continue
                held.append((k, t))
                size += len(t)

    return placed.mapInArrow(common.lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
