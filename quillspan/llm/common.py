"""Helpers shared by the training-data operators: shared storage, batching and range placement."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kernels take so many bytes of text at a time; one longer text is taken whole.
CHUNK_BYTES = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one where it is unset, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='quillspan-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/quillspan/{tag}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows in an Arrow batch than the default, as one text can be very long; never more than are set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)


_CACHES: dict[str, Callable[[], None]] = {}


def only_cache(name: str, clear: Callable[[], None]) -> None:
    """Names what this process keeps from task to task; what other operators have kept before is cleared, as workers outlive stages."""
    for other in [k for k in _CACHES if k != name]:
        _CACHES.pop(other)()
    _CACHES[name] = clear


def give_back() -> None:
    """Return freed memory to the system, which allocators else keep while the worker waits for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives memory back at the end of each task."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return f


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (a folder for each value of ``by``) and read it again: cuts lineage and survives lost executors.

    What an operator has written for itself it gives to :func:`discard` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    gc.collect()  # shuffle files of what is now written go when the driver's objects do
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, *written: DataFrame | str | None) -> None:
    """Delete written tables (results of :func:`materialize`) or folders of the shared folder, which nothing may read any more."""
    for x in written:
        path = x if isinstance(x, str) or x is None else getattr(x, "scratch_path", None)
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; understands Hadoop's names of schemes."""
    import pyarrow.fs as pfs

    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("file:///", "/"), ("file:/", "/")):
        if uri.startswith(hadoop):
            uri = arrow + uri[len(hadoop) :]
    if uri.startswith("/"):
        return pfs.LocalFileSystem(), uri
    return pfs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: to a name of its own, then renamed, so that a repeated task does no harm."""
    fs, path = filesystem(uri)
    parent = path.rpartition("/")[0]
    fs.create_dir(parent, recursive=True)
    part = f"{parent}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def get_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def texts(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``limit`` bytes of text each (one longer text alone)."""
    col = batch.column(batch.schema.get_field_index(name))
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def constant(values: list, kind: str) -> Column:
    """An array of numbers as one literal: an expression for each would keep the optimizer busy."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


#: Ranges at most: their bounds are literals of the plan. Tasks stream through larger ranges, sorted by Spark with spilling.
MOST_RANGES = 20_000


def range_buckets(df: DataFrame, key: str, size: str | None = "text", target: int = 24 << 20, least: int = 1) -> tuple[DataFrame, list[int], int]:
    """``df`` with ``_bucket``, an int that rises with ``key``; the bounds; the number of buckets.

    Bounds are approximate quantiles of the key (only the key and the text's length are read),
    so buckets hold about ``target`` bytes, or more where ``MOST_RANGES`` would hold less than all. Equal keys share a bucket; null keys go to bucket 0.
    """
    length = F.sum(F.octet_length(size)) if size else F.count("*") * 64
    total, count = df.agg(length, F.count("*")).first()
    n = max(least, -(-int(total or 0) // target))
    n = min(n, MOST_RANGES, max(1, int(count or 0)))
    if n == 1:
        return df.withColumn("_bucket", F.lit(0)), [], 1
    cuts = [i / n for i in range(1, n)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, cuts, max(10_000, 20 * n))).first()[0] or []))
    at = F.coalesce(F.array_size(F.filter(constant(bounds, "bigint"), lambda b: b < F.col(key))), F.lit(0)) if len(bounds) <= 64 else None
    if at is None:  # two levels, so that the search isn't linear in the number of buckets
        step = 64
        tops = bounds[step - 1 :: step]
        parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        block = F.array_size(F.filter(constant(tops, "bigint"), lambda b: b < F.col(key)))
        table = F.array(*[constant(p, "bigint") for p in parts])
        inside = F.array_size(F.filter(F.coalesce(F.try_element_at(table, block + 1), constant([], "bigint")), lambda b: b < F.col(key)))
        at = F.coalesce(block * step + inside, F.lit(0))
    return df.withColumn("_bucket", at.cast("int")), [int(b) for b in bounds], len(bounds) + 1


def by_hash(df: DataFrame, key: str, n: int, count: int) -> DataFrame:
    """About ``n`` of the ``count`` rows of ``df``: those whose key's hash is below a bound. What is gathered doesn't grow with the table."""
    if count <= n:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, n / count)))


#: Bits of a Bloom filter at least and at most (16 MB). It is never wrong about a member; beyond about 11 million ids it lets more and more others pass, so that more rows than needed are shuffled.
BLOOM_BITS = (1 << 16, 1 << 27)


def bloom(ids: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter (two bits an id) of a column of longs, of bounded size: words of bits are or-ed by Spark."""
    n = ids.count()
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << (12 * max(1, n)).bit_length()))
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(2)]))
    words = ids.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.v
    return out


def _xxhash64(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long by a seed."""
    u = np.uint64
    p1, p2, p3, p4, p5 = (u(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, k: (v << u(k)) | (v >> u(64 - k))
    h = seed + p5 + u(8)
    h = h ^ (rot(x * p2, 31) * p1)
    h = rot(h, 27) * p1 + p4
    h ^= h >> u(33)
    h *= p2
    h ^= h >> u(29)
    h *= p3
    return h ^ (h >> u(32))


def _xxhash64_int(v: int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int by a seed."""
    u = np.uint64
    p1, p2, p3, p5 = (u(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = seed + p5 + u(4)
    h = h ^ (np.full(len(seed), v, u) * p1)
    h = ((h << u(23)) | (h >> u(41))) * p2 + p3
    h ^= h >> u(33)
    h *= p2
    h ^= h >> u(29)
    h *= p3
    return h ^ (h >> u(32))


def may_hold(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which of the ids the filter may hold; no null."""
    x = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    ok = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
    first = _xxhash64(x, np.full(len(x), 42, np.uint64))
    for i in range(2):
        b = _xxhash64_int(i, first).view(np.int64) % (64 * len(bits))
        ok &= (bits[b >> 6] >> (b & 63)) & 1 == 1
    return ok
