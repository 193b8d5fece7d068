"""WARC archives as a PySpark Python data source, with a writer that turns equal payloads into revisits.

Reading: each file is a partition (small ones share one). Filters on the record's type, id, URI, digest,
date, length and referred id are pushed into the scan: a record's header is parsed first, and the block of a
record that isn't wanted is skipped by seeking. ``payload=none`` skips all payloads. Of compressed archives each record is a
member that tells its own size in an extra field of its header, so that only as much of it is inflated as is read and the
next one is found by seeking; members without that field (of other writers) have to be inflated to find their ends.

Edge cases: a null payload is written as an empty one; null URIs have no header; control characters in
header values are percent-encoded; rows with the same id and payload are all responses (an id never
refers to itself); a null id is written without a record id and read back as null; an empty table gives no
file and an empty table back; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quillspan.llm import common

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_length long, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Header names of the WARC 1.1 standard.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INPUT = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict) -> bytes:
    """A response (HTTP header and payload) or a revisit (HTTP header alone, which keeps the payload's length)."""
    body = row["payload"] or b""
    size = len(body) if row["payload_bytes"] is None else row["payload_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if row["record_type"] == "revisit" else body)
    lines = ["WARC/1.1"]
    for name, header in HEADERS.items():
        if (v := row[name]) is not None:
            v = safe(v)
            lines.append(f"{header}: {f'sha1:{v}' if name == 'payload_digest' else f'<{v}>' if name in ('record_id', 'refers_to') else v}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


#: A gzip member's header with an extra field (deflate, no time, unknown system), and the field's two letters.
GZIP_HEAD, FIELD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", b"QS"


def member(data: bytes) -> bytes:
    """A gzip member with its own size in an extra field."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = len(GZIP_HEAD) + 2 + 12 + len(body) + 8
    return GZIP_HEAD + struct.pack("<H2sHQ", 12, FIELD, 8, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_size(f: io.BufferedReader) -> int | None:
    """The size of the member that begins at the file's place, which is left after its header; None if it doesn't tell."""
    head = f.read(len(GZIP_HEAD) + 14)
    if len(head) < len(GZIP_HEAD) + 14 or not head.startswith(GZIP_HEAD[:4]):
        return None
    extra, field, n, size = struct.unpack("<H2sHQ", head[len(GZIP_HEAD) :])
    return size if (extra, field, n) == (12, FIELD, 8) else None


class Inflated(io.RawIOBase):
    """The content of one member, inflated as it is read."""

    def __init__(self, f: io.BufferedReader, size: int) -> None:
        self.f, self.left, self.z, self.tail = f, size, zlib.decompressobj(-15), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:  # noqa: ANN001
        while not self.z.eof:
            if not self.tail:
                self.tail = self.f.read(min(self.left, 16 << 10))
                self.left -= len(self.tail)
                if not self.tail:
                    raise ValueError("a compressed record ends early")
            got = self.z.decompress(self.tail, len(out))
            self.tail = self.z.unconsumed_tail
            if got:
                out[: len(got)] = got
                return len(got)
        return 0


@dataclass
class FileSet(InputPartition):
    files: list[str] = field(default_factory=list)

    def __init__(self, files: list[str]) -> None:
        super().__init__(files)
        self.files = files


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Files of about ``file_bytes``; they get their names only when the whole job is committed."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("file_bytes", 64 << 20))
        self.gzip = options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = common.filesystem(self.path)
        fs.create_dir(path, recursive=True)
        parts: list[tuple[str, str]] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    parts.append((f"{path}/.{name}", f"{path}/{name}"))
                    out, size = fs.open_output_stream(parts[-1][0], compression=None), 0
                data = record_bytes(row)
                data = member(data) if self.gzip else data
                out.write(data)
                size += len(data)
                if size >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(parts)

    def commit(self, messages: list) -> None:
        fs, path = common.filesystem(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for a, b in m.parts if m else ():
                fs.move(a, b)

    def abort(self, messages: list) -> None:
        fs, _ = common.filesystem(self.path)
        for m in messages:
            for a, _ in m.parts if m else ():
                fs.delete_file(a)


def keeps(filters: list, row: dict) -> bool:
    """Whether a header meets the pushed filters (a null meets none but IsNull)."""
    for f in filters:
        v = row[f.attribute[0]]
        if isinstance(f, IsNull):
            ok = v is None
        elif isinstance(f, EqualNullSafe):
            ok = v == f.value
        elif v is None:
            ok = False
        elif isinstance(f, EqualTo):
            ok = v == f.value
        elif isinstance(f, In):
            ok = v in f.value
        elif isinstance(f, GreaterThan):
            ok = v > f.value
        elif isinstance(f, GreaterThanOrEqual):
            ok = v >= f.value
        elif isinstance(f, LessThan):
            ok = v < f.value
        elif isinstance(f, LessThanOrEqual):
            ok = v <= f.value
        elif isinstance(f, StringStartsWith):
            ok = v.startswith(f.value)
        elif isinstance(f, StringEndsWith):
            ok = v.endswith(f.value)
        elif isinstance(f, StringContains):
            ok = f.value in v
        else:
            ok = True
        if not ok:
            return False
    return True


PUSHED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "decode") != "none"
        self.verify = options.get("verify", "false") == "true"
        self.group = int(options.get("partition_bytes", 32 << 20))
        self.filters: list = []

    def pushFilters(self, filters: list):
        for f in filters:
            if isinstance(f, PUSHED) and len(f.attribute) == 1 and (f.attribute[0] in HEADERS or f.attribute[0] == "content_length"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[FileSet]:
        import pyarrow.fs as pfs

        fs, path = common.filesystem(self.path)
        if fs.get_file_info(path).type == pfs.FileType.File:
            return [FileSet([self.path])]
        found = sorted((i.path, i.size) for i in fs.get_file_info(pfs.FileSelector(path, recursive=True, allow_not_found=True)) if i.is_file and re.search(r"\.warc(\.gz)?$", i.path) and not re.search(r"/[._][^/]*$", i.path))
        sets: list[FileSet] = []
        held, size = [], 0
        for p, n in found:
            if held and size + n > self.group:
                sets.append(FileSet(held))
                held, size = [], 0
            held.append(p)
            size += n
        return [*sets, FileSet(held)]

    def read(self, partition: FileSet) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        fs, _ = common.filesystem(self.path)
        rows, size = [], 0
        for path in partition.files:
            path = common.filesystem(path)[1]
            for row in self.records(fs, path):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, fs, path: str) -> Iterator[dict]:
        with io.BufferedReader(fs.open_input_file(path), 1 << 18) as f:
            if not path.endswith(".gz"):
                yield from self.parsed(f, path)
                return
            while f.peek(1):
                start = f.tell()
                size = member_size(f)
                if size is None:  # of another writer
                    f.seek(start)
                    yield from self.parsed(gzip.GzipFile(fileobj=f), path)
                    return
                yield from self.parsed(io.BufferedReader(Inflated(f, size - len(GZIP_HEAD) - 22), 16 << 10), path, once=True)
                f.seek(start + size)

    def parsed(self, f, path: str, once: bool = False) -> Iterator[dict]:
        """Rows of the records of a stream, or of its first one, whose rest isn't read then."""
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no WARC header at {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.lower()] = v.strip()
            left = length = int(head["content-length"])
            row = {name: head.get(h.lower()) for name, h in HEADERS.items()}
            for k in ("record_id", "refers_to"):
                if row[k] is not None:
                    row[k] = row[k][1:-1]
            if row["payload_digest"]:
                row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
            row |= {"content_length": length, "payload_bytes": None, "payload": None}
            if keeps(self.filters, row):
                http = b""
                if head.get("content-type", "").startswith("application/http"):
                    while left and (line := f.readline(left)):
                        http += line
                        left -= len(line)
                        if not line.strip():
                            break
                if row["record_type"] == "revisit":
                    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                    row["payload_bytes"] = int(m[1]) if m else None
                else:
                    row["payload_bytes"] = left
                    if self.payload:
                        row["payload"] = f.read(left)
                        if len(row["payload"]) < left:
                            raise ValueError(f"{path}: a record ends early")
                        left = 0
                        if self.verify and base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != row["payload_digest"]:
                            raise ValueError(f"{path}: {row['record_id']} has another digest than its header says")
                yield row
            if once:
                return
            f.seek(left, 1)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", **options: str) -> None:
    """Write a record per row. Of rows with equal payloads of at least ``least_bytes``, the smallest key is the response.

    The smallest key of each digest is found on keys and digests alone, pre-aggregated. Payloads of rows that can't be
    revisits (by a Bloom filter of these) are written where they are read; those of the others, hardly more than the revisits', are
    shuffled to learn which they are, and only without what a revisit leaves out.
    """
    spark = df.sparkSession
    register(spark)
    common.small_batches(spark)
    src = df.select(F.col(key).alias("k"), F.col(uri).cast("string").alias("u"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "utf-8").alias("p"))
    src = src.withColumns({"d": F.sha1("p"), "n": F.octet_length("p").cast("long")}).withColumn("h", F.xxhash64("k", "d"))
    keys = src.select("k", "d", "n", "h").where(F.col("n") >= least_bytes)
    first = keys.groupBy("d", "n").agg(F.min("k").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = common.materialize(keys.join(first.hint("merge"), ["d", "n"]).where("k <> first").groupBy("k", "d", "h").agg(F.min("first").alias("first")), "revisits")
    may = common.bloom(again, "h")

    def split(inside: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(common.may_hold(may, batch.column("h")) == inside))

        return src.mapInArrow(common.lean(run), src.schema)

    seen = split(True).join(again.drop("h").hint("merge"), ["k", "d"], "left")
    rows = split(False).withColumn("first", F.lit(None).cast(df.schema[key].dataType)).unionByName(seen)
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    out = rows.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("k")).alias("record_id"), F.col("u").alias("target_uri"), F.lit(date).alias("date"), base32(F.col("d")).alias("payload_digest"), name(F.col("first")).alias("refers_to"), F.col("n").alias("payload_bytes"), F.when(~revisit, F.col("p")).alias("payload"))
    out.write.format("warc").options(**options).mode("append").save(path)
    common.discard(spark, again)


def base32(hexes):
    """Base32 of 40 hexadecimal digits, natively: five digits are four letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for i in range(8):
        word = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(alphabet), F.shiftright(word, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
