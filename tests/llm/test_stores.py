import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex

from quillspan.llm import token_store as ts
from quillspan.llm import warc

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_match_the_pattern():
    rng = random.Random(1)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(1500):
        texts = ["".join(rng.choices("ab '’\n\t 1²é!?'s'll're  中　x", k=rng.randint(0, 25))) for _ in range(4)]
        joined = "".join(texts)
        if not joined:
            continue
        sizes = np.array(list(map(len, texts)))
        first = np.cumsum(sizes) - sizes
        got = ts.pretokens(np.frombuffer(joined.encode("utf-32-le"), np.uint32), first[sizes > 0]).tolist()
        assert got == [int(f) + m.start() for f, t in zip(first, texts) for m in pattern.finditer(t)]


TEXTS = ["", "Hello world's  end\n\n", "naïve 中文 🙂🙂 'll 12345", "a<|endoftext|>b", "  lead", "x" * 5000, "\x00\x7f tab\tx "]


def test_encoder_matches_the_library():
    enc = ts.Encoder(PATH)
    flat, per = enc.encode(TEXTS)
    assert flat.tolist() == [i for t in TEXTS for i in enc.plain(t)] and per.tolist() == [len(enc.plain(t)) for t in TEXTS]
    enc.LIMIT = 10  # starts anew again and again
    assert enc.encode(TEXTS)[0].tolist() == flat.tolist()


@pytest.mark.parametrize("top", [1, 200, 60_000, 1 << 20, 1 << 32])
def test_shards_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 513, 5000):
        ids = rng.integers(0, top, n).astype(np.uint32)
        sizes = [n // 3, 0, n - n // 3]
        s = ts.Shard(ts.shard_bytes([5, 6, 7], sizes, ids))
        assert s.tokens().tolist() == ids.tolist() and len(s) == n
        assert all(s.token(i) == ids[i] for i in range(0, n, 37)) and s.document(2).tolist() == ids[n // 3 :].tolist() if n < 600 else True


@pytest.mark.parametrize("target", [24 << 20, 900])
def test_corpus_matches_brute_force(spark, monkeypatch, target):
    real = ts.write_shards
    monkeypatch.setattr(ts, "write_shards", lambda *a: real(*a, shard_bytes_target=target))
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)] + str(i), "x") for i in range(50)] + [(60, None, "x"), (61, "", "x"), (3, "tie", "x"), (None, "no id", "x")]
    got = ts.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3), PATH).collect()
    enc, start, want = ts.Encoder(PATH), 0, []
    for k, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*enc.plain(t or ""), 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str((r.key, r.start, r.n_tokens, r.ids_crc32)) for r in got)


def test_empty_corpus(spark):
    assert ts.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


PAGES = [(1, "http://a/\n", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é🙂\r\n\r\nWARC/1.1\r\n"), (5, "http://e", "é🙂\r\n\r\nWARC/1.1\r\n"), (6, "http://f", "same"), (None, "http://g", "alone")]


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("least", [0, 1])
def test_archive_round_trip(spark, tmp_path, compression, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    warc.write_archive(df, str(tmp_path / "w"), least_bytes=least, compression=compression, file_bytes="300")
    rows = warc.read_archive(spark, str(tmp_path / "w"), verify="true").collect()
    first = {}
    for k, _, h in PAGES:
        if k is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", k), k)
    want = []
    for k, _, h in PAGES:
        b = (h or "").encode()
        again = k is not None and first.get(h or "", k) != k
        want.append(("revisit" if again else "response", f"urn:page:{k}" if k is not None else None, base64.b32encode(hashlib.sha1(b).digest()).decode(), f"urn:page:{first[h or '']}" if again else None, len(b), None if again else b))
    assert sorted(map(str, want)) == sorted(str((r.record_type, r.record_id, r.payload_digest, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload))) for r in rows)
    assert {r.target_uri for r in rows} == {None, "http://a/%0A", "http://c", "http://d", "http://e", "http://f", "http://g"}


def test_pushed_filters(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    read = warc.read_archive(spark, str(tmp_path / "w"))
    assert read.where("record_type = 'revisit' and record_id = 'urn:page:6'").count() == 1
    assert read.where("target_uri like 'http://%' and content_length > 0 and refers_to is null").count() == 5
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_bytes",), 4)])) == [EqualTo(("payload_bytes",), 4)]
    assert {r.payload for r in warc.read_archive(spark, str(tmp_path / "w"), payload="none").collect()} == {None}


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


class Counting:
    """A file system of one file that counts what is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def open_input_file(self, path):
        import io

        outer = self

        class Raw(io.BytesIO):
            def readinto(self, b):
                n = super().readinto(b)
                outer.read += n
                return n

        return Raw(self.data)


def some_records():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(6):
        body = rng.integers(0, 256, 3_000_000).astype(np.uint8).tobytes() if i != 4 else b"small"
        rows.append({"record_type": "response", "record_id": f"urn:page:{i}", "target_uri": None, "date": "2024", "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(), "refers_to": None, "payload_bytes": None, "payload": body})
    return rows


def test_compressed_payloads_are_skipped_by_seeking():
    import gzip

    from pyspark.sql.datasource import EqualTo

    rows = some_records()
    own = b"".join(warc.member(warc.record_bytes(r)) for r in rows)
    assert gzip.decompress(own) == b"".join(map(warc.record_bytes, rows))  # other readers read it as usual
    for options, wanted in (({"payload": "none"}, None), ({}, "urn:page:4")):
        reader = warc.WarcReader({"path": "x", **options})
        if wanted:
            list(reader.pushFilters([EqualTo(("record_id",), wanted)]))
        fs = Counting(own)
        got = list(reader.records(fs, "a.warc.gz"))
        assert fs.read < 0.2 * len(own)
        assert [r["payload_bytes"] for r in got] == ([5] if wanted else [len(r["payload"]) for r in rows])
        assert [r["payload"] for r in got] == ([b"small"] if wanted else [None] * 6)


@pytest.mark.parametrize("one_member", [True, False])
def test_archives_of_other_writers(one_member):
    import gzip

    rows = some_records()[3:]
    parts = [warc.record_bytes(r) for r in rows]
    data = gzip.compress(b"".join(parts)) if one_member else warc.member(parts[0]) + b"".join(map(gzip.compress, parts[1:]))
    got = list(warc.WarcReader({"path": "x", "verify": "true"}).records(Counting(data), "a.warc.gz"))
    assert [r["payload"] for r in got] == [r["payload"] for r in rows]
    plain = list(warc.WarcReader({"path": "x", "payload": "none"}).records(Counting(b"".join(parts)), "a.warc"))
    assert [r["payload_bytes"] for r in plain] == [len(r["payload"]) for r in rows]
