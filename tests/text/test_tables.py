import duckdb
import pytest

from quillspan.kernels.chunking import lines
from quillspan.operators import chunk, document, extract
from quillspan.plans import queries as first
from quillspan.plans import shapes
from quillspan.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "events", "nation", "customer"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def flat(rows, names):
    return sorted(repr([list(v) if isinstance(v, (list, tuple)) else v for v in (r[names.index(n)] for n in sorted(names))]) for r in rows)


ORACLES, QUERIES = first.oracle_sql() | shapes.oracle_sql(), first.queries() | shapes.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert flat([tuple(r) for r in df.collect()], df.columns) == flat(want.fetchall(), want.columns)


def test_native_lines_match_kernel(spark):
    rows = [(i, t) for i, t in enumerate(["", "a", "é🙂\r\nb\n\nc", "\n\n", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (True, False):
        got = sorted((r.doc_id, r.ordinal, r.kind, r.text, r.start_byte, r.end_rune, r.start_line) for r in chunk.native_lines(df, keep_terminators=keep).collect())
        assert got == [(i, s.ordinal, s.kind, s.text, s.start_byte, s.end_rune, s.start_line) for i, t in rows if t is not None for s in lines(t, keep)]


def test_errors_become_rows_or_fail(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r.error for r in chunk.pack(df, "lines", 3, oversized="error").collect()}
    assert "span_exceeds_budget" in got[1] and got[2] is None
    with pytest.raises(Exception, match="span_exceeds_budget"):
        chunk.pack(df, "lines", 3, oversized="error", errors="failfast").collect()
    assert document.parse(df).count() == 2 and extract.candidates(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": [1]}')
    (tmp_path / "b.yaml").write_text("k: v\n")
    got = {r.path.rsplit("/")[-1]: r.value for r in files.read_data(spark, str(tmp_path)).collect()}
    assert got == {"a.json": '{"k": [1]}', "b.yaml": '{"k": "v"}'}
    df = spark.createDataFrame([("é🙂",)], "text string")
    assert files.write_texts(df, str(tmp_path / "out")).first().bytes == 3


@pytest.mark.parametrize("as_folder", [False, True])
def test_stream_reads_tables_of_one_file_or_many(spark, tmp_path, as_folder):
    df = spark.createDataFrame([(i, "a\nb\n" * (i + 1)) for i in range(9)], "doc_id long, text string")
    path = tmp_path / "sf" / "documents.parquet"
    df.coalesce(1).write.parquet(str(tmp_path / "sf" / "old" / "documents.parquet"))  # not of this table
    if as_folder:
        df.repartition(3).write.parquet(str(path))
    else:
        df.coalesce(1).write.parquet(str(tmp_path / "one"))
        next((tmp_path / "one").glob("*.parquet")).rename(path)
    got = first.queries()["stream_lines"](spark, str(tmp_path / "sf")).collect()
    assert sorted(map(tuple, got)) == [(i, 2 * (i + 1)) for i in range(9)]


def test_blocks_of_documents_with_nulls_match_sql(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "a\nb", None, "s", 3), (3, "é🙂", "de", None, 2), (4, "a", "de", "s", None), (5, None, None, None, None), (6, "", "", "", 0), (7, "a\n\nb", "en", "s", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = first.queries()["md_blocks"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(first.oracle_sql()["md_blocks"])
    assert {r.doc_id for r in df.collect()} == set(range(1, 8))
    assert flat([tuple(r) for r in df.collect()], df.columns) == flat(want.fetchall(), want.columns)
