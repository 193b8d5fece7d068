"""More registered queries: texts of varied shapes, values from the tables, with SQL that says what comes out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as fx
from quillspan.kernels import extract as ke
from quillspan.operators import document, extract, markdown
from quillspan.plans.queries import docs
from quillspan.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def shaped(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A text for each document, by an expression that both engines understand."""
    return docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", F.expr(text).alias("text"))


def folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quillspan-')}"
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


HEADS = "concat('## ', lang, ' Ünïcode - ', source, ' -- (', cast(n_chars as varchar(20)), ')!', chr(10), chr(10), '### ÉTÉ', chr(10))"


@query("""select doc_id, concat(lang, ' Ünïcode - ', source, ' -- (', n_chars, ')!') as text,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(concat(lang, ' Ünïcode - ', source, ' -- (', n_chars, ')!')), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') anchor from documents
union all select doc_id, 'ÉTÉ', 't' from documents""")
def md_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of headings with letters that they leave out."""
    return markdown.toc(shaped(spark, sf_dir, HEADS)).select("doc_id", "text", "anchor")


NESTED = "concat('> - a ', lang, chr(10), '>   - b *', source, '*', chr(10), '>', chr(10), '> tail', chr(10), chr(10), '3. x', chr(10), '   > q ', cast(n_chars as varchar(20)), chr(10), '4. y', chr(10))"
NODES = """[('document', 0, ''), ('blockquote', 1, ''), ('list', 2, ''), ('listItem', 3, ''), ('textBlock', 4, ''), ('text', 5, 'a ' || lang), ('list', 4, ''), ('listItem', 5, ''), ('textBlock', 6, ''), ('text', 7, 'b '),
 ('emphasis', 7, ''), ('text', 8, source), ('paragraph', 2, ''), ('text', 3, 'tail'), ('list', 1, ''), ('listItem', 2, ''), ('textBlock', 3, ''), ('text', 4, 'x'), ('blockquote', 3, ''), ('paragraph', 4, ''), ('text', 5, 'q ' || n_chars),
 ('listItem', 2, ''), ('textBlock', 3, ''), ('text', 4, 'y')]"""
NODE_ROWS = f"n as (select doc_id, unnest({NODES}) x, unnest(range(0, 24))::int node_id from documents)"


@query(f"with {NODE_ROWS} select doc_id, node_id, x[1] as type, x[2]::int depth, x[3] as text from n")
def md_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and quotes within each other."""
    return markdown.nodes(shaped(spark, sf_dir, NESTED)).select("doc_id", "node_id", "type", "depth", "text")


@query(f"with {NODE_ROWS} select doc_id, node_id from n where node_id in (0, 1, 2, 12, 13, 14)")
def md_walk_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor that doesn't go below lists."""
    return markdown.walk(markdown.nodes(shaped(spark, sf_dir, NESTED)), skip=F.col("type") == "list").select("doc_id", "node_id")


@query("""select doc_id, concat('<blockquote>', chr(10), '<ul>', chr(10), '<li>a ', lang, chr(10), '<ul>', chr(10), '<li>b <em>', source, '</em></li>', chr(10), '</ul>', chr(10), '</li>', chr(10), '</ul>', chr(10), '<p>tail</p>', chr(10), '</blockquote>', chr(10),
 '<ol start="3">', chr(10), '<li>x', chr(10), '<blockquote>', chr(10), '<p>q ', n_chars, '</p>', chr(10), '</blockquote>', chr(10), '</li>', chr(10), '<li>y</li>', chr(10), '</ol>', chr(10)) html from documents""")
def md_nested_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.html(shaped(spark, sf_dir, NESTED)).select("doc_id", "html")


@query("select doc_id, case when doc_id % 3 = 0 then 'heading' else '' end as type from documents where doc_id % 3 <> 2")
def md_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes made invalid: headings of level 9, and nodes without a type."""
    heads = markdown.nodes(shaped(spark, sf_dir, "concat('# ', source)"), types=("heading",))
    level, kind = F.when(F.col("doc_id") % 3 == 0, 9).otherwise(F.col("level")), F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("type"))
    return markdown.invalid(heads.withColumns({"level": level, "type": kind})).select("doc_id", "type")


FENCES = """concat('~~~yaml a', chr(10), 'k: ', cast(n_chars as varchar(20)), chr(10), '~~~', chr(10), '  ```', source, chr(10), '{', chr(34), 'a', chr(34), ':1}', chr(10), '  ```', chr(10), '```json', chr(10), '{', chr(34), lang, chr(34), ':2}', chr(10))"""


@query("""select doc_id, unnest([0, 1, 2])::int ordinal, unnest(['yaml', case when source in ('json', 'yaml') then source else '-' end, 'json']) format, unnest([concat('k: ', n_chars, chr(10)), concat('{"a":1}', chr(10)), concat('{"', lang, '":2}', chr(10))]) as text,
  unnest([0.95, 0.95, 0.6])::double confidence from documents""")
def extract_fence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tildes, indented fences and one that isn't closed."""
    out = extract.candidates(shaped(spark, sf_dir, FENCES), "markdowncodeblocks", ke.Options(include_diagnostics=True))
    return out.select("doc_id", "ordinal", F.when(F.col("format").isin("json", "yaml"), F.col("format")).otherwise("-").alias("format"), "text", "confidence")


RAW = """case doc_id % 5 when 0 then concat('{', chr(34), 'n', chr(34), ': ', cast(n_chars as varchar(20)), '}') when 1 then concat('{', chr(39), 'n', chr(39), ': ', cast(n_chars as varchar(20)), ',}')
  when 2 then concat('lang: ', lang, chr(10), 'size: ', cast(n_chars as varchar(20)), chr(10)) when 3 then concat('size:', cast(n_chars as varchar(20)), chr(10), 'lang: ', lang, chr(10), 'lang: ', source) else concat('plain words about ', lang) end"""


@query("""select doc_id, case when doc_id % 5 in (2, 3) then 'yaml' else 'json' end format, case doc_id % 5 when 0 then 0.98 when 1 then 0.75 when 2 then 0.9 else 0.7 end::double confidence from documents where doc_id % 5 < 4""")
def extract_raw_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts: valid JSON, JSON to repair, YAML, YAML that can't be mended (a key twice), and prose (no candidate)."""
    return extract.candidates(shaped(spark, sf_dir, RAW), "rawstructured").select("doc_id", "format", "confidence")


@query("select doc_id, unnest([0, 1])::int ordinal, unnest(['yaml', '-'])  format from documents")
def extract_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of three candidates, in order of place."""
    out = extract.first_n(extract.candidates(shaped(spark, sf_dir, FENCES.replace("source", "'sql'")), "markdowncodeblocks", ke.Options(include_diagnostics=True)), 2)
    return out.select("doc_id", "ordinal", F.when(F.col("format").isin("json", "yaml"), F.col("format")).otherwise("-").alias("format"))


ISSUES = "concat('name:', lang, chr(10), 'tags:', chr(10), chr(9), '-', source, chr(10), 'n: ', cast(n_chars as varchar(20)), chr(10), case when doc_id % 2 = 0 then concat('-x', chr(10)) else '' end)"


@query("""select doc_id, unnest(['list_dash_no_space', 'missing_space_after_colon', 'tab_indent']) rule, unnest([case when doc_id % 2 = 0 then 2 else 1 end, 1, 1])::bigint n from documents""")
def yaml_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.lint(shaped(spark, sf_dir, ISSUES), "yaml").where("rule not in ('parse_error', 'duplicate_key')")
    return out.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query(r"""with e as (select doc_id, regexp_replace(source, '([\\*_`\[\]<>])', '\\\1', 'g') s, lang, n_chars from documents)
select doc_id, concat('*', s, '* **', s, '** [', s, '](<a b/', n_chars, '>) [', lang, '](b/', n_chars, ') ``x`', n_chars, '`` > [!NOTE] ', lang, chr(10), '> one', chr(10), '> ', n_chars) markdown from e""")
def build_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emphasis, links, code spans and a callout, as column functions."""
    s, n = F.col("source"), F.col("n_chars").cast("string")
    parts = [fx.emphasis(s), fx.strong(s), fx.link(s, F.concat(F.lit("a b/"), n)), fx.link(F.col("lang"), F.concat(F.lit("b/"), n)), fx.code(F.concat(F.lit("x`"), n)), fx.callout("note", F.col("lang"), F.concat(F.lit("one\n"), n))]
    return docs(spark, sf_dir).select("doc_id", F.concat_ws(" ", *parts).alias("markdown"))


FRONT = """concat('---', chr(10), 'whole: ', cast(n_chars as varchar(20)), '.0', chr(10), 'half: 2.5', chr(10), 'flag: true', chr(10), 'one: 1', chr(10), 'yes: ', chr(34), ' true ', chr(34), chr(10), 'num: ', chr(34), ' ', cast(n_chars as varchar(20)), ' ', chr(34), chr(10), '---', chr(10), source)"""


@query("""select doc_id, n_chars::varchar whole, '2.5' half, 'true' flag, 'none' missing, n_chars::double num, -1::double flag_number, true yes, false one from documents""")
def doc_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one type asked for as another."""
    p = document.parse(shaped(spark, sf_dir, FRONT))
    text, number, truth = document.get_string, document.get_number, document.get_bool
    return p.select("doc_id", text("whole").alias("whole"), text("half").alias("half"), text("flag").alias("flag"), text("missing", "none").alias("missing"), number("num").alias("num"), number("flag", -1.0).alias("flag_number"), truth("yes").alias("yes"), truth("one").alias("one"))


@query("select n_regionkey::int n_regionkey, concat(string_agg(n_name, chr(10) order by n_nationkey), chr(10)) as text from nation group by 1")
def files_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files written, then read as whole texts."""
    at = folder(spark)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n.repartition(1).sortWithinPartitions("n_regionkey", "n_nationkey").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(at)
    return files.read_texts(spark, f"{at}/*").select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("n_regionkey"), "text")


@query("""select n_regionkey::int n_regionkey, concat('{"region": ', n_regionkey, ', "names": [', string_agg(concat('"', n_name, '"'), ', ' order by n_nationkey), ']}') as value from nation group by nation.n_regionkey""")
def files_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files written, then read as values."""
    at = folder(spark)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    n.select("n_regionkey", F.to_json(F.struct(F.col("n_regionkey").alias("region"), "names")).alias("value")).repartition(1).write.partitionBy("n_regionkey").text(at)
    return files.read_data(spark, f"{at}/*").select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("n_regionkey"), "value")


@query("select c_custkey, c_name, c_mktsegment from customer")
def files_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    files.write_rows(c, at)
    return spark.read.schema(c.schema).json(at)


@query(r"select count(*)::bigint as rows, sum(len(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))::bigint bytes from documents where text is not null")
def files_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text sink says that it has written."""
    return files.write_texts(docs(spark, sf_dir).where("text is not null"), folder(spark)).select("rows", "bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
