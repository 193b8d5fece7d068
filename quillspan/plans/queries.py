"""The registered queries of the text operators, with SQL oracles that state the same results in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as fx
from quillspan.kernels import document as kd
from quillspan.kernels import extract as ke
from quillspan.kernels import sanitize as kz
from quillspan.kernels import template as kt
from quillspan.operators import build, chunk, document, extract, markdown
from quillspan.streaming import stream

#: A Markdown document for each row: front matter, headings, paragraphs, a fence and a tag. Runs in both engines.
VIEW = """concat('---', chr(10), 'title: Doc ', cast(doc_id as varchar(20)), chr(10), 'lang: ', lang, chr(10), 'source: ', source, chr(10),
  'n_chars: ', cast(n_chars as varchar(20)), chr(10), '---', chr(10), {body})"""
BODY = """concat('# ', source, chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10),
  '## Meta', chr(10), chr(10), '```json meta', chr(10), '{{"doc_id": ', cast(doc_id as varchar(20)), ', "lang": "', lang, '"}}', chr(10), '```', chr(10), chr(10),
  '<payload kind="', lang, '">', 'n: ', cast(n_chars as varchar(20)), '</payload>', chr(10))""".replace("{{", "{").replace("}}", "}")
LINKED = """concat('Head [', source, '](https://x.org/', cast(doc_id as varchar(20)), ' "', lang, '")', chr(10), chr(10), '![pic of *', lang, '*](p', cast(doc_id as varchar(20)), '.png)', chr(10), chr(10), '- item ', lang, chr(10), '- **n** ', cast(n_chars as varchar(20)), chr(10))"""
MD = f"md as (select doc_id, lang, source, n_chars, text, {BODY} b from documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.expr(VIEW.format(body=BODY)).alias("text"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are left out of a body, as ``concat`` of the SQL does; Spark's would make the whole body null."""
    return docs(spark, sf_dir).select("doc_id", F.expr(BODY.replace("concat(", "concat_ws('', ")).alias("text"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.expr(LINKED).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


SPAN_COLUMNS = ("doc_id", "ordinal", "kind", "text", "start_byte", "end_byte", "start_rune", "end_rune", "start_line")


def pieces_sql(source: str, pattern: str, kind: str, text: str = "text", with_line: bool = True) -> str:
    """Spans of all matches of a pattern that covers the text, with offsets as running sums."""
    line = ", cast(1 + coalesce(sum(len(s) - len(replace(s, chr(10), ''))) over w, 0) as int) start_line" if with_line else ""
    return f"""with {source} p as (select doc_id, unnest(regexp_extract_all({text}, '{pattern}')) s, generate_subscripts(regexp_extract_all({text}, '{pattern}'), 1) - 1 k from src)
select doc_id, cast(k as int) ordinal, {kind} kind, s as text, cast(coalesce(sum(strlen(s)) over w, 0) as int) start_byte, cast(coalesce(sum(strlen(s)) over w, 0) + strlen(s) as int) end_byte,
  cast(coalesce(sum(len(s)) over w, 0) as int) start_rune, cast(coalesce(sum(len(s)) over w, 0) + len(s) as int) end_rune{line}
from p window w as (partition by doc_id order by k rows between unbounded preceding and 1 preceding)"""


RAW = "src as (select doc_id, text from documents),"
BODIES = f"{MD}, src as (select doc_id, b as text from md),"


@query(pieces_sql(RAW, r"[^\n]*\n|[^\n]+", "'line'"))
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.native_lines(docs(spark, sf_dir))


@query(pieces_sql(RAW, r"\n|[^\n]+", "case when s = chr(10) then 'lineTerminator' else 'line' end"))
def chunk_lines_split_terminators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.native_lines(docs(spark, sf_dir), keep_terminators=False)


@query(pieces_sql(BODIES, r"[^\n]+(?:\n[^\n]+)*\n*", "'paragraph'"))
def chunk_paragraphs_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.segment(bodies(spark, sf_dir), "paragraphs").select(*SPAN_COLUMNS)


@query(pieces_sql(BODIES, r"[^\n]+(?:\n[^\n]+)*\n?|\n+", "case when s[1] = chr(10) then 'paragraphSeparator' else 'paragraph' end"))
def chunk_paragraphs_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.segment(bodies(spark, sf_dir), "paragraphs", blank_lines="separate").select(*SPAN_COLUMNS)


@query(pieces_sql(BODIES, r"\n*[^\n]+(?:\n[^\n]+)*\n?|\n+", "'paragraph'"))
def chunk_paragraphs_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.segment(bodies(spark, sf_dir), "paragraphs", blank_lines="leading").select(*SPAN_COLUMNS)


@query("""select doc_id, cast(i as int) ordinal, substr(text, i * 400 + 1, 400) as text, cast(i * 400 as int) start_rune, cast(least(len(text), i * 400 + 400) as int) end_rune
from (select doc_id, text, unnest(range(0, cast(ceil(len(text) / 400.0) as bigint))) i from documents)""")
def chunk_rune_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.native_windows(docs(spark, sf_dir), 400)


@query("select doc_id, strlen(text)::int n_bytes, len(text)::int n_runes, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v\\x{85}\\x{a0}]+'), lambda x: x <> ''))::int n_words from documents")
def measure_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", fx.measure(t, "bytes").alias("n_bytes"), fx.measure(t, "runes").alias("n_runes"), fx.measure(t, "words").alias("n_words"))


LINES = "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')"


def lines_sql(weight: str = "len(s)") -> str:
    return f"l as (select doc_id, k, s, {weight} w from (select doc_id, unnest({LINES}) s, generate_subscripts({LINES}, 1) k from documents))"


def pack_sql(budget: int, overlap: int = 0, lines: str = "", more: str = "", last: str = "") -> str:
    """The greedy fold as a recursion over lines (l): the state is the chunk's number, first line, weight, and whether it was oversized. e: the chunks, s: places of lines."""
    again = f"case when {overlap} = 1 and not c.big and c.w0 + l.w <= {budget} then l.k - 1 else l.k end"
    weight = f"case when {overlap} = 1 and not c.big and c.w0 + l.w <= {budget} then c.w0 + l.w else l.w end"
    return f"""with recursive {lines or lines_sql()},
c(doc_id, k, n, f, w, w0, big) as (
  select doc_id, k, 0, k, w, w, w > {budget} from l where k = 1
  union all
  select l.doc_id, l.k,
    case when not c.big and l.w <= {budget} and c.w + l.w <= {budget} then c.n else c.n + 1 end,
    case when not c.big and l.w <= {budget} and c.w + l.w <= {budget} then c.f when l.w > {budget} or c.big then l.k else {again} end,
    case when not c.big and l.w <= {budget} and c.w + l.w <= {budget} then c.w + l.w when l.w > {budget} or c.big then l.w else {weight} end,
    l.w, l.w > {budget}
  from c join l on l.doc_id = c.doc_id and l.k = c.k + 1),
e as (select doc_id, n, max(k) k, max(f) f, max(w) w, bool_or(big) big from c group by 1, 2),
s as (select *, coalesce(sum(len(s)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) a, sum(len(s)) over (partition by doc_id order by k) z from l){more}
""" + (last or """select e.doc_id, e.n::int ordinal, x.a::int start_rune, y.z::int end_rune, (e.k - e.f + 1)::int n_spans, e.w::int weight, e.big oversized
from e join s x on x.doc_id = e.doc_id and x.k = e.f join s y on y.doc_id = e.doc_id and y.k = e.k""")


def packed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "ordinal", "start_rune", "end_rune", F.size("span_ordinals").alias("n_spans"), "weight", "oversized")


@query(pack_sql(1200))
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(chunk.pack(docs(spark, sf_dir), "lines", 1200))


@query(pack_sql(1200, 1))
def pack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(chunk.pack(docs(spark, sf_dir), "lines", 1200, overlap=1))


@query(f"select doc_id, (row_number() over (partition by doc_id order by start_rune) - 1)::int k, start_rune, 'span_exceeds_budget' code from ({pack_sql(300)}) where oversized")
def pack_oversized_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk.pack(docs(spark, sf_dir), "lines", 300).select("doc_id", "start_rune", F.explode("diagnostics").alias("d"))
    from pyspark.sql import Window

    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start_rune")) - 1).alias("k"), "start_rune", F.col("d.code").alias("code"))


#: Weights unlike lengths: the words of a line.
LINE_WORDS = "len(list_filter(string_split(replace(s, chr(10), ' '), ' '), lambda x: x <> ''))"


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    return docs(spark, sf_dir).withColumn("w", F.transform(parts, lambda x: F.regexp_count(x, F.lit(r"[^ \n]+"))))


@query(pack_sql(120, lines=lines_sql(LINE_WORDS)))
def pack_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's weights, here the lines' words."""
    return packed(chunk.pack_weighted(weighed(spark, sf_dir), "w", 120))


#: Sums of weights up to each line; a chunk begins with what weighs at most 50 of what is before it, within its own room and not before the chunk before begins.
OVERLAPPED = """, t as (select doc_id, list(q order by k) qs from (select doc_id, k, sum(w) over (partition by doc_id order by k) q from l) group by 1),
b as (select e.*, 1 + len(list_filter(list_prepend(0, qs), lambda x: x < coalesce(qs[f - 1], 0) - 50)) p, 1 + len(list_filter(list_prepend(0, qs), lambda x: x < qs[e.k] - 120)) r from e join t using (doc_id)),
o(doc_id, n, g) as (select doc_id, n, f from b where n = 0 union all select b.doc_id, b.n, least(b.f, greatest(o.g, b.p, b.r)) from o join b on b.doc_id = o.doc_id and b.n = o.n + 1)"""


@query(pack_sql(120, lines=lines_sql(LINE_WORDS), more=OVERLAPPED, last="""select e.doc_id, e.n::int ordinal, x.a::int start_rune, y.z::int end_rune, (e.k - o.g + 1)::int n_spans, (qs[e.k] - coalesce(qs[o.g - 1], 0))::int weight, e.big oversized
from e join o on o.doc_id = e.doc_id and o.n = e.n join t on t.doc_id = e.doc_id join s x on x.doc_id = e.doc_id and x.k = o.g join s y on y.doc_id = e.doc_id and y.k = e.k"""))
def pack_weighted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(chunk.pack_weighted(weighed(spark, sf_dir), "w", 120, 50))


#: Leaves level by level: a section that fits; its blocks; the lines of a block (a paragraph is all of it); pieces of 600 of a line.
LEAVES = f"""{MD}, sec as (select doc_id, source, unnest([b[1:len(b) - len(m)], m]) t, unnest([1, 2]) i from (select *, b[instr(b, concat(chr(10), '## Meta', chr(10))) + 1:] m from md where len(b) > 600)),
blk as (select doc_id, i, unnest(regexp_extract_all(t, '[^\\n]+(?:\\n[^\\n]+)*\\n*')) t, generate_subscripts(regexp_extract_all(t, '[^\\n]+(?:\\n[^\\n]+)*\\n*'), 1) j from sec where len(t) > 600),
lin as (select doc_id, i, j, unnest({LINES.replace("text", "t")}) t, generate_subscripts({LINES.replace("text", "t")}, 1) m from blk where len(t) > 600),
leaf as (select doc_id, 0 i, 0 j, 0 m, 0 q, b s, '' lv from md where len(b) <= 600
  union all select doc_id, i, 0, 0, 0, t, 'markdownSections' from sec where len(t) <= 600
  union all select doc_id, i, j, 0, 0, t, 'markdownBlocks' from blk where len(t) <= 600
  union all select doc_id, i, j, m, 0, t, 'lines' from lin where len(t) <= 600
  union all select doc_id, i, j, m, q, t[600 * q + 1:600 * q + 600], 'runes' from (select *, unnest(range(0, (len(t) + 599) // 600)) q from lin where len(t) > 600)),
l as (select doc_id, row_number() over (partition by doc_id order by i, j, m, q) k, s, len(s) w, lv from leaf)"""


@query(pack_sql(600, lines=LEAVES, last="""select e.doc_id, e.n::int ordinal, x.a::int start_rune, y.z::int end_rune, (e.k - e.f + 1)::int n_spans, e.w::int weight, e.big oversized, x.lv as level
from e join s x on x.doc_id = e.doc_id and x.k = e.f join s y on y.doc_id = e.doc_id and y.k = e.k"""))
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.recursive(bodies(spark, sf_dir), 600).select("doc_id", "ordinal", "start_rune", "end_rune", F.size("span_ordinals").alias("n_spans"), "weight", "oversized", "level")


@query("select doc_id, true lossless from documents")
def spans_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = bodies(spark, sf_dir)
    bad = chunk.lossless(chunk.segment(src, "markdownBlocks"), src).withColumn("bad", F.lit(True))
    return src.join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNull().alias("lossless"))


BLOCK_KIND = "case when starts_with(s, '#') then 'heading' when starts_with(s, '```') then 'fencedCodeBlock' else 'paragraph' end"


@query(pieces_sql(BODIES, r"[^\n]+(?:\n[^\n]+)*\n*", BLOCK_KIND))
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.segment(bodies(spark, sf_dir), "markdownBlocks").select(*SPAN_COLUMNS)


@query(f"""with {MD}, h as (select *, len(b) - len(b[instr(b, concat(chr(10), '## Meta', chr(10))) + 1:]) c from md)
select doc_id, 0::int ordinal, 'section' kind, 0::int start_rune, c::int end_rune, source heading_path from h
union all select doc_id, 1::int, 'section', c::int, len(b)::int, concat(source, '/Meta') from h""")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.segment(bodies(spark, sf_dir), "markdownSections").select("doc_id", "ordinal", "kind", "start_rune", "end_rune", F.array_join("heading_path", "/").alias("heading_path"))


@query(f"""with {MD} select doc_id, 1::int as level, source as text, source anchor, 1::int line, 1::int as column from md
union all select doc_id, 2::int, 'Meta', 'meta', (1 + len(x) - len(replace(x, chr(10), '')))::int, 1::int from (select doc_id, b[1:instr(b, concat(chr(10), '## Meta', chr(10)))] x from md)""")
def md_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.toc(bodies(spark, sf_dir)).drop("node_id")


@query("""select doc_id, 'link' kind, source as text, concat('https://x.org/', doc_id) destination, lang title, 1::int line, 6::int as column from documents
union all select doc_id, 'image', concat('pic of ', lang), concat('p', doc_id, '.png'), '', 3::int, 1::int from documents""")
def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.links(linked(spark, sf_dir)).drop("node_id")


@query(f"""with {MD} select doc_id, 2::bigint headings, 0::bigint links, 0::bigint images, 1::bigint code_blocks, 2::bigint html, len(regexp_extract_all(b, '[^\\n]+(?:\\n[^\\n]+)*\\n*'))::bigint blocks, true valid from md""")
def md_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.summary(bodies(spark, sf_dir)).drop("error")


@query("""select doc_id, unnest([concat('Head ', source), concat('pic of ', lang), concat('item ', lang, 'n ', n_chars)]) text_content, unnest(['paragraph', 'paragraph', 'list']) as type from documents""")
def md_text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.nodes(linked(spark, sf_dir)).where("depth = 1").select("doc_id", "type", "text_content")


@query("""select doc_id, concat('<p>Head <a href="https://x.org/', doc_id, '" title="', lang, '">', source, '</a></p>', chr(10), '<p><img src="p', doc_id, '.png" alt="pic of ', lang, '"></p>', chr(10),
 '<ul>', chr(10), '<li>item ', lang, '</li>', chr(10), '<li><strong>n</strong> ', n_chars, '</li>', chr(10), '</ul>', chr(10)) html from documents""")
def md_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.html(linked(spark, sf_dir)).drop("error")


@query("select doc_id, 3::bigint seen from documents")
def md_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document, first paragraph and its first text: the visitor stops at the link."""
    seen = markdown.walk(markdown.nodes(linked(spark, sf_dir)), stop=F.col("type") == "link").where("type <> 'link'")
    return seen.groupBy("doc_id").agg(F.count("*").alias("seen"))


@query("select doc_id, 0::bigint invalid from documents")
def md_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = markdown.nodes(bodies(spark, sf_dir), types=("document", "heading"))
    bad = markdown.invalid(all_nodes).groupBy("doc_id").agg(F.count("*").alias("n"))
    return all_nodes.where("type = 'document'").select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("invalid"))


SPEC = kd.Spec(
    (kd.FieldRule("title", required=True), kd.FieldRule("n_chars", "number"), kd.FieldRule("draft", "bool", default=False)),
    (kd.BlockRule("meta", fences=("json",), json=True, required=True, strip=True), kd.BlockRule("payload", tags=("payload",))),
)


@query("select doc_id, concat('Doc ', doc_id) title, lang, n_chars::double n_chars, false draft, 'draft,lang,n_chars,source,title' as fields from documents")
def doc_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = document.parse(view(spark, sf_dir), SPEC)
    return p.select("doc_id", document.get_string("title").alias("title"), document.get_string("lang").alias("lang"), document.get_number("n_chars").alias("n_chars"), document.get_bool("draft", True).alias("draft"), F.array_join(document.field_names(), ",").alias("fields"))


@query(f"""with {MD}, x as (select doc_id, n_chars, lang, b, strlen(b[1:instr(b, '```json meta') - 1]) a from md)
select doc_id, 'meta' as name, 'fence' kind, concat('{{"doc_id": ', doc_id, ', "lang": "', lang, '"}}') as text, a::int start_byte, concat('{{"doc_id": ', doc_id, ', "lang": "', lang, '"}}') json_value from x
union all select doc_id, 'payload', 'xml', concat('n: ', n_chars), strlen(b[1:instr(b, '<payload') - 1])::int, null from x""")
def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.blocks(document.parse(view(spark, sf_dir), SPEC)).select("doc_id", "name", "kind", "text", "start_byte", "json_value")


@query(f"""with {MD} select doc_id, regexp_replace(b, '```json meta\\n[^\\n]*\\n```', '') body from md""")
def doc_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.parse(view(spark, sf_dir), SPEC).select("doc_id", "body")


@query("select doc_id, source first_heading from documents")
def doc_first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.first_heading(bodies(spark, sf_dir)).drop("error")


@query(f"with {MD} select doc_id, concat('title: Doc ', doc_id, chr(10), 'lang: ', lang, chr(10), 'source: ', source, chr(10), 'n_chars: ', n_chars) front, b body from md")
def doc_split_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).select("doc_id", fx.frontmatter(F.col("text")).alias("front"), fx.body(F.col("text")).alias("body"))


FRONT = "concat('title: Doc ', doc_id, chr(10), 'lang: ', lang, chr(10), 'source: ', source, chr(10), 'n_chars: ', n_chars, chr(10))"


@query(f"select doc_id, {FRONT} as text, 4::int payload_start_byte, (4 + strlen({FRONT}))::int payload_end_byte, 0.98::double confidence from documents")
def extract_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.candidates(view(spark, sf_dir), "frontmatter").select("doc_id", "text", "payload_start_byte", "payload_end_byte", "confidence")


@query(f"""with {MD}, v as (select doc_id, lang, {VIEW.format(body='b')} v from md)
select doc_id, 'json' format, concat('{{"doc_id": ', doc_id, ', "lang": "', lang, '"}}', chr(10)) as text, 'json' as label, 'json meta' info,
 strlen(v[1:instr(v, '```json meta') - 1])::int start_byte, (len(v[1:instr(v, '```json meta') - 1]) - len(replace(v[1:instr(v, '```json meta') - 1], chr(10), '')))::int start_row, 0::int start_column from v""")
def extract_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.candidates(view(spark, sf_dir), "markdowncodeblocks").select("doc_id", "format", "text", "label", "info", "start_byte", "start_row", "start_column")


@query("""with p as (select page_id, html, unnest(['title', 'h1', 'script']) t from pages), m as (select page_id, t, html, instr(html, concat('<', t)) a from p where html is not null),
x as (select page_id, t, html, a, a + instr(html[a:], '>') - 1 b from m where a > 0), y as (select *, b + instr(html[b + 1:], concat('</', t, '>')) c from x where instr(html[b + 1:], concat('</', t, '>')) > 0)
select page_id, t as label, html[b + 1:c - 1] as text, html[a:b] info, strlen(html[1:a - 1])::int start_byte, (strlen(html[1:c - 1]) + len(t) + 3)::int end_byte from y""")
def extract_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each of these tags a page."""
    src = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract.candidates(src, "xmltagged", ke.Options.of(tags=("title", "h1", "script")), ["page_id"], "html").select("page_id", "label", "text", "info", "start_byte", "end_byte")


@query("select event_id, 'json' format, 0.98::double confidence, trim(props) as text from events where json_valid(props)")
def extract_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    return extract.candidates(src, "rawstructured", keys=["event_id"], text="props").select("event_id", "format", "confidence", "text")


@query("select doc_id, unnest([0, 1, 2])::int ordinal, unnest(['frontmatter', 'markdownCodeBlock', 'xmlTagged']) kind, unnest(['yaml', 'json', 'unknown']) format, unnest([0.98, 0.95, 0.9])::double confidence from documents")
def extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.candidates(view(spark, sf_dir)).select("doc_id", "ordinal", "kind", "format", "confidence")


@query("select doc_id, 0::int ordinal, 'frontmatter' kind, 'yaml' format from documents")
def extract_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.first_valid(extract.validated(extract.candidates(view(spark, sf_dir)))).select("doc_id", "ordinal", "kind", "format")


@query("select doc_id, unnest(['frontmatter', 'markdownCodeBlock', 'xmlTagged']) kind, unnest([true, true, false]) valid, unnest([0, 0, 1])::int error_count from documents")
def extract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.validated(extract.candidates(view(spark, sf_dir))).select("doc_id", "kind", "valid", "error_count")


@query("select doc_id, unnest([1, 2])::int as rank, unnest(['frontmatter', 'markdownCodeBlock']) kind from documents")
def extract_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.top_k(extract.candidates(view(spark, sf_dir)), 2).select("doc_id", "rank", "kind")


@query("""select doc_id, case when doc_id % 3 = 0 then 'unknown' when doc_id % 3 = 1 then 'yaml' else lang end label_format, case when doc_id % 2 = 0 then 'json' else 'unknown' end payload_format from documents""")
def infer_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when doc_id % 3 = 0 then ' Payload x' when doc_id % 3 = 1 then 'YML' else lang end")
    payload = F.expr("case when doc_id % 2 = 0 then concat(' {', source, '} ') else source end")
    return docs(spark, sf_dir).select("doc_id", fx.format_of_label(label).alias("label_format"), fx.format_of_payload(payload).alias("payload_format"))


@query("select event_id, event_id % 2 = 0 valid from events")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("case when event_id % 2 = 0 then props when event_id % 4 = 1 then concat(props, ' x') else replace(props, '}', ',}') end").alias("t"))
    return extract.strict_json(src, ["event_id"], "t").select("event_id", "valid")


@query("""select n_nationkey, concat('{"name": "', n_name, '", "ok": true, "none": null, "l": [', n_nationkey, ']}') sanitized, true strict_parse_clean, 'single_quotes,python_literals,trailing_comma' rules from nation""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey", "concat('{\\'name\\': \\'', n_name, '\\', \"ok\": True, \\'none\\': None, \"l\": [', n_nationkey, ',],}') as t")
    return extract.sanitize(src, "json", keys=["n_nationkey"], text="t").select("n_nationkey", "sanitized", "strict_parse_clean", F.array_join(F.transform("fixes", lambda x: x["rule"]), ",").alias("rules"))


@query("""select c_custkey, concat('name: ', c_name, chr(10), 'tags:', chr(10), '  - ', c_mktsegment, chr(10)) sanitized, true parse_clean, true lint_clean, 3::int fixes from customer""")
def yaml_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "concat('name:', c_name, chr(10), 'tags:', chr(10), chr(9), '-', c_mktsegment, chr(10)) as t")
    return extract.sanitize(src, "yaml", keys=["c_custkey"], text="t").select("c_custkey", "sanitized", "parse_clean", "lint_clean", F.size("fixes").alias("fixes"))


@query("""select * from (values ('python_literals', 25::bigint), ('single_quotes', 50::bigint), ('trailing_comma', 25::bigint)) t(rule, n)""")
def lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey", "concat('{\\'name\\': \\'', n_name, '\\', \"ok\": True,}') as t")
    return extract.lint(src, "json", keys=["n_nationkey"], text="t").groupBy("rule").agg(F.count("*").alias("n"))


@query("""with c as (select n_regionkey, n_nationkey, replace(n_name, '_', '\\_') a, cast(n_nationkey as varchar) b from nation), w as (select n_regionkey, greatest(max(len(a)), 6) wa, greatest(max(len(b)), 11) wb from c group by 1)
select n_regionkey, concat('| n_name', repeat(' ', wa::int - 6), ' | n\\_nationkey', repeat(' ', greatest(0, wb::int - 12)), ' |', chr(10), '| :', repeat('-', wa::int - 1), ' | ', repeat('-', greatest(wb, 12)::int - 1), ': |', chr(10),
 (select string_agg(concat('| ', rpad(a, wa::int, ' '), ' | ', rpad(b, greatest(wb, 12)::int, ' '), ' |'), chr(10) order by n_nationkey) from c where c.n_regionkey = w.n_regionkey), chr(10)) markdown from w""".replace("'| n_name', repeat(' ', wa::int - 6)", "'| n\\_name', repeat(' ', wa::int - 7)").replace("greatest(max(len(a)), 6)", "greatest(max(len(a)), 7)"))
def build_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.markdown_table(spark.read.parquet(f"{sf_dir}/nation.parquet"), ["n_regionkey"], {"n_name": "left", "n_nationkey": "right"}, ["n_nationkey"])


@query("""select n_nationkey, concat('# ', replace(n_name, '_', '\\_'), chr(10), chr(10), '> key ', n_nationkey, chr(10), '> region ', n_regionkey, chr(10), chr(10), '- a\\*b', chr(10), '- ', n_nationkey, chr(10), chr(10),
 '3. x', chr(10), '4. y', chr(10), chr(10), '- [x] t', chr(10), chr(10), '````sql', chr(10), 'select ```', n_nationkey, chr(10), '````', chr(10)) markdown from nation""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    return n.select("n_nationkey", fx.document(
        fx.heading(1, F.col("n_name")), F.lit(""), fx.blockquote(F.concat(F.lit("key "), key, F.lit("\nregion "), region)), fx.bullet_list(F.array(F.lit("a*b"), key)), fx.ordered_list(F.array(F.lit("x"), F.lit("y")), 3),
        fx.checklist(F.array(F.struct(F.lit("t").alias("text"), F.lit(True).alias("checked")))), fx.code_block("sql", F.concat(F.lit("select ```"), key, F.lit("\n"))),
    ).alias("markdown"))


TEMPLATE = '{{ define "row" }}<{{ . }}>{{ end }}{{ .n_name | lower }} {{ printf "%03d" .n_nationkey }}{{ range $i, $x := .l }}{{ if $i }},{{ end }}{{ template "row" $x }}{{ end }}'


@query("select n_nationkey, concat(lower(n_name), ' ', lpad(n_nationkey::varchar, 3, '0'), '<a>,<', n_regionkey, '>') as text, strlen(concat(lower(n_name), ' ', lpad(n_nationkey::varchar, 3, '0'), '<a>,<', n_regionkey, '>'))::int bytes from nation")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("l", F.array(F.lit("a"), F.col("n_regionkey").cast("string")))
    return document.render(n, TEMPLATE, ["n_name", "n_nationkey", "l"], keys=["n_nationkey"]).select("n_nationkey", "text", "bytes")


@query("""select n_nationkey, concat('<p title="&lt;', n_name, '&gt;">&lt;', n_name, '&gt;</p><a href="', case when n_nationkey % 2 = 0 then '#ZgotmplZ' else concat('https://x.org/', n_nationkey) end, '">o</a>') as text from nation""")
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey", "concat('<', n_name, '>') as name", "case when n_nationkey % 2 = 0 then 'javascript:alert(1)' else concat('https://x.org/', n_nationkey) end as url")
    return document.render(n, '<p title="{{ .name }}">{{ .name }}</p><a href="{{ .url }}">o</a>', ["name", "url"], kt.Config(mode="html"), keys=["n_nationkey"]).select("n_nationkey", "text")


@query("select n_regionkey, count(*)::bigint n from nation group by 1")
def template_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function within a template."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = document.render(n, "{{ region .n_regionkey }}", ["n_regionkey"], kt.Config(custom=(("region", lambda x: f"r{x}"),)), keys=["n_nationkey"])
    return out.groupBy(F.substring("text", 2, 9).cast("int").alias("n_regionkey")).agg(F.count("*").alias("n"))


@query("select * from (values ('comment'), ('duplicate_key'), ('markdown_fence_wrapper'), ('missing_closer'), ('missing_comma'), ('multiple_top_level_values'), ('python_literals'), ('single_quotes'), ('strict_parse_error'), ('trailing_comma'), ('unquoted_key')) t(name)")
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rules(spark, "json").select("name")


@query("select rule, rule in ('single_quotes', 'trailing_comma', 'markdown_fence_wrapper') repaired from (values ('single_quotes'), ('trailing_comma'), ('markdown_fence_wrapper')) t(rule)")
def sanitize_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.sanitize(extract.examples(spark, "json"), "json", kz.Options(), ["rule"], "source").select("rule", F.col("strict_parse_clean").alias("repaired"))


@query("select event_id, '(document (object (string) (number)))' tree from events")
def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.parse_tree(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_id"], "props")


@query("select doc_id, count(*)::bigint n_lines from (select doc_id, unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) from documents) group by 1")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line operator on a stream of the table's files, appended to files."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quillspan-')}"
    at = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    src = stream.read_stream(spark, f"{sf_dir}/documents.parquet", docs(spark, sf_dir).schema)
    stream.apply_stream(src, lambda d: chunk.native_lines(d).select("doc_id", "ordinal"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("doc_id long, ordinal int").parquet(f"{at}/out").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into budgeted chunks."""
    return pack_greedy(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
