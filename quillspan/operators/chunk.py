"""Segmentation and packing over DataFrames of documents.

Line splitting, code-point windows and measures are native expressions; the other modes and the greedy fold are
kernels over Arrow batches. Everything is local to a row, so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as fx
from quillspan.kernels import chunking as k
from quillspan.operators.base import explode
from quillspan.schema import CHUNK, SPAN

KEYS = ["doc_id"]


def native_lines(df: DataFrame, keys: list[str] | None = None, text: str = "text", keep_terminators: bool = True) -> DataFrame:
    """Lines as (ordinal, kind, text, byte and code-point ranges, line numbers), by native expressions only.

    Offsets are running sums within a document's own array, so no window and no shuffle is needed.
    """
    keys = keys or KEYS
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    if not keep_terminators:
        ends = lambda s: F.when(F.endswith(s, F.lit("\r\n")), 2).when(F.endswith(s, F.lit("\n")), 1).otherwise(0)
        cut = F.transform(parts, lambda s: F.filter(F.array(F.substring(s, F.lit(1), F.char_length(s) - ends(s)), F.right(s, ends(s))), lambda x: x != ""))
        parts = F.flatten(cut)
    rows = df.select(*keys, parts.alias("__p")).where(F.size("__p") > 0)
    out = rows.select(*keys, F.posexplode(fx.running(F.col("__p"))).alias("ordinal", "s"))
    kind = F.when(F.lit(not keep_terminators) & F.col("s.t").isin("\n", "\r\n"), "lineTerminator").otherwise("line")
    return out.select(*keys, "ordinal", kind.alias("kind"), F.col("s.t").alias("text"), F.col("s.b").alias("start_byte"), (F.col("s.b") + F.octet_length("s.t")).alias("end_byte"), F.col("s.r").alias("start_rune"), (F.col("s.r") + F.char_length("s.t")).alias("end_rune"), F.col("s.l").alias("start_line"))


def native_windows(df: DataFrame, size: int, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Windows of ``size`` code points."""
    keys = keys or KEYS
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    rows = df.where(n > 0).select(*keys, F.col(text).alias("__t"), F.explode(starts).alias("ordinal"))
    piece = F.substring(F.col("__t"), F.col("ordinal") * size + 1, F.lit(size))
    return rows.select(*keys, "ordinal", piece.alias("text"), (F.col("ordinal") * size).alias("start_rune"), (F.col("ordinal") * size + F.char_length(piece)).alias("end_rune"))


def segment(df: DataFrame, strategy: str, keys: list[str] | None = None, text: str = "text", errors: str = "permissive", **options: object) -> DataFrame:
    """Spans by ``lines``, ``paragraphs``, ``markdownBlocks``, ``markdownSections`` or ``runes``; unknown options are refused."""
    run = {"lines": k.lines, "paragraphs": k.paragraphs, "markdownBlocks": k.markdown_blocks, "markdownSections": k.markdown_sections, "runes": k.windows}.get(strategy)
    if run is None:
        raise k.ChunkingError("unknown_strategy", strategy)
    run("x", **options) if strategy != "runes" else None  # options fail when the plan is made
    return explode(df, keys or KEYS, text, SPAN, lambda t: [vars(s) for s in run(t, **options)], errors)


def pack(df: DataFrame, strategy: str, max_units: int, measure: str = "runes", overlap: int = 0, oversized: str = "allow", keys: list[str] | None = None, text: str = "text", errors: str = "permissive", **options: object) -> DataFrame:
    """Segment each text and pack its spans into chunks of at most ``max_units``."""
    k.check_pack(max_units, overlap, oversized, measure)
    run = {"lines": k.lines, "paragraphs": k.paragraphs, "markdownBlocks": k.markdown_blocks, "markdownSections": k.markdown_sections}[strategy]
    return explode(df, keys or KEYS, text, CHUNK, lambda t: [vars(c) for c in k.pack(run(t, **options), max_units, measure, overlap, oversized)], errors)


def pack_weighted(df: DataFrame, weights: str, max_weight: int, overlap_weight: int = 0, oversized: str = "allow", keys: list[str] | None = None, text: str = "text", errors: str = "permissive") -> DataFrame:
    """Pack lines by an array column of weights, one for each line."""
    k.check_pack(max_weight, overlap_weight, oversized)
    return explode(df, keys or KEYS, text, CHUNK, lambda t, w: [vars(c) for c in k.pack_weighted(k.lines(t), list(w or []), max_weight, overlap_weight, oversized)], errors, [weights])


def recursive(df: DataFrame, max_units: int, measure: str = "runes", levels: tuple[str, ...] = k.LEVELS, overlap: int = 0, oversized: str = "allow", atomic: tuple[str, ...] = k.ATOMIC, keys: list[str] | None = None, text: str = "text", errors: str = "permissive") -> DataFrame:
    """Refine each text level by level until its spans fit, then pack them."""
    k.check_pack(max_units, overlap, oversized, measure)
    return explode(df, keys or KEYS, text, CHUNK, lambda t: [vars(c) for c in k.recursive(t, max_units, measure, levels, overlap, oversized, atomic)], errors)


def lossless(spans: DataFrame, docs: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents whose spans, put together in order, aren't their text."""
    keys = keys or KEYS
    joined = spans.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "").alias("__joined"))
    return docs.join(joined, keys, "left").where(F.coalesce("__joined", F.lit("")) != F.col(text)).select(*keys)
