"""Markdown over DataFrames: a flattened node table, and relational queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import slug
from quillspan.kernels import markdown as k
from quillspan.operators.base import explode
from quillspan.schema import NODE

KEYS = ["doc_id"]


def nodes(df: DataFrame, keys: list[str] | None = None, text: str = "text", types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes in pre-order with parent, depth, path, ranges; ``types`` keeps others from being made at all. A text nested too deep gives one row with only ``error``."""
    return explode(df, keys or KEYS, text, NODE, lambda t: k.flatten(t, types))


def html(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    return explode(df, keys or KEYS, text, "html string", lambda t: [{"html": k.render(t)}])


def toc(df: DataFrame, max_level: int = 3, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Headings at any depth up to a level, with anchors."""
    keys = keys or KEYS
    out = nodes(df, keys, text, ("heading",)).where(F.col("level") <= (max_level or 6))
    return out.select(*keys, "node_id", "level", F.col("text_content").alias("text"), slug(F.col("text_content")).alias("anchor"), F.col("start_line").alias("line"), F.col("start_column").alias("column"))


def links(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    keys = keys or KEYS
    out = nodes(df, keys, text, ("link", "image"))
    return out.select(*keys, "node_id", F.col("type").alias("kind"), F.when(F.col("type") == "image", F.col("alt")).otherwise(F.col("text_content")).alias("text"), "destination", "title", F.col("start_line").alias("line"), F.col("start_column").alias("column"))


def summary(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Counts of node kinds of each text, local to its row."""
    return explode(df, keys or KEYS, text, "headings long, links long, images long, code_blocks long, html long, blocks long, valid boolean", lambda t: [k.counts(t)])


def walk(nodes_: DataFrame, skip=None, stop=None, keys: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """Nodes that a visitor sees: below a node where ``skip`` holds none, after the first where ``stop`` holds none."""
    keys = keys or KEYS
    out = nodes_
    if skip is not None:
        cut = nodes_.where(skip).groupBy(*keys).agg(F.collect_set("path").alias("__cut"))  # paths of one document
        under = F.exists("__cut", lambda p: (F.size(p) < F.size("path")) & (F.slice("path", 1, F.size(p)) == p))
        out = out.join(cut, keys, "left").where(F.col("__cut").isNull() | ~under).drop("__cut")
    if stop is not None:
        last = out.where(stop).groupBy(*keys).agg(F.min("node_id").alias("__last"))
        out = out.join(last, keys, "left").where(F.col("__last").isNull() | (F.col("node_id") <= F.col("__last"))).drop("__last")
    return out


def invalid(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("error is null").where((F.coalesce("type", F.lit("")) == "") | ((F.col("type") == "heading") & ~F.col("level").between(1, 6)))
