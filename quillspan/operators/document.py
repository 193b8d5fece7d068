"""Documents of front matter and named blocks, and rendering of templates over DataFrames."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.kernels import document as k
from quillspan.kernels import template as t
from quillspan.operators.base import explode
from quillspan.schema import DOCUMENT, RENDERED

KEYS = ["doc_id"]


def parse(df: DataFrame, spec: k.Spec = k.Spec(), keys: list[str] | None = None, text: str = "text", errors: str = "permissive") -> DataFrame:
    """Front matter (as JSON), body and blocks of each text; a document that breaks the spec has only ``error``."""
    if bad := spec.errors():
        raise k.DocumentError("; ".join(bad))

    def run(x: str) -> list[dict]:
        d = k.build(x, spec)
        blocks = [{"name": b.name, "kind": b.kind, "text": b.text, "raw": b.raw, "start_byte": b.start, "end_byte": b.end, "json_value": b.json_value} for b in d.blocks]
        return [{"has_frontmatter": d.has_frontmatter, "frontmatter": json.dumps(d.frontmatter, ensure_ascii=False, default=str), "body": d.body, "blocks": blocks}]

    return explode(df, keys or KEYS, text, DOCUMENT, run, errors)


def blocks(parsed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or KEYS
    return parsed.select(*keys, F.posexplode("blocks").alias("ordinal", "b")).select(*keys, "ordinal", "b.*")


def value(name: str, column: str) -> tuple[Column, Column]:
    """A front matter value as text, and its JSON type; both null where it is missing or null."""
    text = F.get_json_object(column, f"$.{name}")
    return text, F.expr(f"schema_of_variant(try_variant_get(try_parse_json({column}), '$.{name}', 'variant'))")


def get_string(name: str, fallback: str = "", column: str = "frontmatter") -> Column:
    """A front matter value as a string; whole numbers have no fraction."""
    v, kind = value(name, column)
    v = F.when((kind != "STRING") & F.rlike(v, F.lit(r"^-?\d+\.0+$")), F.regexp_replace(v, r"\.0+$", "")).otherwise(v)
    return F.when(v.isNull() | (v == ""), fallback).otherwise(v)


def get_number(name: str, fallback: float = 0.0, column: str = "frontmatter") -> Column:
    """A number, or a string that is one; booleans and others fall back."""
    v, kind = value(name, column)
    return F.coalesce(F.when(kind != "BOOLEAN", F.trim(v).try_cast("double")), F.lit(fallback))


def get_bool(name: str, fallback: bool = False, column: str = "frontmatter") -> Column:
    """A boolean, or a string that says one; numbers and others fall back."""
    v, kind = value(name, column)
    word = F.when(kind.isin("STRING", "BOOLEAN"), F.regexp_replace(v, r"^\s+|\s+$", ""))
    return F.when(word.isin(*k.TRUE), True).when(word.isin(*k.FALSE), False).otherwise(fallback)


def field_names(column: str = "frontmatter") -> Column:
    return F.array_sort(F.json_object_keys(column))


def first_heading(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """The first heading with a title, at any depth; '' without one; null with an ``error`` where the text can't be parsed."""
    return explode(df, keys or KEYS, text, "first_heading string", lambda x: [{"first_heading": k.first_heading(x)}])


def render(df: DataFrame, source: str, columns: list[str], config: t.Config = t.Config(), name: str | None = None, keys: list[str] | None = None, errors: str = "permissive") -> DataFrame:
    """A template over each row's columns. It is compiled when the plan is made, and again once a worker."""
    t.TemplateSet(source, config)
    held: dict = {}

    def run(x: str) -> list[dict]:
        if "set" not in held:
            held["set"] = t.TemplateSet(source, config)
        return [asdict(held["set"].render(json.loads(x), name))]

    data = df.withColumn("__data", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return explode(data, keys or KEYS, "__data", RENDERED, run, errors)
