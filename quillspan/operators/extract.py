"""Extraction, validation and repair of structured payloads over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.kernels import extract as k
from quillspan.kernels import sanitize as z
from quillspan.operators.base import explode
from quillspan.schema import CANDIDATE, ISSUE, SANITIZED, VALIDATION

KEYS = ["doc_id"]


def candidates(df: DataFrame, extractor: str = "all", options: k.Options = k.Options(), keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Candidates of one extractor or of all enabled ones, in order of place."""
    run = k.extract_all if extractor == "all" else k.RUN[extractor]

    def rows(t: str) -> list[dict]:
        return [r | {"ordinal": i} for i, r in enumerate(k.rows(t, run(t, options)))]

    return explode(df, keys or KEYS, text, f"ordinal int, {CANDIDATE}", rows).drop("error")


def validated(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each candidate with its validation; candidates are rows by now, so repair runs in parallel over them."""
    keys = keys or KEYS
    out = explode(found, [*keys, "ordinal", "kind", "label", "confidence"], "text", VALIDATION, lambda t, f, w: [k.validate(f, t, w)], extra=["format", "wrapper"]).drop("error")
    return out.withColumns({"error_count": F.size("errors"), "fix_count": F.size("fixes"), "preview": F.left("sanitized", F.lit(160))})


def first_valid(checked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first valid candidate of each document."""
    keys = keys or KEYS
    best = checked.where("valid").groupBy(*keys).agg(F.min_by(F.struct("ordinal", "kind", "label", "format", "sanitized"), "ordinal").alias("b"))
    return best.select(*keys, "b.*")


def top_k(found: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The n candidates of each document with the highest confidence; earlier ones first."""
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "ordinal")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_n(found: DataFrame, n: int) -> DataFrame:
    """The first n candidates of each document, in order of place; local to each row."""
    return found.where(F.col("ordinal") < n)


def sanitize(df: DataFrame, kind: str, options: z.Options = z.Options(), keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Repair JSON or YAML texts, with the issues that are left and the fixes made."""
    if bad := options.errors(kind):
        raise z.OptionsError("; ".join(bad))

    def run(t: str) -> list[dict]:
        r = z.sanitize(t, kind, options)
        return [vars(r) | {"lint_issues": k.issue_rows(r.sanitized, r.issues), "fixes": [vars(f) for f in r.fixes]}]

    return explode(df, keys or KEYS, text, SANITIZED, run).drop("error")


def lint(df: DataFrame, kind: str, options: z.Options = z.Options(), keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """A row for each issue."""
    fields = ISSUE.removeprefix("struct<").removesuffix(">").replace(":", " ")
    return explode(df, keys or KEYS, text, fields, lambda t: k.issue_rows(t, z.lint(t, kind, options))).drop("error")


def strict_json(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    def run(t: str) -> list[dict]:
        ok, error, _ = z.strict_json(t)
        return [{"valid": ok, "message": error}]

    return explode(df, keys or KEYS, text, "valid boolean, message string", run).drop("error")


def parse_tree(df: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    return explode(df, keys or KEYS, text, "tree string", lambda t: [{"tree": z.parse_tree(t)}]).drop("error")


def rules(spark, kind: str) -> DataFrame:  # noqa: ANN001
    """The catalogue of the rules that are implemented."""
    return spark.createDataFrame(sorted((z.JSON_RULES if kind == "json" else z.YAML_RULES).items()), "name string, description string")


def examples(spark, kind: str) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(z.JSON_EXAMPLES if kind == "json" else z.YAML_EXAMPLES, "rule string, source string")
