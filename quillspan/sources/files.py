"""Texts in and out: whole files as documents, data files, text and row sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspan.kernels.sanitize import load_yaml


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_data(name: str, text: str) -> object:
    """Values of a data file: JSON by its name, else YAML."""
    if name.endswith(".json"):
        return json.loads(text)
    ok, error, value = load_yaml(text)
    if not ok:
        raise ValueError(f"{name}: {error}")
    return value


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """A row for each data file: path, value (as JSON), error."""
    from quillspan.operators.base import explode

    def run(t: str, p: str) -> list[dict]:
        return [{"value": json.dumps(parse_data(p, t), ensure_ascii=False, default=str)}]

    src = read_texts(spark, path).withColumn("p", F.col("path"))
    return explode(src, ["path"], "text", "value string", run, extra=["p"])


def asset(package: str, name: str) -> str:
    """Text of a file that is installed with a package."""
    from importlib.resources import files

    return files(package).joinpath(name).read_text("utf-8")


def write_texts(df: DataFrame, path: str, text: str = "text", mode: str = "errorifexists") -> DataFrame:
    """Write a text column in one pass; returns how many rows and UTF-16 units were written."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.encode(F.col(text), "UTF-16LE")) / 2).cast("long").alias("bytes"))
    df.select(F.col(text).alias("value")).write.mode(mode).text(path, lineSep="\n")
    return df.sparkSession.createDataFrame([(path, seen.get["rows"], seen.get["bytes"] or 0)], "output_path string, rows long, bytes long")


def write_rows(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(format).save(path)
