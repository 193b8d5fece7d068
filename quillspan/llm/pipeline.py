"""A training corpus out of ``documents``: stages that each take what the stage before kept.

Every stage but the last returns the columns of ``documents``. A rejected document goes for good.

Edge cases: see the operators; in all, texts that are null or without a letter go in the first stage, ids that are null or repeated
are carried through (repeated ones stay or go together as duplicates), an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import common, decontaminate, language, mixing, ngram_join, token_store
from quillspan.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those whose words are mostly unlike those of the learned languages."""
    return language.known(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays."""
    return ngram_join.without_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files, and where each document is in them."""
    return token_store.encode_corpus(docs, tokenizer_path()).withColumnRenamed("key", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("mixing", to_targets),
    ("token_ids", token_ids),
]

#: The first stage is a trained model; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's output goes once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(spark, before)
    return docs
