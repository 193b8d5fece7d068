"""The registered queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Place of the public tokenizer file; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and benchmark item; clean documents have none."""
    from quillspan.llm import decontaminate

    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.token_store import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("key", "doc_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm import language

    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, where=~language.held_out("k", 5, 0))
    out = language.identify(docs, model)
    return out.select("doc_id", language.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "n_words", "n_other")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm import language, toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~language.held_out("k", 4, 2))
    return toxicity.score_texts(docs, model).select("doc_id", language.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.secrets_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_NGRAM = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
n as (select doc_id, count(*) n from s group by 1),
i as (select a.doc_id u, b.doc_id v, count(*) i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select u, v from i join n a on a.doc_id = u join n b on b.doc_id = v where 100 * i >= 80 * (a.n + b.n - i)),
c(doc_id, r) as (select doc_id, doc_id from n union select l.v, c.r from c join l on l.u = c.doc_id where c.r < l.v)
select w.doc_id, coalesce(n, 0)::bigint n_shingles, least(w.doc_id, coalesce(r, w.doc_id)) component_id
from w left join n using (doc_id) left join (select doc_id, min(r) r from c group by 1) x using (doc_id)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm import mixing

    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm import common, warc

    path = common.scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, compression="gzip")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).cast("long")
    return warc.read_archive(spark, path, verify="true").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_WARC = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b) n, sha1(b) d from p),
bits as (select page_id, n, d, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', d[i]) - 1), 4, '0')), '') s from h),
f as (select *, min(page_id) over (partition by d, n) first,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * s[5*i+1]::int + 8 * s[5*i+2]::int + 4 * s[5*i+3]::int + 2 * s[5*i+4]::int + s[5*i+5]::int]), '') digest from bits)
select page_id, n::bigint payload_bytes, digest payload_digest, case when first = page_id then 'response' else 'revisit' end record_type,
  case when first <> page_id then first end refers_to from f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_join": ORACLE_NGRAM, "op10_warc": ORACLE_WARC}
