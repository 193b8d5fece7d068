import math
import random

import pytest

import corpus_pipeline
from quillspan.llm import common, mixing, pipeline
from quillspan.llm.decontaminate import Index

@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 14)


RULES = {"a": "quality = 1", "b": "quality = 0"}


def docs_and_labels(n=300):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        kind = int(rng.random() < 0.8)
        rows.append((i, " ".join(rng.choices(["one", "two", "six"] if kind else ["uno", "dos", "two"], k=rng.randint(5, 60))), "x"))
        if i % 2:
            labels.append((i, kind, 0))
    return [*rows, (n, None, "x"), (n + 1, "", "x"), (None, "one two", "x"), (0, rows[0][1], "x")], labels


def test_mixture_meets_targets(spark):
    rows, labels = docs_and_labels()
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    out = mixing.rates(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES, {"a": 0.5, "b": 0.5}).collect()
    assert len(out) == len(rows) and all(r.rate >= 0 for r in out)
    total = sum(r.n_tokens for r in out)
    for share in ("p_a", "p_b"):
        assert math.isclose(sum(r.rate * r.n_tokens * r[share] for r in out) / total, 0.5, abs_tol=0.01)
    assert {r.rate for r in out if not r.n_tokens} == {1.0}
    known = dict(labels and [(k, q) for k, q, _ in labels])
    right = [(r.p_a > 0.5) == bool(known[r.doc_id]) for r in out if r.doc_id in known and r.n_tokens]
    assert sum(right) >= 0.95 * len(right)


def brute_rates(rows, targets):
    """The same descent by plain loops."""
    total = sum(r.n_tokens for r in rows)
    k = len(targets)
    have = [sum(r.n_tokens * r[f"p_{d}"] for r in rows) for d in targets]
    rate = [1.0] * len(rows)
    for _ in range(mixing.ROUNDS):
        sums = [sum(x * r.n_tokens * r[f"p_{d}"] for x, r in zip(rate, rows) if r.n_tokens) for d in targets]
        error = [(s - total * t) / h for s, t, h in zip(sums, targets.values(), have)]
        if max(map(abs, error)) < mixing.ENOUGH:
            break
        rate = [max(0.0, x - mixing.RATE * (sum(r[f"p_{d}"] * error[i] for i, d in enumerate(targets)) + mixing.PULL * (x - 1))) for x, r in zip(rate, rows)]
    assert k == len(have)
    return [x if r.n_tokens else 1.0 for x, r in zip(rate, rows)]


def test_rates_match_brute_force(spark):
    rows, labels = docs_and_labels(120)
    out = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES, {"a": 0.3, "b": 0.7}).collect()
    assert [r.rate for r in out] == pytest.approx(brute_rates(out, {"a": 0.3, "b": 0.7}), abs=1e-6)


def test_mixture_without_labels_or_rows(spark):
    rows, labels = docs_and_labels(20)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, marks.limit(0), RULES, {"a": 0.5, "b": 0.5})
    assert out.columns == docs.columns and out.count() == len(rows)
    assert mixing.mixed(docs.limit(0), marks, RULES, {"a": 0.5, "b": 0.5}).count() == 0


def test_copies_follow_rates(spark):
    rows, labels = docs_and_labels(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, marks, RULES, {"a": 0.2, "b": 0.8})
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed(docs, marks, RULES, {"a": 0.2, "b": 0.8}).collect()))
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_pipeline_on_the_smallest_table(spark):
    """Each stage's decision, against brute force on what it was given."""
    from test_ngram_join import groups

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, sf), "test-stage")
        if stage is not pipeline.token_ids:
            assert out.columns == docs.columns
        docs = out
        kept.append(out.collect())
    first, known, unique, clean, mixed, tokens = kept
    assert len(known) >= 0.98 * len(first)
    roots = groups([(r.doc_id, r.text) for r in known])
    assert {r.doc_id for r in unique} == {d for d, (_, root) in roots.items() if d == root}
    index = Index([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    bad = {t for t, _ in index.found([r.text for r in unique])}
    assert {r.doc_id for r in clean} == {r.doc_id for i, r in enumerate(unique) if i not in bad} and bad
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and len(tokens) == len(mixed)
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)
