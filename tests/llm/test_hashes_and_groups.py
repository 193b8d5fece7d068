import random

import numpy as np
import public_tokenizers
from test_ngram_join import groups
from test_text_ops import brute_shingles

from quillspan.llm import components, language, ngram_join, toxicity
from quillspan.llm import fingerprint as fp
from quillspan.llm import token_store as ts
from quillspan.llm.textnum import shingle_sets, words_of
from quillspan.llm.wordtable import points_of, runs


def thue_morse(n):
    """A word of n letters and its complement: equal under any polynomial hash modulo 2**64, once n is 1024."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


PAIRS = [thue_morse(n) for n in (1024, 2048, 4096)]


def test_words_that_polynomials_confuse():
    words = [w for p in PAIRS for w in p]
    hashes, _ = words_of([" ".join(words).encode()])
    assert len(set(hashes.tolist())) == len(words)
    texts = [f"one two three four {w} five six seven eight nine" for w in words]
    assert len({x.tobytes() for x in shingle_sets([t.encode() for t in texts])}) == len(words)
    assert len({fp.pack(s) for s in fp.signatures([t.encode() for t in texts])}) == len(words)


def test_encoder_tells_them_apart():
    enc = ts.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert enc.by_piece
    for a, b in PAIRS:
        texts = [a, b, f" {b} {a}", a]
        assert enc.encode(texts)[0].tolist() == [i for t in texts for i in enc.plain(t)]


def test_encoder_compares_pieces_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(ts, "span_hashes", lambda points, starts, ends: np.sort((ends - starts).astype(np.uint64))[np.argsort(np.argsort(ends - starts))])
    enc = ts.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    for texts in (["one two six", "ten"], ["six", "two and three"], [""]):
        assert enc.encode(texts)[0].tolist() == [i for t in texts for i in enc.plain(t)]


def test_a_tokenizer_that_cuts_otherwise_is_used_as_it_is():
    import json

    d = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    assert ts.cuts_alike(json.dumps(d))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": d["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": None}):
        assert not ts.cuts_alike(json.dumps(d | change))


def test_word_tables_tell_them_apart():
    for model in (language.train([(f"{a} {a}", "x") for a, _ in PAIRS] + [(f"{b} {b}", "y") for _, b in PAIRS]), toxicity.Model(["ababab"], np.ones(1), 0.0, (1.0, 0.0))):
        for a, b in PAIRS:
            joined = f"{a} {b} {a}"
            points = points_of(joined)
            at = runs(points != 32)
            from quillspan.llm.wordtable import WordTable

            seen = []
            WordTable(lambda w: seen.extend(w) or np.zeros((len(w), 1), np.float32), 1).look(joined, points, *at)
            assert sorted(seen) == sorted([a, b])
        assert model is not None


def test_chain_of_ten_thousand(spark):
    links = spark.range(9999).selectExpr("id u", "id + 1 v")
    steps = []
    out = components.contract(None, links, steps)
    assert out.where("root <> 0").count() == 0 and out.count() == 10_000
    assert len(steps) <= 17


def test_chain_in_any_order_and_added_links(spark):
    ids = list(range(600))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, ids[1:]))
    cut = [r for i, r in enumerate(rows) if i != 300]
    steps = []
    first = components.contract(None, spark.createDataFrame([*cut, *cut[:50], (5, 5)], "u long, v long"), steps)
    assert first.select("root").distinct().count() == 2 and len(steps) < 40
    assert components.contract(first, spark.createDataFrame([rows[300]], "u long, v long")).where("root <> 0").count() == 0
    assert components.contract(None, spark.createDataFrame([], "u long, v long")).count() == 0


def test_template_pages_that_do_not_link(spark):
    """Documents that share 60 % of their shingles: signatures of many documents, no links but of the copies."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(120)]
    rows = [(d, " ".join([*template, *[f"u{rng.randrange(10**9)}" for _ in range(60)]])) for d in range(120)]
    rows += [(500 + d, rows[d][1] + " end") for d in range(0, 120, 9)] + [(700, rows[3][1]), (3, "other words of the third " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, bucket_bytes=10_000).collect()}
    want = groups([r for r in rows if r[1] != rows[-1][1]])
    assert got == {(d, n, c) for d, (n, c) in want.items()} | {(3, len(brute_shingles(rows[-1][1])), 3)}


def test_rows_of_one_id_join_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(9, a), (9, b), (4, a + " x"), (7, b), (2, "alone"), (None, a)]
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(9, 4), (4, 4), (7, 4), (2, 2), (None, None)}
    kept = ngram_join.without_duplicates(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "None"]
