import random

import numpy as np

from quillspan.llm import language, toxicity

SYLLABLES = {"aa": ["tha", "wen", "ing", "ley"], "bb": ["schu", "keit", "ver", "ung"], "cc": ["eau", "tré", "oiç", "que"]}


def sentence(rng, lang, n=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def corpus(seed, n=150):
    rng = random.Random(seed)
    return [("\n".join(sentence(rng, lang) for _ in range(rng.randint(1, 5))), lang) for lang in rng.choices(sorted(SYLLABLES), k=n)]


def test_forward_backward_matches_enumeration():
    c = language.Chains(["ab cd ef\nx", "", "q r"])
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    pairs = np.zeros((2, 2))
    post, log_z = c.marginals(scores, trans, pairs)
    assert c.per_text.tolist() == [4, 0, 2]
    want, total, moves = np.zeros((6, 2)), 0.0, np.zeros((2, 2))
    for chain in ([0, 1, 2], [3], [4, 5]):
        z, part, mv = 0.0, np.zeros((6, 2)), np.zeros((2, 2))
        for code in range(2 ** len(chain)):
            y = [code >> i & 1 for i in range(len(chain))]
            p = np.exp(sum(scores[w, k] for w, k in zip(chain, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += p
            for w, k in zip(chain, y):
                part[w, k] += p
            for a, b in zip(y, y[1:]):
                mv[a, b] += p
        want += part / z
        moves += mv / z
        total += np.log(z)
    assert np.allclose(post, want) and np.isclose(log_z, total) and np.allclose(pairs, moves)


def test_held_out_language_and_code_switches():
    model = language.train(corpus(1))
    test = corpus(2, 80)
    got = model.predict([t for t, _ in test])
    assert sum(g[0] == y for g, (_, y) in zip(got, test)) >= 76
    rng = random.Random(3)
    spans = language.word_spans(sentence(rng, "aa", 10) + "\n" + sentence(rng, "bb", 10), model)
    assert sum(s[2] == ("aa" if i < 10 else "bb") for i, s in enumerate(spans)) >= 18
    assert model.predict(["", "12 ?! 3"]) == [("und", 0.0, 0, 0, 0.0)] * 2


def test_unlearned_languages_are_rejected(spark):
    model = language.train(corpus(1))
    rng = random.Random(5)
    junk = ["".join(rng.choices("bcdfghjkmpqrtvxz", k=7)) for _ in range(40)]
    mixed = sentence(rng, "aa", 20) + "\n" + sentence(rng, "bb", 20)
    rows = [(1, sentence(rng, "aa"), 0), (2, " ".join(junk), 0), (3, "привет как дела", 0), (4, mixed, 0), (5, None, 0), (5, sentence(rng, "cc"), 0), (None, sentence(rng, "bb"), 0), (7, "12 ?", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang int")
    out = language.known(df, model)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "5", "None"]
    assert language.known(df.limit(0), model).count() == 0


def test_language_table(spark):
    rows = [(i, t, y, "s") for i, (t, y) in enumerate(corpus(4, 60))] + [(60, None, "aa", "s"), (None, "ing ley", "aa", "s"), (62, "", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(df, where=~language.held_out("k", 5, 0))
    out = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert len(out) == len(rows) and out[60].lang_pred == "und" and out[62].score == 0.0 and out[None].lang_pred in SYLLABLES
    empty = df.limit(0)
    assert language.fit(empty).langs == [] and language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(df, language.fit(empty)).collect()} == {"und"}


def brute_kernel(s, t, p=toxicity.P, d=toxicity.DECAY):
    from itertools import combinations

    def spans(w):
        out = {}
        for c in combinations(range(len(w)), p):
            k = "".join(w[i] for i in c)
            out[k] = out.get(k, 0.0) + d ** (c[-1] - c[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_kernel_matches_enumeration():
    words = ["idiot", "idixot", "iidioot", "thing", "ab", "abcabc", "ééé"]
    got = toxicity.kernel(words, ["idiot", "abcabc", "éaéé"])
    for i, s in enumerate(words):
        for j, t in enumerate(["idiot", "abcabc", "éaéé"]):
            own = brute_kernel(s, s) * brute_kernel(t, t)
            want = (brute_kernel(s, t) / own**0.5) ** toxicity.SHARP if own else 0.0
            assert abs(got[i, j] - want) < 1e-4


def toxic_rows(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [sentence(rng, rng.choice(sorted(SYLLABLES))) for _ in range(4)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(4)] += f" you {rng.choice(['blockhead', 'nitwit', 'dunce'])} there."
        rows.append(("\n".join(words), int(bad)))
    return rows


def test_held_out_toxicity_and_gaps():
    model = toxicity.train(toxic_rows(1), 0.25)
    test = toxic_rows(2, 120)
    right = (model.score([t for t, _ in test]) >= toxicity.CUT) == np.array([y for _, y in test], bool)
    assert right.mean() >= 0.95
    s = model.score(["", "a plain sentence", "you blockhead", "you b l o c k h e a d", "you b.l.o.c.k.h.e.a.d", "you blockxhead"])
    assert (s[:2] < toxicity.CUT).all() and (s[2:] >= toxicity.CUT).all()


def test_toxicity_table(spark):
    rows = [(i, t, 5) for i, (t, _) in enumerate(toxic_rows(3))] + [(900, None, 5), (900, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(toxic_rows(3))] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert [r.predicted for r in out if r.doc_id == 900] == [0, 0]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_texts(docs, none).collect()} != set() and toxicity.score_texts(docs.limit(0), none).count() == 0


def test_training_draws_from_whole_texts():
    """What only late lines hold is learned."""
    rng = random.Random(7)
    late = {"aa": "zorgu", "bb": "plimf"}
    rows = [("\n".join([*(sentence(rng, "cc") for _ in range(40)), *(f"{late[y]} " * 12 for _ in range(40))]), y) for y in ("aa", "bb") for _ in range(12)]
    model = language.train(rows)
    assert [g[0] for g in model.predict(["zorgu zorgu zorgu", "plimf plimf plimf"])] == ["aa", "bb"]
    for text in (rows[0][0], "one line of words " * 2000, "a\n" * 1000):
        c = language.Chains([text])
        got = language.Chains([language.drawn(c)])
        assert len(got.starts) == language.TRAIN_WORDS and got.joined == language.drawn(c)
    assert language.drawn(language.Chains(["two words\nmore"])) == language.Chains(["two words\nmore"]).joined


def test_held_out_rows_and_other_columns_do_not_influence_scores(spark, tmp_path):
    """The registered queries on the smallest tables, and on them with labels, languages and sources of held-out rows changed."""
    from pyspark.sql import functions as F

    from quillspan.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out3, out6 = language.held_out("doc_id", 5, 0), language.held_out("doc_id", 4, 2)
    docs.withColumns({"lang": F.when(out3, "xx").otherwise(F.col("lang")), "source": F.lit("other")}).write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("toxic", F.when(out6, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    for query in (queries.op3_language, queries.op6_toxicity):
        before, after = ({r.doc_id: r for r in query(spark, d).collect()} for d in (sf, str(tmp_path)))
        assert before == after and len(before) == docs.count() and any(r.held_out for r in before.values())
