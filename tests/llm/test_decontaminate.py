import random

import pytest

from quillspan.llm import decontaminate as dc


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        r = rng.random()
        t[k : k + 1] = [] if r < 0.3 else [t[k], "z"] if r < 0.6 else ["y"]
    return "".join(t)


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(items, text):
    """Items of which a window is in the text within its edits."""
    out, t = set(), dc.normal(text).encode()
    for k, x in items:
        b = dc.normal(x or "").encode()
        if len(b) < dc.Q:
            continue
        size = min(dc.WINDOW, len(b))
        edits = dc.EDITS * size // dc.WINDOW
        while edits and size + 1 - dc.Q - dc.Q * edits < 1:
            edits -= 1
        for s in {*range(0, len(b) - size + 1, max(1, size // 2)), len(b) - size}:
            if least_edits(b[s : s + size], t) <= edits:
                out.add(k)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_matches_brute_force(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice([3, 8, 15, 30, 50]))) for i in range(8)] + [(8, None), (9, "short")]
    texts = ["", words(rng, 40)]
    for k in range(10):
        x = items[k % 8][1]
        texts.append(f"{words(rng, 10)}\n\t{edited(rng, x, k * len(x) // 100).upper()}  {words(rng, 9)}")
    texts.append(items[4][1][: len(items[4][1]) // 3])
    index = dc.Index(items)
    got = {}
    for t, i in index.found(texts):
        got.setdefault(t, set()).add(index.items[i][0])
    assert got == {n: b for n, t in enumerate(texts) if (b := brute(items, t))}


def test_tables(spark):
    rng = random.Random(9)
    items = [(i, words(rng, 40), "q") for i in range(6)]
    rows = [(1, "x " + items[2][1] + " y", 0), (1, "clean text", 0), (2, None, 0), (3, "", 0), (None, items[0][1], 0), (4, words(rng, 3000) + items[1][1], 0), (4, words(rng, 3000) + items[1][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = sorted((str(r.doc_id), r.item_id, r.edits, r.share) for r in dc.hits(docs, bench).collect())
    assert got == [("1", 2, 0, 1.0), ("4", 1, 0, 1.0), ("4", 1, 0, 1.0), ("None", 0, 0, 1.0)]
    assert len(dc.blocks(bench, most=300)[0]) > 1
    again = dc.hits(docs, bench.unionByName(bench), most=300).collect()  # several blocks, repeated items
    assert sorted((str(r.doc_id), r.item_id, r.edits, r.share) for r in again) == sorted(got * 2)
    assert sorted(r.doc_id for r in dc.without(docs, bench, most=300).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in dc.without(docs, bench).collect()) == [1, 2, 3]
    assert dc.without(docs, bench.limit(0)).count() == 7 and dc.hits(docs.limit(0), bench).count() == 0


def production_like(seed):
    rng = random.Random(seed)
    return rng, [(i, words(rng, 60)) for i in range(20)]


@pytest.mark.parametrize("n", [13, 16, 20, 30])
def test_excerpts_at_any_offset(spark, n):
    rng, items = production_like(n)
    rows, want = [], set()
    for d in range(60):
        k, x = items[d % 20]
        s = rng.randint(0, 60 - n)
        rows.append((d, f"{words(rng, 30)} {' '.join(x.split()[s : s + n]).upper()}\n{words(rng, 30)}"))
        want.add((d, k))
    rows += [(100 + d, words(rng, 90)) for d in range(20)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.hits(docs, bench).collect()} == want
    assert {r.doc_id for r in dc.without(docs, bench).collect()} == set(range(100, 120))


def test_excerpts_match_brute_force():
    """Texts with edited excerpts, against all excerpts by plain alignment."""
    rng, items = production_like(1)
    items = [*items[:6], (90, "x" * 300), (91, " ".join("ab" for _ in range(40)))]
    texts = ["", items[0][1], words(rng, 40), "x" * 100, "ab " * 20]
    for n in range(24):
        x = items[n % 6][1].split()
        s = rng.randint(0, 60 - 13)
        texts.append(f"{words(rng, 6)} {edited(rng, ' '.join(x[s : s + 13]), n // 3)} {words(rng, 6)}")
    index = dc.Index(items, parts=True)
    want = {(t, i) for t, text in enumerate(texts) for i, (_, b) in enumerate(index.items) if any(least_edits(b[s : s + n], dc.normal(text).encode()) <= dc.scaled(n)[0] for s, n in dc.excerpts(b)) or index.items[i][0] in brute(items, text)}
    assert set(index.found(texts)) == want and len(want) > 20


def test_excerpts_have_their_sizes():
    for b in (b"", b"abc", b" ".join([b"a"] * 12), b" ".join([b"a"] * 60), b"x" * 300, " ".join(["wörter"] * 40).encode()):
        got = dc.excerpts(b)
        assert all(dc.SHORTEST <= n <= dc.LONGEST and s + n <= len(b) for s, n in got)
        assert got == sorted(got) and [s + n for s, n in got] == sorted(s + n for s, n in got)
    assert dc.excerpts(b"x" * 300)[:2] == [(0, 80), (20, 80)] and len(dc.excerpts(b" ".join([b"a"] * 60))) > 20
