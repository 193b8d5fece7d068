import random

import numpy as np
from test_text_ops import brute_shingles

from quillspan.llm import ngram_join as nj
from quillspan.llm.textnum import shingle_sets


def groups(rows):
    sets = {d: brute_shingles(t or "") for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def variants(seed, families=12, each=9):
    rng = random.Random(seed)
    rows, k = [], 0
    for f in range(families):
        n = rng.choice([1, 3, 5, 6, 8, 10, 14, 20, 30, 60, 150, 400])
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for _ in range(each):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                t[rng.randrange(n)] = f"x{rng.randrange(9999)}"
            rows.append((k, " ".join(t)))
            k += 1
        rows.append((k, " ".join([*["the same passage of many words that goes on and on"] * 2, *[f"y{rng.randrange(9999)}" for _ in range(20)]])))
        k += 1
    rng.shuffle(rows)
    return rows


def test_linking_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 200)) if rng.random() < 0.7 else int(rng.integers(1, 12))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 9) + 1))
        keep = rng.permutation(a)[drop:]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, int(rng.integers(0, max(1, len(a) // 9) + 1)), dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= 80 * (len(a) + len(b) - inter):
            (x, least), (y, other) = nj.signatures(a), nj.signatures(b)
            shared = set(x.tolist()) & set(y.tolist())
            assert shared
            assert any(sum(s & 1 == k for s in shared) >= max(least[k], other[k], 1) for k in (0, 1))
        differ = int(np.bitwise_count((nj.parities(a) ^ nj.parities(b)).view(np.uint64)).sum()) if len(b) else 0
        assert differ <= len(a) + len(b) - 2 * inter


def test_sets_in_one_part_still_meet():
    # All hashes in one narrow range: nearly all parts are empty.
    for n in (5, 30, 120, 400):
        a = np.arange(1, n + 1, dtype=np.uint64)
        b = a[max(1, n // 6) :] if n > 5 else a[1:]
        assert 100 * len(b) >= 80 * len(a)
        assert set(nj.signatures(a)[0].tolist()) & set(nj.signatures(b)[0].tolist())


def test_components_match_brute_force(spark):
    rows = variants(5) + [(900, None), (901, ""), (902, "  \n")]
    want = groups(rows)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, sig int, first int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, bucket_bytes=20_000).collect()}
    assert got == want


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    got = sorted((r.doc_id or -1, r.component_id) for r in nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1)]
    assert nj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingle_sets_are_sorted():
    (x,) = shingle_sets([b"a b c d e f g a b c d e f g"])
    assert (np.diff(x.astype(object)) > 0).all()


def test_bloom_filter_holds_all_members(spark):
    import pyarrow as pa

    from quillspan.llm import common

    ids = [*range(-50, 3000, 7), 1 << 60, -(1 << 62)]
    bits = common.bloom(spark.createDataFrame([(i,) for i in ids], "id long"), "id")
    assert common.may_hold(bits, pa.array([*ids, None])).tolist() == [True] * len(ids) + [False]
    assert common.may_hold(bits, pa.array(range(10_000, 20_000))).mean() < 0.1
