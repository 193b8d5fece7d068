import hashlib
import random

import numpy as np
import pytest

from quillspan.llm import suffix_dedup as sd
from quillspan.llm.suffix_sort import suffix_array


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_come_sorted(seed, tmp_path):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        t = np.append(rng.integers(1, rng.integers(2, 6), int(rng.integers(1, 60))), 0).astype(np.uint16)
        got = suffix_array(t, 6, 1000, str(tmp_path), memory=int(rng.integers(8, 300)))
        assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute(rows):
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - sd.MATCH + 1):
            s = b[i : i + sd.MATCH]
            first[s] = min(first.get(s, sd.NO_ID), sd.NO_ID if k is None else k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - sd.MATCH + 1):
            if first[b[i : i + sd.MATCH]] < (sd.NO_ID if k is None else k):
                gone[i : i + sd.MATCH] = [True] * sd.MATCH
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((k, len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    passages = [text(rng.randint(45, 200)) for _ in range(6)]
    rows = []
    for _ in range(60):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            c = rng.randint(0, 30)
            parts += [p[c:] if rng.random() < 0.3 else p, text(rng.randint(0, 60))]
        rows.append((rng.randrange(80), "".join(parts)))
    rows += [(3, "!" * 300), (70, "!" * 9000), (71, "x" + "!" * 60), (None, passages[0] * 2), (None, passages[0]), (5, None), (6, ""), (7, "é" * 49), (8, "é" * 25), (0, "\0" * 80), (90, "a\0" + "\0" * 70)]
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(0, sd.HOT), (1, sd.HOT), (2, 5), (3, 0)])
def test_table_matches_brute_force(spark, seed, hot):
    """With no, some and all anchors hot."""
    rows = made(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string").repartition(4)
    got = sorted((tuple(r) for r in sd.remove_repeats(df, hot=hot).collect()), key=str)
    assert got == brute(rows)


def test_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "q" * 60), (2, "é" + "q" * 60)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(df, with_text=True).collect()} == {1: b"q" * 60, 2: "é".encode()}
    assert sd.remove_repeats(df.limit(0)).count() == 0
