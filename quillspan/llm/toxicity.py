"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel of two words sums the subsequences of ``P`` letters they share, each weighed by DECAY to the power of
the letters it spans in both, and is normalised; so an insult with letters put in, left out or drawn apart is still
near the plain one; a power of a kernel is one too, and leaves chance likeness small. Single letters drawn apart by blanks are joined into a word. The kernel of two sentences is the
sum over their words, which is linear in the landmarks' space, so a sentence's margin is the sum of its words'.

Training takes at most ``TRAIN_DOCS`` documents of each label (the first by a hash of the id). Landmarks are the words
that set labelled texts apart most, and frequent ones. A toxic document's sentence with the largest
margin counts as toxic, those of other documents as clean (three rounds). A document's score is that of its
worst sentence, by a logistic fit.

Edge cases: null and empty texts have the margin of an empty sentence; with labels of only one kind the score is
their share; rows are scored one by one, so repeated ones get equal scores; words of over ``LONGEST`` letters
are taken in overlapping windows, whose largest kernel counts; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm.wordtable import kept_table, points_of, runs

P, DECAY, SHARP, LONGEST = 3, 0.8, 3, 24
LANDMARKS, TRAIN_DOCS = 64, 1000
CUT = 0.3
#: Blanks and the marks at which sentences end.
STOPS = np.array([10, 33, 46, 63], np.uint32)
BLANKS = np.array([9, 10, 11, 12, 13, 32, 160], np.uint32)
MARKS = re.compile(r"[\W_]")
APART = re.compile(r"(?<!\S)\w(?:[ \t]\w(?!\S)){2,}")


def codes(words: list[str], size: int) -> np.ndarray:
    out = np.zeros((len(words), size), np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = points_of(w)
    return out


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of each word of ``a`` with each of ``b`` (code points, 0 beyond the end).

    Letter by letter of the first word; axes are the second word's letters, first words, second words.
    """
    n, m, width = len(a), len(b), b.shape[1]
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    prefix = [np.full((width + 1, n, m), p == 0, np.float32) for p in range(P)]  # K' of p letters, for the prefixes so far
    total = np.zeros((n, m), np.float32)
    letters = np.ascontiguousarray(b.T)[:, None, :]
    for i in range(a.shape[1]):
        same = (letters == np.where(a[:, i], a[:, i], 0xFFFFFFFF)[None, :, None]).astype(np.float32)
        same *= square
        total += np.einsum("jnm,jnm->nm", same, prefix[P - 1][:-1])
        for p in range(P - 1, 0, -1):
            hit = same * prefix[p - 1][:-1]
            for j in range(1, width):  # sums over the second word, with decay
                hit[j] += decay * hit[j - 1]
            prefix[p] *= decay
            prefix[p][1:] += hit
    return total


def self_kernel(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        for lo in range(0, len(at), 2000):
            part = at[lo : lo + 2000]
            x = codes([words[i] for i in part], n)
            prefix = np.ones((P, len(part), n + 1), np.float32)
            prefix[1:] = 0
            total = np.zeros(len(part), np.float32)
            for i in range(n):
                same = x[:, i, None] == x
                total += np.float32(DECAY**2) * np.where(same, prefix[P - 1, :, :-1], 0).sum(1)
                for p in range(P - 1, 0, -1):
                    hit = np.where(same, prefix[p - 1, :, :-1], 0) * np.float32(DECAY**2)
                    for j in range(1, n):
                        hit[:, j] += np.float32(DECAY) * hit[:, j - 1]
                    prefix[p] *= np.float32(DECAY)
                    prefix[p, :, 1:] += hit
            out[part] = total
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel, to the power ``SHARP``; 0 where a word has fewer than P letters."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    width = max(map(len, landmarks), default=1)
    b = codes(landmarks, width)
    own = self_kernel(landmarks)
    order = sorted((i for i in range(len(words)) if len(words[i]) >= P), key=lambda i: len(words[i]))
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + 256)
        part = order[lo:hi]
        w = [words[i] for i in part]
        k = raw_kernel(codes(w, len(w[-1])), b)
        out[part] = (k / np.sqrt(np.maximum(self_kernel(w)[:, None] * own[None], 1e-20))) ** SHARP
        lo = hi
    return out


def windows(word: str) -> list[str]:
    """The word, and it without the marks within; in windows if it is long."""
    plain = word if word.isalnum() else MARKS.sub("", word)
    return [x for w in dict.fromkeys((word, plain)) for x in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)])]


def cleaned(text: str) -> str:
    text = text.lower()
    return APART.sub(lambda m: re.sub(r"[ \t]", "", m[0]), text)


class Sentences:
    """Words and sentences of texts; words end at blanks and lose the marks around them."""

    def __init__(self, texts: list[str]) -> None:
        clean = list(map(cleaned, texts))
        self.joined = "\n".join(clean)
        self.points = points_of(self.joined) if self.joined else np.empty(0, np.uint32)
        stop = np.isin(self.points, STOPS)
        blank = np.isin(self.points, BLANKS)
        # A mark ends a sentence only before a blank; other marks stay within a word, as in i.d.i.o.t
        final = stop & np.append(blank[1:], True)
        self.starts, self.ends = runs(~(blank | final | np.isin(self.points, np.array([34, 40, 41, 44, 58, 59], np.uint32))))
        sentence = np.searchsorted(np.flatnonzero(final | (self.points == 10)), self.starts)
        n = len(sentence)
        self.first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))) if n else np.empty(0, np.int64)
        stops = np.cumsum(np.fromiter(map(len, clean), np.int64, len(clean)) + 1)
        self.text_of = np.searchsorted(stops, self.starts[self.first], "right") if n else np.empty(0, np.int64)
        self.n = len(texts)

    def margins(self, words: np.ndarray, bias: float) -> np.ndarray:
        """The largest margin of each text's sentences."""
        out = np.full(self.n, bias)
        if len(self.first):
            np.maximum.at(out, self.text_of, np.add.reduceat(words.astype(np.float64), self.first) + bias)
        return out


class Model:
    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, scale: tuple[float, float]) -> None:
        self.landmarks, self.weights, self.bias, self.scale, self.name = landmarks, weights, bias, scale, f"toxicity-{uuid.uuid4().hex}"

    def fill(self, words: list[str]) -> np.ndarray:
        parts = [windows(w) for w in words]
        k = kernel([x for p in parts for x in p], self.landmarks)
        if len(k) != len(words):
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            k = np.maximum.reduceat(k, np.cumsum(n) - n)
        return (k @ self.weights)[:, None].astype(np.float32)

    def margins(self, texts: list[str]) -> np.ndarray:
        s = Sentences(texts)
        if not self.landmarks:
            return np.full(len(texts), self.bias)
        table = kept_table(self.name, self.fill, 1)
        return s.margins(table.look(s.joined, s.points, s.starts, s.ends)[:, 0], self.bias)

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """L2-regularised squared-hinge machine, by Newton steps; classes weigh the same. The last column of x is the bias."""
    w = np.zeros(x.shape[1])
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost / len(y) * 2
    ridge = np.full(x.shape[1], 1e-3)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        m = y * (x @ w)
        on = m < 1
        g = ridge * w - x[on].T @ (each[on] * y[on] * (1 - m[on]))
        h = np.diag(ridge) + (x[on] * each[on, None]).T @ x[on]
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    x = np.stack([m, np.ones(len(m))], 1)
    w = np.array([a, b])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0]), float(w[1])


def train(rows: list[tuple[str, int]], share: float) -> Model:
    """``share``: of toxic rows among all labelled ones, for the logistic fit's intercept."""
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        p = min(max(float(share), 1e-6), 1 - 1e-6)
        return Model([], np.zeros(0), 0.0, (0.0, float(np.log(p / (1 - p)))))
    s = Sentences([r[0] or "" for r in rows])
    vocab: dict[str, int] = {}
    index = np.empty(len(s.starts), np.int64)
    for lo in range(0, len(index), 50_000):
        part = slice(lo, lo + 50_000)
        index[part] = [vocab.setdefault(s.joined[a:b], len(vocab)) for a, b in zip(s.starts[part].tolist(), s.ends[part].tolist(), strict=True)]
    text_of_word = np.repeat(s.text_of, np.diff(np.append(s.first, len(index))))
    n = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    once = np.unique(text_of_word * len(vocab) + index)  # a word counts once in a text
    label = y[once // len(vocab)]
    counts = [np.bincount((once % len(vocab))[label == k], minlength=len(vocab)) for k in (0, 1)]
    held = [Counter({w: int(c) for w, c in zip(vocab, counts[k].tolist(), strict=True) if c}) for k in (0, 1)]
    del once, label, text_of_word
    odds = {w: (c + 0.5) / (n[1] + 1) * np.log(((c + 0.5) / (n[1] + 1)) / ((held[0][w] + 0.5) / (n[0] + 1))) for w, c in held[1].items() if c >= 2 and P <= len(w) <= LONGEST}
    marked = sorted(odds, key=lambda w: (-odds[w], w))
    landmarks: list[str] = []
    for w in marked:  # a landmark near another adds little
        if len(landmarks) >= LANDMARKS * 3 // 4:
            break
        if odds[w] > 0 and (not landmarks or kernel([w], landmarks).max() < 0.8):
            landmarks.append(w)
    common_words = [w for w, _ in (held[0] + held[1]).most_common(4000) if P <= len(w) <= LONGEST and w not in landmarks]
    landmarks += common_words[:: max(1, len(common_words) // 64)][: LANDMARKS - len(landmarks)]
    gram = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh(gram)
    root = vector / np.sqrt(np.maximum(value, 1e-4))
    parts = [windows(w) for w in vocab]
    k = kernel([x for p in parts for x in p], landmarks)
    each = np.fromiter(map(len, parts), np.int64, len(parts))
    k = np.maximum.reduceat(k, np.cumsum(each) - each)
    phi = (k @ root.astype(np.float32)).astype(np.float32)
    strong = np.array([max(0.0, odds.get(w, 0.0)) for w in vocab])[index]
    sent = np.ones((len(s.first), phi.shape[1] + 1))
    for lo in range(0, len(s.first), 2000):  # sums over words, some sentences at a time
        at = s.first[lo : lo + 2000]
        end = s.first[lo + 2000] if lo + 2000 < len(s.first) else len(index)
        sent[lo : lo + 2000, :-1] = np.add.reduceat(phi[index[at[0] : end]], at - at[0])
    worst = np.add.reduceat(strong, s.first)
    clean = np.flatnonzero(y[s.text_of] == 0)
    clean = clean[:: max(1, len(clean) // 20_000)]
    w = np.zeros(sent.shape[1])
    for _ in range(3):
        order = np.lexsort((worst, s.text_of))
        last = order[np.flatnonzero(np.append(s.text_of[order][1:] != s.text_of[order][:-1], True))]
        picked = last[y[s.text_of[last]] == 1]
        at = np.concatenate([picked, clean])
        w = svm(sent[at], np.where(y[s.text_of[at]] == 1, 1.0, -1.0))
        worst = sent @ w
    model = Model(landmarks, root @ w[:-1], float(w[-1]), (1.0, 0.0))
    margin = s.margins((k @ model.weights.astype(np.float32))[index], model.bias)
    a, b = logistic(margin, y.astype(float))
    p = min(max(share, 1e-6), 1 - 1e-6)  # the sample has as many of each label, the table has not
    return Model(landmarks, model.weights, model.bias, (a, b + float(np.log(p / (1 - p)) - np.log(n[1] / n[0]))))


def fit(docs: DataFrame, labels: DataFrame, where=None, key: str = "doc_id", text: str = "text", label: str = "toxic", each: int = TRAIN_DOCS) -> Model:  # noqa: ANN001
    """Train on a bounded sample: the ``each`` first documents of each label, by a hash of the key."""
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    marks = marks if where is None else marks.where(where)
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in (0, 1):
        part = common.by_hash(marks.where(F.col("y") == y).select("k", "y"), "k", each, counts.get(y, 0))
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(ids.distinct(), "k").select("k", "t", "y").collect()
    rows = sorted(((r.k, r.t or "", r.y) for r in rows), key=lambda r: (r[0], r[2], r[1]))
    total = sum(counts.values())
    return train([(t, y) for _, t, y in rows], counts.get(1, 0) / total if total else 0.0)


def score_texts(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of each row; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                s = model.score([t or "" for t in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= cut).astype(np.int32))})

    common.small_batches(df.sparkSession)
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(common.lean(run), "doc_id long, score double, predicted int")
