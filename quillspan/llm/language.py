"""Language ID: a linear-chain conditional random field over words.

Features of a word: prefixes and suffixes of 1 to 3 letters, letter n-grams of 1 to 3 with word ends, its
place in the lexicon (the most frequent words of a language among the training texts), and the word itself. With learned
transitions they label each word of a line by forward-backward; a text's language is the one with the
largest sum of its words' posteriors, so that text in several languages is split word by word.

Training takes at most ``TRAIN_DOCS`` labelled documents (the first by a hash of the id) and ``TRAIN_WORDS`` words of
each, in lines drawn by a hash from the whole text; all words of a training text carry its label. Chains are lines, cut every ``CHAIN`` words.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in
order of name; with no labelled rows at all every text is ``und``; a null id is not held out; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm.wordtable import kept_table, letters, points_of, runs

TRAIN_DOCS, TRAIN_WORDS = 1200, 300
CHAIN = 128
LEXICON = 300
NONE = "und"
#: Mean familiarity of the words of a text that is in a learned language.
FAMILIAR = 0.5


def features(word: str) -> list[str]:
    w = f"<{word}>"
    out = [f"w{word}"]
    out += [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    out += [w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return out


class Chains:
    """Words of texts in lines of at most CHAIN words, with forward-backward over all of them at once."""

    def __init__(self, texts: list[str]) -> None:
        self.joined = "\n".join(texts)
        self.points = points_of(self.joined) if self.joined else np.empty(0, np.uint32)
        self.starts, self.ends = runs(letters(self.points))
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.per_text = np.diff(np.searchsorted(self.starts, stops), prepend=0)
        line = np.searchsorted(np.flatnonzero(self.points == 10), self.starts)
        n = len(line)
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if n else np.empty(0, np.int64)
        size = np.diff(np.append(first, n))
        pieces = -(-size // CHAIN)
        self.first = np.repeat(first, pieces) + CHAIN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        self.size = np.diff(np.append(self.first, n))
        order = np.argsort(-self.size, kind="stable")
        self.first, self.size = self.first[order], self.size[order]
        self.active = [int(np.searchsorted(-self.size, -t)) for t in range(int(self.size[0]) if n else 0)]  # chains with more than t words

    def marginals(self, scores: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Posteriors of each word's labels, and the sum of the chains' log partition functions; adds expected transitions to ``pairs``."""
        top = scores.max(1, keepdims=True) if len(scores) else scores
        emit, move = np.exp(scores - top).astype(np.float64), np.exp(trans)
        out = np.zeros(emit.shape)
        log_z = float(top.sum())
        alphas, scales = [], []
        for t, n in enumerate(self.active):
            at = self.first[:n] + t
            a = emit[at] if t == 0 else (alphas[-1][:n] @ move) * emit[at]
            z = a.sum(1, keepdims=True)
            log_z += float(np.log(z).sum())
            alphas.append(a / z)
            scales.append(z)
        beta = None
        for t in range(len(self.active) - 1, -1, -1):
            n = self.active[t]
            at = self.first[:n] + t
            b = np.ones((n, emit.shape[1]))
            if beta is not None:
                m = len(beta)
                ahead = emit[self.first[:m] + t + 1] * beta / scales[t + 1]
                b[:m] = ahead @ move.T
                if pairs is not None:
                    pairs += move * (alphas[t][:m].T @ ahead)
            out[at] = alphas[t] * b
            beta = b
        return out, log_z


class Model:
    """Weights of features by language, and transitions."""

    def __init__(self, langs: list[str], index: dict[str, int], weights: np.ndarray, lexicon: dict[str, list[int]], trans: np.ndarray) -> None:
        self.langs, self.index, self.weights, self.lexicon, self.trans = langs, index, weights, lexicon, trans
        self.name = f"language-{uuid.uuid4().hex}"

    def of(self, word: str) -> list[int]:
        got = [i for f in features(word) if (i := self.index.get(f)) is not None]
        return got + self.lexicon.get(word, [])

    def familiar(self, word: str) -> float:
        """1 for a learned word, else the share of its three-letter pieces (with its ends) that are learned ones of any language."""
        if f"w{word}" in self.index or word in self.lexicon:
            return 1.0
        w = f"<{word}>"
        n = len(w) - 2
        return sum(w[i : i + 3] in self.index for i in range(n)) / n

    def fill(self, words: list[str]) -> np.ndarray:
        """A row for each word: its score by language, and how familiar it is."""
        ids = [self.of(w) for w in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
        run = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.weights[flat].astype(np.float64), 0)])
        ends = np.cumsum(n)
        near = np.fromiter(map(self.familiar, words), np.float32, len(words))
        return np.concatenate([(run[ends] - run[ends - n]).astype(np.float32), near[:, None]], 1)

    def tag(self, texts: list[str]) -> tuple[Chains, np.ndarray, np.ndarray]:
        """The words, their posteriors, and how familiar each is."""
        k = len(self.langs)
        c = Chains([t.lower() for t in texts])
        rows = kept_table(self.name, self.fill, k + 1).look(c.joined, c.points, c.starts, c.ends)
        return c, c.marginals(rows[:, :k], self.trans)[0], rows[:, k]

    def predict(self, texts: list[str]) -> list[tuple[str, float, int, int, float]]:
        """(language, score, words, words in other languages, mean familiarity of the words) of each text."""
        if not self.langs:
            return [(NONE, 0.0, 0, 0, 0.0)] * len(texts)
        c, post, near = self.tag(texts)
        out = []
        seen = np.concatenate([[0.0], np.cumsum(near, dtype=np.float64)])
        run = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(post, 0)])
        best = post.argmax(1) if len(post) else np.empty(0, np.int64)
        at = 0
        for n in c.per_text.tolist():
            if not n:
                out.append((NONE, 0.0, 0, 0, 0.0))
            else:
                p = (run[at + n] - run[at]) / n
                k = int(p.argmax())
                out.append((self.langs[k], float(min(1.0, max(0.0, p[k]))), n, int((best[at : at + n] != k).sum()), float(seen[at + n] - seen[at]) / n))
            at += n
        return out


def drawn(c: Chains, most: int = TRAIN_WORDS) -> str:
    """Lines of one text of at most ``most`` words together, by a hash of their content and place, in their order in the text."""
    if len(c.starts) <= most:
        return c.joined
    spans = [(int(a), int(a + n)) for a, n in zip(c.first, c.size, strict=True)]
    text = lambda a, b: c.joined[int(c.starts[a]) : int(c.ends[b - 1])]
    out, left = [], most
    for a, b in sorted(spans, key=lambda x: (zlib.crc32(f"{x[0]} {text(*x)}".encode("utf-8", "surrogatepass")), x)):
        out.append((a, min(b, a + left)))
        left -= out[-1][1] - a
        if not left:
            break
    return "\n".join(text(a, b) for a, b in sorted(out))


def train(rows: list[tuple[str, str]], rounds: int = 30, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Fit by AdaGrad on the whole batch: expected less observed counts of features and transitions."""
    langs = sorted({y for _, y in rows})
    code = {y: i for i, y in enumerate(langs)}
    cut = []
    for text, y in rows:
        c = Chains([(text or "").lower()])
        if len(c.starts):
            cut.append((drawn(c), code[y]))
    if not cut or len(langs) < 1:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    c = Chains([t for t, _ in cut])
    label = np.repeat([y for _, y in cut], c.per_text)
    words = [c.joined[a:b] for a, b in zip(c.starts.tolist(), c.ends.tolist(), strict=True)]
    vocab: dict[str, int] = {}
    word = np.array([vocab.setdefault(w, len(vocab)) for w in words])
    seen = Counter(f for w in vocab for f in features(w)[1:]) + Counter(f"w{w}" for w in words)
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    lexicon: dict[str, list[int]] = {}
    for y in range(len(langs)):
        for w, _ in Counter(w for w, k in zip(words, label.tolist(), strict=True) if k == y).most_common(LEXICON):
            lexicon.setdefault(w, []).append(len(index) + y)
    k, size = len(langs), len(index) + len(langs)
    model = Model(langs, index, np.zeros((size, k)), lexicon, np.zeros((k, k)))
    ids = [model.of(w) for w in vocab]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(ids)), n)
    follows = np.zeros((k, k))
    for first, m in zip(c.first.tolist(), c.size.tolist(), strict=True):
        y = label[first : first + m]
        np.add.at(follows, (y[:-1], y[1:]), 1)
    grad_w, grad_t = np.full((size, k), 1e-6), np.full((k, k), 1e-6)
    observed = np.stack([np.bincount(word[label == y], minlength=len(vocab)) for y in range(k)], 1).astype(float)
    ends = np.cumsum(n)
    for _ in range(rounds):
        run = np.concatenate([np.zeros((1, k)), np.cumsum(model.weights[flat], 0)])
        scores = (run[ends] - run[ends - n])[word]
        pairs = np.zeros((k, k))
        post, _ = c.marginals(scores, model.trans, pairs)
        due = observed - np.stack([np.bincount(word, post[:, y], len(vocab)) for y in range(k)], 1)
        g = np.stack([np.bincount(flat, due[owner, y], size) for y in range(k)], 1) / len(word) - ridge * model.weights
        t = (follows - pairs) / len(word) - ridge * model.trans
        grad_w += g * g
        grad_t += t * t
        model.weights += rate * g / np.sqrt(grad_w)
        model.trans += rate * t / np.sqrt(grad_t)
    model.weights = model.weights.astype(np.float32)
    return model


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", where=None, docs: int = TRAIN_DOCS) -> Model:  # noqa: ANN001
    """Train on a bounded sample of the labelled rows: the ``docs`` first by a hash of the key."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    src = src.where(F.col("t").isNotNull() & F.col("l").isNotNull() & (F.lit(True) if where is None else where))
    rows = common.by_hash(src, "k", docs, src.select("l").count()).select("k", "t", "l").collect()
    rows = sorted(rows, key=lambda r: (str(r.k), r.t, r.l))[:docs]
    return train([(r.t, r.l) for r in rows])


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_other) of each row; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.texts(batch):
                rows = batch.slice(lo, hi - lo)
                got = model.predict([t or "" for t in rows.column(1).to_pylist()])
                a, b, c, d, _ = zip(*got, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "lang_pred": list(a), "score": list(b), "n_words": pa.array(c, pa.int64()), "n_other": pa.array(d, pa.int64())})

    common.small_batches(df.sparkSession)
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(common.lean(run), "doc_id long, lang_pred string, score double, n_words long, n_other long")


def known(df: DataFrame, model: Model, text: str = "text", least: float = FAMILIAR) -> DataFrame:
    """The rows of ``df`` whose text is in the learned languages, one or several of them; narrow, with all columns.

    Posteriors say which of the learned languages is likeliest, not whether it is one of them. So a text goes if it has no letter,
    or if its words' mean familiarity is under ``least``: text of another language or script, and letters at random.
    A null id, repeated rows and other columns don't matter; an empty table stays empty.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.texts(batch, text):
                rows = batch.slice(lo, hi - lo)
                got = model.predict([t or "" for t in rows.column(at).to_pylist()])
                yield rows.filter(pa.array([g[0] != NONE and g[4] >= least for g in got], pa.bool_()))

    common.small_batches(df.sparkSession)
    return df.mapInArrow(common.lean(run), df.schema)


def held_out(key: str, of: int, at: int):  # noqa: ANN201
    """Whether crc32 of the id as text leaves the remainder ``at``."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == at, F.lit(False))


def word_spans(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, language, posterior) of each word, in code points of the lower-cased text."""
    c, post, _ = model.tag([text])
    return [(int(a), int(b), model.langs[int(p.argmax())], float(p.max())) for a, b, p in zip(c.starts, c.ends, post, strict=True)] if model.langs else []
