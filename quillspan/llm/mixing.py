"""Mixing sources to target weights, by DataFrame and SQL functions only.

A classifier of hashed words, fitted on the labelled table, gives each document posteriors of the domains. Then
least squares finds the rates r >= 0 nearest to 1 so that the expected tokens of each domain, the sum of
r * tokens * posterior, match their targets. Such a rate depends on the posteriors and one multiplier a domain, found by
Newton's method. A step is one aggregation over the table of posteriors, so the driver sees a number for each pair of
domains. Where no rates meet the targets, the least error is kept and logged.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled documents (the first by a hash of the id); its counts of
``BUCKETS`` word hashes are what the driver gathers. All statistics of the mixture cover all documents.

Edge cases: a null or empty text has no tokens, the prior as posterior and rate 1; a domain without a labelled
row gets no posterior; without any labelled row all posteriors are equal; an empty table gives no rows; repeated rows
get equal rates, and are drawn by their row's hash; a null id is kept; other columns stay as they are.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common

TRAIN_ROWS, BUCKETS = 6000, 4096
#: Words that a text's posterior counts as at most, so that long texts stay soft.
SOFT = 24
#: Steps until a warning, length of a step at first, pull of the rates to 1 at first, error of a domain that will do.
ROUNDS, RATE, PULL, ENOUGH = 40, 1.0, 1e-3, 1e-5
#: The pull at last, by that at first.
WEAKEST = 1e-4
LOG = logging.getLogger(__name__)

#: Domains of the labelled table, and the shares of tokens that the mixture should have.
DOMAINS = {"good": "toxic = 0 and quality = 1", "plain": "toxic = 0 and quality = 0", "toxic": "toxic = 1"}
TARGETS = {"good": 0.88, "plain": 0.1, "toxic": 0.02}


def words(text: Column) -> Column:
    """Hashes of the text's lower-cased words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


class Classifier:
    """Log-likelihoods of word hashes by domain, and the domains' priors."""

    def __init__(self, names: list[str], rows: list[tuple[int, int, int]], docs: dict[int, int]) -> None:
        k = len(names)
        total = sum(docs.values())
        self.names = names
        self.prior = [math.log((docs.get(d, 0) + 1e-9) / total) if total else 0.0 for d in range(k)]
        counts = [[0.5] * BUCKETS for _ in range(k)]
        for bucket, d, n in rows:
            counts[d][bucket] += n
        logs = [[math.log(c / sum(row)) for c in row] for row in counts]
        mean = [sum(logs[d][b] for d in range(k)) / k for b in range(BUCKETS)]
        self.logs = [[x - m for x, m in zip(row, mean, strict=True)] for row in logs] if rows else [[0.0] * BUCKETS for _ in range(k)]

    def posteriors(self, hashes: Column) -> Column:
        """An array with the posterior of each domain."""
        k = len(self.names)
        tables = [common.constant([round(x, 9) for x in row], "double") for row in self.logs]
        zero = F.array(*[F.lit(0.0)] * k)
        sums = F.aggregate(hashes, zero, lambda acc, b: F.array(*[acc[d] + tables[d][b] for d in range(k)]))
        n = F.size(hashes)
        weight = F.least(n, F.lit(SOFT)) / F.greatest(n, F.lit(1))
        logits = F.transform(F.arrays_zip(sums.alias("s"), common.constant(self.prior, "double").alias("p")), lambda x: x["s"] * weight + x["p"])
        raised = F.transform(logits, F.exp)
        return raised, n


def domain(rules: dict[str, str]) -> Column:
    """The index of the first rule that holds."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules.values()))):
        out = F.when(F.expr(rule), i).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, rules: dict[str, str], key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Classifier:
    """Counts of word hashes by domain over a bounded sample of the labelled rows."""
    marks = labels.select(F.col(key).alias("k"), domain(rules).alias("d")).where("k is not null and d is not null")
    marks = common.by_hash(marks, "k", rows, marks.count())
    per = {r.d: r.n for r in marks.groupBy("d").agg(F.count("*").alias("n")).collect()}
    seen = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(marks, "k").select("d", F.explode(words(F.col("t"))).alias("b"))
    counts = [(r.b, r.d, r.n) for r in seen.groupBy("b", "d").agg(F.count("*").alias("n")).collect()]  # BUCKETS x domains rows at most
    return Classifier(list(rules), counts, per)


def with_posteriors(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``df`` with ``_n`` (tokens) and ``_p0`` .. (posteriors)."""
    raised, n = model.posteriors(F.col("__mix_w"))
    k = len(model.names)
    df = df.withColumn("__mix_w", words(F.col(text))).withColumns({"__mix_e": raised, "__mix_n": n}).drop("__mix_w")
    total = sum((F.col("__mix_e")[d] for d in range(1, k)), F.col("__mix_e")[0])
    return df.withColumns({f"__mix_p{d}": F.col("__mix_e")[d] / total for d in range(k)}).drop("__mix_e")


class Rates:
    """Multipliers of the domains: a document's rate is max(0, 1 - its posteriors times them). ``error``: by domain, what its share misses the target by."""

    def __init__(self, u: list[float], error: list[float] | None = None) -> None:
        self.u, self.error = u, error or [0.0] * len(u)

    def rate(self) -> Column:
        """The multipliers are one literal, so that the code made for a plan doesn't change with them."""
        u = common.constant(self.u, "double")
        return F.greatest(F.lit(0.0), 1.0 - sum((F.col(f"__mix_p{d}") * u[d] for d in range(1, len(self.u))), F.col("__mix_p0") * u[0]))

    def column(self, df: DataFrame) -> DataFrame:
        """``df`` (with posteriors) with its final ``__mix_r``."""
        return df.withColumn("__mix_r", F.when(F.col("__mix_n") > 0, self.rate()).otherwise(1.0))


def solve(stats: DataFrame, targets: list[float], rounds: int | None = None, rate: float = RATE, pull: float = PULL) -> Rates:
    """The rates nearest to 1 that meet the targets, over ``stats`` (_n, _p0 ..), a written table.

    Of the squares of r - 1 and of the domains' errors over ``pull`` (by the domains' tokens, so that small ones count as
    much as large ones), the least sum is where r = max(0, 1 - p u) and pull * u is the error: damped Newton on u, an
    aggregation a round. Its target is then moved on by the error left and the pull weakened, until no error is above ``ENOUGH``
    or, as no rates meet the targets, the errors stay; the log tells both. More than ``rounds`` are told and go on.
    """
    k = len(targets)
    p = [F.col(f"__mix_p{d}") for d in range(k)]
    now = stats.where("__mix_n > 0")
    have = np.array([float(x or 0.0) for x in now.agg(*[F.sum(F.col("__mix_n") * x) for x in p]).first()])
    total = float(have.sum())
    if not total:
        return Rates([0.0] * k)
    goal = total * np.array(targets, float) / (sum(targets) or 1.0)
    on = np.flatnonzero(have > 1e-9 * total)  # a domain without tokens has no multiplier
    pairs = [(int(d), int(e)) for i, d in enumerate(on) for e in on[: i + 1]]

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the sum of n r r, the domains' totals, and the sums of n p p' where r > 0."""
        r, n = F.col("__mix_r"), F.col("__mix_n")
        held = F.when(r > 0, n).otherwise(0)
        row = now.select("__mix_n", *p, Rates(u.tolist()).rate().alias("__mix_r")).agg(F.sum(n * r * r), *[F.sum(n * r * x) for x in p], *[F.sum(held * p[d] * p[e]) for d, e in pairs]).first()
        bends = np.zeros((k, k))
        for (d, e), x in zip(pairs, row[1 + k :], strict=True):
            bends[d, e] = bends[e, d] = x
        return row[0] / 2, np.array(row[1 : 1 + k]), bends

    limit = told = ROUNDS if rounds is None else rounds
    least, done, before = pull * WEAKEST, 0, math.inf
    u = about = np.zeros(k)
    half, sums, bends = at(u)
    error = (sums - goal)[on] / have[on]
    while np.abs(error).max() >= ENOUGH:
        value = lambda half, u: half + goal @ u + pull * (have @ (u - about) ** 2) / 2  # noqa: E731, B023
        slope = pull * (u - about)[on] - error
        while np.abs(slope).max() >= ENOUGH / 10 and np.abs(error).max() >= ENOUGH:
            step = np.zeros(k)
            step[on] = -np.linalg.solve(bends[np.ix_(on, on)] + pull * np.diag(have[on]), slope * have[on])
            length, fall = rate, float(slope * have[on] @ step[on])
            while (got := at(u + length * step)) and value(got[0], u + length * step) > value(half, u) + 1e-4 * length * fall and length > 1e-9:
                length /= 2
            if length <= 1e-9:  # as near as the sums' digits go
                break
            u, (half, sums, bends) = u + length * step, got
            error = (sums - goal)[on] / have[on]
            slope = pull * (u - about)[on] - error
            done += 1
            if done == told:
                LOG.warning("mixing: %d rounds, largest error %.2g of a domain's tokens; going on", done, np.abs(error).max())
                told += limit
        left = float(have[on] @ error**2)
        if left > 0.998 * before:
            break
        before, about, pull = left, u, max(pull / 10, least)
    missed = (sums - goal) / total
    LOG.log(logging.WARNING if np.abs(missed).max() > ENOUGH else logging.INFO, "mixing: %d rounds, shares of tokens %s, less targets %s", done, (sums / total).tolist(), missed.tolist())
    return Rates(u.tolist(), missed.tolist())


def rates(docs: DataFrame, labels: DataFrame, rules: dict[str, str] = DOMAINS, targets: dict[str, float] = TARGETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, a posterior ``p_<domain>`` for each domain, rate, and copies drawn by the rate. Posteriors are worked out once and written."""
    model = fit(docs, labels, rules, key, text)
    stats = common.materialize(with_posteriors(docs.select(*dict.fromkeys([key, text])), model, text).drop(*({text} - {key})), "posteriors")
    out = solve(stats, [targets[n] for n in rules]).column(stats)
    return out.select(F.col(key), F.col("__mix_n").cast("long").alias("n_tokens"), *[F.col(f"__mix_p{d}").alias(f"p_{n}") for d, n in enumerate(model.names)], F.col("__mix_r").alias("rate"), copies(F.col("__mix_r"), F.xxhash64(F.col(key))).alias("copies"))


def copies(rate: Column, seed: Column) -> Column:
    """Whole copies, and one more with the chance of the rest, by a hash: the same in every run."""
    chance = F.pmod(F.xxhash64(seed, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, rules: dict[str, str] = DOMAINS, targets: dict[str, float] = TARGETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with the columns of ``docs``; narrow.

    The solver reads a table of tokens and posteriors alone; the last pass works the posteriors out again, rather than write texts twice.
    Rows with a null or empty text have rate 1 and stay; repeated rows are drawn alike; a null id is kept; an empty table stays empty.
    """
    model = fit(docs, labels, rules, key, text)
    stats = common.materialize(with_posteriors(docs.select(text), model, text).drop(text), "posteriors")
    found = solve(stats, [targets[n] for n in rules])
    common.discard(docs.sparkSession, stats)
    out = found.column(with_posteriors(docs, model, text))
    n = copies(F.col("__mix_r"), F.xxhash64(F.col(key), F.col(text)))
    return out.withColumn("__mix_c", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
