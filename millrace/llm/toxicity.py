"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two models, one of toxic and one of ordinary text, are fitted on a bounded
sample of labelled documents.  A word is generated step by step along its
prefixes (3, 4, 5, 6 letters, then the whole word); each step is discounted
(with the usual estimates of D1, D2, D3+) and gives what it saves to one lower
order shared by both classes: the distinct continuations of the step before in
all sample text.  An expression that is rare in a class so gets nearly the same
probability from both, unless its stem tells the classes apart.

A document's evidence is the log-likelihood ratio per token; the mean over its
few strongest words joins it, so that some toxic expressions in a long text are
not averaged away.  A logistic curve fitted on cross-fitted sample scores turns
the two numbers into a probability.

The sample (at most ``max_docs`` documents by hash of the id, whole texts) is
the only thing that reaches the driver, row by row.  Scoring is one pass without
a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import parts
from millrace.runtime import ship

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
STEPS = (3, 4, 5, 6)  # prefix lengths
CUTOFF = 3  # texts
STRONGEST = 3  # words


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def discounts(counts) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from the counts of counts."""
    n = Counter(c for c in counts if c <= 4)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5]
    d.append(2 - 3 * y * n[3] / n[2] if n[2] else 1.0)
    d.append(3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
    return tuple(min(max(x, 0.1), i + 0.99) for i, x in enumerate(d))


def distinct_texts(texts: list[np.ndarray], n: int = 5, share: float = 0.3) -> np.ndarray:
    """False for texts (word numbers) most of whose n-grams earlier texts had:
    copies of one text must not count as independent evidence."""
    grams = []
    for t in texts:
        at = np.arange(max(1, len(t) - n + 1))
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(n, len(t))):
                h = h * np.uint64(0x9E3779B97F4A7C15) + t[at + k].astype(np.uint64) + np.uint64(1)
        grams.append(np.unique(h))
    if not grams:
        return np.zeros(0, bool)
    sizes = [len(g) for g in grams]
    owner = np.repeat(np.arange(len(grams)), sizes)
    _, first, place = np.unique(np.concatenate(grams), return_index=True, return_inverse=True)
    known = np.bincount(owner[first[place] < np.repeat(np.cumsum(sizes) - sizes, sizes)], minlength=len(grams))
    return known <= share * np.array(sizes)


def path(word: str) -> list[str]:
    """The prefixes of a word that take part in its model, then the word itself
    (closed by an end mark, so that it differs from the equal prefix)."""
    return [word[:n] for n in STEPS if n <= len(word)] + [word + "\n"]


class ClassModel:
    """Kneser-Ney counts of one class along the prefixes of words.

    P(word) is the product of P(step | step before).  Counts are numbers of
    texts: a line repeated inside one text is no evidence of its class.  Steps
    seen in fewer than ``CUTOFF`` texts leave all their mass to the shared
    distribution.
    """

    def __init__(self, count: dict[str, int]):
        self.count = count
        self.total: Counter = Counter()
        for s, c in self.count.items():
            self.total[parent(s)] += c
        self.d = discounts(self.count.values())
        self.saved: dict[str, float] = defaultdict(float)
        for s, c in self.count.items():
            self.saved[parent(s)] += self.off(c) / self.total[parent(s)]

    def off(self, c: int) -> float:
        return c if c < CUTOFF else self.d[min(c, 3) - 1]

    def step(self, s: str, up: str, shared: float) -> float:
        n = self.total.get(up, 0)
        if not n:
            return shared
        c = self.count.get(s, 0)
        return (c - self.off(c)) / n + self.saved[up] * shared


def parent(s: str) -> str:
    """The step before, '' for the first."""
    n = len(s) - 1
    before = [k for k in STEPS if k <= n] if s[-1] == "\n" else [k for k in STEPS if k < n + 1]
    return s[: before[-1]] if before else ""


class Ratio:
    """Log-likelihood ratios of words, toxic over ordinary.

    ``steps`` keeps the ratio of every step that some class saw in ``CUTOFF``
    texts, ``others`` the ratio of all other steps below a known one; where
    neither class knows the step before, the ratio is 0.
    """

    def __init__(self, toxic: dict[str, int], ordinary: dict[str, int]):
        one, two = ClassModel(toxic), ClassModel(ordinary)
        below: Counter = Counter(parent(s) for s in {*one.count, *two.count})  # shared backoff: distinct continuations
        self.steps, self.others = {}, {}
        for s in {s for m in (one, two) for s, c in m.count.items() if c >= CUTOFF}:
            up = parent(s)
            shared = 1 / (below[up] + 1)
            self.steps[s] = math.log(one.step(s, up, shared) / two.step(s, up, shared))
        for up, n in below.items():
            shared = 1 / (n + 1)
            r = math.log(one.step("\n\n", up, shared) / two.step("\n\n", up, shared))
            if abs(r) > 1e-6:
                self.others[up] = r
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            got, up = 0.0, ""
            for s in path(w):
                got += self.steps[s] if s in self.steps else self.others.get(up, 0.0)
                up = s
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = got
        return got

    def evidence(self, bag: dict[str, int]) -> tuple[float, float]:
        """Mean ratio per token, and the mean over the ``STRONGEST`` words."""
        if not bag:
            return 0.0, 0.0
        r = [(self.word(w), n) for w, n in bag.items()]
        top = sorted([x for x, _ in r if x > 0], reverse=True)[:STRONGEST]
        return sum([x * n for x, n in r]) / sum(bag.values()), sum(top) / STRONGEST


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Newton's method for a small ridge logistic regression with intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """Fitted ratios and the curve over their evidence."""

    def __init__(self, ratio: Ratio, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.ratio, self.weights, self.centre, self.scale = ratio, weights, centre, scale

    @staticmethod
    def fit(rows: Iterable[tuple[str | None, int]], prior: float | None = None, folds: int = 3) -> ToxicityModel:
        """Fit on (text, label) rows, which are read once; texts are held as
        word numbers.  ``prior`` is the share of toxic rows among all labelled
        ones; the curve's intercept is moved from the sample's share to it."""
        numbers: dict[str, int] = {}
        texts, labels = [], []
        for text, label in rows:
            texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words(text)], np.int32))
            labels.append(label)
        keep = distinct_texts(texts)
        texts, y = [t for t, k in zip(texts, keep, strict=True) if k], np.array(labels, float)[keep]
        if not len(y) or y.min() == y.max():  # one class only: its share is the score
            share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
            odds = math.log(max(share, 1e-6) / (1 - share))
            return ToxicityModel(Ratio({}, {}), np.array([odds, 0.0, 0.0]), np.zeros(2), np.ones(2))
        vocabulary, step_numbers = list(numbers), {}
        paths = [np.array([step_numbers.setdefault(s, len(step_numbers)) for s in path(w)], np.int32) for w in vocabulary]
        names = list(step_numbers)
        bags = [np.unique(t, return_counts=True) for t in texts]
        steps = [np.unique(np.concatenate([paths[w] for w in ws])) if len(ws) else ws for ws, _ in bags]

        def counts(keep: np.ndarray) -> dict[str, int]:
            n = np.zeros(len(names), np.int64)
            for i in np.flatnonzero(keep):
                n[steps[i]] += 1
            return {names[k]: int(n[k]) for k in np.flatnonzero(n)}

        x = np.zeros((len(y), 2))
        part = np.arange(len(y)) % folds
        for f in range(folds):
            ratio = Ratio(counts((part != f) & (y > 0)), counts((part != f) & (y == 0)))
            for i in np.flatnonzero(part == f):
                x[i] = ratio.evidence({vocabulary[w]: int(n) for w, n in zip(*bags[i], strict=True)})
        centre, scale = x.mean(0), x.std(0) + 1e-9
        weights = logistic((x - centre) / scale, y)
        if prior is not None and 0 < prior < 1:
            weights[0] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
        return ToxicityModel(Ratio(counts(y > 0), counts(y == 0)), weights, centre, scale)

    def score(self, text: str | None) -> float:
        x = (np.array(self.ratio.evidence(Counter(words(text)))) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, held_out: Column, max_docs: int = 2000) -> ToxicityModel:
    """Fit on at most ``max_docs`` labelled documents that are not held out, half
    of them toxic if there are as many, chosen by a hash of the id.  Null labels
    are left out; an id with several labels takes the highest, an id with
    several texts the first."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    shares = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    classes = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for c in (0, 1)]
    sample = F.broadcast(classes[0].unionByName(classes[1]))  # max_docs rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # sorted in Spark: the order decides which of two near copies stays
    got = ((r.text, r.toxic) for r in rows.orderBy("doc_id").coalesce(1).toLocalIterator())  # max_docs rows
    return ToxicityModel.fit(got, (shares.k or 0) / shares.n if shares.n else None)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a double column of probabilities.  Null texts are empty
    texts and get the curve's value for no evidence; other columns pass through,
    an existing ``out_col`` is replaced, repeated rows stay repeated."""
    ship(docs.sparkSession)
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in parts(batches):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t) for t in texts], pa.float64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType(list(docs.schema)).add(out_col, "double"))


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows with crc32(doc_id) mod 5 = 0
    are held out of the fit."""
    held = in_fold(F.col("doc_id"), 5, 0)
    scored = score(docs.select("doc_id", "text"), train(docs, labels, held))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
