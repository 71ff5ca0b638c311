"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other, each by a logistic model over
features of terms (words and beginnings of words), statistics of the text, and
the probabilities of the categories before it. The later models learn on
out-of-fold probabilities of the earlier ones, so they see in training what they
see when scoring. Terms are selected inside each fold, from the rows outside it,
so a held fold's labels have no part in its predictions.

The table of labels marks two things, quality and toxicity, so it allows three
categories: ``low_quality``, ``toxic_low_quality`` (both) and ``toxic``. All are
combinations of labels; none is computed from the text.

Terms are those whose log-likelihood ratio and log odds mark them as toxic
(``G2``, ``ODDS``); every such term is kept, up to ``TERMS`` by that ratio, a
bound on the driver's memory. It is several times what 20,000 labelled texts
yield, but is reached where large groups of copies of one text are labelled, as
all words of such a text then mark it. A word counts once as indicative, however
many of its terms are.

The classifier learns on a bounded sample: the ``TRAIN_ROWS`` labelled rows
first in a seeded hash order. Every document is scored, by its whole text.

Defined results: null text is empty (scored by the intercepts); repeated rows
are scored each, equal texts equally; several labels of one id count as its
largest toxicity and smallest quality; a label without quality teaches the last
category only; without labels of both kinds every score is the base rate (0
without labels); kept columns that are named like a result come back with
``_in`` appended; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, texts_of

TRAIN_ROWS = 20_000
TERMS = 1024
FOLDS = 5
#: Least log-likelihood ratio, log odds and number of documents of an indicative term.
G2, ODDS, LEAST = 20.0, 1.5, 3
THRESHOLD = 0.5
SEED = 8
CATEGORIES = ("low_quality", "toxic_low_quality", "toxic")
RESULTS = (*(f"p_{c}" for c in CATEGORIES), "predicted")
#: Bytes of the beginnings of longer words that are terms beside the words; of a longer word than LONG, that many stand for it.
STEMS, LONG = (5, 6, 7), 64
#: ASCII letters in lower case and bytes beyond ASCII; all else ends a word.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
DIGITS, SYMBOLS = b"0123456789", b"#$%&*@^~<>{}[]\\/=+_|!"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(LETTERS).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a hyphen."""
    return [word if len(word) <= LONG else word[:LONG] + b"-", *(word[:n] + b"-" for n in STEMS if len(word) > n)]


@dataclass
class Counted:
    """Of each text: its known terms, its statistics, and its indicative words by each selection of terms."""

    found: list[list[int]]
    stats: np.ndarray
    hits: np.ndarray

    def dense(self, k: int) -> np.ndarray:
        """Features beside the terms, by selection ``k``: counts and density of indicative words, statistics, a constant."""
        hits, n = self.hits[:, k], self.stats[:, 0]
        return np.column_stack([np.log1p(hits), np.minimum(hits, 3), 30 * hits / (n + 10), np.log1p(n) / 10, np.minimum(self.stats[:, 1:], 2), np.ones(len(n))])


def counted(texts: list[str], terms: dict[bytes, int], chosen: np.ndarray) -> Counted:
    """``chosen`` (selections, terms) marks the terms of each selection."""
    found, stats, hits = [], np.zeros((len(texts), 4)), np.zeros((len(texts), len(chosen)))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = Counter(words_of(raw))
        n = words.total()
        stats[i] = n, len(words) / max(n, 1), (len(raw) - len(raw.translate(None, DIGITS))) / max(n, 1), (len(raw) - len(raw.translate(None, SYMBOLS))) / max(n, 1)
        own: set[int] = set()
        for word, times in words.items():
            if some := [terms[t] for t in terms_of(word) if t in terms]:
                own.update(some)
                hits[i] += times * chosen[:, some].any(1)
        found.append(sorted(own))
    return Counted(found, stats, hits)


@dataclass
class Chain:
    """Terms, and for each category the weights of terms, of the other features and of earlier categories."""

    terms: dict[bytes, int] = field(default_factory=dict)
    by_term: np.ndarray = field(default_factory=lambda: np.zeros((0, len(CATEGORIES))))
    weights: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def predict(self, texts: list[str]) -> np.ndarray:
        """(n, categories) probabilities, each fed with those before it."""
        if not self.weights:
            return np.full((len(texts), len(CATEGORIES)), self.base)
        got = counted(texts, self.terms, np.ones((1, len(self.terms)), bool))
        x, z = got.dense(0), np.array([self.by_term[f].sum(0) for f in got.found]).reshape(len(texts), -1)
        first = x.shape[1]
        for c, w in enumerate(self.weights):
            x = np.column_stack([x, sigmoid(x @ w + z[:, c])])
        return x[:, first:]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Rows:
    """Training rows: dense features of all, and presence of terms (bytes) for the rows ``at`` that have any.

    Terms are turned into numbers a chunk of rows at a time, so a step needs
    little more than the bytes.
    """

    dense: np.ndarray
    at: np.ndarray
    terms: np.ndarray

    CHUNK = 2048

    def take(self, keep: np.ndarray) -> Rows:
        place = np.cumsum(keep) - 1
        inside = keep[self.at]
        return Rows(self.dense[keep], place[self.at[inside]], self.terms[inside])

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(self.at), self.CHUNK):
            yield self.at[start : start + self.CHUNK], self.terms[start : start + self.CHUNK].astype(np.float32)

    def score(self, w: np.ndarray) -> np.ndarray:
        n = self.terms.shape[1]
        z = self.dense @ w[n:]
        for at, t in self.chunks():
            z[at] += t @ w[:n]
        return z

    def product(self, v: np.ndarray) -> np.ndarray:
        total = np.zeros(self.terms.shape[1])
        for at, t in self.chunks():
            total += v[at] @ t
        return np.concatenate([total, self.dense.T @ v])

    def curvature(self, c: np.ndarray) -> np.ndarray:
        n, d = self.terms.shape[1], self.dense
        own, cross = np.zeros((n, n)), np.zeros((n, d.shape[1]))
        for at, t in self.chunks():
            weighed = t * c[at, None].astype(np.float32)
            own += weighed.T @ t
            cross += weighed.T @ d[at]
        return np.block([[own, cross], [cross.T, (d * c[:, None]).T @ d]])


def logistic(rows: Rows, y: np.ndarray, ridge: float = 2.0, steps: int = 12) -> np.ndarray:
    """Newton steps for logistic regression with a ridge on all weights."""
    w = np.zeros(rows.terms.shape[1] + rows.dense.shape[1])
    for _ in range(steps):
        p = sigmoid(rows.score(w))
        step = np.linalg.solve(rows.curvature(np.maximum(p * (1 - p), 1e-6)) + ridge * np.eye(len(w)), rows.product(p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_chain(terms: list[bytes], chosen: np.ndarray, got: Counted, targets: np.ndarray, folds: np.ndarray) -> Chain:
    """Weights of the chain for ``targets`` (n, categories; NaN where unknown).

    ``chosen[f]`` are the terms selected without fold f, the last row those of all folds.
    """
    at = np.array([i for i, f in enumerate(got.found) if f], int)
    present = np.zeros((len(at), len(terms)), np.uint8)
    for i, k in enumerate(at):
        present[i, got.found[k]] = 1
    earlier = np.zeros((len(folds), 0))
    use = chosen[-1]
    chain = Chain({terms[k]: i for i, k in enumerate(np.flatnonzero(use))}, np.zeros((use.sum(), targets.shape[1])))
    for c in range(targets.shape[1]):
        y, known = targets[:, c], ~np.isnan(targets[:, c])
        held = np.full(len(y), float(np.nanmean(y)) if known.any() else 0.0)
        for f in range(FOLDS):
            rest, own = (folds != f) & known, folds == f
            if own.any() and rest.any():
                rows = Rows(np.column_stack([got.dense(f), earlier]), at, present[:, chosen[f]])
                held[own] = sigmoid(rows.take(own).score(logistic(rows.take(rest), y[rest])))
        rows = Rows(np.column_stack([got.dense(FOLDS), earlier]), at, present[:, use])
        w = logistic(rows.take(known), y[known])
        chain.by_term[:, c] = w[: use.sum()]
        chain.weights.append(w[use.sum() :])
        earlier = np.column_stack([earlier, held])
    return chain


def sample_of(labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """``doc_id, y, low``, a row a document: the first ``rows`` ones with a toxicity label in a seeded hash order."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"), (1 - F.min("quality")).cast("int").alias("low"))
    return named.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(rows)


def ratio(a: Column, b: Column, pos: Column, neg: Column) -> tuple[Column, Column]:
    """Log-likelihood ratio and log odds of a term in a of pos and b of neg documents."""
    all_, seen = pos + neg, a + b

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)

    g2 = part(a, seen * pos / all_) + part(b, seen * neg / all_) + part(pos - a, (all_ - seen) * pos / all_) + part(neg - b, (all_ - seen) * neg / all_)
    return g2, F.ln((a + 0.5) / (pos + 1)) - F.ln((b + 0.5) / (neg + 1))


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")


def select_terms(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Terms of ``rows(text, y, f)``, and which of them are indicative without each fold, and in all (FOLDS + 1, terms)."""

    def make_words():
        def work(batch):
            out = [
                (t.decode("latin-1"), y, f)
                for text, y, f in zip(texts_of(batch), batch.column("y").to_pylist(), batch.column("f").to_pylist(), strict=True)
                for t in {t for w in {*words_of(text.encode("utf-8", "surrogatepass"))} for t in terms_of(w)}
            ]
            return {n: [r[k] for r in out] for k, n in enumerate(("w", "y", "f"))}

        return work

    size = {(r["y"], r["f"]): r["count"] for r in rows.groupBy("y", "f").count().collect()}  # two labels a fold
    n = {y: [size.get((y, f), 0) for f in range(FOLDS)] for y in (0, 1)}
    counts = [F.sum(F.when((F.col("y") == y) & (F.col("f") == f), 1).otherwise(0)).alias(f"c{y}{f}") for y in (0, 1) for f in range(FOLDS)]
    df = map_columns(rows.select("text", "y", "f"), "w string, y int, f int", make_words).groupBy("w").agg(*counts).where(" + ".join(f"c{y}{f}" for y in (0, 1) for f in range(FOLDS)) + f" >= {LEAST}")
    best, tests = F.lit(0.0), []
    for out in (*range(FOLDS), None):
        a, b = (sum((F.col(f"c{y}{f}") for f in range(FOLDS) if f != out), F.lit(0)) for y in (1, 0))
        pos, neg = (F.lit(float(sum(v for f, v in enumerate(n[y]) if f != out))) for y in (1, 0))
        g2, odds = ratio(a, b, pos, neg)
        tests.append((a + b >= LEAST) & (g2 > G2) & (odds > ODDS))
        best = F.greatest(best, F.when(tests[-1], g2).otherwise(0.0))
    got = df.select("w", best.alias("best"), F.array(*tests).alias("tests")).where("best > 0").orderBy(F.desc("best"), "w").limit(TERMS).collect()
    return [r["w"].encode("latin-1") for r in got], np.array([r["tests"] for r in got], bool).reshape(len(got), FOLDS + 1).T


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit on the sample; what reaches the driver is bounded by TRAIN_ROWS and TERMS."""
    sample = F.broadcast(sample_of(labels, TRAIN_ROWS, SEED))  # at most TRAIN_ROWS rows of three numbers
    rows = docs.select("doc_id", "text").join(sample, "doc_id").withColumn("f", fold_of(F.col("doc_id")))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return Chain(base=1.0 if n.get(1) else 0.0)
    terms, chosen = select_terms(rows)
    index = {t: i for i, t in enumerate(terms)}

    def make_counts():
        def work(batch):
            got = counted(texts_of(batch), index, chosen)
            return {n: batch.column(n) for n in ("doc_id", "y", "low", "f")} | {"found": got.found, "s": [x.tobytes() for x in np.hstack([got.stats, got.hits])]}

        return work

    got = map_columns(rows.select("doc_id", "text", "y", "low", "f"), "doc_id long, y int, low int, f int, found array<int>, s binary", make_counts)
    got = got.orderBy(F.xxhash64(F.col("doc_id"), F.lit(SEED)), "doc_id", "s").limit(TRAIN_ROWS).collect()
    s = np.frombuffer(b"".join(bytes(r["s"]) for r in got), np.float64).reshape(len(got), -1)
    y, low = np.array([r["y"] for r in got], float), np.array([np.nan if r["low"] is None else r["low"] for r in got], float)
    return fit_chain(terms, chosen, Counted([r["found"] for r in got], s[:, :4], s[:, 4:]), np.column_stack([low, low * y, y]), np.array([r["f"] for r in got]))


def score(docs: DataFrame, chain: Chain, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus ``p_<category>`` of each, and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # TERMS terms and as many weights a category
    names = {n: f"{n}_in" if n in RESULTS else n for n in keep}

    def make():
        def work(batch):
            p = shared.value.predict(texts_of(batch))
            return {to: batch.column(n) for n, to in names.items()} | {f"p_{c}": p[:, i].tolist() for i, c in enumerate(CATEGORIES)} | {"predicted": (p[:, -1] >= THRESHOLD).astype(int).tolist()}

        return work

    ddl = ", ".join([*(f"`{to}` {docs.schema[n].dataType.simpleString()}" for n, to in names.items()), *(f"p_{c} double" for c in CATEGORIES), "predicted int"])
    return map_columns(docs.select(*dict.fromkeys([*keep, "text"])), ddl, make)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    names = docs.columns
    safe = docs.toDF(*(f"_tox_{n}" if n in RESULTS else n for n in names))
    return score(safe, train(docs, labels), safe.columns).where("predicted = 0").select(*(F.col(f"`{s}`").alias(n) for s, n in zip(safe.columns, names, strict=True)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
