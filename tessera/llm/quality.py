"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in every round each feature in turn gets a shallow tree (up
to four leaves over its bins: one of each frequent value, such as zero, and
quantiles of the others) fitted to the current gradients, added to the
feature's lookup table. Then the pairs of features whose coarse grid explains
most of the remaining gradient get tables of their own, boosted by trees of
one split in each feature. A score is the sigmoid of one table entry a feature
and a pair, added for whole columns of bin numbers at once.

The model learns on a bounded sample: the ``TRAIN_ROWS`` labelled rows first in
a seeded hash order, without the held-out ones (crc32 of the doc_id's text a
multiple of 5). Inputs are statistics of the whole text and nothing else.

Defined results: null text is empty and scored like any other, texts of any
length are described whole; a null doc_id is held out; repeated rows are scored
each, equal texts equally; without labels of both kinds every score is the base
rate (0.5 without labels); kept columns that are named ``score`` or ``predicted``
come back with ``_in`` appended, the working column is ``_q``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, settle, texts_of, tidied
from .toxicity import sigmoid

TRAIN_ROWS = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE = 0.15
THRESHOLD = 0.3
SEED = 10

FEATURES = (
    "words", "word_length", "distinct_words", "letters", "capitals", "digits", "punctuation", "bars", "exclamations", "symbols",
    "lines", "repeated_lines", "top_word", "function_words", "repeated_next", "beyond_ascii", "longest_word", "line_length", "closed_lines", "capital_words",
)
COMMON = {w.encode() for w in "the of and to in a is that it for on with as was be by an are this et de la le les des un une que qui en du dans pour par sur il elle der die das und in den von zu mit ist ein eine im auf für el los las que y en por con una para se del".split()}
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOLS = b"#$%&*@^~<>{}[]\\/=+_"
PUNCTUATION = b".,;:!?'\"()-" + SYMBOLS + b"|`"


def features_of(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x]
    n_lines = max(len(lines), 1)
    count = lambda of: len(raw) - len(raw.translate(None, of))
    upper = count(UPPER)
    counted = Counter(words)
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counted) / n,
        (upper + count(LOWER)) / size,
        upper / size,
        count(DIGITS) / size,
        count(PUNCTUATION) / n,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        count(SYMBOLS) / n,
        len(lines) / n,
        1 - len({*lines}) / n_lines,
        max(counted.values(), default=0) / n,
        sum(counted[w] for w in COMMON if w in counted) / n,
        sum(map(eq, words, words[1:])) / n,
        (len(raw) - len(text)) / size,
        np.log1p(max(map(len, counted), default=0)),
        np.log1p(len(raw) / n_lines),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / n_lines,
        sum(c for w, c in counted.items() if w[:1].isupper()) / n,
    ]


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus ``_q``, the features as packed doubles."""

    def make():
        def work(batch):
            return {n: batch.column(n) for n in keep} | {"_q": [np.array(features_of(t)).tobytes() for t in texts_of(batch)]}

        return work

    ddl = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep), "_q binary"])
    return map_columns(docs.select(*dict.fromkeys([*keep, "text"])), ddl, make)


@dataclass
class Additive:
    edges: list[np.ndarray] = field(default_factory=list)
    coarse_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def coarse(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse_edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.tables:
            bins = self.bins(x)
            for j, table in enumerate(self.tables):
                z += table[bins[:, j]]
            small = self.coarse(x)
            for (a, b), grid in self.pairs.items():
                z += grid[small[:, a], small[:, b]]
        return sigmoid(z)


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges of a feature: each value of at least 1 / ``bins`` of the rows alone, the others by their quantiles."""
    values, times = np.unique(x, return_counts=True)
    frequent = values[times * bins >= len(x)]
    rest = x[~np.isin(x, frequent)]
    inner = np.quantile(rest, np.linspace(0, 1, bins + 1)[1:-1]) if len(rest) else []
    edges = np.unique(np.concatenate([frequent, np.nextafter(frequent, np.inf), inner]))
    return edges[edges > values[0]]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values a bin of the best tree of depth two on a feature's histogram of gradients and weights."""

    def split(lo: int, hi: int) -> int | None:
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(cg):
            return None
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        gain = _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th)
        gain[(ch < 1) | (th - ch < 1)] = -1
        at = int(gain.argmax())
        return lo + at + 1 if gain[at] > 1e-9 else None

    cuts = [0, len(g)]
    if (first := split(0, len(g))) is not None:
        cuts += [first, *(c for c in (split(0, first), split(first, len(g))) if c is not None)]
    cuts = sorted(cuts)
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one split in either feature on a grid: its gain, and its values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    r, s = cg[:-1, -1:], ch[:-1, -1:]
    c, d = cg[-1:, :-1], ch[-1:, :-1]
    t, u = cg[-1, -1], ch[-1, -1]
    parts = [(a, b), (r - a, s - b), (c - a, d - b), (t - r - c + a, u - s - d + b)]
    gain = sum(_gain(x, y) for x, y in parts) - _gain(t, u)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for rows, cols, (x, y) in ((slice(0, i + 1), slice(0, j + 1), parts[0]), (slice(0, i + 1), slice(j + 1, None), parts[1]), (slice(i + 1, None), slice(0, j + 1), parts[2]), (slice(i + 1, None), slice(j + 1, None), parts[3])):
        out[rows, cols] = x[i, j] / (y[i, j] + 1.0)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of main effects, then of the strongest pairs."""
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < rate < 1:
        return Additive(base=float(np.log(np.clip(rate, 1e-3, 1 - 1e-3) / (1 - np.clip(rate, 1e-3, 1 - 1e-3)))))
    model = Additive(base=float(np.log(rate / (1 - rate))))
    for j in range(x.shape[1]):
        model.edges.append(edges_of(x[:, j], BINS))
        model.coarse_edges.append(edges_of(x[:, j], COARSE))
    bins = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            p = sigmoid(z)
            step = RATE * shallow_tree(np.bincount(bins[:, j], y - p, len(model.tables[j])), np.bincount(bins[:, j], p * (1 - p), len(model.tables[j])))
            model.tables[j] += step
            z += step[bins[:, j]]
    small = model.coarse(x)
    sizes = [len(e) + 1 for e in model.coarse_edges]
    cell = lambda a, b: small[:, a] * sizes[b] + small[:, b]
    grid = lambda a, b, w: np.bincount(cell(a, b), w, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])
    p = sigmoid(z)
    gains = {(a, b): quadrants(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0] for a, b in combinations(range(x.shape[1]), 2)}
    for pair in sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]:
        model.pairs[pair] = np.zeros((sizes[pair[0]], sizes[pair[1]]))
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            p = sigmoid(z)
            step = RATE * quadrants(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            table += step
            z += step.reshape(-1)[cell(a, b)]
    return model


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def _matrix(packed: list) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in packed), np.float64).reshape(-1, len(FEATURES))


def train(rows: DataFrame, labels: DataFrame) -> Additive:
    """``rows(doc_id, _q)``, settled; at most TRAIN_ROWS feature rows reach the driver."""
    named = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"))
    sample = named.orderBy(F.xxhash64(F.col("doc_id"), F.lit(SEED)), "doc_id", "y").limit(TRAIN_ROWS)
    got = rows.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(SEED)), "doc_id", "y", "_q").limit(TRAIN_ROWS).select("_q", "y").collect()
    return fit(_matrix([r["_q"] for r in got]), np.array([r["y"] for r in got], np.float64))


def scored(rows: DataFrame, model: Additive, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    names = {n: f"{n}_in" if n in ("score", "predicted") else n for n in keep}

    def make():
        def work(batch):
            s = shared.value.predict(_matrix(batch.column("_q").to_pylist()))
            return {to: batch.column(n) for n, to in names.items()} | {"score": s.tolist(), "predicted": (s >= THRESHOLD).astype(int).tolist()}

        return work

    ddl = ", ".join([*(f"`{to}` {rows.schema[n].dataType.simpleString()}" for n, to in names.items()), "score double, predicted int"])
    return map_columns(rows.select(*keep, "_q"), ddl, make)


@tidied
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = settle(described(docs, ["doc_id"]))
    model = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(rows, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
