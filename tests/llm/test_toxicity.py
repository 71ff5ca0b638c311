"""The classifier chain: held-out rows, folds that don't see their labels, a plain version of the scores."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def chain(tables):
    docs, labels = tables
    return toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))


def test_held_out_rows(tables, chain):
    docs, labels = tables
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and toxic is not null").select("doc_id", "toxic")
    rows = toxicity.score(docs.join(F.broadcast(held), "doc_id"), chain, ["doc_id", "toxic"]).collect()
    toxic, other = ([r.predicted for r in rows if r.toxic == t] for t in (1, 0))
    print("held out: found", sum(toxic), "of", len(toxic), "false alarms", sum(other), "of", len(other))
    assert np.mean(toxic) >= 0.93 and np.mean(other) <= 0.005


def plain(text, chain):
    """The chain's probabilities, word by word and category by category."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    words = re.findall(rb"[a-z\x80-\xff]+", raw)
    n, hits, seen = len(words), 0, set()
    for w in words:
        own = {(w if len(w) <= 64 else w[:64] + b"-"), *(w[:k] + b"-" for k in (5, 6, 7) if len(w) > k)} & {*chain.terms}
        hits += bool(own)
        seen |= own
    upper = text.encode("utf-8", "surrogatepass")
    count = lambda of: sum(c in of for c in upper) / max(n, 1)
    x = [np.log1p(hits), min(hits, 3), 30 * hits / (n + 10), np.log1p(n) / 10, min(len({*words}) / max(n, 1), 2), min(count(toxicity.DIGITS), 2), min(count(toxicity.SYMBOLS), 2), 1.0]
    out = []
    for c, w in enumerate(chain.weights):
        z = sum(a * b for a, b in zip(x + out, w, strict=True)) + sum(chain.by_term[chain.terms[t], c] for t in seen)
        out.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
    return out


def test_scores_equal_a_plain_version(spark, tables, chain):
    texts = [r.text for r in tables[0].where("doc_id % 211 = 0").collect()]
    texts += [None, "", " \n", "Idiot!! idiotic x9 " * 3, "scum" * 40 + " é😀", "moron " * 20000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("predicted", F.lit("p"))
    rows = toxicity.score(df, chain, ["doc_id", "predicted"])
    assert rows.columns == ["doc_id", "predicted_in", "p_low_quality", "p_toxic_low_quality", "p_toxic", "predicted"]
    for r in rows.collect():
        want = plain(texts[r.doc_id] or "", chain)
        assert [r.p_low_quality, r.p_toxic_low_quality, r.p_toxic] == pytest.approx(want, abs=1e-9) and r.predicted == (want[-1] >= 0.5)


def test_terms_are_selected_without_the_held_fold(spark):
    """A word that marks toxic rows of one fold alone is not selected without that fold; each selection equals a plain count."""
    ids = spark.range(600).select("id", toxicity.fold_of(F.col("id")).alias("f")).collect()
    rows = []
    for r in ids:
        toxic = r.id % 3 == 0
        rows.append((f"plain text {'vile' if toxic and r.id % 2 else ''} {'only' if toxic and r.f == 2 else ''} n{r.id % 7}", int(toxic), r.f))
    terms, chosen = toxicity.select_terms(spark.createDataFrame(rows, "text string, y int, f int"))
    at = {t: i for i, t in enumerate(terms)}
    assert not chosen[2, at[b"only"]] and chosen[5, at[b"only"]] and chosen[:, at[b"vile"]].all()
    for k in range(6):
        some = [(set(re.findall("[a-z]+", t)), y) for t, y, f in rows if f != k]
        pos = sum(y for _, y in some)
        neg = len(some) - pos
        a, b = (Counter(w for s, y in some if y == want for w in s) for want in (1, 0))
        want = set()
        for w in {*a, *b}:
            o = np.array([[a[w], b[w]], [pos - a[w], neg - b[w]]], float)
            e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
            g2 = (o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum()
            if a[w] + b[w] >= 3 and g2 > 20 and np.log((a[w] + 0.5) / (pos + 1)) - np.log((b[w] + 0.5) / (neg + 1)) > 1.5:
                want.add(w.encode())
        assert {t for t, i in at.items() if chosen[k, i]} == want


def test_newton_finds_the_optimum():
    rng = np.random.default_rng(3)
    dense, terms, at = rng.standard_normal((400, 3)), (rng.random((150, 5)) < 0.3).astype(np.uint8), np.sort(rng.choice(400, 150, replace=False))
    y = (rng.random(400) < 0.3).astype(float)
    rows = toxicity.Rows(dense, at, terms)
    w = toxicity.logistic(rows, y)
    full = np.zeros((400, 8))
    full[at, :5], full[:, 5:] = terms, dense
    assert np.allclose(full @ w, rows.score(w)) and np.abs(full.T @ (1 / (1 + np.exp(-full @ w)) - y) + 2 * w).max() < 1e-3
    some = rows.take(np.arange(400) % 2 == 0)
    assert np.allclose(some.score(w), (full @ w)[::2])
