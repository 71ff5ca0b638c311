"""MinHash near-dedup by rows: shared and null ids, whole rows kept, both verifiers alike."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tests.llm.test_large_operators import brute_components, jaccard_links

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in df.collect())


def test_rows_that_share_an_id_are_nodes_each(spark):
    rows = [(1, LONG), (1, "something else entirely"), (2, "x"), (3, "x"), (None, LONG), (None, "a b c"), (None, "a b c"), (5, None), (5, ""), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(minhash.near_duplicates(df)) == [(-1, 2, -1, True), (-1, 2, -1, True), (-1, 11, 1, False), (1, 2, 1, True), (1, 11, 1, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False), (5, 0, 5, True), (5, 0, 5, True)]
    kept = minhash.deduplicated(df.withColumn("class", F.lit(1)).withColumn("first", F.lit("f")))
    assert kept.columns == ["doc_id", "text", "class", "first"]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "a b c"), (1, LONG), (1, "something else entirely"), (2, "x"), (5, ""), (5, "")]


def test_deduplicated_odd(spark):
    df = spark.createDataFrame([(None, None), (None, " \n"), (1, "w " * 50000), (2, "W " * 50000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in minhash.deduplicated(df).collect()) == [(0, 0), (0, 2), (1, 100000)]
    assert minhash.deduplicated(df.limit(0)).count() == 0


def test_both_verifiers_agree_at_the_threshold(spark, monkeypatch):
    """Pairs exactly at, just above and just below 80%, by stars and (with blocks of 2) by crossing."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(101)]
    texts = []
    for edits in [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13] * 3:
        words = base[:]
        for at in rng.sample(range(0, 101, 2), edits):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:-k]) for k in (5, 10, 19, 20, 21, 22)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, links = jaccard_links(texts, 2, 80)
    want = brute_components(len(texts), links)
    for block in (512, 2):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_links_are_confirmed_on_full_sets(spark, monkeypatch):
    """With a hash that confuses all shingles, no false link comes out."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    real = minhash.shingle_hashes
    monkeypatch.setattr(minhash, "shingle_hashes", lambda words, size, known: np.minimum(real(words, size, known), np.uint64(3)) if words else real(words, size, known))
    texts = [f"{a} {b} {c}" for a in "ab" for b in "cd" for c in "ef"] + ["a c e", "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == [*range(8), 0, 9]


def test_band_keys_of_one_and_of_many():
    sigs = np.random.default_rng(1).integers(0, 2**32, (5, minhash.PERMUTATIONS), dtype=np.uint32)
    many = minhash.band_keys(sigs)
    assert many.shape == (5, minhash.BANDS) and all((minhash.band_keys(s) == m).all() for s, m in zip(sigs, many, strict=True))


@pytest.mark.parametrize("percent", [80, 95])
def test_percent_of_equals_sets(percent):
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 12, rng.integers(1, 12)).astype(np.uint64)) for _ in range(2))
        assert minhash.percent_of(x, y, percent) == minhash.similar({*x.tolist()}, {*y.tolist()}, percent)
