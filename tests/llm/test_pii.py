"""Disclosing terms masked wherever they stand, against brute force; cost by length."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import pii
from tests.llm.test_large_operators import naive_spans

WORD = r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+"


def entities_of(text):
    return {f"{k}:{text[s:e].lower()}" for k, s, e in naive_spans(text)}


def brute(texts):
    """A function from a text to its terms with their shares: those of its own entities, and those that disclose others almost for certain."""
    texts = [*dict.fromkeys(texts)]  # equal texts count once
    n = len(texts)
    has = [{*re.findall(WORD, t.lower())} for t in texts]
    ents = [entities_of(t) for t in texts]
    pairs, strong = {}, {}
    for e in set().union(*ents):
        held = [i for i in range(n) if e in ents[i]]
        if len(held) < pii.MIN_DOCS:
            continue
        for w in set().union(*(has[i] for i in held)):
            both = sum(w in has[i] for i in held)
            share = np.log2(both * n / (len(held) * sum(w in h for h in has))) / -np.log2(len(held) / n)
            if both >= pii.MIN_DOCS and share >= pii.GENERALISE:
                pairs[e, w] = share
                if both >= pii.EVIDENCE and share >= pii.REMOVE:
                    strong[w] = max(strong.get(w, 0.0), share)

    def terms(text):
        words, own = {*re.findall(WORD, text.lower())}, entities_of(text)
        out = {w: s for w, s in strong.items() if w in words}
        for e in own:
            for w in words:
                if (e, w) in pairs:
                    out[w] = max(out.get(w, 0.0), pairs[e, w])
        return out

    terms.strong = strong
    return terms


def corpus(seed):
    rng = random.Random(seed)
    common, rare = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)], [f"r{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    people = [("ann@x.org", "quixote"), ("+1 (974) 555-3436", "zed"), ("10.1.2.3", "mallory"), ("bob@y.org", "bob")]
    texts = []
    for _ in range(260):
        words = rng.choices(common, k=rng.randrange(3, 30)) + rng.choices(rare, k=rng.randrange(3))
        if rng.random() < 0.15:
            who = rng.sample(people, rng.choice([1, 1, 2]))
            words += [x for address, name in who for x in (address, name) if x is address or rng.random() < 0.8]
        elif rng.random() < 0.05:
            words.append(rng.choice(people)[1].title())
        rng.shuffle(words)
        texts.append(rng.choice([" ", "\n", " , "]).join(words))
    return texts + ["", "Quixote alone", texts[3], texts[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_everywhere_equal_brute_force(spark, seed):
    texts = corpus(seed)
    terms = brute(texts)
    assert terms.strong
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df, everywhere=True).collect()}
    elsewhere = 0
    for r in pii.find(df, ["doc_id"], everywhere=True).collect():
        text = texts[r.doc_id]
        own, base = terms(text), naive_spans(text)
        words = [m for m in re.finditer(WORD, text) if m[0].lower() in own and not any(m.start() < e and s < m.end() for _, s, e in base)]
        assert [(t.s, t.e) for t in r._pii_terms or []] == [m.span() for m in words]
        elsewhere += bool(words) and not base
        spans = sorted([(s, e, pii.MASKS[k]) for k, s, e in base] + [(*m.span(), "" if own[m[0].lower()] >= pii.REMOVE else "[TERM]") for m in words])
        plain, at = "", 0
        for s, e, mask in spans:
            if s >= at:
                plain, at = plain + text[at:s] + mask, e
            else:  # overlapping spans are one
                at = max(at, e)
        assert clean[r.doc_id] == plain + text[at:]
    assert elsewhere


def test_copies_are_no_evidence(spark):
    """Words beside an entity in copies of one text alone, or in few texts, stay in documents without it."""
    rare = "one quagga here mail a@b.org"
    texts = [rare] * 6 + ["two zorilla mail c@d.org", "zorilla mail c@d.org again"] + ["a quagga elsewhere", "a zorilla elsewhere"] + [f"plain text {'abcdefgh'[i % 8]}x{'abcdefgh'[i // 8]}" for i in range(64)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df, everywhere=True).collect()}
    assert clean[8] == texts[8] and clean[9] == texts[9] and clean[0] == "one quagga here mail [EMAIL]"
    assert "zorilla" not in clean[6] and all(clean[i] == t for i, t in enumerate(texts) if i >= 8)


def test_copies_of_a_text_full_of_addresses(spark):
    """Entities of the same documents are counted as one: 2,000 addresses beside 2,000 words in three copies."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04}")
    text = " ".join(f"{name(i)} {name(i)}@x.org" for i in range(2000))
    df = spark.createDataFrame([(i, text if i < 3 else f"other {i}") for i in range(60)], "doc_id long, text string")
    scanned = pii.scan(df, ["doc_id"])
    members, found = pii.shares(scanned)
    assert members.count() == 2000 and members.select("of").distinct().count() == 1
    assert 2000 <= found.count() <= 2010
    for everywhere in (False, True):  # of equal texts, all words disclose; counted as one, none does
        clean = pii.sanitise(df, everywhere=everywhere).where("doc_id < 3").collect()
        assert all("@" not in r.text and bool(re.search("[a-z]{4}", r.text)) == everywhere for r in clean)


def test_time_grows_with_the_length():
    def took(n):
        text = " ".join(f"name{i} u{i}@host{i}.org +1 555 {i:07}" for i in range(n // 2))
        start = time.process_time()
        spans = pii.base_spans(text)
        pii.occurrences(text, {*pii.words_of(text)}, [(s, e) for _, s, e in spans])
        assert len(spans) >= n // 2
        return time.process_time() - start

    took(1000)
    few, many = min(took(8000) for _ in range(2)), took(80000)
    assert many < 30 * few + 0.5


def test_columns_and_nulls(spark):
    rows = [(1, None, 5, "x"), (2, "", 0, None), (None, "mail a@b.c", 10, "y"), (3, "no data", 7, "z"), (3, "no data", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, term string").withColumn("disclosure", F.lit(1)).withColumn("of", F.lit("o"))
    out = pii.sanitise(df, everywhere=True)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [(0, "mail [EMAIL]", 12), (2, "", 0), (3, "no data", 7), (3, "no data", 7)]
    assert out.where("doc_id = 1").head().n_chars == 5
    assert pii.sanitise(df.limit(0), everywhere=True).count() == 0
