"""PII, lattice and MinHash near-dedup, toxicity, quality and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lattice, minhash, pii, quality, toxicity
from tests.llm.test_small_operators import DOCS, ODD

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def naive_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(PHONE, text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_pii_patterns_equal_the_plain_ones():
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", "@x.y", ".", "1", "22", "255", "256", "00012", "-", " ", "+", "(", ")", "4111111111111111", "4845168114407329", "é", "\n", "%", "a@b.c", "1.2.3.4", "+1 (974) 555-3436"]
    for _ in range(20000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert pii.base_spans(text) == naive_spans(text), repr(text)


def test_pii_long_runs_are_linear():
    for unit in ("1", "a", "1.", "1 ", "+1", "@", "a@", "a.", "+1 "):
        pii.base_spans(unit * 60000)


def test_pii_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op4_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = naive_spans(texts[r.doc_id])
        assert r.base_sha256 == pii.digest(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in spans) for x in pii.KINDS)
        assert r.spans.startswith(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def test_pii_disclosure(spark):
    docs = [(i, f"call zanzibar a{i % 3}@x.org about common things" if i < 6 else "common things about nothing much") for i in range(40)]
    docs += [(100, "zebra b@x.org"), (101, "zebra b@x.org"), (102, "zebra")] + [(200 + i, "nothing") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scanned = pii.scan(df, ["doc_id"])
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing(df, scanned).collect()}
    n = len(docs)
    both, ent, term = 2, 2, 3
    assert got[("email:b@x.org", "zebra")] == pytest.approx(np.log2(both * n / (ent * term)) / -np.log2(ent / n))
    assert not any(t in ("common", "about", "things") for _, t in got)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[102] == "zebra" and clean[100] in ("[TERM] [EMAIL]", " [EMAIL]") and "@" not in "".join(clean.values())


def test_pii_counts_entities_that_stand_alone(spark):
    texts = ["marmalade lone@x.org"] * 4 + ["lone@x.org"] * 36 + ["marmalade"] * 11 + ["nothing"] * 949
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(t == "marmalade" for _, t, _ in pii.disclosing(df, pii.scan(df, ["doc_id"])).collect())
    assert np.log2(4 * 1000 / (40 * 15)) / np.log2(1000 / 40) < pii.GENERALISE < np.log2(1000 / 15) / np.log2(1000 / 4)


def test_pii_terms_over_whole_texts(spark):
    rng = random.Random(5)
    common = [f"word{i}" for i in range(300)]
    texts = []
    for i in range(400):
        words = rng.choices(common, k=40)
        if i < 6:
            words[0], words[-1] = "Quixote", f"\n\nx{i % 2}@x.org"
            words[20] = "Zed"
        elif i < 8:
            words[0], words[10] = "solo@y.org", "solo"
        texts.append(" ".join(words))
    texts += ["no such thing as zed", ""]
    df, n = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), len(texts)
    has = [{*re.findall("[a-z]+", t.lower())} for t in texts]
    ents = [{f"{k}:{t[s:e].lower()}" for k, s, e in naive_spans(t)} for t in texts]
    want = {}
    for e in set().union(*ents):
        held = [i for i in range(n) if e in ents[i]]
        for w in set().union(*(has[i] for i in held)):
            both = sum(w in has[i] for i in held)
            share = np.log2(both * n / (len(held) * sum(w in h for h in has))) / -np.log2(len(held) / n)
            if both >= pii.MIN_DOCS and share >= pii.GENERALISE:
                want[e, w] = share
    assert {w for _, w in want} >= {"quixote", "zed", "solo"}
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing(df, pii.scan(df, ["doc_id"])).collect()}
    assert got == pytest.approx(want)
    for r in pii.find(df, ["doc_id"]).collect():
        terms = {w for e, w in want if e in ents[r.doc_id]}
        spans = naive_spans(texts[r.doc_id])
        words = [m for m in re.finditer("[A-Za-z]+", texts[r.doc_id]) if m[0].lower() in terms and not any(m.start() < e and s < m.end() for _, s, e in spans)]
        assert [(t.s, t.e) for t in r._pii_terms or []] == [m.span() for m in words]


def test_pii_bloom_hash_agrees(spark):
    import xxhash

    words = ["a", "zebra", "été", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(F.xxhash64(F.col("t").cast("binary"))).collect()]
    assert [g % 2**64 for g in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_pii_odd(odd):
    assert pii.find(odd, ["doc_id"]).count() == len(ODD)
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert pii.sanitise(odd.limit(0)).count() == 0


def brute_components(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_e8_points_are_nearest():
    x = np.random.default_rng(0).standard_normal((200, 8)) * 2
    near = lattice.e8_nearest(x)
    doubled = np.rint(near * 2).astype(int)
    assert ((doubled % 2).sum(1) % 8 == 0).all() and (doubled.sum(1) % 4 == 0).all()
    d = ((x - near) ** 2).sum(1)
    assert d.max() <= 1 + 1e-9
    for r in lattice.ROOTS:
        assert (((x - near - r) ** 2).sum(1) >= d - 1e-9).all()


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    for cosine, least in ((0.95, 0.985), (0.97, 0.997), (0.99, 0.999)):
        noise = rng.standard_normal(a.shape)
        noise -= (noise * a).sum(1, keepdims=True) * a
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        b = cosine * a + np.sqrt(1 - cosine**2) * noise
        met = (lattice.cells(a)[:, :, None] == lattice.cells(b)[:, None, :]).any((1, 2))
        assert met.mean() >= least, (cosine, met.mean())


def test_lattice_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 64))
    rows = [base[i % 40] + 0.02 * rng.standard_normal(64) * (i >= 40) for i in range(900)]
    rows += [rows[3], rows[3], base[0] + 0.02 * rng.standard_normal(64)]
    hot = rng.standard_normal(64)
    rows += [hot + 0.01 * rng.standard_normal(64) for _ in range(1200)]
    x = np.array(rows, np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = len(data)
    data += [(n, None), (n + 1, [0.0] * 64), (n + 2, [1.0, None]), (n + 3, [float("nan")] * 3), (n + 4, [float("inf"), 1.0]), (n + 5, []), (n + 6, [2.0, 2.0]), (n + 7, [1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("class", F.lit("x"))
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    assert len(got) == len(data)
    roots = brute_components(n, zip(*np.nonzero(np.triu(close, 1)), strict=True))
    exact = sum(got[i].n_links == close[i].sum() - 1 for i in range(n))
    assert exact >= 0.99 * n and all(got[i].n_links <= close[i].sum() - 1 for i in range(n))
    assert [got[i].component_id for i in range(n)] == roots
    assert all(got[i].n_links == 0 and got[i].kept for i in range(n, n + 6))
    assert got[n + 7].component_id == n + 6 and got[n + 6].n_links == 1
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def jaccard_links(texts, size, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, links


def test_minhash_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    rng = random.Random(4)
    texts = [r.text or "" for r in docs]
    for _ in range(150):  # chains of near copies around the threshold
        words = rng.choice(texts[:220] if rng.random() < 0.5 else texts).split(" ")
        for _ in range(rng.randrange(1, max(2, len(words) // 9))):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z"])
        texts.append(" ".join(words))
    texts += [None, "", " \n", "One", "one", "one two", "ONE  two", "a b c", "a b c d"]
    sets, links = jaccard_links(texts, 2, 80)
    roots = brute_components(len(texts), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in got)


def test_minhash_blocks_in_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(60)]
    texts = []
    for _ in range(90):
        words = base[:]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(60)] = str(rng.randrange(1000))
        texts.append(" ".join(words))
    _, links = jaccard_links(texts, 2, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(len(texts), links)


def test_minhash_odd(odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_bayesian_bounds():
    least = minhash.least_matches(0.8)
    assert least[-1] <= 0.8 * minhash.PERMUTATIONS and (np.diff(least) > 0).all()
    a = np.zeros((3, minhash.PERMUTATIONS), np.uint32)
    b = a.copy()
    b[1, 30:] = 1
    b[2, ::10] = 1
    assert minhash.survive(a, b, least).tolist() == [0, 2]


def test_toxicity_finds_the_words(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, labels)
    planted = spark.createDataFrame([(i, "the quick note about idiot and stupid trash and scum pathetic loser today " * 2) for i in range(5)] + [(10 + i, "the quick note about gardens and rivers today " * 3) for i in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(planted, chain, ["doc_id"]).collect()}
    assert all(got[i] == 1 and got[10 + i] == 0 for i in range(5))


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (6, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 1")):
        chain = toxicity.train(odd, some)
        assert toxicity.score(odd, chain, odd.columns).count() == len(ODD)
    assert toxicity.clean(odd.withColumn("predicted", F.lit(1)), labels).columns == [*odd.columns, "predicted"]
    assert toxicity.clean(odd.limit(0), labels).count() == 0


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op10_quality(spark, sf).collect()]
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = [r.score for r in held if labels[r.doc_id] == 1]
    bad = [r.score for r in held if labels[r.doc_id] == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.85, auc
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_sees_rare_values_of_a_feature():
    rng = np.random.default_rng(6)
    x = rng.random((2000, len(quality.FEATURES)))
    y = (rng.random(2000) < 0.7).astype(float)
    x[:, 7] = 0
    x[:40, 7], y[:40] = rng.random(40), 0  # 2% of the rows
    x[:, 8] = 0
    x[40:120, 8], y[40:120] = np.linspace(1e-6, 1, 80), 0  # 4%; the smallest are not zero either
    x[:, 9] = np.where(rng.random(2000) < 0.5, 3, rng.integers(0, 3, 2000))
    x[120:150, 9], y[120:150] = 4, 0  # 1.5% above a frequent value
    model = quality.fit(x, y)
    assert (model.predict(x[:150]) < quality.THRESHOLD).all()
    bins, small = model.bins(x), model.coarse(x)
    for j, junk in ((7, slice(0, 40)), (8, slice(40, 120)), (9, slice(120, 150))):
        other = np.delete(np.arange(2000), np.arange(2000)[junk])
        assert not {*bins[junk, j]} & {*bins[other, j]} and not {*small[junk, j]} & {*small[other, j]}
    assert model.predict(x[150:]).mean() > 0.6


def test_quality_odd(spark, odd):
    rows = quality.described(odd, ["doc_id"])
    labels = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert quality.scored(rows, quality.train(rows, some), ["doc_id"]).count() == len(ODD)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        ids = [r.doc_id for r in kept.collect()]
        if name == "minhash":
            texts = [r.text for r in before.orderBy("doc_id").collect()]
            order = [r.doc_id for r in before.orderBy("doc_id").collect()]
            _, links = jaccard_links(texts, 5, 80)
            roots = brute_components(len(texts), links)
            assert sorted(ids) == sorted(order[i] for i in range(len(order)) if roots[i] == i)
        if name == "pii":
            assert len(ids) == before.count() and not any(naive_spans(r.text) for r in kept.collect())
    rows = p.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}
    assert hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()
    by_window = defaultdict(int)
    for r in rows:
        by_window[r.sequence_id] += r.length
    assert max(by_window.values()) <= 1024
