"""Full text: typo rules, stems, variants, and ranks against a plain evaluator."""

import math
import random
import re

import pytest

from tessera.catalog import Database, Index
from tessera.operators import fulltext
from tessera.operators.stemming import english, russian
from tessera.spec import QueryError

# fixed values: the documented examples of each number of typos
TYPOS = [
    ("world", {"max_typos": 1}, "world word worlds", "wurld worldss wor"),
    ("sward", {}, "sward sword ward swards", "swords war dword"),
    ("sward", {"max_typos": 3}, "sward sword swords ward war swards", "dword"),
    ("sward", {"max_typos": 4}, "sward sword swords ward war swards dword", ""),
    ("black", {"max_typos": 1}, "blaack", "block blok"),
    ("black", {}, "blaack block", "blok"),
    ("black", {"max_typos": 3}, "blok", ""),
    ("dword", {"max_typo_distance": -1}, "sword words", ""),
    ("dword", {}, "sword", "words"),
    ("wsord", {}, "sword", ""),
    ("wsord", {"max_permutation_distance": 0}, "", "sword"),
    ("sward", {"max_typos": 0}, "sward", "sword ward"),
    ("sward", {"max_missing_letters": 0}, "sword ward", "swards"),
    ("sward", {"max_extra_letters": 0}, "sword swards", "ward"),
]


@pytest.mark.parametrize("word, config, found, missed", TYPOS)
def test_documented_typos(word, config, found, missed):
    t = fulltext.Typos(word, 100.0, fulltext.Config(**config))
    assert [w for w in found.split() if t.proc_of(w) is None] == []
    assert [w for w in missed.split() if t.proc_of(w) is not None] == []


def test_typos_equal_all_deletions():
    """Against trying every pair of deletions, and the distance rule on each."""
    rng = random.Random(4)

    def cuts(w, most):
        out = [(w, ())]
        if len(w) >= 3:
            out += [(w[:i] + w[i + 1 :], (i,)) for i in range(len(w))]
        if most > 1 and len(w) > 3:
            out += [("".join(c for k, c in enumerate(w) if k not in (i, j)), (i, j)) for i in range(len(w)) for j in range(i + 1, len(w))]
        return out

    for most in (1, 2):
        for _ in range(300):
            a = "".join(rng.choices("abc", k=rng.randrange(2, 7)))
            b = "".join(rng.choices("abc", k=rng.randrange(2, 7)))
            want = False
            for x, p in cuts(a, 1):
                for y, q in cuts(b, 1):
                    if x == y and len(p) + len(q) <= most:
                        want |= not p or not q or p == q or (abs(p[0] - q[0]) == 1 and a[p[0]] == b[q[0]])
            assert (fulltext.Typos(a, 100.0, fulltext.Config(max_typos=most)).proc_of(b) is not None) == want, (a, b, most)


def test_stems():
    # fixed values: samples of the published vocabularies
    for words in ("consign consigned consigning consignment", "generous generously", "knight knightly", "happi happy", "run running runs", "hope hoping", "hop hopping"):
        first, *rest = words.split()
        assert {english(w) for w in rest} <= {english(first), first}
    for word, stem in (("важная", "важн"), ("вперегонки", "вперегонк"), ("красивейший", "красив"), ("падение", "паден"), ("наследственность", "наследствен"), ("бежавши", "бежа")):
        assert russian(word) == stem
    assert english("skies") == "sky" and english("proceed") == "proceed" and english("naïve") == "naïve" and russian("abc") == "abc"


def test_numbers_in_words():
    assert fulltext.numbers_as_words("12") == ["twelve", "двенадцать"] and fulltext.numbers_as_words("x") == []
    assert fulltext.numbers_as_words("345")[:4] == ["three", "hundred", "forty", "five"]


ROWS = 60
WORDS = "alpha beta gamma delta things thing thinking dicaprio di caprio user-friendly userfriendly running run the of".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 14))), " ".join(rng.choices(WORDS, k=rng.randrange(0, 4)))) for i in range(ROWS)] + [(ROWS, None, None), (ROWS + 1, "", "alpha")]
    db = Database(spark)
    db.open("t", spark.createDataFrame(rows, "id long, body string, title string"), [Index("id", pk=True), Index("text", "text", config={"fields": ["body", "title"]})])
    return db, rows


def plain_ranks(rows, asked, c):
    """Ranks by loops over rows, terms, words and fields."""
    q = fulltext.parse(asked, c)
    docs = {i: [re.findall(r"[a-z]+(?:[-+/'][a-z]+)*", (t or "").lower()) for t in fields] for i, *fields in rows}
    vocabulary = {w for fs in docs.values() for ws in fs for w in ws}
    n, average = len(docs), [sum(len(d[f]) for d in docs.values()) / len(docs) for f in range(2)]
    boosts = [q.fields.get(f, 0.0) if q.fields and "*" not in q.fields else 1.0 for f in ("body", "title")]
    found = []
    for i, t in enumerate(q.terms):
        typos = {}
        if t.typos:
            for v in fulltext._begun(q, i, c):
                for w in vocabulary - c.stop_words:
                    if (p := fulltext.Typos(v.word, v.proc, c).proc_of(w)) is not None:
                        typos[w] = max(typos.get(w, 0), p)
        procs = {}
        for v in fulltext.variants(q, i, c, typos):
            for w in vocabulary:
                size, at = len(v.word), w.find(v.word)
                while at >= 0:
                    if (v.suffix or at == 0) and (v.prefix or at + size == len(w)):
                        off = abs(len(w) - size + at)
                        p = min(v.proc, max(v.proc - 15 * off / max(size, 3), 10 if at else 20)) if off else v.proc
                        procs[w] = max(procs.get(w, 0), p)
                        break
                    at = w.find(v.word, at + 1)
        found.append(procs)
    out = {}
    for doc, fields in docs.items():
        total, last, met, length, ok = 0.0, {}, 0, None, True
        for t, procs in zip(q.terms, found, strict=True):
            best, where, size = 0.0, None, None
            for w, p in sorted(procs.items(), key=lambda x: (-x[1], x[0])):
                at = [[k for k, x in enumerate(ws) if x == w] for ws in fields]
                m = sum(any(w in ws for ws in d) for d in docs.values())
                rank, of = 0.0, None
                for f, spots in enumerate(at):
                    if spots and boosts[f]:
                        idf = max(0.2, math.log((n - m + 1) / m) / math.log(1 + n))
                        bm = idf * len(spots) * 3.0 / (len(spots) + 2.0 * (0.25 + 0.75 * len(fields[f]) / average[f]))
                        r = boosts[f] * (0.9 + 0.1 * bm) * (0.7 + 0.3 * t.length) * (0.9 + 0.1 * (1 - spots[0] / 100 if spots[0] <= 10 else 0.9 - spots[0] / 1000)) * t.boost * p
                        if r > rank:
                            rank, of = r, len(fields[f])
                if not rank:
                    continue
                gaps = [abs(a - b) for f in range(2) for a in last.get(f, []) for b in at[f]]
                final = rank * (0.5 + 0.5 / max(min(gaps, default=0), 1) if last else 1.0)
                if final > best:
                    best, where, size = final, {f: s for f, s in enumerate(at) if s}, of
            if t.op == "not":
                ok &= where is None
            elif where is None:
                ok &= t.op != "must"
            else:
                total, met = total + best, met + 1
                length = size if not last else length
                last = where
        if ok and met:
            out[doc] = total * (1.1 if met == len(q.terms) == length else 1.0)
    out = {k: v for k, v in out.items() if v >= c.min_rank}
    top = max(out.values(), default=0)
    return {k: math.floor(v * (255 / top if top > 255 else 1)) for k, v in out.items()}


@pytest.mark.parametrize("asked", ["thing", "thing~", "run +alpha", "+beta -gamma", "*ing^2 alpha", "alph*", "@title^2 thing", "@body^1.5,title thing alpha", "*hin* delta", "things~ =alpha run"])
def test_ranks_equal_the_plain_evaluator(texts, asked):
    db, rows = texts
    c = fulltext.Config(split=False)
    db.get("t").indexes["text"].config["config"] = c
    got = {r.id: r["rank()"] for r in db.query("t").match("text", asked).select("id").with_rank().exec().df.collect()}
    want = plain_ranks(rows, asked, c)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want), (got, want)


def test_groups_of_words(texts):
    db, rows = texts
    has = {i: {*f"{a or ''} {b or ''}".split()} for i, a, b in rows}

    def find(asked, **config):
        db.get("t").indexes["text"].config["config"] = fulltext.Config(**({"stemming": False, "min_rank": 0.0} | config))
        return {r.id for r in db.query("t").match("text", asked).select("id").exec().df.collect()}

    both = {i for i, w in has.items() if {"di", "caprio"} <= w}
    one = {i for i, w in has.items() if "dicaprio" in w}
    assert find("dicaprio") == both | one and find("dicaprio", split=False) == one and find("+dicaprio") == one
    assert find("di caprio") == {i for i, w in has.items() if w & {"di", "caprio", "dicaprio"}}
    assert find("zzz", synonyms={"zzz": ["alpha beta"]}) == {i for i, w in has.items() if {"alpha", "beta"} <= w}
    assert find("alpha beta", synonyms={"alpha beta": ["gamma"]}) == {i for i, w in has.items() if w & {"alpha", "beta", "gamma"}}
    assert find("user-friendly") == {i for i, w in has.items() if w & {"user-friendly", "userfriendly"}}


def test_an_index_is_built_once_and_again_after_a_write(texts, spark):
    db, _ = texts
    own = db.copy()
    first = own.get("t").text_index(["body", "title"])
    assert own.get("t").text_index(["body", "title"]) is first and own.copy().get("t").text_index(["body", "title"]) is first
    plan = fulltext.ask(first, "=thing")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [word") <= 2 and "body" not in plan  # postings alone, not the texts
    own.sql("DELETE FROM t WHERE id < 30")
    found = {r.id for r in own.query("t").match("text", "=alpha").select("id").exec().df.collect()}
    assert found and min(found) >= 30 and own.get("t").text_index(["body", "title"]) is not first


def test_debug_rank_takes_no_arguments(texts):
    db, _ = texts
    db.get("t").indexes["text"].config["config"] = fulltext.Config()
    with pytest.raises(QueryError):
        db.query("t").match("text", "=alpha").functions("text.debug_rank(1)").exec()


def test_small_writes_change_the_index(texts):
    """After updates, deletes and inserts, counts, averages and ranks are those of a new index."""
    from tessera.operators import modify

    db = texts[0].copy()
    ns = db.get("t")
    ns.indexes["text"].config["config"] = fulltext.Config()
    ns.text_index(["body", "title"])
    db.sql("UPDATE t SET body = 'alpha new things alpha' WHERE id = 3")
    db.sql("DELETE FROM t WHERE id IN (5, 6)")
    extra = db.spark.createDataFrame([(900, "gamma alpha", None), (901, None, "things")], "id long, body string, title string")
    modify.apply(db, "t", extra, "upsert")
    got, want = ns.text_index(["body", "title"]), fulltext.build(ns.df, ["id"], ["body", "title"])
    assert ns.delta is not None and got.total == want.total and got.average == pytest.approx(want.average)
    assert sorted(map(tuple, got.words.collect())) == sorted(map(tuple, want.words.collect()))
    for asked in ("alpha", "things~ +gamma", "new"):
        assert sorted(map(tuple, fulltext.ask(got, asked).collect())) == sorted(map(tuple, fulltext.ask(want, asked).collect()))


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_words_of_many_texts_are_those_of_each():
    rng = random.Random(1)
    texts = ["".join(rng.choices("aB1_-+/' \n.\u00e9\u00df\u0130\u03a3\u03c3\u4e2d\u7814\u0436\u0401\U0001f600\u0663\u2167a", k=rng.randrange(0, 30))) for _ in range(2000)] + ["", "-", "a-"]
    for c in (fulltext.Config(), fulltext.Config(extra_symbols=""), fulltext.Config(extra_symbols="_-"), fulltext.Config(diacritics=False)):
        want = [fulltext.words_in(t, c) for t in texts]
        words, counts = fulltext.words_of_all(texts, c)
        assert words.to_pylist() == [w for own in want for w in own] and counts.tolist() == [len(own) for own in want]
    assert [len(x) for x in fulltext.words_of_all([], fulltext.Config())] == [0, 0]


def test_postings_are_not_shuffled(spark, monkeypatch):
    """Neither when an index is built, nor those that don't match when many words do."""
    rng = random.Random(3)
    usual = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*rng.choices(usual, k=300), f"rare{i % 40}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(2)
    before = shuffled(spark)
    index = fulltext.build(df, ["id"], ["text"])
    built = shuffled(spark)
    assert built - before < 100_000 < sum(len(t) for _, t in rows) / 5  # 440 words by task and their counts
    want = sorted(map(tuple, fulltext.ask(index, "=rare*").collect()))
    assert len(want) == 600
    monkeypatch.setattr(fulltext, "WORDS_BY_VALUE", 3)
    before = shuffled(spark)
    assert sorted(map(tuple, fulltext.ask(index, "=rare*").collect())) == want
    assert shuffled(spark) - before < 200_000  # 600 of 130,000 postings


def test_segments_hold_what_one_index_holds(texts, monkeypatch):
    """Of one row each, and of all rows: the same words, counts and ranks."""
    db, _ = texts
    ns = db.get("t")
    whole = fulltext.build(ns.df.coalesce(1), ["id"], ["body", "title"])
    monkeypatch.setattr(fulltext, "SEGMENT_CHARACTERS", 1)
    split = fulltext.build(ns.df, ["id"], ["body", "title"])
    for a, b in ((whole.words, split.words), (whole.postings, split.postings), *((fulltext.ask(whole, t), fulltext.ask(split, t)) for t in ("things", "alpha beta", '"the of"'))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_one_snapshot_has_one_index(texts):
    """A second namespace over the same table is not indexed anew, and keeps its own after a write."""
    db = texts[0].copy()
    db.open("other", db.get("t").df, [Index("id", pk=True), Index("text", "text", config={"fields": ["body", "title"]})])
    first = db.get("t").text_index(["body", "title"])
    assert db.get("other").text_index(["body", "title"]) is first
    db.sql("DELETE FROM other WHERE id < 30")
    assert db.get("other").text_index(["body", "title"]) is not first and db.get("t").text_index(["body", "title"]) is first
