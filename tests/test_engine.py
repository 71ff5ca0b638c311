"""The engine against a naive evaluator, golden tables and round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import dsl, sqltext
from tessera.catalog import Database, Index
from tessera.functions import scalar
from tessera.operators import fulltext, modify
from tessera.spec import Bracket, Entry, Filter, Query, QueryError, validate

DOCS = [{"id": i, "a": random.Random(i).choice([None, 1, 2, 3]), "s": random.Random(i * 7).choice([None, "Foo", "bar", "12"]), "arr": random.Random(i * 3).choice([None, [], [1], [1, None], [2, 3], [None]]), "b": random.Random(i * 5).randrange(4)} for i in range(120)]


@pytest.fixture(scope="module")
def db(spark):
    d = Database(spark)
    d.open("t", spark.createDataFrame([tuple(x.values()) for x in DOCS], "id long, a int, s string, arr array<int>, b int"), [Index("id", pk=True)])
    return d


def naive_leaf(doc, f):
    v = doc[f.left]
    values = v if isinstance(v, list) else [] if v is None else [v]
    some = [x for x in values if x is not None]
    if f.cond == "empty":
        return v is None or v == [] or (isinstance(v, list) and None in v)
    if f.cond == "any":
        return bool(some)

    def num(x):
        try:
            return float(x)
        except ValueError:
            return None

    def test(x, op, y):
        if isinstance(x, str) != isinstance(y, str):
            x, y = num(x), num(y)
            if x is None or y is None:
                return False
        return {"eq": x == y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op]

    if f.cond in ("eq", "lt", "le", "gt", "ge"):
        return any(test(x, f.cond, f.value) for x in some)
    if f.cond == "set":
        return any(test(x, "eq", y) for x in some for y in f.value)
    if f.cond == "allset":
        return all(any(test(x, "eq", y) for x in some) for y in f.value)
    if f.cond == "range":
        return any(test(x, "ge", f.value[0]) and test(x, "le", f.value[1]) for x in some)
    raise AssertionError(f.cond)


def naive(doc, entries):
    out, now = True, None
    for e in entries:
        r = naive(doc, e.item.entries) if isinstance(e.item, Bracket) else naive_leaf(doc, e.item)
        if e.op == "or":
            now = now or r
        else:
            out = out and (now is None or now)
            now = not r if e.op == "not" else r
    return out and (now is None or now)


def random_entries(rng, depth=2):
    out = []
    for i in range(rng.randrange(1, 4)):
        op = rng.choice(["and", "or", "not"]) if i else rng.choice(["and", "not"])
        if depth and rng.random() < 0.3:
            out.append(Entry(op, Bracket(random_entries(rng, depth - 1))))
            continue
        field = rng.choice(["a", "s", "arr", "b"])
        value = lambda: rng.choice([1, 2, 3]) if field != "s" else rng.choice(["Foo", "bar", "12", 12])  # noqa: E731, B023
        cond = rng.choice(["eq", "set", "lt", "ge", "range", "empty", "any", "allset"] if field != "s" else ["eq", "set", "empty", "any"])
        v = None if cond in ("empty", "any") else value() if cond in ("eq", "lt", "ge") else sorted([rng.choice([1, 2]), rng.choice([2, 3])]) if cond == "range" else [value() for _ in range(2)]
        out.append(Entry(op, Filter(field, cond, v)))
    return out


def test_conditions_equal_the_naive_evaluator(db):
    rng = random.Random(11)
    queries = [random_entries(rng) for _ in range(120)]
    from tessera.operators.predicates import compile_entries

    ns = db.get("t")
    cols = [compile_entries(ns.df, q, [], ns, "names", lambda e: None).alias(f"q{i}") for i, q in enumerate(queries)]
    rows = {r.id: r for r in ns.df.select("id", *cols).collect()}
    for doc in DOCS:
        for i, q in enumerate(queries):
            assert rows[doc["id"]][f"q{i}"] == naive(doc, q), (doc, q)


STATEMENTS = [
    "SELECT * FROM t WHERE a = 1 AND b > 2 OR s = 'x' LIMIT 5 OFFSET 2",
    "SELECT a, b.c FROM t WHERE NOT (a IN (1,2) OR b RANGE (1,3)) ORDER BY a DESC, 2 * b - abs(c)",
    "SELECT FACET(a, b ORDER BY 'count' DESC LIMIT 3), SUM(c) FROM t WHERE s LIKE '%x_'",
    "SELECT COUNT(*) FROM t WHERE a IS NOT NULL AND b IS NULL",
    "SELECT * FROM t WHERE INNER JOIN (SELECT * FROM r WHERE z = 1 LIMIT 0) ON (id = r.rid AND x < r.y)",
    "SELECT * FROM t LEFT JOIN r ON (t.id = r.rid) ORDER BY FIELD(a, 3, 1) DESC",
    "SELECT *, RANK() FROM t WHERE KNN(v, [1.0, -2.5], k=5, ef=10)",
    "SELECT * FROM t WHERE (SELECT MAX(a) FROM m) > 3 AND id IN (SELECT q FROM m WHERE q > 1)",
    "SELECT * FROM t WHERE p = 'a' AND q = 20 EQUAL_POSITION(p, q)",
    "SELECT * FROM t WHERE ST_DWithin(p, ST_GeomFromText('point(1 2.5)'), 3.0) AND \"a+b\" IN ({1,2},{3,4})",
    "SELECT * FROM t WHERE flat_array_len(arr) >= 2 AND ts < now(sec) MERGE (SELECT * FROM u WHERE a = 1)",
    "UPDATE t SET a = 3, b.c = a + 2 * b, arr = [1,2], o = {\"x\": 1} DROP z WHERE id = 5",
    "DELETE FROM t WHERE a <> 3 LIMIT 3",
    "TRUNCATE t",
]


@pytest.mark.parametrize("text", STATEMENTS)
def test_round_trips(text):
    q = sqltext.parse(text)
    assert sqltext.parse(sqltext.encode(q)) == q
    assert dsl.parse(json.loads(json.dumps(dsl.encode(q)))) == q or "{" in text


@pytest.mark.parametrize("text", ["SELECT * FROM t WHERE OR a = 1", "SELECT FROM", "SELECT * FROM t WHERE a =", "SELECT * FROM t WHERE a ~ 3", "SELECT a, SUM(b) FROM t", "SELECT * FROM t WHERE a = 1 OR b <> 2", "SELECT * FROM t WHERE a = 1 OR NOT b = 2"])
def test_parse_errors(text):
    with pytest.raises(QueryError):
        sqltext.parse(text)


def test_null_tables(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, [1, None]), (5, [0])]
    df = spark.createDataFrame(rows, "id long, f array<int>")
    d = Database(spark)
    d.open("plain", df, [Index("id", pk=True)])
    d.open("indexed", df, [Index("id", pk=True), Index("f", array=True)])
    ids = lambda ns: sorted(r.id for r in d.sql(f"SELECT id FROM {ns} WHERE f IS NULL").df.collect())
    assert ids("plain") == [1, 2, 3, 4] and ids("indexed") == [1, 2]


def test_equal_position_and_grouping(spark):
    df = spark.createDataFrame([(1, ["wink", "dns"], [10, 20])], "id long, p array<string>, a array<int>")
    nested = spark.createDataFrame([(1, [([1, 2], "x"), ([3], "y")])], "id long, g array<struct<v:array<int>,n:string>>")
    d = Database(spark)
    d.open("e", df, [Index("id", pk=True)])
    d.open("n", nested, [Index("id", pk=True)])
    count = lambda t: d.sql(t).df.count()
    assert count("SELECT * FROM e WHERE p = 'wink' AND a = 20") == 1
    assert count("SELECT * FROM e WHERE p = 'wink' AND a = 20 EQUAL_POSITION(p, a)") == 0
    assert count("SELECT * FROM e WHERE p = 'wink' AND a = 10 EQUAL_POSITION(p, a)") == 1
    assert count("SELECT * FROM n WHERE g[#].v = 2 AND g[#].n = 'x' EQUAL_POSITION(g[#].v, g[#].n)") == 1
    assert count("SELECT * FROM n WHERE g[#].v = 3 AND g[#].n = 'x' EQUAL_POSITION(g[#].v, g[#].n)") == 0


def test_joins_nest_and_flag(spark, db):
    r = spark.createDataFrame([(1, 1, "u"), (2, 1, "v"), (3, 2, "w")], "rid long, k int, n string")
    db.open("r", r, [Index("rid", pk=True)])
    got = {x.id: [y.n for y in x.joined_r] for x in db.sql("SELECT id FROM t WHERE id < 40 LEFT JOIN (SELECT n FROM r ORDER BY n DESC LIMIT 1) ON (a = r.k)").df.collect()}
    for doc in DOCS[:40]:
        assert got[doc["id"]] == {1: ["v"], 2: ["w"]}.get(doc["a"], [])
    kept = {x.id for x in db.sql("SELECT id FROM t WHERE b = 0 OR INNER JOIN r ON (arr IN r.k)").df.collect()}
    assert kept == {d["id"] for d in DOCS if d["b"] == 0 or {1, 2} & {*(d["arr"] or [])}}


def test_text_language():
    q = fulltext.parse("@title^2,body =exact *suff pref* typo~ word^3 +must -never \"two words\"~4")
    assert q.fields == {"title": 2.0, "body": 1.0}
    kinds = [(t.word, t.op, t.exact, t.prefix, t.suffix, t.typos, t.boost, t.gap) for t in q.terms]
    assert kinds[0][:3] == ("exact", "or", True) and kinds[1][4] and kinds[2][3] and kinds[3][5] and kinds[4][6] == 3.0
    assert [t.op for t in q.terms[5:7]] == ["must", "not"] and q.terms[-1].gap == 4
    for bad in ('"open', "-only -these"):
        with pytest.raises(QueryError):
            fulltext.parse(bad)


def test_snippets():
    found = fulltext.areas("some text", ["text"])
    assert fulltext.highlight("some text", found, "<b>", "</b>") == "some <b>text</b>"
    assert fulltext.snippet("some text", found, "<b>", "</b>", 2, 0) == "e <b>text</b> "
    long = fulltext.areas("some text string", ["text"])
    assert fulltext.snippet("some text string", long, "<b>", "</b>", 2, 2, "{", "}", True) == "{[3,11]e <b>text</b> s}"
    assert fulltext.snippet("some text string", long, "<b>", "</b>", 5, 5, "{", "}", left_bound="o", right_bound="i") == "{me <b>text</b> str}"


def test_text_search(spark):
    d = Database(spark)
    rows = [(1, "the quick brown fox"), (2, "quick thinking foxes"), (3, "slow brown bear"), (4, "brown quick"), (5, None)]
    d.open("x", spark.createDataFrame(rows, "id long, text string"), [Index("id", pk=True), Index("text", "text", config={"fields": ["text"]})])
    find = lambda q: {r.id for r in d.query("x").match("text", q).exec().df.collect()}
    assert find("fox") >= {1} and find("=fox") == {1} and find("fox*") == {1, 2}
    assert find("+quick +brown") == {1, 4} and find("+quick -brown") == {2}
    assert find('"quick brown"') == {1} and find("qick~") == {1, 2, 4} and find("*own") == {1, 3, 4}
    assert find("йгшсл") == {1, 2, 4}


def test_updates(spark):
    d = Database(spark)
    df = spark.createDataFrame([(1, (2, "x"), [1, 2, 2, 3]), (2, (5, None), [])], "id long, o struct<n:int,s:string>, arr array<int>")
    d.open("u", df, [Index("id", pk=True)])
    d.sql("UPDATE u SET o.n = 9, arr[0] = 7 WHERE id = 1")
    d.sql("UPDATE u SET fresh = 'v' WHERE id = 2")
    rows = {r.id: r for r in d.get("u").df.collect()}
    assert rows[1].o.n == 9 and rows[1].arr == [7, 2, 2, 3] and rows[2].o.n == 5 and rows[2].fresh == "v" and rows[1].fresh is None
    d.sql("UPDATE u SET arr = array_remove_once(arr, [2]) DROP fresh WHERE id = 1")
    assert {r.id: r.arr for r in d.get("u").df.collect()}[1] == [7, 2, 3]
    tx = modify.Transaction(d, "u").put(df.where("id = 1").withColumn("id", F.lit(3).cast("long")), "insert")
    tx.commit()
    assert d.get("u").df.count() == 3
    d.sql("TRUNCATE u")
    assert d.get("u").df.count() == 0


def test_array_functions(spark):
    row = spark.range(1).select(scalar.array_remove(F.array(*map(F.lit, [1, 2, 1, 3])), F.array(F.lit(1))).alias("a"), scalar.array_remove_once(F.array(*map(F.lit, [1, 2, 1, 3])), F.array(F.lit(1), F.lit(3))).alias("b")).head()
    assert row.a == [2, 3] and row.b == [2, 1]


def test_dump_and_stream(spark, tmp_path):
    from tessera.sources import files
    from tessera.streaming.changes import ChangeLog, follow

    d, folder = Database(spark), f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    d.open("n", df, [Index("id", pk=True)])
    files.dump(d, f"{folder}/dump")
    other = Database(spark)
    files.restore(other, f"{folder}/dump", ["n"])
    assert other.get("n").pk == ["id"] and other.get("n").df.count() == 2
    d.log = ChangeLog(spark, f"{folder}/log")
    d.sql("UPDATE n SET s = 'z' WHERE id = 1")
    d.sql("DELETE FROM n WHERE id = 2")
    follow(d.log, other, "n", f"{folder}/cp").awaitTermination()
    assert [(r.id, r.s) for r in other.get("n").df.collect()] == [(1, "z")]


def test_rules():
    for q in (Query("a", merge=[Query("b", limit=1)]), Query("a", where=[Entry("and", Filter("x", "near", 1))]), Query("a", equal_positions=[["x"]])):
        with pytest.raises(QueryError):
            validate(q)
    assert sqltext.suggest("SELECT * FROM or", {"orders": ["o_id"]}) == ["orders"]
