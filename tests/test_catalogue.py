"""Every query of the catalogue against its SQL in DuckDB, and what its plans must show."""

import duckdb
import pytest

from tessera.catalog import Database, Index
from tessera.plans import catalogue, catalogue_extra, catalogue_more  # noqa: F401
from tessera.plans.catalogue import database
from tessera.spec import QueryError

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted({*catalogue.QUERIES} - {*catalogue.ORACLE_SQL}))
def test_query_without_sql_repeats(spark, sf_dir, name):
    first, again = (sorted(map(str, catalogue.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again


def test_ttl_rounds_parts_of_seconds(spark, sf_dir, tmp_path, duck):
    """Events less than a second around the limit, and a last one past half a second."""
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    at = ["2024-01-30 10:00:00.7", *(f"2024-01-20 {s}" for s in ("09:59:59.6", "10:00:00.4", "10:00:00.5", "10:00:00.6", "10:00:01.4", "10:00:01.5"))]
    path = f"{tmp_path}/events.parquet"
    rows = ", ".join(f"({i}, TIMESTAMP '{t}')" for i, t in enumerate(at))
    duck.execute(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, t AS ts FROM (VALUES {rows}) v(i, t)) TO '{path}' (FORMAT parquet)")
    want = duck.execute(f"WITH events AS (SELECT * FROM '{path}') {catalogue.ORACLE_SQL['ttl']}").fetchall()
    assert 1 < len(want) < len(at)
    assert sorted(tuple(r) for r in catalogue.QUERIES["ttl"](spark, str(tmp_path)).collect()) == sorted(want)


def test_conditions_reach_the_scan(spark, sf_dir):
    db = database(spark, sf_dir)
    for where, pushed in (
        ("o_custkey = 7 AND o_totalprice > 1000", ("EqualTo(o_custkey,7)", "GreaterThan(o_totalprice,1000.0)")),
        ("o_orderstatus IN ('O', 'F') OR o_custkey < 5", ("Or(In(o_orderstatus, [F,O]),LessThan(o_custkey,5))", "Or(In(o_orderstatus, [O,F]),LessThan(o_custkey,5))")),
    ):
        plan = db.sql(f"SELECT o_orderkey FROM orders WHERE {where}").explain()["plan"]
        assert any(p in plan for p in pushed), plan
        assert "o_orderpriority" not in plan  # columns are pruned


def test_streamed_knn_needs_a_limit(spark):
    db = Database(spark)
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "id long, v array<float>, odd int")
    db.open("v", rows, [Index("id", pk=True), Index("v", "hnsw")])
    q = lambda: db.query("v").knn("v", [0.0, 1.0]).where("odd", "eq", 1)
    assert [r.id for r in q().select("id").limit(3).exec().df.collect()] == [1, 3, 5]
    for bad in (q(), q().sort("id").limit(3)):
        with pytest.raises(QueryError):
            bad.exec()
