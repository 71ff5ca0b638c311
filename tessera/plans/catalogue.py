"""The engine's queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Database, Index
from ..operators import aggregates, fulltext, modify
from ..spec import Aggregate, Sort
from ..storage import fresh_path
from ..streaming.changes import ChangeLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id"}


_OPENED: dict[str, tuple[SparkSession, Database]] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    """The tables as namespaces, opened once a session; callers get copies, which share snapshots and text indexes."""
    if sf_dir not in _OPENED or _OPENED[sf_dir][0] is not spark or not spark.sparkContext._jsc:
        _OPENED[sf_dir] = (spark, opened(spark, sf_dir))
    return _OPENED[sf_dir][1].copy()


def opened(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for name, key in KEYS.items():
        extra = [Index("text", "text", config={"fields": ["text"]})] if name == "documents" else []
        db.open(name, read(name), [Index(key, pk=True), *extra])
    db.open("lineitem", read("lineitem"), [Index("l_orderkey+l_linenumber", pk=True)])
    db.open("embeddings", read("embeddings"), [Index("vec_id", pk=True), Index("embedding", "vec_bf", metric="l2")])
    return db


def sql(name: str, text: str, oracle: str, *, fields: str = "") -> None:
    """A query given as SQL text; ``fields`` picks and names what is returned."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = database(spark, sf_dir).sql(text).df
        return out.selectExpr(*fields.split(";")) if fields else out

    QUERIES[name], ORACLE_SQL[name] = run, oracle


def query(name: str, oracle: str = ""):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# predicates

sql("where_eq_set_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('O','F') ORDER BY o_totalprice DESC LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('O','F') ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
sql("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77", "SELECT * FROM orders WHERE o_orderkey = 77")
sql("left_to_right_or", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_custkey < 100", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND (o_orderstatus = 'O' OR o_orderstatus = 'F') AND o_custkey < 100")
sql("brackets_and_not", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 10 OR l_returnflag = 'N') AND l_discount RANGE (0.02, 0.06)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 10 OR l_returnflag = 'N') AND l_discount BETWEEN 0.02 AND 0.06")
sql("compare_all", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 40 AND p_retailprice < 1500 AND p_retailprice > 950 AND p_size <> 20", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 40 AND p_retailprice < 1500 AND p_retailprice > 950 AND p_size <> 20")
sql("like_ignores_case", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%r_m%'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%r_m%'")
sql("relaxed_compare", "SELECT o_orderkey FROM orders WHERE o_custkey = '7' OR o_custkey > '140'", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_custkey > 140")
sql("composite_set", 'SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "l_orderkey+l_linenumber" IN ({1,1},{2,1},{3,2},{5,1})', "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1,1),(2,1),(3,2),(5,1))")
sql("field_to_field", 'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < "l_suppkey"', "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")


def sparse_orders(spark: SparkSession, sf_dir: str) -> Database:
    db = database(spark, sf_dir)
    df = db.get("orders").df.withColumn("prio", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    db.open("sparse", df, [Index("o_orderkey", pk=True), Index("prio", sparse=True)])
    return db


_SPARSE = "WITH sparse AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prio FROM orders) "


def sparse(name: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda s, d: sparse_orders(s, d).sql(text).df
    ORACLE_SQL[name] = _SPARSE + oracle


sparse("is_null", "SELECT o_orderkey FROM sparse WHERE prio IS NULL", "SELECT o_orderkey FROM sparse WHERE prio IS NULL")
sparse("is_not_null", "SELECT o_orderkey, prio FROM sparse WHERE prio IS NOT NULL", "SELECT o_orderkey, prio FROM sparse WHERE prio IS NOT NULL")
sparse("two_valued_not", "SELECT o_orderkey FROM sparse WHERE NOT prio = '1-URGENT'", "SELECT o_orderkey FROM sparse WHERE prio IS DISTINCT FROM '1-URGENT'")
sparse("nulls_sort_first", "SELECT o_orderkey, prio FROM sparse ORDER BY prio LIMIT 50", "SELECT o_orderkey, prio FROM sparse ORDER BY prio NULLS FIRST, o_orderkey LIMIT 50")
sparse("forced_sort", "SELECT o_orderkey FROM sparse ORDER BY FIELD(o_orderstatus, 'P', 'O'), o_totalprice DESC LIMIT 40", "SELECT o_orderkey FROM sparse ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 40")

# arrays

_ARRAYS = "WITH arrays AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS parts, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS qty, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) "


def array_orders(spark: SparkSession, sf_dir: str) -> Database:
    db = database(spark, sf_dir)
    item = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"))
    rows = db.get("lineitem").df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    rows = rows.select("l_orderkey", F.col("x.l_partkey").alias("parts"), F.col("x.q").alias("qty"), F.col("x.f").alias("flags"), F.col("x").alias("items"))
    db.open("arrays", rows, [Index("l_orderkey", pk=True)])
    return db


def arrays(name: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda s, d: array_orders(s, d).sql(text).df
    ORACLE_SQL[name] = _ARRAYS + oracle


arrays("array_any_eq", "SELECT l_orderkey FROM arrays WHERE parts = 17 OR parts IN (3, 5)", "SELECT l_orderkey FROM arrays WHERE list_has_any(parts, [17, 3, 5])")
arrays("array_any_range", "SELECT l_orderkey FROM arrays WHERE qty RANGE (48, 50) AND qty < 4", "SELECT l_orderkey FROM arrays WHERE len(list_filter(qty, lambda x: x BETWEEN 48 AND 50)) > 0 AND len(list_filter(qty, lambda x: x < 4)) > 0")
arrays("allset", "SELECT l_orderkey FROM arrays WHERE flags ALLSET ('R', 'N', 'A')", "SELECT l_orderkey FROM arrays WHERE list_has_all(flags, ['R', 'N', 'A'])")
arrays("not_array", "SELECT l_orderkey FROM arrays WHERE NOT flags = 'R'", "SELECT l_orderkey FROM arrays WHERE NOT list_contains(flags, 'R')")
arrays("equal_position", "SELECT l_orderkey FROM arrays WHERE flags = 'R' AND qty > 40 EQUAL_POSITION(flags, qty)", "SELECT l_orderkey FROM arrays WHERE len(list_filter(list_zip(flags, qty), lambda x: x[1] = 'R' AND x[2] > 40)) > 0")
arrays("equal_position_or", "SELECT l_orderkey FROM arrays WHERE flags = 'A' AND qty < 5 OR qty > 48 EQUAL_POSITION(flags, qty)", "SELECT l_orderkey FROM arrays WHERE len(list_filter(list_zip(flags, qty), lambda x: x[1] = 'A' AND (x[2] < 5 OR x[2] > 48))) > 0")
arrays("flat_array_len", "SELECT l_orderkey FROM arrays WHERE flat_array_len(parts) >= 6", "SELECT l_orderkey FROM arrays WHERE len(parts) >= 6")
arrays("nested_path_any", "SELECT l_orderkey FROM arrays WHERE items.q > 49 AND items.f = 'R'", "SELECT l_orderkey FROM arrays WHERE len(list_filter(qty, lambda x: x > 49)) > 0 AND list_contains(flags, 'R')")
arrays("array_index_path", "SELECT l_orderkey FROM arrays WHERE items[0].q > 45", "SELECT l_orderkey FROM arrays WHERE qty[1] > 45")


@query("facet_array", _ARRAYS + "SELECT f AS flags, count(*) AS count FROM (SELECT unnest(flags) AS f FROM arrays) GROUP BY 1")
def facet_array(spark, sf_dir):
    return array_orders(spark, sf_dir).sql("SELECT FACET(flags) FROM arrays").aggregations[0]


@query("sum_array", _ARRAYS + "SELECT CAST(sum(q) AS DOUBLE) AS value FROM (SELECT unnest(qty) AS q FROM arrays WHERE list_contains(flags, 'R'))")
def sum_array(spark, sf_dir):
    return array_orders(spark, sf_dir).sql("SELECT SUM(qty) FROM arrays WHERE flags = 'R'").aggregations[0]


@query("distinct_array", _ARRAYS + "SELECT DISTINCT unnest(parts) AS parts FROM arrays WHERE list_contains(flags, 'A')")
def distinct_array(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    df = db.sql("SELECT * FROM arrays WHERE flags = 'A'").df
    return aggregates.distinct(df, Aggregate("distinct", ["parts"]), db.get("arrays"))


@query("distinct_zipped", _ARRAYS + "SELECT DISTINCT z.f AS flags, z.q AS qty FROM (SELECT unnest(list_transform(range(1, len(flags) + 1), lambda i: {'f': flags[i], 'q': qty[i]})) AS z FROM arrays)")
def distinct_zipped(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    return aggregates.distinct(db.get("arrays").df, Aggregate("distinct", ["flags", "qty"]), db.get("arrays"))


# aggregation


@query("scalar_aggregates", "SELECT round(sum(l_extendedprice), 2) AS sum_price, avg(l_quantity) AS avg_qty, min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem WHERE l_returnflag = 'R'")
def scalar_aggregates(spark, sf_dir):
    rows = database(spark, sf_dir).sql("SELECT * FROM lineitem WHERE l_returnflag = 'R'").df
    wanted = [Aggregate("sum", ["l_extendedprice"]), Aggregate("avg", ["l_quantity"]), Aggregate("min", ["l_discount"]), Aggregate("max", ["l_tax"])]
    out = aggregates.fused(rows, wanted, database(spark, sf_dir).get("lineitem"))
    return out.select(F.round("value0", 2).alias("sum_price"), F.col("value1").alias("avg_qty"), F.col("value2").alias("min_disc"), F.col("value3").alias("max_tax"))


@query("aggregate_after_limit", "SELECT max(l_quantity) AS value FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 25 OFFSET 5)")
def aggregate_after_limit(spark, sf_dir):
    return database(spark, sf_dir).sql("SELECT MAX(l_quantity) FROM lineitem ORDER BY l_orderkey LIMIT 25 OFFSET 5").aggregations[0]


@query("count_ignores_limit", "SELECT count(*) AS value FROM orders WHERE o_totalprice > 100000")
def count_ignores_limit(spark, sf_dir):
    return database(spark, sf_dir).sql("SELECT *, count(*) FROM orders WHERE o_totalprice > 100000 LIMIT 3").counted.agg(F.count("*").alias("value"))


@query("count_cached", "SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'F'")
def count_cached(spark, sf_dir):
    db = database(spark, sf_dir)
    r = db.sql("SELECT count_cached(*) FROM orders WHERE o_orderstatus = 'F'")
    return spark.createDataFrame([(max(r.total(), r.total()),)], "value long")


@query("facet", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def facet(spark, sf_dir):
    return database(spark, sf_dir).sql("SELECT FACET(o_orderpriority) FROM orders").aggregations[0]


@query("facet_multi_sorted", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 4 OFFSET 2")
def facet_multi_sorted(spark, sf_dir):
    return database(spark, sf_dir).sql("SELECT FACET(o_orderstatus, o_orderpriority ORDER BY 'count' DESC LIMIT 4 OFFSET 2) FROM orders").aggregations[0]


sql("distinct_filter", "SELECT o_orderkey, o_orderpriority, DISTINCT(o_orderpriority) FROM orders WHERE o_totalprice > 50000", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice > 50000) WHERE n = 1")
sql("distinct_two", "SELECT o_orderkey, DISTINCT(o_orderpriority), DISTINCT(o_orderstatus) FROM orders", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS m FROM orders) WHERE n = 1 OR m = 1")

# sorting

sql("sort_expression", "SELECT p_partkey, p_size FROM part ORDER BY 2 * p_size - abs(p_retailprice - 1200) / 100 DESC LIMIT 20", "SELECT p_partkey, p_size FROM part ORDER BY 2.0 * p_size - abs(p_retailprice - 1200.0) / 100.0 DESC, p_partkey DESC LIMIT 20")
sql("sort_multi_offset", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate, l_quantity DESC LIMIT 30 OFFSET 60", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate, l_quantity DESC, l_orderkey, l_linenumber LIMIT 30 OFFSET 60")


@query("collation", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#13' ORDER BY p_partkey")
def collation(spark, sf_dir):
    db = database(spark, sf_dir)
    db.open("part", db.get("part").df, [Index("p_partkey", pk=True), Index("p_brand", collate="ascii")])
    return db.sql("SELECT p_partkey FROM part WHERE p_brand = 'bRaNd#13'").df


@query("numeric_collation", "SELECT k FROM (SELECT p_partkey, p_size || 'x' || p_partkey AS k, p_size AS n, 'x' || p_partkey AS r FROM part) ORDER BY n, r LIMIT 30")
def numeric_collation(spark, sf_dir):
    db = database(spark, sf_dir)
    rows = db.get("part").df.select("p_partkey", F.concat_ws("x", "p_size", "p_partkey").alias("k"))
    db.open("sizes", rows, [Index("p_partkey", pk=True), Index("k", "tree", collate="numeric")])
    return db.sql("SELECT k FROM sizes ORDER BY k LIMIT 30").df


# joins and subqueries

sql("semi_join", "SELECT c_custkey FROM customer WHERE INNER JOIN (SELECT * FROM orders WHERE o_totalprice > 250000 LIMIT 0) ON (c_custkey = orders.o_custkey)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql("anti_join", "SELECT c_custkey FROM customer WHERE NOT INNER JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON (c_custkey = orders.o_custkey)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql("or_join", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR INNER JOIN (SELECT * FROM orders WHERE o_totalprice > 300000 LIMIT 0) ON (c_custkey = orders.o_custkey)", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("join_in_bracket", "SELECT c_custkey FROM customer WHERE c_nationkey < 12 AND (c_mktsegment = 'BUILDING' OR INNER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' LIMIT 0) ON (c_custkey = orders.o_custkey))", "SELECT c_custkey FROM customer WHERE c_nationkey < 12 AND (c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'))")
sql("theta_join", "SELECT n_nationkey FROM nation WHERE INNER JOIN (SELECT * FROM region WHERE r_regionkey > 1 LIMIT 0) ON (n_regionkey < region.r_regionkey)", "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey > 1 AND n_regionkey < r_regionkey)")
sql("inner_join_nested", "SELECT c_custkey FROM customer INNER JOIN (SELECT * FROM orders WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC LIMIT 2) ON (c_custkey = orders.o_custkey)", "SELECT o_custkey AS c_custkey, string_agg(o_orderkey, ',' ORDER BY n) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS n FROM orders WHERE o_totalprice > 200000) JOIN customer ON o_custkey = c_custkey WHERE n <= 2 GROUP BY 1", fields="c_custkey;concat_ws(',', transform(joined_orders, x -> string(x.o_orderkey))) as ids")
sql("left_join_nested", "SELECT n_nationkey FROM nation LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON (n_nationkey = supplier.s_nationkey)", "SELECT n_nationkey, CAST(count(s_suppkey) AS INTEGER) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 GROUP BY 1", fields="n_nationkey;size(joined_supplier) as n")
arrays("join_on_array", "SELECT l_orderkey FROM arrays WHERE INNER JOIN (SELECT * FROM part WHERE p_size = 1 LIMIT 0) ON (parts IN part.p_partkey)", "SELECT l_orderkey FROM arrays WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 1 AND list_contains(parts, p_partkey))")
sql("sort_by_joined", "SELECT c_custkey FROM customer INNER JOIN nation ON (c_nationkey = nation.n_nationkey) ORDER BY nation.n_name DESC", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey", fields="c_custkey")
sql("subquery_field", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_totalprice > 100000", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_totalprice > 100000")
sql("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT MAX(o_totalprice) FROM orders WHERE o_orderstatus = 'F')", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'F')")
sql("subquery_constant", "SELECT n_nationkey FROM nation WHERE (SELECT count(*) FROM orders WHERE o_totalprice > 100) > 10 AND n_regionkey = 1", "SELECT n_nationkey FROM nation WHERE (SELECT count(*) FROM orders WHERE o_totalprice > 100) > 10 AND n_regionkey = 1")
sql("subquery_exists", "SELECT n_nationkey FROM nation WHERE (SELECT o_orderkey FROM orders WHERE o_totalprice < 0) IS NULL AND n_regionkey = 2", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AND n_regionkey = 2")
sql("merge", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 MERGE (SELECT * FROM region WHERE r_regionkey > 2)", "SELECT 'nation' AS _ns, n_nationkey, n_name, n_regionkey, CAST(NULL AS INTEGER) AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region', NULL, NULL, NULL, r_regionkey, r_name FROM region WHERE r_regionkey > 2")

# geometry


def points(spark: SparkSession, sf_dir: str) -> Database:
    db = database(spark, sf_dir)
    df = db.get("customer").df.withColumn("p", F.struct((F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y")))
    db.open("places", df, [Index("c_custkey", pk=True), Index("p", "rtree")])
    return db


@query("dwithin", "SELECT c_custkey FROM customer WHERE (c_acctbal / 100 - 40.0) * (c_acctbal / 100 - 40.0) + (c_nationkey - 12.0) * (c_nationkey - 12.0) <= 15.0 * 15.0")
def dwithin(spark, sf_dir):
    return points(spark, sf_dir).sql("SELECT c_custkey FROM places WHERE ST_DWithin(p, ST_GeomFromText('point(40 12)'), 15)").df


@query("sort_distance", "SELECT c_custkey FROM customer ORDER BY sqrt((c_acctbal / 100 - 40.0) * (c_acctbal / 100 - 40.0) + (c_nationkey - 12.0) * (c_nationkey - 12.0)), c_custkey LIMIT 15")
def sort_distance(spark, sf_dir):
    return points(spark, sf_dir).query("places").select("c_custkey").sort_distance("p", (40, 12)).limit(15).exec().df


# vectors

_DIST = "list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE))))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"


def vectors(spark: SparkSession, sf_dir: str, metric: str = "l2") -> tuple[Database, list[float]]:
    db = database(spark, sf_dir)
    db.get("embeddings").indexes["embedding"].metric = metric
    row = db.get("embeddings").df.where("vec_id = 7").select("embedding").head()
    return db, [float(v) for v in row[0]]


@query("knn_l2", f"SELECT e.vec_id, round({_DIST}, 5) AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_DIST}, e.vec_id LIMIT 20")
def knn_l2(spark, sf_dir):
    db, q = vectors(spark, sf_dir)
    return db.query("embeddings").knn("embedding", q, k=20).with_rank().exec().df.select("vec_id", F.round("rank()", 5).alias("dist"))


@query("knn_ip_postfilter", f"SELECT vec_id FROM (SELECT e.vec_id, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_DOT} DESC, e.vec_id LIMIT 50) WHERE label < 5")
def knn_ip_postfilter(spark, sf_dir):
    db, q = vectors(spark, sf_dir, "inner_product")
    return db.query("embeddings").knn("embedding", q, k=50).where("label", "lt", 5).select("vec_id").exec().df


@query("knn_radius", f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE {_DIST} <= 1.7")
def knn_radius(spark, sf_dir):
    db, q = vectors(spark, sf_dir)
    return db.query("embeddings").knn("embedding", q, radius=1.7).select("vec_id").exec().df


@query("knn_cosine", f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_DOT} / sqrt({_DOT.replace('q.', 'e.')}) DESC, e.vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    db, q = vectors(spark, sf_dir, "cosine")
    return db.query("embeddings").knn("embedding", q, k=10).select("vec_id").exec().df


# full text


@query("text_search")
def text_search(spark, sf_dir):
    return database(spark, sf_dir).query("documents").match("text", "thing~ +ea* \"of the\"").select("doc_id").with_rank().limit(50).exec().df


@query("text_bm25", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}]+(?:[-+/''][\p{L}\p{N}]+)*)', 1) AS w FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS a FROM w),
h AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS l, CAST(len(list_filter(w, lambda x: x = 'thing')) AS DOUBLE) AS tf FROM w WHERE list_contains(w, 'thing'))
SELECT h.doc_id, round(greatest(0.2, ln((n - (SELECT count(*) FROM h) + 1) / (SELECT count(*) FROM h)) / ln(n + 1)) * tf * 3.0 / (tf + 2.0 * (0.25 + 0.75 * l / a)), 6) AS bm25
FROM h, s""")
def text_bm25(spark, sf_dir):
    c = fulltext.Config()
    rows = database(spark, sf_dir).get("documents").df.select("doc_id", fulltext.tokens(F.col("text")).alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("double").alias("l"), F.size(F.filter("w", lambda x: x == "thing")).cast("double").alias("tf"))
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("l").alias("a"), F.sum((F.col("tf") > 0).cast("int")).cast("double").alias("m"))
    out = rows.where("tf > 0").crossJoin(F.broadcast(stats))  # one row of totals
    return out.select("doc_id", F.round(fulltext.bm25(F.col("tf"), F.col("l"), F.col("a"), F.col("n"), F.col("m"), c), 6).alias("bm25"))


# the rank of one exact word, as SQL over (doc_id, word list w)
_TOKENS = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+(?:[-+/''][\p{{L}}\p{{N}}]+)*)', 1)"
_POSITION = "CASE WHEN p <= 10 THEN 1 - p / 100.0 WHEN p <= 100 THEN 0.9 - p / 1000.0 WHEN p <= 1000 THEN 0.8 - p / 10000.0 WHEN p <= 10000 THEN 0.7 - p / 100000.0 WHEN p <= 100000 THEN 0.6 - p / 1000000.0 ELSE 0.5 END"
_IDF = "greatest(0.2, ln((n - m + 1) / m) / ln(n + 1))"
_RANK = f"(0.9 + 0.1 * {_IDF} * tf * 3.0 / (tf + 2.0 * (0.25 + 0.75 * l / a))) * (0.9 + 0.1 * ({_POSITION}))"


def words_sql(words: str) -> str:
    """``hits(doc_id, word, proc, l, tf, p, r, spots)``: the rank r of each (word, proc) of ``words`` in each document."""
    return f"""
w AS (SELECT doc_id, coalesce({_TOKENS.format("text")}, []) AS w FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS a FROM w),
met AS ({words}),
found AS (
  SELECT doc_id, word, proc, CAST(len(w) AS DOUBLE) AS l, list_filter(range(0, len(w)), lambda i: w[i + 1] = word) AS spots FROM w, met WHERE list_contains(w, word)),
freq AS (SELECT word, CAST(count(*) AS DOUBLE) AS m FROM found GROUP BY word),
hits AS (SELECT doc_id, word, proc, l, spots, {_RANK} * proc AS r FROM (SELECT f.*, CAST(len(spots) AS DOUBLE) AS tf, CAST(spots[1] AS DOUBLE) AS p, m, n, a FROM found f JOIN freq USING (word), s))"""


_ONE_WORD = words_sql("SELECT 'thing' AS word, 100.0 AS proc")
_FT = "floor(r * CASE WHEN top > 255 THEN 255 / top ELSE 1 END)"
_THING = f"{_ONE_WORD}, raw AS (SELECT doc_id, r * CASE WHEN l = 1 THEN 1.1 ELSE 1 END AS r FROM hits), ft AS (SELECT doc_id, {_FT} AS ft FROM raw, (SELECT max(r) AS top FROM raw) WHERE r >= 5)"


def ranked(name: str, asked: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark, sf_dir):
        return database(spark, sf_dir).query("documents").match("text", asked).select("doc_id").with_rank().exec().df.withColumnRenamed("rank()", "ft")


ranked("text_rank", "=thing", f"WITH {_THING} SELECT doc_id, ft FROM ft")
ranked("text_two_terms", "=thing =water^1.5", f"""
WITH {words_sql("SELECT 'thing' AS word, 100.0 AS proc UNION ALL SELECT 'water', 150.0")},
a AS (SELECT * FROM hits WHERE word = 'thing'), b AS (SELECT * FROM hits WHERE word = 'water'),
pairs AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.l, b.l) AS l, a.r AS ra, b.r AS rb,
         list_min(list_transform(a.spots, lambda x: list_min(list_transform(b.spots, lambda y: abs(x - y))))) AS gap FROM a FULL JOIN b ON a.doc_id = b.doc_id),
raw AS (SELECT doc_id, (coalesce(ra, 0) + coalesce(rb, 0) * CASE WHEN ra IS NULL OR rb IS NULL THEN 1 ELSE 0.5 + 0.5 / greatest(gap, 1) END) * CASE WHEN l = 2 AND ra IS NOT NULL AND rb IS NOT NULL THEN 1.1 ELSE 1 END AS r FROM pairs)
SELECT doc_id, {_FT} AS ft FROM raw, (SELECT max(r) AS top FROM raw) WHERE r >= 5""")
_CUTS = "unnest(list_append(list_transform(range(0, len({0})), lambda i: {{'d': substr({0}, 1, i) || substr({0}, i + 2), 'i': i}}), {{'d': {0}, 'i': -1}}), recursive := true)"
ranked("text_typos", "=thing~", f"""
WITH v AS (SELECT DISTINCT unnest({_TOKENS.format("text")}) AS word FROM documents),
c AS (SELECT word, {_CUTS.format("word")} FROM v WHERE len(word) BETWEEN 4 AND 6),
q AS (SELECT word AS own, {_CUTS.format("word")} FROM (SELECT 'thing' AS word)),
typo AS (
  SELECT c.word, CASE WHEN c.i >= 0 OR q.i >= 0 THEN 1 ELSE 0 END AS k FROM c JOIN q ON c.d = q.d
  WHERE c.i < 0 OR q.i < 0 OR c.i = q.i OR (abs(c.i - q.i) = 1 AND substr(own, q.i + 1, 1) = substr(word, c.i + 1, 1))),
procs AS (SELECT word, max(CASE WHEN word = 'thing' THEN 100.0 ELSE greatest(85.0 - k * 15.0 / greatest((strlen(word) - k) / 3.0, 1.0), 1.0) END) AS proc FROM typo GROUP BY word),
{words_sql("SELECT word, proc FROM procs")},
best AS (SELECT doc_id, max(r) AS r, any_value(l) AS l FROM hits GROUP BY doc_id),
raw AS (SELECT doc_id, r * CASE WHEN l = 1 THEN 1.1 ELSE 1 END AS r FROM best)
SELECT doc_id, {_FT} AS ft FROM raw, (SELECT max(r) AS top FROM raw) WHERE r >= 5""")

_WORD = r"[\p{L}\p{N}]+(?:[-+/''][\p{L}\p{N}]+)*"


@query("text_highlight", rf"""
WITH split AS (SELECT doc_id, text, regexp_split_to_array(text, '{_WORD}') AS gaps, regexp_extract_all(text, '{_WORD}') AS words FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, text, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap, unnest(range(1, len(words) + 1)) AS i FROM split),
ends AS (SELECT doc_id, text, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM each),
areas AS (SELECT doc_id, text, e - 5 AS s, e, greatest(0, e - 15) AS lo, least(length(text), e + 10) AS hi FROM ends WHERE lower(word) = 'thing'),
marked AS (SELECT *, CASE WHEN lo <= lag(hi) OVER by_doc THEN 0 ELSE 1 END AS fresh FROM areas WINDOW by_doc AS (PARTITION BY doc_id ORDER BY s)),
pieces AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS piece FROM marked),
bits AS (
  SELECT doc_id, piece, s, substr(text, lag(e, 1, lo) OVER p + 1, s - lag(e, 1, lo) OVER p) || '<b>' || substr(text, s + 1, e - s) || '</b>'
         || CASE WHEN lead(s) OVER p IS NULL THEN substr(text, e + 1, hi - e) || ' ' ELSE '' END AS bit FROM pieces WINDOW p AS (PARTITION BY doc_id, piece ORDER BY s))
SELECT doc_id, string_agg(bit, '' ORDER BY s) AS text FROM bits GROUP BY doc_id""")
def text_highlight(spark, sf_dir):
    return database(spark, sf_dir).query("documents").match("text", "=thing").functions("text.snippet(<b>,</b>,10,10)").select("doc_id", "text").exec().df


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) / sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))))"
_HYBRID = f"""WITH {_THING},
near AS (
  SELECT doc_id, {_COS} / sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))) AS c
  FROM documents, (SELECT count(*) AS k FROM embeddings) JOIN embeddings e ON e.vec_id = doc_id % k, (SELECT embedding FROM embeddings WHERE vec_id = 7) q
  ORDER BY 2 DESC, 1 LIMIT 30)"""


def hybrid(spark, sf_dir):
    db = database(spark, sf_dir)
    n = db.get("embeddings").df.count()
    both = db.get("documents").df.withColumn("vec_id", F.col("doc_id") % n).join(db.get("embeddings").df, "vec_id")
    db.open("both", both, [Index("doc_id", pk=True), Index("text", "text", config={"fields": ["text"]}), Index("embedding", "vec_bf", metric="cosine")])
    return db, [float(v) for v in db.get("embeddings").df.where("vec_id = 7").head().embedding]


@query("hybrid_rrf", f"""{_HYBRID},
a AS (SELECT doc_id, rank() OVER (ORDER BY ft DESC) AS p FROM ft), b AS (SELECT doc_id, rank() OVER (ORDER BY c DESC) AS p FROM near)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0 / (60 + a.p), 0) + coalesce(1.0 / (60 + b.p), 0), 9) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id ORDER BY 2 DESC, 1 DESC LIMIT 25""")
def hybrid_rrf(spark, sf_dir):
    db, q = hybrid(spark, sf_dir)
    found = db.query("both").match("text", "=thing").or_().knn("embedding", q, k=30).sort("RRF(rank_const=60)", True).select("doc_id").with_rank().limit(25).exec().df
    return found.select("doc_id", F.round("rank()", 9).alias("rrf"))


@query("hybrid_linear", f"""{_HYBRID}
SELECT coalesce(ft.doc_id, near.doc_id) AS doc_id FROM ft FULL JOIN near ON ft.doc_id = near.doc_id
ORDER BY 2 * coalesce(ft, 1) + 50 * coalesce(c, 0) + 1 DESC, 1 DESC LIMIT 25""")
def hybrid_linear(spark, sf_dir):
    db, q = hybrid(spark, sf_dir)
    return db.query("both").match("text", "=thing").or_().knn("embedding", q, k=30).sort("2 * rank(text, 1) + 50 * rank(embedding, 0) + 1", True).select("doc_id").limit(25).exec().df


@query("hybrid_and", f"{_HYBRID} SELECT doc_id FROM ft JOIN near USING (doc_id)")
def hybrid_and(spark, sf_dir):
    db, q = hybrid(spark, sf_dir)
    return db.query("both").match("text", "=thing").knn("embedding", q, k=30).select("doc_id").exec().df


# writes


@query("update_set", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_totalprice * 2.0 + 1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_set(spark, sf_dir):
    db = database(spark, sf_dir)
    db.sql("UPDATE orders SET o_totalprice = o_totalprice * 2 + 1, o_orderstatus = 'X' WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
    return db.get("orders").df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("update_arrays", _ARRAYS + "SELECT l_orderkey, CAST(list_sum(CASE WHEN l_orderkey < 50 THEN list_concat(list_filter(qty, lambda x: x <> 10), [7]) ELSE qty END) AS BIGINT) AS total FROM arrays")
def update_arrays(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    db.sql("UPDATE arrays SET qty = array_remove(qty, [10]) || [7] WHERE l_orderkey < 50")
    return db.get("arrays").df.select("l_orderkey", F.aggregate("qty", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("delete_limited", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100)")
def delete_limited(spark, sf_dir):
    db = database(spark, sf_dir)
    db.sql("DELETE FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC LIMIT 100")
    return db.get("orders").df.select("o_orderkey")


@query("upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT -c_custkey, 1.0 FROM customer WHERE c_custkey % 10 = 0 AND c_custkey <> 0")
def upsert(spark, sf_dir):
    db = database(spark, sf_dir)
    some = db.get("customer").df.where("c_custkey % 10 = 0")
    tx = modify.Transaction(db, "customer")
    tx.put(some.withColumn("c_acctbal", F.lit(0.0))).put(some.withColumn("c_custkey", -F.col("c_custkey")).withColumn("c_acctbal", F.lit(1.0)), "insert")
    tx.put(some.withColumn("c_custkey", F.col("c_custkey") + 10**9), "update").put(some.withColumn("c_acctbal", F.lit(5.0)), "insert")
    tx.commit()
    return db.get("customer").df.select("c_custkey", "c_acctbal")


@query("ttl", "SELECT event_id FROM events WHERE NOT (epoch(ts)::BIGINT < (SELECT max(epoch(ts)::BIGINT) FROM events) - 86400 * 10)")
def ttl(spark, sf_dir):
    db = database(spark, sf_dir)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 10**6
    df = db.get("events").df.withColumn("at", F.rint(seconds).cast("long"))  # the nearest second, as SQL's cast
    db.open("events", df, [Index("event_id", pk=True), Index("at", "ttl", expire_after=86400 * 10)])
    db.expire("events", df.agg(F.max("at")).head()[0])
    return db.get("events").df.select("event_id")


@query("change_log", "SELECT CAST(3 AS BIGINT) AS lsn, 'delete' AS op, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 2, 'update', count(*) FROM orders WHERE o_orderkey < 10")
def change_log(spark, sf_dir):
    db = database(spark, sf_dir)
    db.log = ChangeLog(spark, fresh_path(spark, "log"))
    db.sql("UPDATE orders SET o_totalprice = 1 WHERE o_orderkey < 5")
    db.sql("UPDATE orders SET o_totalprice = 2 WHERE o_orderkey < 10")
    db.sql("DELETE FROM orders WHERE o_orderstatus = 'P'")
    return db.log.since("orders", 1).groupBy("lsn", "op").agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def json_props(spark, sf_dir):
    db = database(spark, sf_dir)
    df = db.get("events").df.withColumn("props", F.from_json("props", "k bigint"))
    db.open("events", df, [Index("event_id", pk=True)])
    return db.sql("SELECT event_id FROM events WHERE props.k > 90").df


@query("open_props", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42")
def open_props(spark, sf_dir):
    db = database(spark, sf_dir)
    db.open("events", db.get("events").df.withColumn("props", F.parse_json("props")), [Index("event_id", pk=True)])
    return db.sql("SELECT event_id FROM events WHERE props.k = 42").df


@query("dsl", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'O' OR o_custkey < 20) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def dsl(spark, sf_dir):
    return database(spark, sf_dir).dsl({"namespace": "orders", "select_filter": ["o_orderkey"], "limit": 10, "sort": {"field": "o_totalprice", "desc": True}, "filters": [{"field": "o_totalprice", "cond": "gt", "value": 100000}, {"filters": [{"field": "o_orderstatus", "cond": "eq", "value": "O"}, {"op": "or", "field": "o_custkey", "cond": "lt", "value": 20}]}]}).df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment, with a join as a condition inside OR."""
    db = database(spark, sf_dir)
    orders = db.query("orders").where("o_totalprice", "gt", 300000).limit(0)
    q = db.query("customer").open_bracket().where("c_acctbal", "lt", 0).or_().inner_join(orders, "c_custkey", "eq", "o_custkey").close_bracket()
    q.q.aggregates.append(Aggregate("facet", ["c_mktsegment"], [Sort("count", True)]))
    return q.exec().aggregations[0]


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = "SELECT c_mktsegment, count(*) AS count FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1"
