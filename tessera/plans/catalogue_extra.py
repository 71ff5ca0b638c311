"""More queries of the catalogue: sources, writes, vectors and full text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..catalog import Database, Index
from ..operators import aggregates, modify, vector
from ..sources import files
from ..spec import Aggregate
from ..storage import fresh_path
from .catalogue import _DIST, KEYS, array_orders, arrays, database, query, sql, vectors


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return fresh_path(spark, "out")


# sources and sinks


@query("json_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3")
def json_round_trip(spark, sf_dir):
    rows, to = database(spark, sf_dir).sql("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3").df, scratch(spark)
    files.write_json(rows, to)
    return files.read_json(spark, to, rows.schema)


@query("csv_out_nested", "SELECT n_nationkey, CAST(count(s_suppkey) AS INTEGER) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def csv_out_nested(spark, sf_dir):
    to = scratch(spark)
    files.write_csv(database(spark, sf_dir).sql("SELECT n_nationkey FROM nation LEFT JOIN (SELECT s_suppkey FROM supplier) ON (n_nationkey = supplier.s_nationkey)").df, to)
    back = spark.read.schema("n_nationkey int, joined_supplier string").option("header", True).option("escape", "\\").csv(to)
    return back.select("n_nationkey", F.size(F.from_json("joined_supplier", "array<struct<s_suppkey:bigint>>")).alias("n"))


@query("dump_restore", "SELECT * FROM nation WHERE n_regionkey = 4")
def dump_restore(spark, sf_dir):
    to, other = scratch(spark), Database(spark)
    files.dump(database(spark, sf_dir), to, ["nation"])
    files.restore(other, to, ["nation"])
    return other.sql("SELECT * FROM nation WHERE n_regionkey = 4").df


@query("sharded_pruning", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def sharded_pruning(spark, sf_dir):
    to, db = scratch(spark), database(spark, sf_dir)
    files.write_sharded(db.get("customer").df, "c_mktsegment", to)
    db.open("customer", spark.read.parquet(to), [Index("c_custkey", pk=True)])
    return db.sql("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0").df


@query("clustered_ranges", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def clustered_ranges(spark, sf_dir):
    to, db = scratch(spark), database(spark, sf_dir)
    files.write_clustered(db.get("orders").df, ["o_totalprice"], to)
    db.open("orders", spark.read.parquet(to), [Index("o_orderkey", pk=True), Index("o_totalprice", "tree")])
    return db.sql("SELECT o_orderkey FROM orders WHERE o_totalprice RANGE (100000, 120000)").df


@query("system_namespaces", "SELECT unnest([" + ", ".join(f"'{n}'" for n in [*KEYS, "lineitem", "embeddings"]) + "]) AS name")
def system_namespaces(spark, sf_dir):
    return database(spark, sf_dir).query("#namespaces").select("name").exec().df


@query("explain_pushes_filters", "SELECT true AS pushed, true AS pruned")
def explain_pushes_filters(spark, sf_dir):
    plan = database(spark, sf_dir).sql("SELECT o_orderkey FROM orders WHERE o_custkey = 7").explain()["plan"]
    return spark.createDataFrame([("EqualTo(o_custkey,7)" in plan, "o_totalprice" not in plan)], "pushed boolean, pruned boolean")


# writes


@query("delete_items", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1")
def delete_items(spark, sf_dir):
    db = database(spark, sf_dir)
    modify.apply(db, "nation", db.get("nation").df.where("n_regionkey = 1"), "delete")
    return db.get("nation").df.select("n_nationkey")


@query("truncate", "SELECT CAST(0 AS BIGINT) AS n")
def truncate(spark, sf_dir):
    db = database(spark, sf_dir)
    db.sql("TRUNCATE nation")
    return db.get("nation").df.agg(F.count("*").alias("n"))


@query("precepts_serial", "SELECT row_number() OVER () + 100 AS serial FROM customer")
def precepts_serial(spark, sf_dir):
    db = database(spark, sf_dir)
    db.get("customer").meta["_SERIAL_serial"] = "100"
    return modify.precepts(db, "customer", db.get("customer").df, {"serial": "serial()"}).select("serial")


@query("update_nested", "SELECT event_id, CASE WHEN event_id < 100 THEN 5 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def update_nested(spark, sf_dir):
    db = database(spark, sf_dir)
    db.open("events", db.get("events").df.withColumn("props", F.from_json("props", "k bigint")), [Index("event_id", pk=True)])
    db.sql("UPDATE events SET props.k = 5 WHERE event_id < 100")
    return db.get("events").df.select("event_id", "props.k")


@query("update_drop", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_drop(spark, sf_dir):
    db = database(spark, sf_dir)
    db.sql("UPDATE orders DROP o_orderpriority WHERE o_orderstatus = 'P'")
    return db.get("orders").df.select("o_orderkey", "o_orderpriority")


@query("update_join", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_join(spark, sf_dir):
    db = database(spark, sf_dir)
    db.sql("UPDATE customer SET c_acctbal = 0 WHERE INNER JOIN (SELECT * FROM orders WHERE o_totalprice > 300000 LIMIT 0) ON (c_custkey = orders.o_custkey)")
    return db.get("customer").df.select("c_custkey", "c_acctbal")


# arrays and aggregation

arrays("equal_position_group", "SELECT l_orderkey FROM arrays WHERE items[#].q > 45 AND items[#].f = 'R' EQUAL_POSITION(items[#].q, items[#].f)", "SELECT l_orderkey FROM arrays WHERE len(list_filter(list_zip(flags, qty), lambda x: x[1] = 'R' AND x[2] > 45)) > 0")


@query("distinct_multi", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_multi(spark, sf_dir):
    db = database(spark, sf_dir)
    return aggregates.distinct(db.get("orders").df, Aggregate("distinct", ["o_orderstatus", "o_orderpriority"]), db.get("orders"))


@query("array_remove_once", "WITH a AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(coalesce(list_sum(qty), 0) - CASE WHEN list_contains(qty, 10) THEN 10 ELSE 0 END AS BIGINT) AS total FROM a")
def array_remove_once(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    db.sql("UPDATE arrays SET qty = array_remove_once(qty, [10])")
    return db.get("arrays").df.select("l_orderkey", F.aggregate("qty", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


sql("sort_unary_nested", "SELECT c_custkey FROM customer ORDER BY -(c_acctbal + 2 * (c_nationkey - 1)) / 4 LIMIT 25", "SELECT c_custkey FROM customer ORDER BY -(c_acctbal + 2.0 * (c_nationkey - 1.0)) / 4.0, c_custkey LIMIT 25")

# vectors


@query("knn_streaming", f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label < 3 ORDER BY {_DIST}, e.vec_id LIMIT 10 OFFSET 2")
def knn_streaming(spark, sf_dir):
    db, q = vectors(spark, sf_dir)
    db.get("embeddings").indexes["embedding"].kind = "hnsw"
    return db.query("embeddings").knn("embedding", q).where("label", "lt", 3).select("vec_id").limit(10).offset(2).exec().df


@query("knn_ivf_all_cells", f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_DIST}, e.vec_id LIMIT 12")
def knn_ivf_all_cells(spark, sf_dir):
    db, q = vectors(spark, sf_dir)
    rows, centers = vector.train_cells(db.get("embeddings").df, "embedding", 4)
    db.open("embeddings", rows, [Index("vec_id", pk=True), Index("embedding", "ivf", config={"cells": centers, "column": "_cell"})])
    return db.query("embeddings").knn("embedding", q, k=12, nprobe=len(centers)).select("vec_id").exec().df


_BACK = _DIST.replace("e.embedding[i]", "e.embedding[65 - i]")


@query("knn_array_of_vectors", f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY least({_DIST}, {_BACK}), e.vec_id LIMIT 15")
def knn_array_of_vectors(spark, sf_dir):
    db, q = vectors(spark, sf_dir)
    rows = db.get("embeddings").df.withColumn("both", F.array("embedding", F.reverse("embedding")))
    db.open("many", rows, [Index("vec_id", pk=True), Index("both", "vec_bf")])
    return db.query("many").knn("both", q, k=15).select("vec_id").exec().df


@query("merge_ranked", f"WITH d AS (SELECT e.vec_id, e.label, {_DIST} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q), a AS (SELECT 'embeddings' AS _ns, vec_id, d FROM d ORDER BY d, vec_id LIMIT 6), b AS (SELECT 'odd' AS _ns, vec_id, d FROM d WHERE label % 2 = 1 ORDER BY d, vec_id LIMIT 6) SELECT _ns, vec_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def merge_ranked(spark, sf_dir):
    db, q = vectors(spark, sf_dir)
    db.open("odd", db.get("embeddings").df.where("label % 2 = 1"), [Index("vec_id", pk=True), Index("embedding", "vec_bf")])
    return db.query("embeddings").knn("embedding", q, k=6).merge(db.query("odd").knn("embedding", q, k=6)).exec().df.select("_ns", "vec_id")


# full text: which documents match

_WORDS = r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}]+(?:[-+/''][\p{L}\p{N}]+)*)', 1) AS w FROM documents) SELECT doc_id FROM w WHERE "


def text(name: str, asked: str, oracle: str) -> None:
    @query(name, _WORDS + oracle)
    def run(spark, sf_dir):
        return database(spark, sf_dir).query("documents").match("text", asked).select("doc_id").exec().df


text("text_exact", "=thing", "list_contains(w, 'thing')")
text("text_prefix", "=thin*", "len(list_filter(w, lambda x: starts_with(x, 'thin'))) > 0")
text("text_must_not", "+=thing -=water", "list_contains(w, 'thing') AND NOT list_contains(w, 'water')")
text("text_phrase", '"of the"', "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
