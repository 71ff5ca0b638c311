"""Queries of the catalogue on what the others leave out: rules, writes that repeat, variants of words, logs, formats."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Database, Index
from ..operators import aggregates, fulltext, modify
from ..operators.predicates import resolve
from ..sources import files, wire
from ..spec import Aggregate, QueryError
from ..storage import fresh_path
from ..streaming.changes import ChangeLog, follow
from .catalogue import _ARRAYS, _COS, _DIST, _TOKENS, array_orders, arrays, database, hybrid, points, query, sparse, sparse_orders, sql, vectors, words_sql

# what the model doesn't allow

REJECTED = (
    "SELECT o_orderkey, SUM(o_totalprice) FROM orders",
    "SELECT * FROM orders WHERE OR o_custkey = 1",
    "SELECT * FROM orders WHERE o_custkey = 1 OR <> 2",
    "SELECT * FROM orders WHERE nowhere = 1",
    "SELECT * FROM orders INNER JOIN (SELECT * FROM customer INNER JOIN nation ON (c_nationkey = nation.n_nationkey)) ON (o_custkey = customer.c_custkey)",
    "SELECT * FROM orders INNER JOIN (SELECT SUM(c_acctbal) FROM customer) ON (o_custkey = customer.c_custkey)",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey, c_name FROM customer)",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer INNER JOIN nation ON (c_nationkey = nation.n_nationkey))",
    "SELECT * FROM orders ORDER BY o_custkey MERGE (SELECT * FROM customer)",
    "SELECT * FROM orders MERGE (SELECT * FROM customer LIMIT 3)",
    "SELECT SUM(o_totalprice) FROM orders LIMIT 3 MERGE (SELECT * FROM customer)",
    "SELECT DISTINCT(o_custkey), DISTINCT(o_orderstatus), SUM(o_totalprice) FROM orders",
    "SELECT *, RANK() FROM orders",
    "SELECT * FROM orders WHERE o_orderstatus IS NULL AND o_custkey = 1 EQUAL_POSITION(o_orderstatus, o_custkey)",
    'SELECT SUM("l_orderkey+l_linenumber") FROM lineitem',
    "SELECT SUM(embedding) FROM embeddings",
    "SELECT * FROM orders ORDER BY o_custkey, FIELD(o_orderstatus, 'P')",
    "SELECT * FROM embeddings WHERE KNN(embedding, [1.0], k=2, ef=10, nprobe=2)",
    "UPDATE orders DROP o_orderkey WHERE o_custkey = 1",
    "SELECT * FROM orders WHERE #lsn > 3",
)


def _values(texts) -> str:
    return ", ".join("('" + t.replace("'", "''") + "')" for t in texts)


@query("rejected_statements", f"SELECT statement FROM (VALUES {_values(REJECTED)}) v(statement)")
def rejected_statements(spark, sf_dir):
    db, out = database(spark, sf_dir), []
    for text in REJECTED:
        try:
            db.sql(text)
        except QueryError:
            out.append((text,))
    return spark.createDataFrame(out, "statement string")


# projection, functions and options

sql("all_vectors", "SELECT vec_id, vectors() FROM embeddings WHERE label = 3", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE label = 3", fields="vec_id;size(embedding) as dims")
sql("vectors_hidden", "SELECT * FROM embeddings WHERE label = 3", "SELECT vec_id, label FROM embeddings WHERE label = 3")
sql("vector_present", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND NOT embedding IS NULL", "SELECT vec_id FROM embeddings WHERE len(embedding) > 0")
sql("now_condition", "SELECT event_id FROM events WHERE event_id < now(sec)", "SELECT event_id FROM events WHERE event_id < epoch(now())")
sql("hash_order", "SELECT c_custkey FROM customer ORDER BY hash(7)", "SELECT c_custkey FROM customer")
sql("avg_of_nothing", "SELECT o_orderkey FROM orders WHERE o_totalprice < (SELECT AVG(c_acctbal) FROM customer WHERE c_custkey < 0)", "SELECT o_orderkey FROM orders WHERE o_totalprice < (SELECT avg(c_acctbal) FROM customer WHERE c_custkey < 0)")
sql("joins_to_one_namespace", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON (c_custkey = orders.o_custkey) LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON (c_custkey = orders.o_custkey)", "SELECT c_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS INTEGER) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", fields="c_custkey;size(joined_orders) as f;size(joined_orders_2) as o")
sql("join_on_two", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE INNER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' LIMIT 0) ON (l_orderkey = orders.o_orderkey AND l_shipdate > orders.o_orderdate)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND l_orderkey = o_orderkey AND l_shipdate > o_orderdate)")
sql("theta_anti_join", "SELECT p_partkey FROM part WHERE NOT INNER JOIN (SELECT * FROM supplier) ON (p_retailprice < supplier.s_acctbal)", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE p_retailprice < s_acctbal)")
arrays("function_subquery", "SELECT l_orderkey FROM arrays WHERE flat_array_len(parts) = (SELECT MAX(n_regionkey) FROM nation)", "SELECT l_orderkey FROM arrays WHERE len(parts) = (SELECT max(n_regionkey) FROM nation)")
arrays("function_subquery_set", "SELECT l_orderkey FROM arrays WHERE flat_array_len(parts) IN (SELECT n_regionkey FROM nation)", "SELECT l_orderkey FROM arrays WHERE len(parts) IN (SELECT n_regionkey FROM nation)")
arrays("field_to_array", 'SELECT l_orderkey FROM arrays WHERE parts = "qty"', "SELECT l_orderkey FROM arrays WHERE list_has_any(parts, qty)")
arrays("array_elements_path", "SELECT l_orderkey FROM arrays WHERE items[*].q > 49", "SELECT l_orderkey FROM arrays WHERE len(list_filter(qty, lambda x: x > 49)) > 0")
sparse("facet_missing", "SELECT o_orderkey FROM sparse WHERE prio IS NULL OR prio = '2-HIGH'", "SELECT o_orderkey FROM sparse WHERE prio IS NULL OR prio = '2-HIGH'")


@query("facet_missing_multi", "SELECT o_orderstatus, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, '') AS prio, count(*) AS count FROM orders GROUP BY 1, 2")
def facet_missing_multi(spark, sf_dir):
    return sparse_orders(spark, sf_dir).sql("SELECT FACET(o_orderstatus, prio) FROM sparse").aggregations[0]


@query("distinct_array_sql", _ARRAYS + "SELECT DISTINCT unnest(parts) AS parts FROM arrays WHERE list_contains(flags, 'A')")
def distinct_array_sql(spark, sf_dir):
    return array_orders(spark, sf_dir).sql("SELECT DISTINCT(parts) FROM arrays WHERE flags = 'A'").aggregations[0].distinct()


@query("array_aggregates", _ARRAYS + ", q AS (SELECT unnest(qty) AS q FROM arrays) SELECT CAST(sum(q) AS DOUBLE) AS value0, avg(q) AS value1, CAST(min(q) AS DOUBLE) AS value2, CAST(max(q) AS DOUBLE) AS value3 FROM q")
def array_aggregates(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    return aggregates.fused(db.get("arrays").df, [Aggregate(k, ["qty"]) for k in ("sum", "avg", "min", "max")], db.get("arrays"))


@query("fetch_batches", "SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches, count(*) AS n FROM customer")
def fetch_batches(spark, sf_dir):
    sizes = [len(b) for b in database(spark, sf_dir).query("customer").select("c_custkey").fetch_count(100).local().debug(1).exec().batches()]
    return spark.createDataFrame([(len(sizes), sum(sizes))], "batches long, n long")


@query("strict_modes", "SELECT 'indexes' AS mode, true AS error, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'names', true, 0 UNION ALL SELECT 'none', false, (SELECT count(*) FROM customer)")
def strict_modes(spark, sf_dir):
    out = []
    for mode, name in (("indexes", "c_address.zip"), ("names", "c_address"), ("none", "c_address")):
        try:
            out.append((mode, False, database(spark, sf_dir).query("customer").where(name, "empty").strict(mode).exec().df.count()))
        except QueryError:
            out.append((mode, True, 0))
    return spark.createDataFrame(out, "mode string, error boolean, n long")


@query("explain_matched", "SELECT 'o_custkey' AS field, count(*) FILTER (o_custkey < 20) AS matched FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus = 'F') FROM orders")
def explain_matched(spark, sf_dir):
    told = database(spark, sf_dir).sql("SELECT * FROM orders WHERE o_custkey < 20 AND o_orderstatus = 'F'").explain(matched=True)["selectors"]
    return spark.createDataFrame([(s["field"], s["matched"]) for s in told], "field string, matched long")


@query("meta_values", "SELECT 'a' AS key, '2' AS value UNION ALL SELECT 'c', '3'")
def meta_values(spark, sf_dir):
    db = database(spark, sf_dir)
    for k, v in (("a", "1"), ("b", "x"), ("c", "3"), ("a", "2")):
        db.put_meta("nation", k, v)
    db.delete_meta("nation", "b")
    return spark.createDataFrame([(k, db.get_meta("nation", k)) for k in db.enum_meta("nation")], "key string, value string")


@query("rename_drop", "SELECT unnest(['countries', 'customer', 'documents', 'embeddings', 'events', 'lineitem', 'orders', 'part', 'region']) AS name")
def rename_drop(spark, sf_dir):
    db = database(spark, sf_dir)
    db.rename("nation", "countries")
    db.drop("supplier")
    return db.sql("SELECT name FROM #namespaces").df


@query("system_tables", "SELECT unnest(['#activitystats', '#clientsstats', '#clusterconfig', '#config', '#memstats', '#namespaces', '#perfstats', '#queriesperfstats', '#replicationstats']) AS name, true AS read")
def system_tables(spark, sf_dir):
    db = database(spark, sf_dir)
    db.sql("SELECT * FROM nation")
    return spark.createDataFrame([(n, db.sql(f"SELECT * FROM {n}").df.count() >= 0) for n in db.SYSTEM], "name string, read boolean")


@query("query_statistics", "SELECT 'nation' AS name, CAST(2 AS BIGINT) AS total_queries_count UNION ALL SELECT 'region', 1")
def query_statistics(spark, sf_dir):
    db = database(spark, sf_dir)
    for text in ("SELECT * FROM nation", "SELECT * FROM nation WHERE n_regionkey = 1", "SELECT * FROM region"):
        db.sql(text)
    return db.sql("SELECT name, total_queries_count FROM #perfstats").df


# geometry


@query("dwithin_subquery", "WITH p AS (SELECT c_custkey, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment FROM customer) SELECT c_custkey FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.c_mktsegment = 'BUILDING' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25)")
def dwithin_subquery(spark, sf_dir):
    db = points(spark, sf_dir)
    return db.query("places").dwithin_query("p", db.query("places").where("c_mktsegment", "eq", "BUILDING").select("p"), 0.5).select("c_custkey").exec().df


@query("dwithin_clustered", "SELECT c_custkey, true AS pushed FROM customer WHERE (c_acctbal / 100 - 40.0) * (c_acctbal / 100 - 40.0) + (c_nationkey - 12.0) * (c_nationkey - 12.0) <= 25.0")
def dwithin_clustered(spark, sf_dir):
    db, to = points(spark, sf_dir), fresh_path(spark, "places")
    files.write_spatial(db.get("places").df, "p", to)
    db.open("near", spark.read.parquet(to), [Index("c_custkey", pk=True), Index("p", "rtree", config={"x": "_px", "y": "_py"})])
    found = db.sql("SELECT c_custkey FROM near WHERE ST_DWithin(p, ST_GeomFromText('point(40 12)'), 5)")
    return found.df.withColumn("pushed", F.lit("GreaterThanOrEqual(_px,35.0)" in found.explain()["plan"]))


# writes


@query("upsert_repeated_keys", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'last' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'first'")
def upsert_repeated_keys(spark, sf_dir):
    db = database(spark, sf_dir)
    some = db.get("nation").df.where("n_nationkey < 5")
    items = some.withColumns({"n_name": F.lit("old"), "at": F.lit(1)}).unionByName(some.withColumns({"n_name": F.lit("last"), "at": F.lit(2)}))
    modify.apply(db, "nation", items, "upsert", order="at")
    twice = spark.createDataFrame([(100, "first", 1, 1), (100, "second", 1, 2), (0, "no", 1, 3)], "n_nationkey int, n_name string, n_regionkey int, at int")
    modify.apply(db, "nation", twice, "insert", order="at")
    return db.get("nation").df.select("n_nationkey", "n_name")


@query("update_serial_twice", "SELECT row_number() OVER () AS k FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM nation WHERE n_regionkey = 1) QUALIFY k > (SELECT count(*) FROM nation WHERE n_regionkey = 1)")
def update_serial_twice(spark, sf_dir):
    db = database(spark, sf_dir)
    db.sql("UPDATE nation SET k = serial() WHERE n_regionkey = 1")
    db.sql("UPDATE nation SET k = serial()")
    return db.get("nation").df.select("k")


@query("transaction_rollback", "SELECT n_nationkey, n_name, '7' AS meta, CAST(1 AS BIGINT) AS logged FROM nation WHERE n_nationkey <> 3")
def transaction_rollback(spark, sf_dir):
    db = database(spark, sf_dir)
    db.log = ChangeLog(spark, fresh_path(spark, "log"))
    db.put_meta("nation", "_SERIAL_k", "7")
    some = db.get("nation").df
    tx = modify.Transaction(db, "nation").put(some.withColumn("n_name", F.lit("x"))).query(db.query("nation").set_expression("k", "serial()").q.copy(kind="update")).put(some, "no such mode")
    try:
        tx.commit()
    except QueryError:
        tx.rollback()
    db.sql("DELETE FROM nation WHERE n_nationkey = 3")
    logged = db.log.since("nation", 0).count()
    return db.get("nation").df.select("n_nationkey", "n_name", F.lit(db.get_meta("nation", "_SERIAL_k")).alias("meta"), F.lit(logged).cast("long").alias("logged"))


@query("follow_after_rollback", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'c' WHEN n_regionkey = 1 THEN 'b' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 0")
def follow_after_rollback(spark, sf_dir):
    leader, other = database(spark, sf_dir), database(spark, sf_dir)
    leader.log = ChangeLog(spark, fresh_path(spark, "log"))
    one = leader.get("nation").df.where("n_regionkey = 1")
    modify.Transaction(leader, "nation").put(one.withColumn("n_name", F.lit("a"))).put(one.withColumn("n_name", F.lit("b"))).commit()
    try:
        modify.Transaction(leader, "nation").put(one.withColumn("n_name", F.lit("lost"))).put(one, "bad").commit()
    except QueryError:
        pass
    leader.sql("UPDATE nation SET n_name = 'c' WHERE n_regionkey = 2")
    leader.sql("DELETE FROM nation WHERE n_nationkey = 0")
    follow(leader.log, other, "nation", fresh_path(spark, "follow")).awaitTermination()
    return other.get("nation").df.select("n_nationkey", "n_name")


@query("resync_outdated", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1")
def resync_outdated(spark, sf_dir):
    leader, other = database(spark, sf_dir), database(spark, sf_dir)
    leader.log = ChangeLog(spark, fresh_path(spark, "log"))
    leader.sql("DELETE FROM nation WHERE n_regionkey = 1 AND n_nationkey > 5")
    leader.sql("DELETE FROM nation WHERE n_regionkey = 1")
    leader.log.trim("nation", 1)
    follow(leader.log, other, "nation", fresh_path(spark, "follow"), leader).awaitTermination()
    return other.get("nation").df.select("n_nationkey")


@query("log_condition", "SELECT CAST(2 AS BIGINT) AS lsn, 'delete' AS op, count(*) AS n FROM nation WHERE n_regionkey = 2")
def log_condition(spark, sf_dir):
    db = database(spark, sf_dir)
    db.log = ChangeLog(spark, fresh_path(spark, "log"))
    db.sql("UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1")
    db.sql("DELETE FROM nation WHERE n_regionkey = 2")
    return db.sql("SELECT * FROM nation WHERE #lsn > 1").df.groupBy("lsn", "op").agg(F.count("*").alias("n"))


@query("subscribe_events", "SELECT 'delete' AS op, count(*) AS n FROM nation WHERE n_regionkey = 2")
def subscribe_events(spark, sf_dir):
    db, seen = database(spark, sf_dir), []
    db.log = ChangeLog(spark, fresh_path(spark, "log"))
    db.sql("UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1")
    db.sql("DELETE FROM nation WHERE n_regionkey = 2")
    db.sql("DELETE FROM region WHERE r_regionkey = 2")
    db.log.subscribe(lambda batch, _: seen.extend(batch.groupBy("op").count().collect()), fresh_path(spark, "seen"), ["nation"], ["delete"]).awaitTermination()
    return spark.createDataFrame([(r["op"], r["count"]) for r in seen], "op string, n long")


@query("many_writes", "SELECT n_nationkey, CASE WHEN n_nationkey < 8 THEN 'w' || n_nationkey ELSE n_name END AS n_name FROM nation WHERE n_nationkey < 8 OR n_nationkey >= 12")
def many_writes(spark, sf_dir):
    db = database(spark, sf_dir)
    for k in range(8):
        db.sql(f"UPDATE nation SET n_name = 'w{k}' WHERE n_nationkey = {k}")
    for k in range(8, 12):
        db.sql(f"DELETE FROM nation WHERE n_nationkey = {k}")
    return db.get("nation").df.select("n_nationkey", "n_name")


@query("update_elements", _ARRAYS + "SELECT l_orderkey, CAST(list_sum(list_transform(qty[2:], lambda x: x)) AS BIGINT) AS rest, CASE WHEN len(qty) > 0 THEN CAST(7 AS BIGINT) END AS first FROM arrays")
def update_elements(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    db.sql("UPDATE arrays SET qty[0] = 7")
    rest = F.when(F.size("qty") > 1, F.aggregate(F.slice("qty", 2, 10**6), F.lit(0).cast("long"), lambda a, x: a + x))
    return db.get("arrays").df.select("l_orderkey", rest.alias("rest"), F.get("qty", F.lit(0)).alias("first"))


@query("update_element_drop", _ARRAYS + "SELECT l_orderkey, CAST(len(qty) - 1 AS INTEGER) AS n FROM arrays")
def update_element_drop(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    db.sql("UPDATE arrays DROP qty[0]")
    return db.get("arrays").df.select("l_orderkey", F.size("qty").alias("n"))


@query("update_object_null_empty", "SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE 5 END AS k, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE n END AS n FROM (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1)")
def update_object_null_empty(spark, sf_dir):
    db = array_orders(spark, sf_dir)
    rows = db.get("arrays").df.select("l_orderkey", "qty", F.struct(F.lit(1).cast("long").alias("k")).alias("o"), (F.col("l_orderkey") % 2).alias("odd"))
    db.open("arrays", rows, [Index("l_orderkey", pk=True)])
    db.query("arrays").set("o", {"k": 5}).update()
    db.query("arrays").where("odd", "eq", 0).set("o", None).set("qty", []).update()
    return db.get("arrays").df.select("l_orderkey", F.col("o.k").cast("int").alias("k"), F.size("qty").alias("n"))


@query("update_type_change", "SELECT c_custkey, '7' AS c_name, CAST(12 AS DOUBLE) AS c_acctbal FROM customer")
def update_type_change(spark, sf_dir):
    db = database(spark, sf_dir)
    db.query("customer").set("c_name", 7).set("c_acctbal", "12").update()
    return db.get("customer").df.select("c_custkey", "c_name", "c_acctbal")


@query("embed_on_upsert", "SELECT vec_id, CAST(CASE WHEN vec_id < 5 THEN len('label' || label) ELSE round(embedding[1], 4) END AS DOUBLE) AS x FROM embeddings")
def embed_on_upsert(spark, sf_dir):
    db = database(spark, sf_dir)
    db.get("embeddings").indexes["embedding"].config["embed"] = {"fields": ["name"], "strategy": "empty_only"}
    db.embedders["embedding"] = lambda text: [float(len(text))] * 64
    items = db.get("embeddings").df.where("vec_id < 10").withColumn("name", F.concat(F.lit("label"), "label")).withColumn("embedding", F.when(F.col("vec_id") >= 5, F.col("embedding")))
    modify.apply(db, "embeddings", items, "upsert")
    return db.get("embeddings").df.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("x"))


# merge


@query("merge_ties_limit", "SELECT 'customer' AS _ns, c_custkey AS id FROM customer UNION ALL SELECT 'part', p_partkey FROM part ORDER BY 2, 1 LIMIT 31 OFFSET 4")
def merge_ties_limit(spark, sf_dir):
    out = database(spark, sf_dir).sql("SELECT c_custkey FROM customer LIMIT 31 OFFSET 4 MERGE (SELECT p_partkey FROM part)").df
    return out.select("_ns", F.coalesce("c_custkey", "p_partkey").alias("id"))


@query("merge_aggregates", "SELECT CAST(sum(c_acctbal) AS DOUBLE) AS value FROM customer WHERE c_nationkey < 3 OR c_nationkey > 20")
def merge_aggregates(spark, sf_dir):
    return database(spark, sf_dir).sql("SELECT SUM(c_acctbal) FROM customer WHERE c_nationkey < 3 MERGE (SELECT * FROM customer WHERE c_nationkey > 20)").aggregations[0].select(F.round("value", 6).alias("value"))


_FUSED = """near AS (
  SELECT doc_id, {cos} AS c FROM documents, (SELECT count(*) AS k FROM embeddings) JOIN embeddings e ON e.vec_id = doc_id % k, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY 2 DESC, 1 LIMIT 30),
raw AS (SELECT doc_id, r * CASE WHEN l = 1 THEN 1.1 ELSE 1 END AS r FROM hits), ft AS (SELECT doc_id, floor(r * CASE WHEN top > 255 THEN 255 / top ELSE 1 END) AS ft FROM raw, (SELECT max(r) AS top FROM raw) WHERE r >= 5),
a AS (SELECT doc_id, rank() OVER (ORDER BY ft DESC) AS p FROM ft), b AS (SELECT doc_id, rank() OVER (ORDER BY c DESC) AS p FROM near),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0 / (60 + a.p), 0) + coalesce(1.0 / (60 + b.p), 0) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


@query("merge_hybrid", f"WITH {words_sql("SELECT 'thing' AS word, 100.0 AS proc")}, {_FUSED.format(cos=_COS)} SELECT ns AS _ns, doc_id FROM f, (VALUES ('both'), ('copy')) v(ns) ORDER BY rrf DESC, doc_id, ns LIMIT 21")
def merge_hybrid(spark, sf_dir):
    db, q = hybrid(spark, sf_dir)
    both = db.get("both")
    db.open("copy", both.df, [*both.indexes.values()])
    ask = lambda n: db.query(n).match("text", "=thing").or_().knn("embedding", q, k=30).select("doc_id")
    return ask("both").merge(ask("copy")).limit(21).exec().df.select("_ns", "doc_id")


# full text: variants, by the rows that they find

_HAS = f"WITH w AS (SELECT doc_id, lang, coalesce({_TOKENS.format('text')}, []) AS w FROM documents) SELECT doc_id FROM w WHERE "
PLAIN = {"stemming": False, "translit": False, "keyboard": False, "concat": False, "split": False}


def variant(name: str, asked: str, oracle: str, also: tuple | None = None, **config) -> None:
    @query(name, _HAS + oracle)
    def run(spark, sf_dir):
        db = database(spark, sf_dir)
        db.get("documents").indexes["text"].config = {"fields": ["text"], "config": fulltext.Config(**(PLAIN | config))}
        q = db.query("documents").match("text", asked)
        return (q.where(*also) if also else q).select("doc_id").exec().df


variant("text_stemming", "things", "len(list_filter(w, lambda x: starts_with(x, 'thing'))) > 0", stemming=True)
variant("text_stemming_ru_keeps", "=thing", "list_contains(w, 'thing')", stemming=True)
variant("text_keyboard", "ерштп", "list_contains(w, 'thing')", keyboard=True)
variant("text_translit", "тинг", "list_contains(w, 'ting')", translit=True)
variant("text_synonym", "zzz", "list_contains(w, 'thing')", synonyms={"zzz": ["thing"]})
variant("text_synonym_words", "zzz", "list_contains(w, 'thing') AND list_contains(w, 'water')", synonyms={"zzz": ["thing water"]})
variant("text_synonym_of_words", "qq zzz", "list_contains(w, 'thing')", synonyms={"qq zzz": ["thing"]})
variant("text_concat", "thi ng", "list_has_any(w, ['thi', 'ng', 'thing'])", concat=True)
variant("text_split", "thingwater", "list_contains(w, 'thing') AND list_contains(w, 'water') OR list_contains(w, 'thingwater')", split=True)
variant("text_delimiter", "thi-water", "list_has_any(w, ['thi-water', 'thi', 'water', 'thiwater'])")
variant("text_suffix", "*hing", "len(list_filter(w, lambda x: ends_with(x, 'hing'))) > 0", min_rank=0.0)
variant("text_infix", "*hin*", "len(list_filter(w, lambda x: contains(x, 'hin'))) > 0", min_rank=0.0)
variant("text_stop_words", "the thing about", "list_contains(w, 'thing')")
variant("text_phrase_gap", '"the thing"~3', "len(list_filter(range(0, len(w)), lambda i: w[i + 1] = 'thing' AND list_contains(w[greatest(i - 2, 1):i], 'the'))) > 0")
variant("text_not_phrase", '+thing -"of the"', "list_contains(w, 'thing') AND len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) = 0")
variant("text_preselect", "thing", "list_contains(w, 'thing') AND lang = 'en'", also=("lang", "eq", "en"), preselect=True)
variant("text_numbers", "12", "list_has_any(w, ['12', 'twelve', 'двенадцать'])", numbers=True)


@query("text_terms_boost", f"WITH {words_sql("SELECT 'thing' AS word, 50.0 AS proc")} SELECT doc_id, floor(r * CASE WHEN l = 1 THEN 1.1 ELSE 1 END) AS ft FROM hits WHERE r * CASE WHEN l = 1 THEN 1.1 ELSE 1 END >= 5")
def text_terms_boost(spark, sf_dir):
    db = database(spark, sf_dir)
    db.get("documents").indexes["text"].config = {"fields": ["text"], "config": fulltext.Config(terms_boost={"thing": 0.5})}
    return db.query("documents").match("text", "=thing").select("doc_id").with_rank().exec().df.withColumnRenamed("rank()", "ft")


_WORD = r"[\p{L}\p{N}]+(?:[-+/''][\p{L}\p{N}]+)*"


@query("text_whole_highlight", rf"""
WITH split AS (SELECT doc_id, regexp_split_to_array(text, '{_WORD}') AS gaps, regexp_extract_all(text, '{_WORD}') AS words FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(words) + 1), lambda i: gaps[i] || CASE WHEN lower(words[i]) = 'thing' THEN '<b>' || words[i] || '</b>' ELSE words[i] END), '') || gaps[len(words) + 1] AS text
FROM split WHERE list_contains(list_transform(words, lambda x: lower(x)), 'thing')""")
def text_whole_highlight(spark, sf_dir):
    return database(spark, sf_dir).query("documents").match("text", "=thing").functions("text.highlight(<b>,</b>)").select("doc_id", "text").exec().df


@query("text_debug_rank", f"WITH {words_sql("SELECT 'thing' AS word, 100.0 AS proc")} SELECT doc_id, true AS told FROM hits WHERE r >= 5")
def text_debug_rank(spark, sf_dir):
    found = database(spark, sf_dir).query("documents").match("text", "=thing").functions("text.debug_rank()").select("doc_id", "text").exec().df
    return found.select("doc_id", F.col("text").startswith("thing: ").alias("told"))


# vectors


@query("knn_sq8", f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_DIST}, e.vec_id LIMIT 10")
def knn_sq8(spark, sf_dir):
    from ..operators import vector

    db, q = vectors(spark, sf_dir)
    rows, scale = vector.quantise(db.get("embeddings").df, "embedding")
    db.open("embeddings", rows, [Index("vec_id", pk=True), Index("embedding", "vec_bf", config={"sq8": scale})])
    return db.query("embeddings").knn("embedding", q, k=10).select("vec_id").exec().df


# formats


@query("msgpack_round_trip", _ARRAYS + "SELECT l_orderkey, CAST(len(parts) AS INTEGER) AS n, list_sum(qty) AS total FROM arrays")
def msgpack_round_trip(spark, sf_dir):
    rows = array_orders(spark, sf_dir).get("arrays").df
    back = wire.from_msgpack(wire.to_msgpack(rows), rows.schema)
    return back.select("l_orderkey", F.size("parts").alias("n"), F.aggregate("items", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["q"]).cast("decimal(38,0)")).alias("total"))


@query("variant_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def variant_round_trip(spark, sf_dir):
    rows = database(spark, sf_dir).get("nation").df
    return wire.from_variant(wire.to_variant(rows), rows.schema)


@query("durable_namespaces", "SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'kept' ELSE n_name END AS n_name, 'v' AS meta FROM nation WHERE n_nationkey <> 1")
def durable_namespaces(spark, sf_dir):
    db, folder = database(spark, sf_dir), fresh_path(spark, "database")
    db.attach(folder)
    db.put_meta("nation", "k", "v")
    db.sql("UPDATE nation SET n_name = 'kept' WHERE n_nationkey = 2")
    db.sql("DELETE FROM nation WHERE n_nationkey = 1")
    again = Database.load(spark, folder, ["nation"])
    return again.sql("SELECT n_nationkey, n_name FROM nation").df.withColumn("meta", F.lit(again.get_meta("nation", "k")))


@query("join_handlers", "SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_handlers(spark, sf_dir):
    def named(item, joined):
        item["region"] = joined[0]["r_name"]
        return False

    rows = database(spark, sf_dir).sql("SELECT n_nationkey FROM nation INNER JOIN region ON (n_regionkey = region.r_regionkey)").objects({"region": named})
    return spark.createDataFrame([(r["n_nationkey"], r["region"]) for r in rows], "n_nationkey int, region string")


@query("text_segmented", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def text_segmented(spark, sf_dir):
    db = database(spark, sf_dir)
    config = fulltext.Config(splitter="mmseg_cn", dictionary={"研究": 10, "研究生": 5, "生命": 8, "起源": 6, "命": 3})
    rows = db.get("documents").df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "研究生命起源").otherwise("研究生").alias("text"))
    db.open("cn", rows, [Index("doc_id", pk=True), Index("text", "text", config={"fields": ["text"], "config": config})])
    return db.query("cn").match("text", "=生命").select("doc_id").exec().df


@query("text_diacritics", "SELECT doc_id FROM documents WHERE text ILIKE '%ß%' AND NOT text ILIKE 'zz%'")
def text_diacritics(spark, sf_dir):
    db = database(spark, sf_dir)
    rows = db.get("documents").df.select("doc_id", F.when(F.lower("text").contains("ß"), F.lit("ein Café")).otherwise("ein cafe-x").alias("text"))
    db.open("marked", rows, [Index("doc_id", pk=True), Index("text", "text", config={"fields": ["text"], "config": fulltext.Config(diacritics=False)})])
    return db.query("marked").match("text", "=cafe").select("doc_id").exec().df


@query("proto_schema", "SELECT unnest(['syntax = \"proto3\";', 'message Item {', '  optional int64 n_nationkey = 1;', '  optional string n_name = 2;', '  optional int64 n_regionkey = 3;', '}']) AS line")
def proto_schema(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in wire.proto_schema(database(spark, sf_dir).get("nation").df.schema).splitlines()], "line string")


@query("table_view", "SELECT 'r_regionkey | r_name' AS line UNION ALL SELECT rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || r_name FROM region")
def table_view(spark, sf_dir):
    text = files.table_view(database(spark, sf_dir).get("region").df)
    return spark.createDataFrame([(x,) for x in text.splitlines() if not x.startswith("-")], "line string")
