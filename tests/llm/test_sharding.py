"""Sharding against a plain tree, SQL, repeated rows and clashing columns."""

import hashlib
import math
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tessera.llm import sharding


def plain_shard(key, leaves, seed=sharding.SEED):
    """Descend by the least -ln(u) / weight, level by level."""
    text = "null" if key is None else str(key)
    for level in ("region", "rack", "shard"):
        weight = defaultdict(float)
        for leaf in leaves:
            weight[getattr(leaf, level)] += leaf.weight
        draw = {c: -math.log((int(hashlib.md5(f"{seed}/{level}/{c}/{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for c, w in weight.items() if w > 0}
        won = min(draw, key=draw.get)
        leaves = [x for x in leaves if getattr(x, level) == won]
    return leaves[0].shard


def test_shards_equal_a_plain_tree(spark):
    leaves = [sharding.Leaf(x.region, x.rack, x.shard, [1.0, 2.5, 0.0, 0.7][x.shard % 4]) for x in sharding.topology(19)]
    keys = [None, *range(-50, 700)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.shard_of(F.col("k"), leaves).alias("s")).collect()
    assert {r.k: r.s for r in rows} == {k: plain_shard(k, leaves) for k in keys}


def test_query_equals_its_sql(spark, tmp_path):
    texts = [(i % 90, f"text {i % 90}é") for i in range(400)] + [(None, None)] * 30 + [(None, f"n{i}") for i in range(50)] + [(7, "😀" * 500), (8, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = sharding.op7_sharding(spark, str(tmp_path))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sharding.OP7_SQL})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, found))


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a", "old", 5)] * 500 + [(2, None, "old", None)] * 3 + [(None, "b", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, grown_shard int")
    out = sharding.number(sharding.assign(df), ["doc_id"])
    assert out.columns == ["doc_id", "text", "shard_in", "grown_shard_in", "shard", "grown_shard", "slot"]
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
        assert r.shard_in == (None if r.doc_id is None else "old")
    assert sum(map(len, slots.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = sharding.assign(df.drop("grown_shard"), "shard").select("shard_in", "shard").distinct().collect()
    assert len(by_text) == 2  # the key may be the clashing column
    assert sharding.number(sharding.assign(df.limit(0)), ["doc_id"]).count() == 0
