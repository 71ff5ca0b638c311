"""Sharding by a weighted hash tree of regions, racks and shards.

A key descends the tree: at every level each child draws ``-ln(u) / weight``
from a hash of key and child, and the least draw wins (weighted rendezvous).
A child's weight is the sum of its shards' weights, so when a weight grows,
keys move only into that child's subtree, and nowhere else. New shards open a
region of their own: then the only subtree whose weight changed is the new
shard, and it alone receives rows.

Slots are numbered without a window over a whole shard: distinct rows are dealt
to hash groups of bounded size and ranked there, and equal rows are one row with
a count until the end, so a row that is repeated without bound is no hot group.

Defined results: a null key is a key like any other (all such rows share a
shard); null text has no bytes; repeated rows get slots of their own in one
shard; a column of the input that is named ``shard`` or ``grown_shard`` comes
back with ``_in`` appended, and working columns are prefixed ``_slot_``; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settle, tidied

SHARDS = 16
SEED = 7


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int = SHARDS, base: int = SHARDS) -> list[Leaf]:
    """``base`` shards in racks of four, two racks a region; each further one is a region of its own."""
    first = [Leaf(i // 8, i // 4, i) for i in range(min(shards, base))]
    return first + [Leaf(1000 + i, 1000 + i, i) for i in range(base, shards)]


def _draw(key: Column, level: str, child: int, weight: float, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(level), F.lit(str(child)), key).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / F.lit(float(weight))


def _pick(key: Column, level: str, children: dict[int, float], seed: int) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(key, level, c, w, seed).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items())]
    return F.least(*draws)["c"]


def shard_of(key: Column, leaves: list[Leaf], seed: int = SEED) -> Column:
    """The shard of ``key``; the tree is data of the plan, of a row a shard."""
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def weigh(of: list[Leaf], attr: str) -> dict[int, float]:
        sums: dict[int, float] = {}
        for leaf in of:
            sums[getattr(leaf, attr)] = sums.get(getattr(leaf, attr), 0.0) + leaf.weight
        return sums

    def descend(of: list[Leaf], levels: tuple[str, ...]) -> Column:
        children = weigh(of, levels[0])
        won = _pick(key, levels[0], children, seed)
        if len(levels) == 1:
            return won
        below = {c: descend([x for x in of if getattr(x, levels[0]) == c], levels[1:]) for c in children}
        if len(below) == 1:
            return next(iter(below.values()))
        out: Column | None = None
        for c, col in below.items():
            out = F.when(won == c, col) if out is None else out.when(won == c, col)
        return out

    return descend([x for x in leaves if x.weight > 0], ("region", "rack", "shard")).cast("int")


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` plus ``shard`` and ``grown_shard`` (its shard if there were one more)."""
    for name in ("shard", "grown_shard"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, f"{name}_in")
    key = f"{key}_in" if key in ("shard", "grown_shard") else key
    return docs.withColumn("shard", shard_of(F.col(key), topology(shards), seed)).withColumn(
        "grown_shard", shard_of(F.col(key), topology(shards + 1), seed)
    )


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: by hash group, then by ``order`` and the other columns.

    Rows of a shard are dealt to about as many hash groups as a group has rows;
    a row's slot is what comes before it in its group plus the groups before.
    """
    names = rows.columns
    by = [*order, *(n for n in names if n not in order)]
    distinct = settle(rows.groupBy(*names).agg(F.count("*").alias("_slot_n")))
    total, most = distinct.agg(F.sum("_slot_n"), F.max("shard")).head()
    groups = groups_of(total or 0, (most or 0) + 1)
    dealt = distinct.withColumn("_slot_group", group_of(order, groups))
    sizes = dealt.groupBy("shard", "_slot_group").agg(F.sum("_slot_n").alias("_slot_size"))
    starts = sizes.select(
        F.col("shard").alias("_slot_shard"),
        F.col("_slot_group").alias("_slot_of"),
        (F.sum("_slot_size").over(W.partitionBy("shard").orderBy("_slot_group")) - F.col("_slot_size")).alias("_slot_start"),
    )
    before = F.sum("_slot_n").over(W.partitionBy("shard", "_slot_group").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_slot_n")
    placed = dealt.withColumn("_slot_before", before).join(settle(starts), (F.col("shard") == F.col("_slot_shard")) & (F.col("_slot_group") == F.col("_slot_of")))
    first = F.col("_slot_start") + F.col("_slot_before")
    return placed.select(*names, F.explode(F.sequence(first, first + F.col("_slot_n") - 1)).alias("slot"))


def groups_of(total: int, shards: int) -> int:
    """Hash groups a shard: as many as a group has rows, of 64 rows at least."""
    return max(1, ceil(total / shards / max(64, ceil(sqrt(total / shards)))))


def group_of(order: list[str], groups: int) -> Column:
    text = F.concat_ws("/", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in order))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % F.lit(groups)


@tidied
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = assign(docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")))
    return number(rows, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(leaves: list[Leaf], seed: int = SEED) -> str:
    """``shard_of`` as SQL over a column ``key``."""

    def weigh(of: list[Leaf], attr: str) -> dict[int, float]:
        return {c: sum(x.weight for x in of if getattr(x, attr) == c) for c in sorted({getattr(x, attr) for x in of})}

    def draw(level: str, child: int, weight: float) -> str:
        return f"{{'d': -ln((CAST('0x' || substr(md5('{seed}/{level}/{child}/' || key), 1, 13) AS BIGINT) + 0.5) / {1 << 52}.0) / {weight}, 'c': {child}}}"

    def descend(of: list[Leaf], levels: tuple[str, ...]) -> str:
        children = weigh(of, levels[0])
        below = {c: descend([x for x in of if getattr(x, levels[0]) == c], levels[1:]) if levels[1:] else str(c) for c in children}
        if len(children) == 1:
            return next(iter(below.values()))
        won = f"least({', '.join(draw(levels[0], c, w) for c, w in children.items())}).c"
        return f"CASE {won} " + " ".join(f"WHEN {c} THEN {sql}" for c, sql in below.items()) + " END"

    return descend(leaves, ("region", "rack", "shard"))


def _nibbles() -> list[int]:
    """The CRC-32 of each half byte."""
    table = range(16)
    for _ in range(4):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


OP7_SQL = f"""
WITH hexed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g') AS x,
         coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
rows AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, key,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(x, ''), lambda c: c <> ''), lambda c: instr('0123456789ABCDEF', c)::BIGINT - 1)),
                         lambda a, b: xor({_nibbles()}[(xor(a, b) & 15) + 1]::BIGINT, a >> 4)), 4294967295) AS text_crc32 FROM hexed),
dealt AS (SELECT *, CAST({_sql_shard(topology())} AS INTEGER) AS shard, CAST({_sql_shard(topology(SHARDS + 1))} AS INTEGER) AS grown_shard FROM rows),
sizes AS (SELECT count(*) AS total, max(shard) + 1 AS shards FROM dealt),
grouped AS (
  SELECT d.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || size || '/' || text_crc32), 1, 12) AS BIGINT)
              % greatest(1, CAST(ceil(total / shards / greatest(64, ceil(sqrt(total / shards)))) AS BIGINT)) AS g FROM dealt d, sizes)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM grouped
"""
