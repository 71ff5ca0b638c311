"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the total by its weight. A source can give at
most ``max_epochs`` times its own words; what it can't give is dealt to the
others by weight until nobody is above its cap. The mix then takes each
document whole ``floor(target / source size)`` times, and of the remaining
fraction a seeded sample: within small hash buckets of a source the documents
stand in seeded order on a line of words, and the first ``fraction`` of the
line is taken once more. At most one document a bucket is cut.

Defined results: null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0; repeated rows count each;
an empty table gives an empty result. Columns that clash with the working
names are safe, as all working columns are prefixed ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, settle

MAX_EPOCHS = 3
SEED = 20
#: Documents a bucket, about; bounds each window's rows whatever the source holds.
BUCKET_DOCS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(stats: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of ``stats(source, source_size, n_docs)``: adds ``weight`` and ``target``.

    Closed form of the iteration: in order of cap / weight the capped sources
    are a prefix. The table has a row a source, after aggregation.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = (
        stats.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest_w", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn(
            "capped",
            F.col("cap").cast("double") * F.col("rest_w")
            <= F.col("weight").cast("double") * (F.col("total") - F.col("before")),
        )
    )
    every = W.partitionBy()
    return (
        ranked.withColumn("given", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("open_w", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every))
        .select(
            "source",
            "n_docs",
            "source_size",
            "weight",
            F.when(F.col("capped"), F.col("cap").cast("double"))
            .otherwise(F.col("weight").cast("double") * (F.col("total") - F.col("given")) / F.col("open_w"))
            .alias("target"),
        )
    )


def plan_mix(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` plus ``_mix_size, _mix_source_size, _mix_target, _mix_taken`` (all words).

    One pass counts words a source (partial sums before the shuffle); the
    source table is settled and joined back by Spark's own choice of join (it
    has a row a source, so Spark broadcasts it where its size allows).
    """
    sized = docs.withColumn("_mix_size", word_count(F.col("text")))
    stats = settle(sized.groupBy("source").agg(F.sum("_mix_size").alias("source_size"), F.count("*").alias("n_docs")))
    targets = settle(water_fill(stats, max_epochs)).select(
        F.col("source").alias("_mix_key"),
        F.col("source_size").alias("_mix_source_size"),
        F.col("target").alias("_mix_target"),
        F.ceil(F.col("n_docs") / BUCKET_DOCS).alias("_mix_buckets"),
    )
    draw = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}")).cast("binary"))
    placed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_mix_key")))
        .withColumn("_mix_draw", draw)
        .withColumn("_mix_bucket", F.conv(F.substring("_mix_draw", 25, 8), 16, 10).cast("long") % F.col("_mix_buckets"))
        .withColumn("_mix_ratio", F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0))
    )
    bucket = W.partitionBy("_mix_key", "_mix_bucket")
    line = bucket.orderBy("_mix_draw", "doc_id", "_mix_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = F.floor("_mix_ratio")
    return (
        placed.withColumn("_mix_upto", F.sum("_mix_size").over(line))
        .withColumn("_mix_extra", F.floor(F.sum("_mix_size").over(bucket) * (F.col("_mix_ratio") - whole) + 0.5))
        .withColumn(
            "_mix_taken",
            (
                whole * F.col("_mix_size")
                + F.greatest(
                    F.lit(0), F.least(F.col("_mix_size"), F.col("_mix_extra") - F.col("_mix_upto") + F.col("_mix_size"))
                )
            ).cast("long"),
        )
        .drop("_mix_key", "_mix_draw", "_mix_bucket", "_mix_buckets", "_mix_ratio", "_mix_upto", "_mix_extra")
    )


def mix(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each document as often as the plan takes it.

    Whole repetitions keep the text as it is; a cut repetition holds the words
    the plan takes, with the white space between them. Columns as in ``docs``.
    Documents without words are taken once if their source is taken at all.
    """
    names = docs.columns
    planned = plan_mix(docs, seed, max_epochs)
    size, taken = F.col("_mix_size"), F.col("_mix_taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(1).cast("int")
    part = F.when(size > 0, taken % size).otherwise(0)
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    words = planned.withColumn("_mix_words", F.explode(parts))
    # one piece a word, with the white space before it
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D]+[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_mix_words").cast("int")), "")
    out = words.withColumn("text", F.when(F.col("_mix_words") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_mix_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    # only numbers pass the window's shuffle: the planner prunes the text
    return plan_mix(docs).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        F.col("_mix_taken").alias("taken"),
    )


OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/{SEED}') AS draw
  FROM documents),
stats AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight,
         source_size * {MAX_EPOCHS} AS cap FROM stats),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_w
  FROM ranked),
marked AS (SELECT *, CAST(cap AS DOUBLE) * rest_w <= CAST(weight AS DOUBLE) * (total - before) AS capped FROM filled),
targets AS (
  SELECT source, source_size, n_docs,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight AS DOUBLE) * (total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT))
                   / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) END AS target
  FROM marked),
placed AS (
  SELECT s.doc_id, s.source, s.size, s.draw, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio,
         CAST('0x' || substr(s.draw, 25, 8) AS BIGINT) % CAST(ceil(t.n_docs / {BUCKET_DOCS}.0) AS BIGINT) AS bucket
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
lined AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, bucket ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
         CAST(floor(CAST(sum(size) OVER (PARTITION BY source, bucket) AS BIGINT) * (ratio - floor(ratio)) + 0.5) AS BIGINT) AS extra
  FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(CAST(floor(ratio) AS BIGINT) * size + greatest(0, least(size, extra - upto + size)) AS BIGINT) AS taken
FROM lined
"""
