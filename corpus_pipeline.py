"""The corpus pipeline: toxicity, MinHash near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import minhash, mixing, packing, pii, toxicity
from tessera.llm.common import settle, tidied


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, whatever ids its rows have: the first by doc_id. Shingles of five words, similarity 0.8."""
    return minhash.deduplicated(docs, shingle=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked, terms that disclose it generalised or removed wherever they stand."""
    return pii.sanitise(docs, everywhere=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their targets, with whole and cut repetitions."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 1,024."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("pii", sanitise), ("mixing", mix_sources), ("packing", pack)]

#: Classifiers, MinHash, patterns with offsets and a tokenizer are beyond SQL; tests/llm hold each stage of run() against a plain version.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tidied(lambda stage=stage, docs=docs: settle(stage(spark, docs, sf_dir)))()  # a stage's own tables go when it is settled
    return STAGES[-1][1](spark, docs, sf_dir)
