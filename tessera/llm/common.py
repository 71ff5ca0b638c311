"""What the training-data operators share: durable cuts, Arrow mapping, components.

Everything here is written for executors that may vanish: a cut of the lineage
is a Parquet table in the folder named by ``spark.checkpoint.dir`` (shared by
driver and executors), never a local checkpoint.
"""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches are cut to slices of this many rows, so that a worker holds
#: the Python objects of a few hundred texts at a time, however long they are.
SLICE_ROWS = 256

#: Bits of a Bloom filter, whatever is put in (8 MB).
BLOOM_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from the session.

    Only in local mode (tests on one machine) may it be unset: a temporary
    folder is made and set then. A cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Settled(threading.local):
    """Tables settled by the ``tidied`` calls under way, innermost last."""

    def __init__(self) -> None:
        self.calls: list[list[str]] = []


_settled = _Settled()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    Cuts the lineage, so later stages neither recompute nor depend on any
    executor's disk; unlike a row checkpoint it keeps column pruning.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if _settled.calls:
        _settled.calls[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete settled tables."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidied(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``work`` with the tables that it settles deleted in the end, but for those that its result reads."""

    @wraps(work)
    def run(*args, **kwargs) -> DataFrame:
        _settled.calls.append([])
        out = None
        try:
            out = work(*args, **kwargs)
        finally:
            mine = _settled.calls.pop()
            spark = SparkSession.active()
            read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()} if out is not None and mine else set()
            kept = [p for p in mine if p.rsplit("/", 1)[1] in read]
            discard(spark, [p for p in mine if p not in kept])
            if _settled.calls:
                _settled.calls[-1].extend(kept)
        return out

    return run


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T._parse_datatype_string(ddl)
    return spark_schema, to_arrow_schema(spark_schema)


def release() -> None:
    """Give memory that is free, but kept by Arrow's allocator or by C's, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with free memory given back after every batch and at the end of the task.

    A worker outlives its tasks, and an executor has several a core where a
    stage holds more than one Python step, so what each keeps adds up beside
    whatever runs later, in the JVM too.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            release()

    def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            release()

    return given_back


def map_columns(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` over bounded slices.

    ``make`` is called once a task and returns a function from a slice to the
    output columns (lists or Arrow arrays, in any order).
    """
    spark_schema, out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cols = work(batch.slice(at, SLICE_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in out], schema=out
                )

    return df.mapInArrow(lean(run), spark_schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null is empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def bloom(rows: DataFrame, hashed: Column) -> bytes:
    """A Bloom filter of the hashes ``hashed`` of ``rows``: at most BLOOM_BITS / 64 words reach the driver."""
    at = F.pmod(hashed, F.lit(BLOOM_BITS))
    bits = np.zeros(BLOOM_BITS // 64, np.uint64)
    words = rows.select(F.floor(at / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 16 bytes a word, not a Python row
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return bits.tobytes()


def maybe(spark: SparkSession, ids: DataFrame) -> Callable[[Column], Column]:
    """A test of long values against the one column of ``ids``: false for most others, true for all of these."""
    shared = spark.sparkContext.broadcast(bloom(ids, F.xxhash64(ids.columns[0])))

    @F.pandas_udf("boolean")
    def may(hashed: pd.Series) -> pd.Series:
        at = (hashed.to_numpy(np.int64) % BLOOM_BITS).astype(np.uint64)
        bits = np.frombuffer(shared.value, np.uint64)
        return pd.Series((bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    return lambda c: may(F.xxhash64(c))


def likely(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose long ``key`` is not in the one column of ``ids``.

    For the large side of a join that keeps few of its rows: they are dropped
    before the shuffle. Every row that matches stays; where ``ids`` fill the
    filter, all rows stay.
    """
    return rows.where(maybe(rows.sparkSession, ids)(F.col(key)))


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose long ``key`` is not in the one column of ``ids``.

    Only rows that the filter takes for possible ones are shuffled to an exact
    join; the others pass as they are. ``rows`` has to be settled: it is read
    twice.
    """
    may = maybe(rows.sparkSession, ids)
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    doubtful = rows.where(may(F.col(key)))
    return rows.where(~may(F.col(key))).unionByName(doubtful.join(gone, F.col(key) == F.col("_gone"), "left_anti"))


def with_few(rows: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """``rows`` left joined with ``few`` by the long ``key``, a row a key.

    Only rows that may have a partner are shuffled. ``rows`` has to be settled:
    it is read twice.
    """
    may = maybe(rows.sparkSession, few.select(key))
    rest = rows.where(~may(F.col(key)))
    kinds = few.drop(key).schema
    rest = rest.select(*rows.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds))
    return rows.where(may(F.col(key))).join(few, key, "left").select(*rows.columns, *kinds.names).unionByName(rest)


@tidied
def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, root)``, root = smallest id.

    Alternates large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond"), each a grouped minimum (combined
    map-side) and an equi-join whose sides are both freshly exchanged, so that
    Spark can split a hot node. Each step is settled. Nothing reaches the
    driver but a count and a checksum.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        if small:
            sym = pairs.select(F.col("u").alias("a"), F.col("v").alias("b"))
        else:
            sym = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
                pairs.select(F.col("v").alias("a"), F.col("u").alias("b"))
            )
        least = settle(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        joined = sym.join(least, "a")
        if small:
            moved = joined.where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
            moved = moved.unionByName(least.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")))
        else:
            moved = joined.where("b > a and b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        return settle(moved.distinct())

    def mark(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        return tuple(row)

    now = settle(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = mark(now)
    while seen[0]:
        now = star(star(now, small=False), small=True)
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
