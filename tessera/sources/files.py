"""Reading and writing namespaces: Parquet folders, JSON lines, CSV, dumps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Database, Index
from ..functions import scalar


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, open_fields: bool = False) -> DataFrame:
    """JSON lines; without a schema and with ``open_fields`` each document is a variant in ``_doc``."""
    if open_fields:
        return spark.read.text(path).select(F.parse_json("value").alias("_doc"))
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested values, joined rows among them, as JSON strings."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema)).write.mode("overwrite").option("header", True).csv(path)


def dump(db: Database, folder: str, names: list[str] | None = None) -> None:
    """A Parquet folder a namespace, and its declaration beside it."""
    for n in names or [*db.namespaces]:
        ns = db.get(n)
        ns.df.write.mode("overwrite").parquet(f"{folder}/{n}/data")
        text = json.dumps({"indexes": [i.__dict__ for i in ns.indexes.values()], "meta": ns.meta, "schema": ns.schema}, default=list)
        db.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{n}/definition")


def restore(db: Database, folder: str, names: list[str]) -> None:
    for n in names:
        told = json.loads("".join(r.value for r in db.spark.read.text(f"{folder}/{n}/definition").collect()))
        ns = db.open(n, db.spark.read.parquet(f"{folder}/{n}/data"))
        ns.indexes = {i["name"]: Index(**i) for i in told["indexes"]}
        ns.meta, ns.schema = told["meta"], told["schema"]


def write_sharded(df: DataFrame, key: str, path: str) -> None:
    """A folder a value of ``key``: equality on it prunes to one."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def write_clustered(df: DataFrame, keys: list[str], path: str) -> None:
    """Ranges of ``keys`` a file, sorted: min/max statistics then serve range conditions."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_spatial(df: DataFrame, point: str, path: str, bits: int = 15) -> None:
    """Neighbouring points in neighbouring rows, by the interleaved bits of x and y, which are kept as ``_px`` and ``_py``.

    An ``rtree`` index with ``config={"x": "_px", "y": "_py"}`` then brings the
    box around a distance condition to the scan's statistics.
    """
    x, y = scalar.point(F.col(f"`{point}`"), df.schema[point].dataType)
    rows = df.withColumn("_px", x).withColumn("_py", y)
    low_x, high_x, low_y, high_y = rows.agg(F.min("_px"), F.max("_px"), F.min("_py"), F.max("_py")).head()
    place = F.lit(0).cast("long")
    for name, low, high, shift in (("_px", low_x, high_x, 0), ("_py", low_y, high_y, 1)):
        wide = (high - low) if low is not None and high > low else 1.0
        cell = F.least(F.floor((F.col(name) - F.lit(low or 0.0)) / F.lit(wide) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
        for i in range(bits):
            place = place + F.shiftleft(F.shiftright(cell, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + shift)
    rows.withColumn("_z", place).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)


def table_view(df: DataFrame, rows: int = 20, width: int = 40) -> str:
    """The first ``rows`` as a text table; nested values as JSON, long ones cut."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    shown = df.limit(rows).select(*((F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema)).collect()
    cells = [df.columns, *([("" if v is None else v if len(v) <= width else v[: width - 3] + "...") for v in r] for r in shown)]
    sizes = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = [" | ".join(v.ljust(n) for v, n in zip(r, sizes, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * n for n in sizes), *lines[1:]])
