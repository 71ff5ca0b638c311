"""Tables that the engine writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode a temporary folder where it is unset, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table", root: str | None = None) -> DataFrame:
    """``df`` as a Parquet table read back: its lineage is cut, and it survives lost executors."""
    path = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}" if root else fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return opened(df.sparkSession, path, df.schema)


def opened(spark: SparkSession, path: str, schema=None) -> DataFrame:
    out = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    out._tessera_path = path
    return out


def path_of(df: DataFrame | None) -> str | None:
    """Where a table of ``written`` lies."""
    return None if df is None else df.__dict__.get("_tessera_path")


def delete(df: DataFrame) -> None:
    """Delete a table of ``written``; anything else is left alone."""
    path = path_of(df)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
