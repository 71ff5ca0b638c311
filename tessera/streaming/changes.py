"""A change log of namespaces: append-only Parquet, read by version or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import QueryError

SCHEMA = "ns string, lsn long, op string, item string"


class ChangeLog:
    """Every write as rows (namespace, version, operation, item as JSON)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append_all(self, events: list[tuple[str, str, DataFrame, int]]) -> None:
        """(namespace, operation, rows, lsn) of each write, all or none: one append of Parquet files."""
        rows = None
        for ns, op, items, lsn in events:
            told = F.to_json(F.struct(*(F.col(f"`{c}`") for c in items.columns)))
            some = items.select(F.lit(ns).alias("ns"), F.lit(lsn).cast("long").alias("lsn"), F.lit(op).alias("op"), told.alias("item"))
            if op == "truncate":
                some = self.spark.createDataFrame([(ns, lsn, op, None)], SCHEMA)
            rows = some if rows is None else rows.unionByName(some)
        rows.write.mode("append").partitionBy("ns").parquet(self.folder)

    def append(self, ns: str, op: str, items: DataFrame, lsn: int) -> None:
        self.append_all([(ns, op, items, lsn)])

    def trim(self, ns: str, upto: int) -> None:
        """Mark everything up to ``upto`` as no longer kept: readers behind it have to start from a copy."""
        self.spark.createDataFrame([(ns, upto, "trim", None)], SCHEMA).write.mode("append").partitionBy("ns").parquet(self.folder)

    def begins(self, ns: str) -> int:
        """The lsn behind which the log is whole."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.folder)
        return rows.where((F.col("ns") == ns) & (F.col("op") == "trim")).agg(F.max("lsn")).head()[0] or 0

    def since(self, ns: str, lsn: int) -> DataFrame:
        """``#lsn > n``: a pruned scan of one namespace's partition; an error where the log no longer goes back to n."""
        if lsn < (first := self.begins(ns)):
            raise QueryError(f"the log of {ns} begins at {first}: start from a copy")
        rows = self.spark.read.schema(SCHEMA).parquet(self.folder)
        return rows.where((F.col("ns") == ns) & (F.col("lsn") > lsn) & (F.col("op") != "trim")).select("ns", "lsn", "op", "item")

    def stream(self, namespaces: list[str] | None = None, ops: list[str] | None = None) -> DataFrame:
        rows = self.spark.readStream.schema(SCHEMA).parquet(self.folder)
        if namespaces:
            rows = rows.where(F.col("ns").isin(*namespaces))
        return rows.where(F.col("op").isin(*ops)) if ops else rows

    def subscribe(self, handler: Callable[[DataFrame, int], None], checkpoint: str, namespaces: list[str] | None = None, ops: list[str] | None = None):
        """Calls ``handler`` with each batch of events, each exactly once by checkpoint."""
        return self.stream(namespaces, ops).writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(log: ChangeLog, db, ns: str, checkpoint: str, leader=None):
    """Keep ``db``'s namespace up with a leader's log: each batch's last change a key is applied.

    Changes that the namespace already has (by lsn) are passed over. Where the
    log no longer reaches back to it, it starts from a copy of ``leader``'s.
    """
    from ..operators import modify
    from ..storage import written

    if db.get(ns).lsn < log.begins(ns):
        if leader is None:
            raise QueryError(f"the log of {ns} no longer reaches back: a leader to copy from is needed")
        db.replace(ns, written(leader.get(ns).df, "copy"))
        db.get(ns).lsn = leader.get(ns).lsn

    def handle(batch: DataFrame, _: int) -> None:
        target = db.get(ns)
        rows = batch.where((F.col("lsn") > target.lsn) & (F.col("op") != "trim"))
        most, cut = rows.agg(F.max("lsn"), F.max(F.when(F.col("op") == "truncate", F.col("lsn")))).head()
        if most is None:
            return
        if cut is not None:
            db.replace(ns, db.spark.createDataFrame([], target.df.schema))
            rows = rows.where(F.col("lsn") > cut)
        rows = rows.withColumn("v", F.from_json("item", target.df.schema))
        keys = [F.col(f"v.{k}") for k in target.pk]
        last = written(rows.groupBy(*keys).agg(F.max_by(F.struct("op", "v"), F.col("lsn")).alias("x")), "batch")
        modify.apply(db, ns, last.where("x.op = 'delete'").select("x.v.*"), "delete")
        modify.apply(db, ns, last.where("x.op <> 'delete'").select("x.v.*"), "upsert")
        db.get(ns).lsn = most

    return log.subscribe(handle, checkpoint, [ns])
