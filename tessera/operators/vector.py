"""Nearest neighbours: exact scans, a coarse-cell index, and rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..spec import Knn, QueryError
from ..storage import written

ASCENDING = {"l2"}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(col: Column, vector: list[float], metric: str) -> Column:
    """Squared distance for l2, otherwise a similarity."""
    q = F.array(*(F.lit(float(v)) for v in vector))
    if metric == "l2":
        return F.aggregate(F.zip_with(col, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "inner_product":
        return dot(col, q)
    norm = sum(float(v) ** 2 for v in vector) ** 0.5
    return dot(col, q) / (F.sqrt(dot(col, col)) * F.lit(norm))


def streamed(ns, knn: Knn) -> bool:
    """KNN over an hnsw field without k or radius: all rows are ranked, and the query's limit cuts after its conditions."""
    index = ns.index(knn.field)
    return bool(index and index.kind == "hnsw" and knn.k is None and knn.radius is None and index.radius is None)


def nearest(df: DataFrame, ns, knn: Knn, embedder=None) -> DataFrame:
    """``df`` cut to the k nearest rows (or those within the radius), with ``_knn``.

    Equal scores go by key. A row of several vectors counts by its best one.
    The cut comes before any other condition of the query. A top-k of a scan is
    a partial top-k a task and a merge of those.
    """
    index = ns.index(knn.field)
    metric = index.metric if index else "l2"
    vector = embedder(knn.vector) if isinstance(knn.vector, str) and embedder else knn.vector
    if isinstance(vector, str):
        raise QueryError("a text needs an embedder")
    if index and index.dimension and len(vector) != index.dimension:
        raise QueryError(f"the vector has {len(vector)} dimensions, not {index.dimension}")
    radius = knn.radius if knn.radius is not None else (index.radius if index else None)
    if knn.k is None and radius is None and not streamed(ns, knn):
        raise QueryError("KNN needs k or a radius")
    kind = df.schema[knn.field].dataType
    many = isinstance(kind.elementType, T.ArrayType)
    rows = df.where(F.col(knn.field).isNotNull())
    if index and index.kind == "ivf" and "cells" in index.config:
        rows = rows.where(F.col(index.config["column"]).isin(*probed(index, vector, int(knn.params.get("nprobe", 1)))))
    if index and "sq8" in index.config and knn.k is not None and radius is None and not many:
        rows = nearest_by_bytes(rows, index.config["sq8"], vector, metric, int(knn.k), ns.key())
    if many:
        scores = F.transform(knn.field, lambda v: score(v, vector, metric))
        rows = rows.withColumn("_knn", F.array_min(scores) if metric in ASCENDING else F.array_max(scores))
    else:
        rows = rows.withColumn("_knn", score(F.col(knn.field), vector, metric))
    rows = rows.where(F.col("_knn").isNotNull())
    if radius is not None:
        rows = rows.where(F.col("_knn") <= radius if metric in ASCENDING else F.col("_knn") >= radius)
    if knn.k is not None:
        rows = rows.orderBy(F.col("_knn").asc() if metric in ASCENDING else F.col("_knn").desc(), *ns.key()).limit(int(knn.k))
    return rows


#: Candidates by quantised distance for each of the k rows that are ranked exactly.
QUANTISED_PER_K = 8


def quantise(df: DataFrame, field: str) -> tuple[DataFrame, dict]:
    """``df`` with ``_sq8``, a byte a component on one scale for the table, and the scale.

    A KNN condition on an index with the scale in ``config["sq8"]`` reads the
    bytes for all rows, and whole vectors only of the nearest ones by bytes.
    """
    low, high = df.agg(F.min(F.array_min(field)), F.max(F.array_max(field))).head()
    low, high = (float(low), float(high)) if low is not None else (0.0, 1.0)
    step = max(high - low, 1e-12) / 255

    @F.pandas_udf("binary")
    def bytes_of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: np.clip(np.rint((np.asarray(v, float) - low) / step), 0, 255).astype(np.uint8).tobytes(), na_action="ignore")

    return df.withColumn("_sq8", bytes_of(field)), {"low": low, "step": step}


def nearest_by_bytes(rows: DataFrame, scale: dict, vector: list[float], metric: str, k: int, key: list[Column]) -> DataFrame:
    """The best ``QUANTISED_PER_K`` * k rows by their bytes."""
    q = np.array(vector, float)

    @F.pandas_udf("double")
    def rough(data: pd.Series) -> pd.Series:
        if not len(data):
            return pd.Series([], dtype=float)
        x = np.stack([np.frombuffer(d, np.uint8) for d in data]) * scale["step"] + scale["low"]
        if metric == "l2":
            return pd.Series(((x - q) ** 2).sum(1))
        dots = x @ q
        return pd.Series(dots if metric == "inner_product" else dots / np.sqrt((x * x).sum(1)))

    best = F.col("_rough").asc() if metric in ASCENDING else F.col("_rough").desc()
    return rows.where("_sq8 is not null").withColumn("_rough", rough("_sq8")).orderBy(best, *key).limit(QUANTISED_PER_K * k).drop("_rough")


def least_by_hash(df: DataFrame, field: str, n: int) -> DataFrame:
    """The values of ``field`` with the ``n`` least hashes: those of a sort by hash and a limit.

    The limit is found by counts of hashes, first of 65,536 ranges, then within
    one, so no task gets ``n`` rows of every other one. Equal hashes are equal
    values, so what goes in of the last one is a row's copies.
    """
    rows = df.select(field).withColumn("_h", F.xxhash64(field))

    def cut(some: DataFrame, value: Column, room: int) -> tuple[int | None, int]:
        """The value whose rows fill the room, and how much is left for them."""
        for v, count in sorted(map(tuple, some.groupBy(value.alias("v")).agg(F.count("*").alias("n")).collect())):
            if count >= room:
                return v, room
            room -= count
        return None, room

    range_of = F.shiftright("_h", 48)
    at, room = cut(rows, range_of, n)
    if at is None:
        return rows.select(field)
    last, room = cut(rows.where(range_of == at), F.col("_h"), room)
    copies = rows.where(F.col("_h") == last).limit(1).select(field, F.explode(F.sequence(F.lit(1), F.lit(room)))).select(field)
    return rows.where(F.col("_h") < last).select(field).unionByName(copies)


def train_cells(df: DataFrame, field: str, cells: int, sample_rows: int = 100_000, seed: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """k-means centroids on a bounded sample, and ``df`` with the cell of every row (``_cell``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = least_by_hash(df.where(F.col(field).isNotNull()), field, sample_rows)
    vectors = sample.select(array_to_vector(F.col(field).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(vectors)
    centers = np.array(model.clusterCenters())

    @F.pandas_udf("int")
    def cell(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()).astype(float)
        return pd.Series((-2 * x @ centers.T + (centers**2).sum(1)).argmin(1).astype("int32"))

    return df.withColumn("_cell", cell(field)), centers.tolist()


def probed(index, vector: list[float], nprobe: int) -> list[int]:
    centers = np.array(index.config["cells"])
    return np.argsort(((centers - np.array(vector)) ** 2).sum(1), kind="stable")[: max(1, nprobe)].tolist()


def positions(df: DataFrame, column: str, ascending: bool) -> DataFrame:
    """``(_v, _p)``: each value of ``column`` with one more than the number of better rows.

    Values are counted first (combined map-side), then summed up along their
    order, range by range: no task holds more than a range of distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    better = F.col("_v").asc() if ascending else F.col("_v").desc()
    ranged = written(counts.repartitionByRange(better).withColumn("_r", F.spark_partition_id()), "ranks")
    sizes = ranged.groupBy("_r").agg(F.sum("_n").alias("_m"))
    before = sizes.select(F.col("_r").alias("_s"), (F.sum("_m").over(W.orderBy("_r")) - F.col("_m")).alias("_b"))  # a row a range
    within = F.sum("_n").over(W.partitionBy("_r").orderBy(better)) - F.col("_n")
    return ranged.withColumn("_w", within).join(F.broadcast(before), F.col("_r") == F.col("_s")).select("_v", (F.col("_w") + F.col("_b") + 1).alias("_p"))


def fuse_rrf(df: DataFrame, text: str, knn: str, knn_ascending: bool, const: float = 60.0) -> DataFrame:
    """``df`` with ``_rrf``: 1 / (const + position) summed over both ranks.

    Equal ranks share a position; a missing one adds nothing.
    """
    if const < 1:
        raise QueryError("rank_const is 1 at least")
    total = F.lit(0.0)
    for i, (column, ascending) in enumerate(((text, False), (knn, knn_ascending))):
        places = positions(df, column, ascending).select(F.col("_v").alias(f"_v{i}"), F.col("_p").alias(f"_p{i}"))
        df = df.join(places, F.col(column) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        total = total + F.coalesce(1.0 / (const + F.col(f"_p{i}")), F.lit(0.0))
    return df.withColumn("_rrf", total).drop("_p0", "_p1")
