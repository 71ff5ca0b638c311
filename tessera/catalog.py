"""Databases of namespaces: a DataFrame each, with declared fields, key and meta values."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import QueryError
from .storage import opened, path_of, written

KINDS = {"hash", "tree", "-", "text", "rtree", "ttl", "hnsw", "vec_bf", "ivf"}


@dataclass
class Index:
    """A declared field: kind, and whether it is sparse, an array, collated; several paths make an array."""

    name: str
    kind: str = "hash"
    paths: list[str] = field(default_factory=list)
    pk: bool = False
    sparse: bool = False
    array: bool = False
    collate: str = "none"  # none ascii utf8 numeric custom
    order: str = ""  # of a custom collation
    expire_after: int = 0
    metric: str = "l2"  # l2 cosine inner_product
    radius: float | None = None
    dimension: int | None = None
    default: object = None
    config: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise QueryError(f"unknown index kind {self.kind!r}")

    @property
    def fields(self) -> list[str]:
        """Of a composite index, its parts."""
        return self.name.split("+") if "+" in self.name and not self.paths else [self.name]


@dataclass
class Namespace:
    name: str
    df: DataFrame
    indexes: dict[str, Index] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)
    schema: dict | None = None
    version: int = 0
    lsn: int = 0  # of the last logged write
    texts: dict[tuple[str, ...], object] = field(default_factory=dict)  # text indexes of this snapshot by fields
    base_texts: dict[tuple, object] = field(default_factory=dict)  # those of ``base``
    base: DataFrame | None = None  # ``df`` without the changes since
    delta: DataFrame | None = None  # a row a changed key, ``_gone`` if it is deleted

    def state(self) -> dict:
        return {n: dict(v) if isinstance(v := getattr(self, n), dict) else v for n in ("df", "base", "delta", "version", "lsn", "meta", "texts", "base_texts")}

    def restore(self, state: dict) -> None:
        for n, v in state.items():
            setattr(self, n, v)

    def text_index(self, fields: list[str], config=None):
        """The inverted index over ``fields``, built when first asked for; after small writes, from the one before and the changes."""
        from .operators import fulltext

        if not self.pk:
            raise QueryError(f"{self.name} needs a primary key to be searched")
        config = config or fulltext.Config()
        at = (*fields, *config.splitting())
        if at not in self.texts and self.delta is not None and all(f in self.base.columns for f in fields):
            if at not in self.base_texts:
                self.base_texts[at] = fulltext.build(self.base, self.pk, fields, config)
            self.texts[at] = fulltext.changed(self.base_texts[at], self.delta, config)
        elif at not in self.texts:
            self.texts[at] = fulltext.build(self.df, self.pk, fields, config)
        return self.texts[at]

    @property
    def pk(self) -> list[str]:
        for i in self.indexes.values():
            if i.pk:
                return i.fields
        return []

    def index(self, name: str) -> Index | None:
        return self.indexes.get(name)

    def key(self) -> list[Column]:
        """Columns that order rows where a query leaves ties: the key, or all sortable columns."""
        names = self.pk or [f.name for f in self.df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        return [F.col(f"`{n}`") if n in self.df.columns else F.col(n) for n in names]


def _same_keys(keys: list[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    return on


def _merged(ns: Namespace) -> DataFrame:
    """The unchanged rows of the base, and the changed ones."""
    gone = ns.delta.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(ns.pk)))
    rest = ns.base.join(gone, _same_keys(ns.pk), "left_anti")
    return rest.unionByName(ns.delta.where("not _gone").drop("_gone"), allowMissingColumns=True).select(*_in_order(ns.base, ns.delta))


def _in_order(base: DataFrame, delta: DataFrame) -> list[Column]:
    """The table's columns, then those that changes have added."""
    return [F.col(f"`{c}`") for c in [*base.columns, *(c for c in delta.columns if c not in base.columns and c != "_gone")]]


class Database:
    """Namespaces by name; SQL, JSON and builder queries run against it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.namespaces: dict[str, Namespace] = {}
        self.counts: dict[tuple, int] = {}
        self.embedders: dict[str, object] = {}
        self.log = None  # a change log, see tessera.streaming
        self.held: list | None = None  # events of a transaction that isn't committed
        self.runs: dict[str, list[float]] = {}  # seconds by statement
        self.folder: str | None = None  # where namespaces are kept, see ``attach``

    def open(self, name: str, df: DataFrame, indexes: list[Index] | None = None) -> Namespace:
        """Declare a namespace over ``df``; regular scalar fields take their defaults for missing values."""
        ns = Namespace(name, df, {i.name: i for i in indexes or []})
        for i in ns.indexes.values():
            if len(i.paths) > 1 or (i.paths and i.paths[0] != i.name):
                parts = [F.col(p) for p in i.paths]
                df = df.withColumn(i.name, parts[0] if len(parts) == 1 else F.concat(*(self._listed(df, p) for p in i.paths)))
            if i.default is not None and not i.sparse and i.name in df.columns:
                df = df.withColumn(i.name, F.coalesce(F.col(f"`{i.name}`"), F.lit(i.default)))
        ns.df = df
        twin = next((n for n in self.namespaces.values() if n.df is df and n.pk == ns.pk), None)
        if twin is not None:  # one snapshot has one set of text indexes; a write begins another
            ns.texts = twin.texts
        self.namespaces[name] = ns
        return ns

    @staticmethod
    def _listed(df: DataFrame, path: str) -> Column:
        kind = df.select(path).schema.fields[0].dataType
        empty = F.array().cast(kind if isinstance(kind, T.ArrayType) else T.ArrayType(kind))
        return F.coalesce(F.col(path) if isinstance(kind, T.ArrayType) else F.when(F.col(path).isNotNull(), F.array(path)), empty)

    def copy(self) -> Database:
        """Another database of the same snapshots: what is written or declared there stays there."""
        out = Database(self.spark)
        out.counts, out.embedders = dict(self.counts), dict(self.embedders)
        for n in self.namespaces.values():
            out.namespaces[n.name] = replace(n, indexes={k: replace(i) for k, i in n.indexes.items()}, meta=dict(n.meta))
        return out

    def get(self, name: str) -> Namespace:
        if name.startswith("#"):
            return self.system(name)
        if name not in self.namespaces:
            raise QueryError(f"no namespace {name!r}")
        return self.namespaces[name]

    SYSTEM = ("#namespaces", "#memstats", "#config", "#perfstats", "#queriesperfstats", "#activitystats", "#clientsstats", "#replicationstats", "#clusterconfig")

    def system(self, name: str) -> Namespace:
        """Small tables about the database: what is declared, how large it is, what ran."""
        make = lambda rows, ddl: self.spark.createDataFrame(rows, ddl)
        context = self.spark.sparkContext
        if name == "#config":
            df = make([(k, v) for k, v in sorted(context.getConf().getAll()) if k.startswith("spark.sql")], "name string, value string")
        elif name == "#namespaces":
            df = make([(n.name, len(n.indexes), json.dumps([i.__dict__ for i in n.indexes.values()], default=str), json.dumps(n.meta), n.version) for n in self.namespaces.values()], "name string, index_count int, indexes string, meta string, version long")
        elif name == "#memstats":
            size = lambda d: int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            df = make([(n.name, size(n.df), 0 if n.delta is None else size(n.delta), sum(size(t.postings) + size(t.words) for t in n.texts.values())) for n in self.namespaces.values()], "name string, data_size long, changes_size long, text_indexes_size long")
        elif name in ("#perfstats", "#queriesperfstats"):
            runs: dict[str, list[float]] = {}
            for text, seconds in self.runs.items():
                runs.setdefault(text if name == "#queriesperfstats" else text.partition("\0")[0], []).extend(seconds)
            rows = [(k.partition("\0")[2] if "\0" in k else k, len(v), sum(v) / len(v), max(v)) for k, v in runs.items()]
            df = make(rows, "name string, total_queries_count long, avg_seconds double, max_seconds double")
        elif name == "#activitystats":
            df = make([(str(j), "") for j in context.statusTracker().getActiveJobsIds()], "name string, description string")
        elif name == "#clientsstats":
            df = make([(context.applicationId, context.sparkUser(), context.startTime)], "name string, user string, start_time long")
        elif name == "#replicationstats":
            df = make([(n.name, n.lsn, n.version) for n in self.namespaces.values()], "name string, last_lsn long, version long")
        elif name == "#clusterconfig":
            df = make([(k, v) for k, v in sorted(context.getConf().getAll()) if k.startswith(("spark.master", "spark.executor", "spark.cores"))], "name string, value string")
        else:
            raise QueryError(f"no system namespace {name!r}")
        return Namespace(name, df, {"name": Index("name", pk=True)})

    def add_index(self, ns: str, index: Index) -> None:
        self.get(ns).indexes[index.name] = index

    def drop_index(self, ns: str, name: str) -> None:
        if self.get(ns).indexes.pop(name, None) is None:
            raise QueryError(f"no index {name!r}")

    def rename(self, old: str, new: str) -> None:
        ns = self.namespaces.pop(old)
        ns.name = new
        self.namespaces[new] = ns

    def drop(self, name: str) -> None:
        self.get(name)
        del self.namespaces[name]

    def truncate(self, name: str) -> None:
        ns = self.get(name)
        gone = ns.df
        self.replace(name, self.spark.createDataFrame([], ns.df.schema))
        self.note(ns, "truncate", gone.limit(0))

    def replace(self, name: str, df: DataFrame) -> Namespace:
        """A new snapshot of a namespace."""
        ns = self.get(name)
        ns.df, ns.version, ns.texts, ns.base, ns.delta = df, ns.version + 1, {}, None, None
        ns.base_texts = {}
        self.save(ns)
        return ns

    def attach(self, folder: str) -> None:
        """Keep all namespaces in ``folder`` from now on: what is written is there when the session is gone."""
        self.folder = folder.rstrip("/")
        for ns in self.namespaces.values():
            self.save(ns)

    def save(self, ns: Namespace) -> None:
        """Tables that aren't in the folder yet, and a new manifest that names them."""
        if self.folder is None or self.held is not None:
            return
        root = f"{self.folder}/{ns.name}"
        kept = lambda d: d if (path_of(d) or "").startswith(root) else written(d, "data", root)
        if ns.delta is None:
            ns.df = kept(ns.df)
            tables = {"base": path_of(ns.df), "delta": None}
        else:
            ns.base, ns.delta = kept(ns.base), kept(ns.delta)
            ns.df = _merged(ns)
            tables = {"base": path_of(ns.base), "delta": path_of(ns.delta)}
        told = tables | {"name": ns.name, "indexes": [i.__dict__ for i in ns.indexes.values()], "meta": ns.meta, "schema": ns.schema, "version": ns.version, "lsn": ns.lsn}
        text = json.dumps(told, default=lambda v: None)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest/v={ns.version}")

    def vacuum(self, name: str) -> int:
        """Delete the tables of a durable namespace that its last manifest doesn't name; returns how many."""
        ns, jvm = self.get(name), self.spark._jvm
        if self.folder is None:
            raise QueryError("the database is attached to no folder")
        used = {p.rsplit("/", 1)[1] for d in (ns.df, ns.base, ns.delta) if (p := path_of(d))}
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in files.listStatus(root) if s.getPath().getName() not in used | {"manifest"}]
        for path in old:
            files.delete(path, True)
        return len(old)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, names: list[str]) -> Database:
        """The namespaces that a database attached to ``folder`` has left there, as of their last whole manifest."""
        db = cls(spark)
        db.folder = folder.rstrip("/")
        for name in names:
            last = spark.read.text(f"{db.folder}/{name}/manifest").orderBy(F.col("v").desc()).head()
            told = json.loads(last["value"])
            ns = Namespace(name, opened(spark, told["base"]), {i["name"]: Index(**i) for i in told["indexes"]}, told["meta"], told["schema"], told["version"], told["lsn"])
            if told["delta"]:
                ns.base, ns.delta = ns.df, opened(spark, told["delta"])
                ns.df = _merged(ns)
            db.namespaces[name] = ns
        return db

    #: Changed keys that are kept beside the table, as a share of its rows; beyond it the table is written anew.
    KEPT_APART = 0.2

    def write(self, name: str, changed: DataFrame | None, gone: DataFrame | None, op: str) -> Namespace:
        """Put ``changed`` rows, or drop those of the keys of ``gone``; both are tables of a row a key.

        Changes lie in a table of their own beside the unchanged one, so a small
        write costs its own size, and plans don't grow with the number of
        writes. When they are many, both are written as one.
        """
        ns = self.get(name)
        keys = [f"`{k}`" for k in ns.pk]
        fresh = changed.withColumn("_gone", F.lit(False)) if changed is not None else gone.select(*keys, F.lit(True).alias("_gone"))
        if ns.delta is not None:
            fresh = fresh.unionByName(ns.delta.join(fresh.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))), _same_keys(ns.pk), "left_anti"), allowMissingColumns=True)
        base = ns.base if ns.base is not None else ns.df
        if ns.delta is None:
            ns.base_texts = ns.texts
        ns.base, ns.delta = base, written(fresh, "delta")
        ns.df = _merged(ns)
        if ns.delta.count() > self.KEPT_APART * max(base.count(), 1):
            ns.df, ns.base, ns.delta, ns.base_texts = written(ns.df, "snapshot"), None, None, {}
        ns.version, ns.texts = ns.version + 1, {}
        self.save(ns)
        self.note(ns, op, changed if changed is not None else gone)
        return ns

    def note(self, ns: Namespace, op: str, items: DataFrame) -> None:
        """Tell the change log; within a transaction only when it is committed."""
        if self.log is None:
            return
        ns.lsn += 1
        event = (ns.name, op, items, ns.lsn)
        if self.held is not None:
            self.held.append(event)
        else:
            self.tell([event])

    def tell(self, events: list) -> None:
        if self.log is not None and events:
            self.log.append_all(events)

    def expire(self, name: str, now: int | None = None) -> None:
        """Drop the rows whose ttl fields are older than their index allows."""
        ns, now = self.get(name), int(time.time()) if now is None else now
        old = None
        for i in ns.indexes.values():
            if i.kind == "ttl":
                c = F.coalesce(F.col(i.name) < now - i.expire_after, F.lit(False))
                old = c if old is None else old | c
        if old is not None:
            if not ns.pk:
                raise QueryError(f"{name} needs a primary key")
            self.write(name, None, written(ns.df.where(old), "gone"), "delete")

    # meta values

    def put_meta(self, ns: str, key: str, value: str) -> None:
        self.get(ns).meta[key] = value

    def get_meta(self, ns: str, key: str) -> str | None:
        return self.get(ns).meta.get(key)

    def enum_meta(self, ns: str) -> list[str]:
        return sorted(self.get(ns).meta)

    def delete_meta(self, ns: str, key: str) -> None:
        self.get(ns).meta.pop(key, None)

    # queries

    def sql(self, text: str):
        from . import sqltext

        return self.run(sqltext.parse(text))

    def dsl(self, text: str | dict):
        from . import dsl

        return self.run(dsl.parse(text))

    def query(self, namespace: str):
        from .builder import Builder

        return Builder(self, namespace)

    def run(self, q):
        from .operators import modify
        from .plans import compile as c
        from .sqltext import encode

        start = time.perf_counter()
        out = c.run(self, q) if q.kind == "select" else modify.run(self, q)
        # planning, and what a statement runs on its own
        seconds = self.runs.setdefault(f"{q.namespace}\0{encode(q)}", [])
        seconds.append(time.perf_counter() - start)
        del seconds[:-100]
        while len(self.runs) > 1000:
            del self.runs[next(iter(self.runs))]
        return out
