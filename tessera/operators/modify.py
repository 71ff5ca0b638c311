"""Writes as new snapshots: upsert by key, UPDATE, DELETE, TRUNCATE, transactions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from math import isqrt
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import scalar
from ..plans.compile import Plan, Result
from ..spec import Query, QueryError
from ..storage import written
from .joins import _same
from .predicates import resolve


def _keyed(db, name: str):
    ns = db.get(name)
    if not ns.pk:
        raise QueryError(f"{name} needs a primary key")
    return ns


def reduced(items: DataFrame, keys: list[str], last: bool = True, order: str | None = None) -> DataFrame:
    """A row a key: the last (or first) one by ``order``, or as the rows come."""
    names = items.columns
    at = F.col(f"`{order}`") if order else F.monotonically_increasing_id()
    pick = (F.max_by if last else F.min_by)(F.struct(*(F.col(f"`{n}`") for n in names)), F.col("_at"))
    return items.withColumn("_at", at).groupBy(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys))).agg(pick.alias("_row")).select("_row.*")


def _keys(df: DataFrame, ns) -> DataFrame:
    return df.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(ns.pk)))


def apply(db, name: str, items: DataFrame, mode: str, order: str | None = None) -> None:
    """insert, update, upsert or delete items by key; inserts of present keys and updates of missing ones do nothing.

    Of several items with one key the last counts (``order`` says by which
    column), of inserts the first.
    """
    if mode not in ("insert", "update", "upsert", "delete"):
        raise QueryError(f"unknown mode {mode!r}")
    ns = _keyed(db, name)
    if mode == "delete":
        here = ns.df.join(_keys(items, ns).distinct(), _same(ns.pk), "left_semi")
        return db.write(name, None, written(here, "gone"), mode)
    rows = reduced(items, ns.pk, mode != "insert", order)
    if mode in ("insert", "update"):
        rows = rows.join(_keys(ns.df, ns), _same(ns.pk), "left_anti" if mode == "insert" else "left_semi")
    db.write(name, written(embedded(db, ns, rows), "changed"), None, mode)


def embedded(db, ns, items: DataFrame) -> DataFrame:
    """``items`` with the vectors that an index makes of other fields.

    ``config["embed"]`` names the ``fields`` and a ``strategy``: ``always``,
    ``empty_only`` (missing vectors), or ``strict`` (given ones are an error).
    """
    for index in ns.indexes.values():
        wanted, make = index.config.get("embed"), db.embedders.get(index.name)
        if not wanted or make is None:
            continue
        strategy = wanted.get("strategy", "always")
        text = F.concat_ws(" ", *(F.col(f"`{f}`").cast("string") for f in wanted["fields"]))
        made = _vectors(make)(text)
        if index.name in items.columns:
            given = F.col(f"`{index.name}`").isNotNull() & (F.size(f"`{index.name}`") > 0)
            if strategy == "empty_only":
                made = F.when(given, F.col(f"`{index.name}`")).otherwise(made)
            elif strategy == "strict":
                made = F.when(given, F.raise_error(F.lit(f"{index.name} is made by an embedder")).cast("array<float>")).otherwise(made)
        items = items.withColumn(index.name, made)
    return items


def _vectors(make: Callable[[str], list[float]]):
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(x) for x in make(t)])

    return run


def precepts(db, name: str, items: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``field=serial()`` and ``field=now(unit)`` on items before they are written."""
    ns = _keyed(db, name)
    for f, rule in rules.items():
        fn, arg = re.fullmatch(r"(serial|now)\((\w*)\)", rule).groups()
        if fn == "now":
            items = items.withColumn(f, scalar.now(arg or "sec"))
        else:
            last = int(ns.meta.get(f"_SERIAL_{f}", 0))
            items, total = numbered(items, ns.pk, f, last)
            ns.meta[f"_SERIAL_{f}"] = str(last + total)
    return items


def numbered(items: DataFrame, keys: list[str], name: str, last: int) -> tuple[DataFrame, int]:
    """Numbers without gaps after ``last``, and how many: ranks in hash groups of the key, behind the groups before."""
    total = items.count()
    dealt = items.withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(max(1, isqrt(total) // 16))))
    sizes = dealt.groupBy("_g").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("_g").alias("_of"), (F.sum("_n").over(W.orderBy("_g")) - F.col("_n")).alias("_start"))  # a row a group
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("_g").orderBy(*keys)))
    out = ranked.join(starts, F.col("_g") == F.col("_of")).withColumn(name, (F.col("_start") + F.col("_rank") + last).cast("long"))
    return out.drop("_g", "_of", "_start", "_rank"), total


class Transaction:
    """Steps that become one snapshot: the last one on a key wins."""

    def __init__(self, db, name: str):
        self.db, self.name, self.steps, self.queries = db, name, [], []

    def put(self, items: DataFrame, mode: str = "upsert") -> Transaction:
        self.steps.append((mode, items))
        return self

    def query(self, q: Query) -> Transaction:
        if q.joins:
            raise QueryError("no joins in a transaction")
        self.steps.append(("query", q))
        return self

    def rollback(self) -> None:
        self.steps.clear()

    def commit(self) -> None:
        """All steps, or none: on an error the namespace, its meta values and its log are as before."""
        ns = _keyed(self.db, self.name)
        before, held = ns.state(), self.db.held
        self.db.held = []
        try:
            for mode, what in self.steps:
                run(self.db, what) if mode == "query" else apply(self.db, self.name, what, mode)
            events = self.db.held
        except Exception:
            ns.restore(before)
            raise
        finally:
            self.db.held = held
        ns.version = before["version"] + 1
        self.db.save(ns)
        self.db.tell(events)
        self.steps.clear()


def run(db, q: Query) -> Result:
    if q.kind == "truncate":
        touched = db.get(q.namespace).df
        db.truncate(q.namespace)
        return Result(touched, counted=touched, db=db, query=q)
    ns = _keyed(db, q.namespace)
    plan = Plan(db, q)
    rows = plan.limited().select(*(F.col(f"`{c}`") for c in plan.base))
    if q.kind == "delete":
        gone = written(rows, "gone")
        db.write(q.namespace, None, gone, "delete")
        return Result(gone, counted=gone, db=db, query=q)
    df, serials = rows, {}
    for name, how, value in q.changes:
        if how == "expr" and re.search(r"\bserial\s*\(", str(value)) and name not in serials:
            last = int(ns.meta.get(f"_SERIAL_{name}", 0))
            df, total = numbered(df if not serials else written(df, "numbered"), ns.pk, f"_serial_{len(serials)}", last)
            serials[name] = (f"_serial_{len(serials)}", last + total)
    df = df.withColumn("_hit", F.lit(True))
    for name, how, value in q.changes:
        df = change(df, ns, name, how, value, serials.get(name, (None,))[0])
    touched = written(embedded(db, ns, df.drop("_hit", *(c for c, _ in serials.values()))), "changed")
    for name, (_, last) in serials.items():
        ns.meta[f"_SERIAL_{name}"] = str(last)
    db.write(q.namespace, touched, None, "update")
    return Result(touched, counted=touched, db=db, query=q)


def expression(df: DataFrame, ns, text: str, serial: str | None = None) -> Column:
    """The right side of SET: arithmetic in doubles, ``||`` and array functions on arrays."""
    arrays = bool(re.search(r"\|\||array_remove", text))

    def name(n: str) -> Column:
        f = resolve(df, n, ns)
        if arrays:
            return f.col if f.is_array else F.array(f.col)
        if isinstance(f.element, (T.StringType, T.BooleanType)):
            raise QueryError(f"{n} isn't a number")
        return f.col.cast("double")

    def call(fn: str, args: list[str]) -> Column:
        if fn == "now":
            return scalar.now(*[a for a in args if a])
        if fn == "serial":
            return F.col(serial)
        if fn == "flat_array_len":
            f = resolve(df, args[0], ns, "none")
            return scalar.flat_array_len(f.col, f.kind)
        if fn in ("array_remove", "array_remove_once"):
            arr = scalar.Arithmetic(args[0], name, call, True).parse()
            items = scalar.Arithmetic(args[1], name, call, True).parse()
            kind = df.select(items).schema.fields[0].dataType
            items = items if isinstance(kind, T.ArrayType) else F.array(items)
            inner = df.select(arr).schema.fields[0].dataType
            return getattr(scalar, fn)(arr, items.cast(inner))
        raise QueryError(f"unknown function {fn!r}")

    return scalar.Arithmetic(text, name, call, True).parse()


def literal(value: Any, kind: T.DataType | None) -> Column:
    if isinstance(value, dict):
        return F.from_json(F.lit(json.dumps(value)), kind) if isinstance(kind, (T.StructType, T.MapType)) else F.from_json(F.lit(json.dumps(value)), F.schema_of_json(F.lit(json.dumps(value))))
    if isinstance(value, (list, tuple)):
        out = F.array(*(F.lit(v) for v in value))
        return out.cast(kind) if kind is not None and isinstance(kind, T.ArrayType) else out
    return F.lit(value).cast(kind) if kind is not None else F.lit(value)


def change(df: DataFrame, ns, name: str, how: str, value: Any, serial: str | None = None) -> DataFrame:
    """One SET or DROP on the rows marked ``_hit``; nested paths and array elements included."""
    steps = re.findall(r"[^.\[\]]+|\[(?:\d+|\*)\]", name)
    top, rest = steps[0], steps[1:]
    hit = F.col("_hit")
    if how == "drop" and not rest:
        if ns.index(top):
            raise QueryError(f"{top} is indexed and can't be dropped")
        return df.withColumn(top, F.when(hit, F.lit(None)).otherwise(F.col(f"`{top}`"))) if top in df.columns else df
    old = F.col(f"`{top}`") if top in df.columns else None
    kind = df.schema[top].dataType if top in df.columns else None

    def new(k: T.DataType | None) -> Column:
        return expression(df, ns, value, serial) if how == "expr" else literal(value, k)

    def put(col: Column | None, k: T.DataType | None, path: list[str]) -> Column:
        if not path:
            v = new(k)
            return v.cast(k) if k is not None and not isinstance(k, (T.StructType, T.MapType)) else v
        step = path[0]
        if step[0] == "[":
            at = step[1:-1]
            same = lambda i: F.lit(True) if at == "*" else i == int(at)
            if how == "drop" and len(path) == 1:
                return F.filter(col, lambda x, i: ~same(i))
            return F.transform(col, lambda x, i: F.when(same(i), put(x, k.elementType, path[1:])).otherwise(x))
        if isinstance(k, T.ArrayType):
            return F.transform(col, lambda x: put(x, k.elementType, path))
        if how == "drop" and len(path) == 1:
            return col.withField(step, F.lit(None).cast(k[step].dataType))
        inner = k[step].dataType if isinstance(k, T.StructType) and step in k.names else None
        if col is None or not isinstance(k, T.StructType):
            return F.struct(put(None, None, path[1:]).alias(step))
        blank = F.coalesce(col, F.from_json(F.lit("{}"), k))
        return blank.withField(step, put(col[step] if inner is not None else None, inner, path[1:]))

    value_col = put(old, kind, rest)
    if old is None:
        return df.withColumn(top, F.when(hit, value_col))
    if rest and kind is not None and isinstance(kind, T.StructType):
        target = df.select(value_col.alias("x")).schema["x"].dataType
        if target != kind:  # a new nested field: the other rows get it empty
            base = F.from_json(F.to_json(old), target)
            return df.withColumn(top, F.when(hit, value_col).otherwise(base))
    return df.withColumn(top, F.when(hit, value_col).otherwise(old))
