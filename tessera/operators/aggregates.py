"""Aggregations over the rows that a query leaves, and the DISTINCT filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Aggregate, QueryError
from .predicates import Field, resolve


SCALARS = ("sum", "avg", "min", "max")


def number(df: DataFrame, a: Aggregate, ns) -> tuple[Field, Column]:
    """The field of a scalar aggregate, and how an element ``v`` is read as a double."""
    f = resolve(df, a.fields[0], ns)
    if isinstance(f.element, (T.StructType, T.MapType)) or (f.is_array and isinstance(f.element, T.FloatType)):
        raise QueryError(f"{a.kind} can't take {a.fields[0]}")
    v = F.col("v")
    return f, v.try_cast("double") if isinstance(f.element, T.StringType) else v.cast("double")


def scalar(df: DataFrame, a: Aggregate, ns) -> DataFrame:
    """sum, avg, min and max as doubles over all elements; null without any."""
    f, v = number(df, a, ns)
    rows = df.select(F.explode(f.values()).alias("v")) if f.is_array else df.select(f.col.alias("v"))
    return rows.agg(getattr(F, a.kind)(v).alias("value"))


def fused(df: DataFrame, wanted: list[Aggregate], ns) -> DataFrame:
    """All of some scalar aggregates in one pass: a row of ``value0``, ``value1``, ...; arrays are reduced in their rows first."""
    cols = []
    for i, a in enumerate(wanted):
        f, _ = number(df, a, ns)
        read = (lambda x: x.try_cast("double")) if isinstance(f.element, T.StringType) else (lambda x: x.cast("double"))
        if not f.is_array:
            cols.append(getattr(F, a.kind)(read(f.col)).alias(f"value{i}"))
            continue
        some = F.filter(F.transform(f.values(), read), lambda x: x.isNotNull())
        total = F.aggregate(some, F.lit(0.0), lambda s, x: s + x)
        if a.kind in ("min", "max"):
            cols.append(getattr(F, a.kind)(F.array_min(some) if a.kind == "min" else F.array_max(some)).alias(f"value{i}"))
        else:
            all_of_it = F.sum(F.when(F.size(some) > 0, total))
            cols.append((all_of_it / F.sum(F.size(some)) if a.kind == "avg" else all_of_it).alias(f"value{i}"))
    return df.agg(*cols)


def all_of(df: DataFrame, wanted: list[Aggregate], ns, counted: DataFrame) -> list[DataFrame]:
    """A table for each aggregate of a query; the scalar ones come from one pass."""
    scalars = [a for a in wanted if a.kind in SCALARS]
    row = fused(df, scalars, ns) if scalars else None
    out = []
    for a in wanted:
        if a.kind in SCALARS:
            place = next(i for i, s in enumerate(scalars) if s is a)
            out.append(row.select(F.col(f"value{place}").alias("value")))
        elif a.kind in ("count", "count_cached"):
            out.append(counted.agg(F.count("*").alias("value")))
        else:
            out.append({"facet": facet, "distinct": distinct}[a.kind](df, a, ns))
    return out


def facet(df: DataFrame, a: Aggregate, ns) -> DataFrame:
    """Counts by value, or by tuple; a single array counts each element. Values keep their types; in a tuple a missing string is ''."""
    fields = [resolve(df, n, ns) for n in a.fields]
    if len(fields) > 1 and any(f.is_array for f in fields):
        raise QueryError("a facet over several fields can't hold arrays")
    names = [n.replace(".", "_").replace("+", "_") for n in a.fields]
    if fields[0].is_array:
        rows = df.select(F.explode(fields[0].values()).alias(names[0]))
    else:
        rows = df.select(*(f.col.alias(n) for f, n in zip(fields, names, strict=True)))
    if len(fields) == 1:
        rows = rows.where(F.col(names[0]).isNotNull())
    else:
        rows = rows.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) if isinstance(f.kind, T.StringType) else F.col(n) for f, n in zip(fields, names, strict=True)))
    out = rows.groupBy(*names).agg(F.count("*").alias("count"))
    if a.sort:
        keys = []
        for s in a.sort:
            name = "count" if s.expr == "count" else names[a.fields.index(s.expr)]
            keys.append(F.col(name).desc() if s.desc else F.col(name).asc())
        used = {s.expr for s in a.sort}
        out = out.orderBy(*keys, *(F.col(n) for n, f in zip(names, a.fields, strict=True) if f not in used))
    elif a.limit is not None or a.offset:
        out = out.orderBy(*names)
    if a.offset:
        out = out.offset(a.offset)
    return out if a.limit is None else out.limit(a.limit)


def _zipped(fields: list[Field]) -> Column:
    """Values by position; scalars stand at every position, short arrays end in nulls."""
    longest = F.greatest(F.lit(1), *(F.size(f.values()) for f in fields if f.is_array)) if any(f.is_array for f in fields) else F.lit(1)
    return F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.struct(*((F.get(f.values(), i) if f.is_array else f.col).alias(f"d{k}") for k, f in enumerate(fields))))


def distinct(df: DataFrame, a: Aggregate, ns) -> DataFrame:
    fields = [resolve(df, n, ns) for n in a.fields]
    names = [n.replace(".", "_") for n in a.fields]
    if len(fields) == 1:
        f = fields[0]
        rows = df.select((F.explode(f.values()) if f.is_array else f.col).alias(names[0]))
        return rows.where(F.col(f"`{names[0]}`").isNotNull()).distinct()
    rows = df.select(F.explode(_zipped(fields)).alias("z")).select(*(F.col("z")[f"d{k}"].alias(n) for k, n in enumerate(names)))
    return rows.distinct()


def distinct_filter(df: DataFrame, aggregates: list[Aggregate], ns) -> DataFrame:
    """Keep the rows that bring a new value of any distinct field, in key order.

    The first key of every value comes from a grouped minimum (combined
    map-side), the rows by a semi join: no task gets all rows of a value.
    """
    wanted = [a for a in aggregates if a.kind == "distinct"]
    if not wanted:
        return df
    if not ns.pk:
        raise QueryError("DISTINCT needs a primary key")
    keys = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(ns.pk)]
    least = F.min(F.struct(*(f"_k{i}" for i in range(len(keys))))).alias("m")
    first = None
    for a in wanted:
        fields = [resolve(df, n, ns) for n in a.fields]
        if any(f.is_array for f in fields):
            rows = df.select(*keys, F.explode(_zipped(fields)).alias("z"))
        else:
            rows = df.select(*keys, F.struct(*(f.col.alias(f"d{k}") for k, f in enumerate(fields))).alias("z"))
        rows = rows.where(" or ".join(f"z.d{k} is not null" for k in range(len(fields))))
        ids = rows.groupBy("z").agg(least).select("m.*")
        first = ids if first is None else first.unionByName(ids)
    from .joins import _same

    return df.join(first.distinct(), _same(ns.pk), "left_semi")
