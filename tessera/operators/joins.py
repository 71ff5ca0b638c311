"""Joins as conditions, with matched rows attached as nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..spec import Join, QueryError
from .predicates import COMPARE, resolve, truth


def _condition(left: dict[str, Column], right: dict[str, Column], on: list) -> Column:
    out: Column | None = None
    for op, a, cond, b in on:
        c = COMPARE["eq" if cond == "set" else cond](left[a], right[b])
        if op == "or":
            if out is None:
                raise QueryError("ON can't begin with OR")
            last, rest = groups[-1], groups[:-1]
            groups[:] = [*rest, last | c]
        else:
            c = ~truth(c) if op == "not" else c
            if out is None:
                groups = [c]
            else:
                groups.append(c)
        out = c
    total = groups[0]
    for g in groups[1:]:
        total = total & g
    return total


def prepare(df: DataFrame, ns, keys: list[str], right: DataFrame, right_ns, join: Join) -> tuple[DataFrame, DataFrame, Column]:
    """Narrow sides with safe names, and the ON condition; array keys on the left are exploded."""
    lhs, rhs = df, right
    left_cols, right_cols = {}, {}
    for i, (_, a, _, b) in enumerate(join.on):
        f = resolve(lhs, a, ns, "names")
        name = f"_l{i}"
        lhs = lhs.withColumn(name, F.explode(f.values()) if f.is_array else f.col)
        left_cols[a] = F.col(name)
        g = resolve(rhs, b, right_ns, "names")
        rhs = rhs.withColumn(f"_r{i}", F.explode(g.values()) if g.is_array else g.col)
        right_cols[b] = F.col(f"_r{i}")
    narrow = lhs.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), *(f"_l{i}" for i in range(len(join.on))))
    return narrow, rhs, _condition(left_cols, right_cols, join.on)


def simple(df: DataFrame, ns, right: DataFrame, right_ns, join: Join) -> bool:
    """Scalar keys compared with AND alone: the join needs no key of the left side."""
    scalar = all(not resolve(df, a, ns).is_array and not resolve(right, b, right_ns).is_array for _, a, _, b in join.on)
    return scalar and all(op == "and" for op, *_ in join.on)


def matching(df: DataFrame, ns, right: DataFrame, right_ns, join: Join, keep: bool = True) -> DataFrame:
    """Rows with (or without) a match: a semi or anti join."""
    how = "left_semi" if keep else "left_anti"
    if simple(df, ns, right, right_ns, join):
        if (bound := bounded(df, ns, right, right_ns, join)) is not None:
            rows, test = bound
            return rows.where(test if keep else ~truth(test)).select(*df.columns)
        lhs, rhs = df, right
        names = []
        for i, (_, a, cond, b) in enumerate(join.on):
            lhs = lhs.withColumn(f"_l{i}", resolve(df, a, ns).col)
            names.append(resolve(right, b, right_ns).col.alias(f"_r{i}"))
        rhs = right.select(*names)
        cond = _condition({a: F.col(f"_l{i}") for i, (_, a, _, _) in enumerate(join.on)}, {b: F.col(f"_r{i}") for i, (*_, b) in enumerate(join.on)}, join.on)
        return lhs.join(rhs, cond, how).drop(*(f"_l{i}" for i in range(len(join.on))))
    keys = ns.pk
    narrow, rhs, cond = prepare(df, ns, keys, right, right_ns, join)
    found = narrow.join(rhs.select(*(f"_r{i}" for i in range(len(join.on)))), cond, "left_semi").select(*(f"_k{i}" for i in range(len(keys)))).distinct()
    on = _same(keys)
    return df.join(found, on, how)


def bounded(df: DataFrame, ns, right: DataFrame, right_ns, join: Join) -> tuple[DataFrame, Column] | None:
    """For one inequality beside equalities: ``df`` with the right side's extreme (by the equal keys), and the test against it.

    A row matches some right row just if it matches the largest (or least) one.
    """
    odd = [(i, c) for i, (_, _, c, _) in enumerate(join.on) if c not in ("eq", "set")]
    if len(odd) != 1:
        return None
    at, cond = odd[0]
    lefts = [resolve(df, a, ns).col for _, a, _, _ in join.on]
    rights = [resolve(right, b, right_ns).col.alias(f"_r{i}") for i, (*_, b) in enumerate(join.on)]
    extreme = (F.max if cond in ("lt", "le") else F.min)(f"_r{at}").alias("_x")
    equal = [i for i in range(len(join.on)) if i != at]
    test = COMPARE[cond](lefts[at], F.col("_x"))
    if not equal:
        return df.crossJoin(F.broadcast(right.select(*rights).agg(extreme))), test  # a single row
    best = right.select(*rights).groupBy(*(f"_r{i}" for i in equal)).agg(extreme)
    on = lefts[equal[0]] == F.col(f"_r{equal[0]}")
    for i in equal[1:]:
        on = on & (lefts[i] == F.col(f"_r{i}"))
    return df.join(best, on, "left"), test


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        c = F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
        on = c if i == 0 else on & c
    return on


def flagged(df: DataFrame, ns, right: DataFrame, right_ns, join: Join, flag: str) -> DataFrame:
    """A boolean column: has the row a match? For joins inside OR and brackets."""
    keys = ns.pk
    if not keys:
        raise QueryError("a join inside OR or a bracket needs a primary key")
    if simple(df, ns, right, right_ns, join) and (bound := bounded(df, ns, right, right_ns, join)) is not None:
        rows, test = bound
        return rows.withColumn(flag, truth(test)).select(*df.columns, flag)
    equi = simple(df, ns, right, right_ns, join) and all(c in ("eq", "set") for _, _, c, _ in join.on)
    if equi:
        found = right.select(*(resolve(right, b, right_ns).col.alias(f"_r{i}") for i, (*_, b) in enumerate(join.on))).distinct().withColumn(flag, F.lit(True))
        cond = None
        for i, (_, a, _, _) in enumerate(join.on):
            c = resolve(df, a, ns).col == F.col(f"_r{i}")
            cond = c if cond is None else cond & c
        out = df.join(found, cond, "left").drop(*(f"_r{i}" for i in range(len(join.on))))
    else:
        narrow, rhs, cond = prepare(df, ns, keys, right, right_ns, join)
        found = narrow.join(rhs.select(*(f"_r{i}" for i in range(len(join.on)))), cond, "left_semi").select(*(f"_k{i}" for i in range(len(keys)))).distinct().withColumn(flag, F.lit(True))
        out = df.join(found, _same(keys), "left").drop(*(f"_k{i}" for i in range(len(keys))))
    return out.withColumn(flag, truth(F.col(flag)))


def attach(df: DataFrame, ns, right: DataFrame, right_ns, join: Join, name: str, order: list[Column], fields: list[str]) -> DataFrame:
    """An array column of the matched rows, in order, at most ``limit`` a left row; empty without any.

    Where all conditions are equalities of scalars, right rows are gathered by
    their own keys once, and neither side is read twice.
    """
    keys = ns.pk
    if simple(df, ns, right, right_ns, join) and all(c in ("eq", "set") for _, _, c, _ in join.on):
        return _attach_by_key(df, ns, right, right_ns, join, name, order, fields)
    if not keys:
        raise QueryError("joined rows need a primary key on the left side")
    narrow, rhs, cond = prepare(df.select(*df.columns), ns, keys, right, right_ns, join)
    ks = [f"_k{i}" for i in range(len(keys))]
    order = order or right_ns.key()
    # what a right row shows, and where it stands: both belong to its side of the join
    shown = rhs.select(F.struct(*(F.col(f"`{f}`") for f in fields)).alias("_row"), F.struct(*(F.col(f"`{c}`") for c in right_ns.pk) or [F.lit(0)]).alias("_id"), *(f"_r{i}" for i in range(len(join.on))), *(o.alias(f"_o{i}") for i, (o, _) in enumerate(_parts(order))))
    matched = narrow.join(shown, cond).dropDuplicates([*ks, "_id"]) if right_ns.pk else narrow.join(shown, cond)
    place = W.partitionBy(*ks).orderBy(*((F.col(f"_o{i}").desc() if desc else F.col(f"_o{i}")) for i, (_, desc) in enumerate(_parts(order))))
    ranked = matched.withColumn("_n", F.row_number().over(place))
    if join.query.limit is not None:
        ranked = ranked.where(F.col("_n") <= join.query.limit)
    rows = ranked.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("_n", "_row"))).alias("_rows")).select(*ks, F.transform("_rows", lambda r: r["_row"]).alias(name))
    kind = rows.schema[name].dataType
    out = df.join(rows, _same(keys), "left").drop(*ks)
    return out.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(T.ArrayType(kind.elementType))))


def _attach_by_key(df: DataFrame, ns, right: DataFrame, right_ns, join: Join, name: str, order: list, fields: list[str]) -> DataFrame:
    rs = [f"_r{i}" for i in range(len(join.on))]
    parts = _parts(order or right_ns.key())
    shown = right.select(
        F.struct(*(F.col(f"`{f}`") for f in fields)).alias("_row"),
        *(resolve(right, b, right_ns).col.alias(r) for r, (*_, b) in zip(rs, join.on, strict=True)),
        *(o.alias(f"_o{i}") for i, (o, _) in enumerate(parts)),
        *(k.alias(f"_t{i}") for i, k in enumerate(right_ns.key())),
    ).where(" and ".join(f"{r} is not null" for r in rs))
    place = W.partitionBy(*rs).orderBy(*(F.col(f"_o{i}").desc() if desc else F.col(f"_o{i}") for i, (_, desc) in enumerate(parts)), *(f"_t{i}" for i in range(len(right_ns.key()))))
    ranked = shown.withColumn("_n", F.row_number().over(place))
    if join.query.limit is not None:
        ranked = ranked.where(F.col("_n") <= join.query.limit)
    rows = ranked.groupBy(*rs).agg(F.array_sort(F.collect_list(F.struct("_n", "_row"))).alias("_rows")).select(*rs, F.transform("_rows", lambda r: r["_row"]).alias(name))
    kind = rows.schema[name].dataType
    on = None
    for r, (_, a, _, _) in zip(rs, join.on, strict=True):
        c = resolve(df, a, ns).col == F.col(r)
        on = c if on is None else on & c
    out = df.join(rows, on, "left").drop(*rs)
    return out.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(T.ArrayType(kind.elementType))))


def _parts(order: list) -> list[tuple[Column, bool]]:
    return [o if isinstance(o, tuple) else (o, False) for o in order]
