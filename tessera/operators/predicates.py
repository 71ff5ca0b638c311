"""Conditions as Columns, in two-valued logic: what is null counts as false, before it is negated."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..spec import Bracket, Entry, FieldRef, Filter, Func, QueryError


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass
class Field:
    """A path resolved against a schema."""

    col: Column
    kind: T.DataType | None
    collate: str = "none"
    indexed_array: bool = False

    @property
    def is_array(self) -> bool:
        return isinstance(self.kind, T.ArrayType)

    @property
    def element(self) -> T.DataType | None:
        kind = self.kind
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return kind

    def values(self) -> Column:
        """A flat array of the field's values."""
        if not self.is_array:
            return F.when(self.col.isNotNull(), F.array(self.col))
        col, kind = self.col, self.kind
        while isinstance(kind.elementType, T.ArrayType):
            col, kind = F.flatten(F.filter(col, lambda x: x.isNotNull())), kind.elementType
        return col


def _pick(name: str):
    return lambda x: x[name]


def resolve(df: DataFrame, path: str, ns: Any = None, strict: str = "names") -> Field:
    """A field by index name, composite name or dotted path; arrays on the way are flattened."""
    index = ns.index(path) if ns else None
    if path in df.columns:
        return Field(F.col(f"`{path}`"), df.schema[path].dataType, index.collate if index else "none", bool(index and (index.array or len(index.paths) > 1)))
    if "+" in path:
        parts = [resolve(df, p, ns, strict) for p in path.split("+")]
        return Field(F.struct(*(p.col.alias(f"c{i}") for i, p in enumerate(parts))), T.StructType([T.StructField(f"c{i}", p.kind) for i, p in enumerate(parts)]))
    if strict == "indexes" and not index:
        raise QueryError(f"{path!r} has no index")
    if path.startswith('"') or not path:
        raise QueryError(f"bad field {path!r}")
    steps = re.findall(r"[^.\[\]]+|\[(?:\d+|\*)\]", path)
    if steps[0] not in df.columns:
        if strict == "none":
            return Field(F.lit(None), None)
        raise QueryError(f"no field {path!r}")
    col, kind = F.col(f"`{steps[0]}`"), df.schema[steps[0]].dataType
    for step in steps[1:]:
        if step == "[*]":
            continue
        if step[0] == "[":
            col, kind = F.get(col, F.lit(int(step[1:-1]))), kind.elementType
        elif isinstance(kind, T.StructType) and step in kind.names:
            col, kind = col[step], kind[step].dataType
        elif isinstance(kind, T.MapType):
            col, kind = col[step], kind.valueType
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and step in kind.elementType.names:
            inner = kind.elementType[step].dataType
            col = F.transform(col, _pick(step))
            if isinstance(inner, T.ArrayType):
                col, kind = F.flatten(F.filter(col, lambda x: x.isNotNull())), inner
            else:
                kind = T.ArrayType(inner)
        elif isinstance(kind, T.VariantType):
            col, kind = F.try_variant_get(col, f"$.{step}", "string"), T.StringType()
        elif strict == "none":
            return Field(F.lit(None), None)
        else:
            raise QueryError(f"no field {path!r}")
    return Field(col, kind, index.collate if index else "none")


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def comparable(field: Field, value: Any) -> tuple[Any, Column | None]:
    """How an element is read, and the literal it is compared with; None if the types don't compare."""
    kind = field.element
    fold = {"ascii": F.lower, "utf8": F.lower}.get(field.collate)
    if isinstance(value, tuple) and isinstance(kind, T.StructType):
        return lambda x: x, F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    if isinstance(kind, T.StringType):
        text = str(value).lower() if isinstance(value, bool) else str(value)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return lambda x: x.try_cast("double"), F.lit(float(value))
        if field.collate == "numeric":
            return number_key, number_key(F.lit(text))
        return fold or (lambda x: x), fold(F.lit(text)) if fold else F.lit(text)
    if isinstance(kind, NUMERIC):
        if isinstance(value, bool):
            return lambda x: x, F.lit(int(value))
        if isinstance(value, str):
            try:
                return lambda x: x.cast("double"), F.lit(float(value))
            except ValueError:
                return lambda x: x, None
        return lambda x: x, F.lit(value)
    if isinstance(kind, T.BooleanType):
        return lambda x: x, F.lit(value if isinstance(value, bool) else str(value).lower() in ("1", "true", "1.0"))
    return lambda x: x, F.lit(value) if value is not None else None


def number_key(c: Column) -> Column:
    """Of the numeric collation: the leading integer, then the rest."""
    lead = F.regexp_extract(c, r"^\s*([-+]?[0-9]+)", 1)
    return F.struct(F.coalesce(lead.try_cast("bigint"), F.lit(0)).alias("n"), F.regexp_replace(c, r"^\s*[-+]?[0-9]+", "").alias("r"))


def custom_key(c: Column, order: str) -> Column:
    """Of a custom collation: listed characters first, in order."""
    return F.translate(c, order, "".join(chr(0xE000 + i) for i in range(len(order))))


COMPARE = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b}


def like_pattern(p: str) -> str:
    return p.replace("\\", "\\\\")


def element_test(field: Field, cond: str, value: Any):
    """A function from one element to a boolean Column."""
    if cond in ("eq", "match", "lt", "le", "gt", "ge"):
        read, lit = comparable(field, value)
        return lambda x: F.lit(False) if lit is None else COMPARE["eq" if cond == "match" else cond](read(x), lit)
    if cond == "set":
        pairs = [comparable(field, v) for v in value if v is not None]
        pairs = [(r, v) for r, v in pairs if v is not None]
        if not pairs:
            return lambda x: F.lit(False)
        if all(type(v) is type(value[0]) for v in value):
            return lambda x: pairs[0][0](x).isin(*(v for _, v in pairs)) if not isinstance(value[0], tuple) else _any([x == v for _, v in pairs])
        return lambda x: _any([truth(r(x) == v) for r, v in pairs])
    if cond == "range":
        lo, hi = (comparable(field, v) for v in value)
        if lo[1] is None or hi[1] is None:
            return lambda x: F.lit(False)
        return lambda x: (lo[0](x) >= lo[1]) & (hi[0](x) <= hi[1])
    if cond == "like":
        return lambda x: x.cast("string").ilike(like_pattern(str(value)))
    raise QueryError(f"{cond} can't be tested on elements")


def _any(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def leaf(df: DataFrame, f: Filter, ns: Any = None, strict: str = "names") -> Column:
    """One condition without subqueries; null counts as false (bare comparisons reach the scan)."""
    if isinstance(f.left, Func):
        if f.left.name == "flat_array_len":
            if f.cond not in ("eq", "set", "lt", "le", "gt", "ge", "range"):
                raise QueryError("flat_array_len takes comparisons only")
            inner = resolve(df, f.left.args[0], ns, "none")
            field = Field(scalar.flat_array_len(inner.col, inner.kind).cast("long"), T.LongType())
        else:
            field = Field(scalar.now(*f.left.args), T.LongType())
    else:
        field = resolve(df, f.left, ns, strict)
    if field.kind is None:
        return F.lit(f.cond == "empty")
    if f.cond == "dwithin":
        (x, y), d = f.value
        px, py = scalar.point(field.col, field.kind)
        index = ns.index(f.left) if ns and isinstance(f.left, str) else None
        bx, by = (F.col(index.config["x"]), F.col(index.config["y"])) if index and "x" in index.config else (px, py)
        box = bx.between(x - d, x + d) & by.between(y - d, y + d)  # pushed down where the parts are columns
        return box & ((px - x) * (px - x) + (py - y) * (py - y) <= F.lit(float(d)) * float(d))
    if f.cond == "empty":
        if not field.is_array:
            return field.col.isNull()
        has_null = F.lit(False) if field.indexed_array else F.exists(field.values(), lambda x: x.isNull())
        return field.col.isNull() | truth(F.size(field.values()) <= 0) | truth(has_null)
    if f.cond == "any":
        if not field.is_array:
            return field.col.isNotNull()
        if isinstance(field.element, T.FloatType):
            return truth(field.col.isNotNull() & (F.size(field.col) > 0))
        return truth(F.exists(field.values(), lambda x: x.isNotNull()))
    if isinstance(f.value, FieldRef):
        other = resolve(df, f.value.name, ns, strict)
        test = COMPARE.get({"set": "eq"}.get(f.cond, f.cond))
        if not test or other.kind is None:
            return F.lit(False)
        cast = (lambda c: c.try_cast("double")) if isinstance(field.element, T.StringType) != isinstance(other.element, T.StringType) else (lambda c: c)
        if not field.is_array and not other.is_array:
            return test(cast(field.col), cast(other.col))
        return truth(F.exists(field.values(), lambda a: F.exists(other.values(), lambda b: truth(test(cast(a), cast(b))))))
    if isinstance(f.value, Func):
        return COMPARE[f.cond](field.col, scalar.now(*f.value.args))
    if f.cond == "allset":
        tests = [element_test(field, "eq", v) for v in dict.fromkeys(f.value)]
        if not tests:
            return F.lit(False)
        checks = [truth(F.exists(field.values(), t)) if field.is_array else truth(t(field.col)) for t in tests]
        out = checks[0]
        for c in checks[1:]:
            out = out & c
        return out
    cond, value = f.cond, f.value
    if isinstance(value, list) and cond in ("eq", "match"):
        cond = "set"
    test = element_test(field, cond, value)
    return F.exists(field.values(), test) if field.is_array else test(field.col)


def fold(parts: list[tuple[str, Column]]) -> Column:
    """Left to right: OR joins the result just before; NOT and AND start a new one. Null is false, so only NOT has to replace it."""
    groups: list[Column] = []
    for op, c in parts:
        if op == "or":
            if not groups:
                raise QueryError("OR can't stand before the first condition")
            groups[-1] = groups[-1] | c
        else:
            groups.append(~truth(c) if op == "not" else c)
    out = groups[0] if groups else F.lit(True)
    for g in groups[1:]:
        out = out & g
    return out


def equal_position(df: DataFrame, entries: list[Entry], fields: list[str], ns: Any, strict: str) -> tuple[Column, list[Entry]]:
    """All conditions on ``fields`` hold at one index; the entries that this covers."""
    covered = [e for e in entries if isinstance(e.item, Filter) and e.item.left in fields]
    if not covered:
        raise QueryError("equal_position needs conditions on its fields")
    named = {n: resolve(df, n.replace("[#]", "").replace("[*]", ""), ns, strict) for n in fields}
    grouped = {n: _grouped(df, n, named[n], ns, strict) for n in fields}
    longest = F.greatest(F.lit(0), *(F.size(g) for g, _ in grouped.values()))

    def holds(i: Column) -> Column:
        parts = []
        for e in covered:
            values, nested = grouped[e.item.left]
            test = element_test(Field(named[e.item.left].col, named[e.item.left].element), e.item.cond, e.item.value)
            at = F.get(values, i)
            parts.append((e.op, truth(F.exists(at, test)) if nested else truth(test(at))))
        return fold([("and" if k == 0 and op == "or" else op, c) for k, (op, c) in enumerate(parts)])

    return truth(F.exists(F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), lambda i: (i < longest) & holds(i))), covered


def _grouped(df: DataFrame, path: str, field: Field, ns: Any, strict: str) -> tuple[Column, bool]:
    """Values by the index that ``[#]`` marks; nested if a group holds several."""
    if "[#]" not in path:
        return (field.values() if field.is_array else F.array(field.col)), False
    head, _, tail = path.partition("[#]")
    if "[*]" in head:  # a[*].b[#]: transpose
        outer = resolve(df, head.replace("[*]", "").rpartition(".")[0], ns, strict)
        inner = head.rpartition(".")[2]
        lists = F.transform(outer.col, lambda x: x[inner])
        most = F.coalesce(F.array_max(F.transform(lists, lambda x: F.size(x))), F.lit(0))
        groups = F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda i: F.transform(lists, lambda x: F.get(x, i)))
        return F.when(most > 0, groups).otherwise(F.slice(groups, 1, 0)), True
    outer = resolve(df, head, ns, strict)
    rest = [s for s in tail.replace("[*]", "").split(".") if s]
    kind = outer.kind.elementType

    def down(x: Column) -> Column:
        k = kind
        for s in rest:
            if isinstance(k, T.ArrayType):
                x, k = F.transform(x, _pick(s)), T.ArrayType(k.elementType[s].dataType)
            else:
                x, k = x[s], k[s].dataType
        return x if isinstance(k, T.ArrayType) else F.array(x)

    return F.transform(outer.col, down), True


def compile_entries(df: DataFrame, entries: list[Entry], positions: list[list[str]], ns: Any, strict: str, special, bare: bool = False) -> Column:
    """A condition list as one Column; ``special`` gives the flag of joins, rank conditions and subqueries.

    ``bare`` leaves null for false, for filters: comparisons under ``coalesce`` wouldn't be pushed to the scan.
    """
    extra: list[tuple[str, Column]] = []
    covered: list[int] = []
    for fields in positions:
        col, used = equal_position(df, entries, fields, ns, strict)
        extra.append(("and", col))
        covered += [id(e) for e in used]
    parts = []
    for e in entries:
        if id(e) in covered:
            continue
        if isinstance(e.item, Bracket):
            col = compile_entries(df, e.item.entries, e.item.equal_positions, ns, strict, special, True)
        else:
            col = special(e)
            if col is None:
                col = leaf(df, e.item, ns, strict)
        parts.append(("and" if not parts and e.op == "or" else e.op, col))
    out = fold(parts + extra)
    return out if bare else truth(out)
