"""ORDER BY: fields, expressions, joined fields, forced orders, collations."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..spec import QueryError, Sort
from .predicates import comparable, custom_key, number_key, resolve

PLAIN = re.compile(r"""["']?([A-Za-z_#][\w#.+]*)["']?""")


def _point(text: str, df: DataFrame, ns, joined: dict[str, str]) -> tuple[Column, Column]:
    m = re.fullmatch(r"""ST_GeomFromText\s*\(\s*'\s*point\s*\(\s*(\S+)\s+(\S+)\s*\)\s*'\s*\)""", text.strip(), re.I)
    if m:
        return F.lit(float(m[1])), F.lit(float(m[2]))
    name = text.strip()
    head, _, tail = name.partition(".")
    if head in joined:
        return scalar.point(_only(joined[head])[tail], df.schema[joined[head]].dataType.elementType[tail].dataType)
    f = resolve(df, name, ns)
    return scalar.point(f.col, f.kind)


def _only(name: str) -> Column:
    """The single joined row; anything else is an error."""
    c = F.col(f"`{name}`")
    return F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.raise_error(F.lit(f"sorting by {name} needs one joined row")))


def key(df: DataFrame, s: Sort, ns, ranks: dict[str, Column], joined: dict[str, str], strict: str) -> Column:
    """The value that an entry sorts by."""
    expr = s.expr.strip()
    m = PLAIN.fullmatch(expr)
    if m and m[1] not in ("rank",):
        head, _, tail = m[1].partition(".")
        if head in joined and tail:
            return _only(joined[head])[tail]
        f = resolve(df, m[1], ns, strict)
        index = ns.index(m[1])
        if isinstance(f.element, T.StringType) and index and not f.is_array:
            if f.collate in ("ascii", "utf8"):
                return F.lower(f.col)
            if f.collate == "numeric":
                return number_key(f.col)
            if f.collate == "custom":
                return custom_key(f.col, index.order)
        return f.col

    def name(n: str) -> Column:
        head, _, tail = n.partition(".")
        if head in joined and tail:
            return _only(joined[head])[tail].cast("double")
        return resolve(df, n, ns, strict).col.cast("double")

    def call(fn: str, args: list[str]) -> Column:
        if fn == "abs":
            return F.abs(scalar.Arithmetic(args[0], name, call).parse())
        if fn == "rank":
            if not ranks:
                raise QueryError("rank() needs a ranked query")
            if not args:
                return ranks["rank"]
            which = ranks.get(args[0].strip())
            if which is None:
                raise QueryError(f"{args[0]} has no rank")
            return F.coalesce(which, F.lit(float(args[1]) if len(args) > 1 else 0.0))
        if fn == "st_distance":
            return scalar.distance(*_point(args[0], df, ns, joined), *_point(args[1], df, ns, joined))
        if fn == "hash":
            return F.hash(*ns.key(), F.lit(int(args[0]) if args else random.getrandbits(31))).cast("double")  # another order each time without a seed
        if fn == "rrf":
            if "rrf" not in ranks:
                raise QueryError("RRF is for hybrid queries")
            const = re.search(r"rank_const\s*=\s*([\d.]+)", args[0]) if args else None
            return ranks["rrf"](float(const[1]) if const else 60.0)
        raise QueryError(f"unknown function {fn!r}")

    m = re.fullmatch(r"ST_Distance\s*\((.*)\)", expr, re.I | re.S)
    if m:
        depth, cut = 0, None
        for i, c in enumerate(m[1]):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                cut = i
        return call("st_distance", [m[1][:cut], m[1][cut + 1 :]])
    return scalar.Arithmetic(expr, name, call).parse()


def order(df: DataFrame, sorts: list[Sort], ns, ranks: dict[str, Column], joined: dict[str, str], strict: str = "names") -> list[Column]:
    """Sort columns; nulls first ascending, ties by key (descending if the first entry is)."""
    out: list[Column] = []
    for s in sorts:
        if s.forced:
            f = resolve(df, s.expr, ns, strict)
            if f.is_array:
                raise QueryError("a forced order can't hold arrays")
            at = F.lit(None).cast("int")
            for i in reversed(range(len(s.forced))):
                read, lit = comparable(f, s.forced[i])
                at = F.when(read(f.col) == lit, i).otherwise(at)
            listed = F.coalesce(at, F.lit(len(s.forced)))
            out += [listed.desc(), f.col.desc()] if s.desc else [listed.asc(), f.col.asc()]
            continue
        k = key(df, s, ns, ranks, joined, strict)
        out.append(k.desc_nulls_last() if s.desc else k.asc_nulls_first())
    ties = ns.key()
    return out + [t.desc() if sorts and sorts[0].desc else t.asc() for t in ties]
