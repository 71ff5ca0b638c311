"""The query model that SQL, JSON and the builder share.

A condition list is evaluated left to right without precedence: OR joins an
entry to the result just before it, NOT holds for one entry.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

CONDITIONS = {"any", "eq", "lt", "le", "gt", "ge", "range", "set", "allset", "empty", "like", "dwithin", "knn", "match"}


class QueryError(ValueError):
    """A query that the model doesn't allow."""


@dataclass
class Func:
    """``flat_array_len(field)`` or ``now(unit)`` in a condition."""

    name: str
    args: list[str] = field(default_factory=list)


@dataclass
class FieldRef:
    name: str


@dataclass
class Filter:
    """``field cond value``; the left side may be a function or a subquery, the right a field, function or subquery."""

    left: str | Func | Query
    cond: str
    value: Any = None


@dataclass
class Knn:
    field: str
    vector: list[float] | str
    k: int | None = None
    radius: float | None = None
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class Bracket:
    entries: list[Entry]
    equal_positions: list[list[str]] = field(default_factory=list)


@dataclass
class Join:
    """kind: left, inner; on: entries of (op, left field, cond, right field)."""

    kind: str
    query: Query
    on: list[tuple[str, str, str, str]]


@dataclass
class Entry:
    op: str  # and, or, not
    item: Filter | Knn | Bracket | Join


@dataclass
class Sort:
    expr: str
    desc: bool = False
    forced: list[Any] = field(default_factory=list)


@dataclass
class Aggregate:
    kind: str  # sum avg min max facet distinct count count_cached
    fields: list[str] = field(default_factory=list)
    sort: list[Sort] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Query:
    namespace: str
    where: list[Entry] = field(default_factory=list)
    equal_positions: list[list[str]] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    merge: list[Query] = field(default_factory=list)
    select: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    sort: list[Sort] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    total: str = ""  # "", accurate or cached
    with_rank: bool = False
    vectors: bool = False
    explain: bool = False
    strict: str = "names"
    local: bool = False  # this node alone; of no effect on one cluster
    debug: int = 0  # log the plan from level 1 on
    fetch_count: int = 1000  # rows a batch of ``Result.batches``
    kind: str = "select"  # select update delete truncate
    changes: list[tuple[str, str, Any]] = field(default_factory=list)  # (field, set | drop | expr, value)

    def copy(self, **changes: Any) -> Query:
        return replace(self, **changes)


def walk(entries: list[Entry]):
    for e in entries:
        yield e
        if isinstance(e.item, Bracket):
            yield from walk(e.item.entries)


def validate(q: Query, nested: str = "") -> Query:
    """The rules that hold whatever the data; returns ``q``."""

    def check(entries: list[Entry]) -> None:
        for i, e in enumerate(entries):
            if i == 0 and e.op == "or":
                raise QueryError("OR can't stand before the first condition")
            if isinstance(e.item, Bracket):
                check(e.item.entries)
                positions(e.item.equal_positions, e.item.entries)
            if isinstance(e.item, Filter) and e.item.cond not in CONDITIONS:
                raise QueryError(f"unknown condition {e.item.cond}")
            if isinstance(e.item, Join):
                validate(e.item.query, "join")
            if isinstance(e.item, Filter):
                for side in (e.item.left, e.item.value):
                    if isinstance(side, Query):
                        validate(side, "subquery")

    def positions(groups: list[list[str]], entries: list[Entry]) -> None:
        for fields in groups:
            if len(fields) < 2:
                raise QueryError("equal_position needs two fields at least")
            for e in entries:
                if isinstance(e.item, Filter) and e.item.left in fields and (e.item.cond in ("empty", "any") or e.item.value == []):
                    raise QueryError("equal_position can't hold IS NULL, IS EMPTY or an empty list")

    check(q.where)
    positions(q.equal_positions, q.where)
    items = [e.item for e in walk(q.where)]
    if sum(isinstance(i, Knn) for i in items) > 1:
        raise QueryError("one KNN condition a query")
    others = [a for a in q.aggregates if a.kind not in ("distinct", "count", "count_cached")]
    if others and q.select and q.select != ["*"]:
        raise QueryError("aggregations other than DISTINCT exclude a field list")
    distinct = [f for a in q.aggregates if a.kind == "distinct" for f in a.fields]
    if sum(a.kind == "distinct" for a in q.aggregates) > 1 and any(f not in distinct for a in others for f in a.fields):
        raise QueryError("with several DISTINCT, other aggregations are for distinct fields only")
    for a in q.aggregates:
        if a.kind in ("sum", "avg", "min", "max") and len(a.fields) != 1:
            raise QueryError(f"{a.kind} takes one field")
        if a.kind in ("facet", "distinct") and not a.fields:
            raise QueryError(f"{a.kind} needs a field")
    for i, s in enumerate(q.sort):
        if s.forced and (i or any(v is None for v in s.forced)):
            raise QueryError("a forced order is for the first sort entry, without nulls")
    joins = [*q.joins, *(i for i in items if isinstance(i, Join))]
    subs = [x for i in items if isinstance(i, Filter) for x in (i.left, i.value) if isinstance(x, Query)]
    if nested:
        if joins or q.merge or subs:
            raise QueryError(f"a {nested} query can't hold joins, MERGE or subqueries")
        if any(isinstance(i, Knn) for i in items) or (nested == "join" and (q.aggregates or q.total)):
            raise QueryError(f"KNN and aggregations aren't allowed in a {nested} query")
    if nested == "subquery" and (len(q.aggregates) + len([s for s in q.select if s != "*"]) + bool(q.total)) > 1:
        raise QueryError("a subquery has one of: an aggregation, a field, a total")
    if q.merge:
        if (q.limit is not None or q.offset) and q.aggregates:
            raise QueryError("MERGE with a limit can't aggregate")
        for m in q.merge:
            if m.limit is not None or m.offset or m.aggregates or m.total or m.merge:
                raise QueryError("merged queries can't hold limit, aggregations or MERGE")
            validate(m)
    if q.kind in ("update", "delete") and any(j.kind == "left" for j in joins):
        raise QueryError("UPDATE and DELETE take inner joins only")
    return q
