"""A fluent way to write queries."""

from __future__ import annotations

from typing import Any

from .spec import Aggregate, Bracket, Entry, FieldRef, Filter, Func, Join, Knn, Query, Sort, validate


class Builder:
    def __init__(self, db, namespace: str):
        self.db, self.q = db, Query(namespace)
        self._op, self._open = "and", [self.q]
        self._join: Join | None = None

    def _add(self, item: Any) -> Builder:
        top = self._open[-1]
        (top.entries if isinstance(top, Bracket) else top.where).append(Entry(self._op, item))
        self._op = "and"
        return self

    def where(self, left: str | Func, cond: str, value: Any = None) -> Builder:
        if isinstance(value, Builder):
            value = value.q
        if cond in ("set", "allset", "range") and not isinstance(value, (list, Query)):
            value = list(value) if isinstance(value, (set, tuple, range)) else [value]
        return self._add(Filter(left, cond, value))

    def where_composite(self, name: str, cond: str, *keys: tuple) -> Builder:
        return self.where(name, cond, list(keys) if cond in ("set", "range", "allset") else keys[0])

    def where_fields(self, left: str, cond: str, right: str) -> Builder:
        return self._add(Filter(left, cond, FieldRef(right)))

    def where_query(self, sub: Builder, cond: str, value: Any = None) -> Builder:
        return self._add(Filter(sub.q, cond, value))

    def match(self, name: str, text: str) -> Builder:
        return self._add(Filter(name, "match", text))

    def dwithin(self, name: str, point: tuple[float, float], distance: float) -> Builder:
        return self._add(Filter(name, "dwithin", (point, distance)))

    def knn(self, name: str, vector: Any, k: int | None = None, radius: float | None = None, **params: Any) -> Builder:
        return self._add(Knn(name, vector, k, radius, params))

    def or_(self) -> Builder:
        self._op = "or"
        return self

    def not_(self) -> Builder:
        self._op = "not"
        return self

    def open_bracket(self) -> Builder:
        b = Bracket([])
        self._add(b)
        self._open.append(b)
        return self

    def close_bracket(self) -> Builder:
        self._open.pop()
        return self

    def equal_position(self, *fields: str) -> Builder:
        self._open[-1].equal_positions.append(list(fields))
        return self

    def _joined(self, kind: str, other: Builder, left: str, cond: str, right: str) -> Builder:
        self._join = Join(kind, other.q, [("and", left, cond, right)])
        if kind == "left":
            self.q.joins.append(self._join)
            return self
        return self._add(self._join)

    def inner_join(self, other: Builder, left: str, cond: str, right: str) -> Builder:
        return self._joined("inner", other, left, cond, right)

    def left_join(self, other: Builder, left: str, cond: str, right: str) -> Builder:
        return self._joined("left", other, left, cond, right)

    def on(self, left: str, cond: str, right: str, op: str = "and") -> Builder:
        self._join.on.append((op, left, cond, right))
        return self

    def merge(self, other: Builder) -> Builder:
        self.q.merge.append(other.q)
        return self

    def sort(self, expr: str, desc: bool = False, *forced: Any) -> Builder:
        self.q.sort.append(Sort(expr, desc, list(forced)))
        return self

    def sort_distance(self, name: str, point: tuple[float, float], desc: bool = False) -> Builder:
        return self.sort(f"ST_Distance({name}, ST_GeomFromText('point({point[0]} {point[1]})'))", desc)

    def select(self, *fields: str) -> Builder:
        self.q.select += fields
        return self

    def functions(self, *texts: str) -> Builder:
        self.q.functions += texts
        return self

    def with_rank(self) -> Builder:
        self.q.with_rank = True
        return self

    def limit(self, n: int) -> Builder:
        self.q.limit = n
        return self

    def offset(self, n: int) -> Builder:
        self.q.offset = n
        return self

    def req_total(self, cached: bool = False) -> Builder:
        self.q.total = "cached" if cached else "accurate"
        return self

    def explain(self) -> Builder:
        self.q.explain = True
        return self

    def strict(self, mode: str) -> Builder:
        self.q.strict = mode
        return self

    def local(self) -> Builder:
        self.q.local = True
        return self

    def debug(self, level: int = 1) -> Builder:
        self.q.debug = level
        return self

    def fetch_count(self, n: int) -> Builder:
        self.q.fetch_count = n
        return self

    def dwithin_query(self, name: str, points: Builder, distance: float) -> Builder:
        """Within a distance of any point that a query selects."""
        return self._add(Filter(name, "dwithin", (points.q, distance)))

    def aggregate(self, kind: str, *fields: str, sort: list[tuple[str, bool]] = (), limit: int | None = None, offset: int = 0) -> Builder:
        self.q.aggregates.append(Aggregate(kind, list(fields), [Sort(*s) for s in sort], limit, offset))
        return self

    def sum(self, f: str) -> Builder:
        return self.aggregate("sum", f)

    def avg(self, f: str) -> Builder:
        return self.aggregate("avg", f)

    def min(self, f: str) -> Builder:
        return self.aggregate("min", f)

    def max(self, f: str) -> Builder:
        return self.aggregate("max", f)

    def distinct(self, *fields: str) -> Builder:
        return self.aggregate("distinct", *fields)

    def facet(self, *fields: str, **kw: Any) -> Builder:
        return self.aggregate("facet", *fields, **kw)

    def set(self, name: str, value: Any) -> Builder:
        self.q.changes.append((name, "set", value))
        return self

    def set_expression(self, name: str, expr: str) -> Builder:
        self.q.changes.append((name, "expr", expr))
        return self

    def drop(self, name: str) -> Builder:
        self.q.changes.append((name, "drop", None))
        return self

    def exec(self):
        return self.db.run(validate(self.q))

    def update(self):
        self.q.kind = "update"
        return self.exec()

    def delete(self):
        self.q.kind = "delete"
        return self.exec()
