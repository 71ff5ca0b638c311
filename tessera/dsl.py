"""The JSON form of a ``Query`` and back."""

from __future__ import annotations

import json
from typing import Any

from .spec import Aggregate, Bracket, Entry, FieldRef, Filter, Func, Join, Knn, Query, QueryError, Sort, validate

TOTALS = {"disabled": "", "enabled": "accurate", "cached": "cached"}


def parse(text: str | dict) -> Query:
    return validate(_query(json.loads(text) if isinstance(text, str) else text))


def _sort(s: Any) -> list[Sort]:
    rows = s if isinstance(s, list) else [s] if s else []
    return [Sort(x, False) if isinstance(x, str) else Sort(x["field"], bool(x.get("desc")), list(x.get("values", []))) for x in rows]


def _query(d: dict) -> Query:
    d = {k.lower(): v for k, v in d.items()}
    known = {"namespace", "limit", "offset", "filters", "sort", "merge_queries", "select_filter", "select_functions", "req_total", "aggregations", "explain", "local", "equal_positions", "select_with_rank", "strict_mode", "type", "drop_fields", "update_fields"}
    if extra := set(d) - known:
        raise QueryError(f"unknown keys {sorted(extra)}")
    q = Query(d["namespace"], kind=d.get("type", "select").lower(), limit=d.get("limit"), offset=d.get("offset") or 0, select=list(d.get("select_filter", [])), functions=list(d.get("select_functions", [])), with_rank=bool(d.get("select_with_rank")), explain=bool(d.get("explain")), strict=d.get("strict_mode") or "names", total=TOTALS[(d.get("req_total") or "disabled").lower()])
    q.sort = _sort(d.get("sort"))
    for f in d.get("filters") or []:
        e = _entry(f)
        if isinstance(e.item, Join) and e.item.kind == "left":
            q.joins.append(e.item)
        else:
            q.where.append(e)
    q.equal_positions = [p["positions"] if isinstance(p, dict) else p for p in d.get("equal_positions", [])]
    q.merge = [_query(m) for m in d.get("merge_queries") or []]
    q.aggregates = [Aggregate(a["type"].lower(), list(a.get("fields", [])), _sort(a.get("sort")), a.get("limit"), a.get("offset") or 0) for a in d.get("aggregations") or []]
    q.changes = [(u["name"], "expr" if u.get("type") == "expression" else "set", u["values"][0] if len(u.get("values", [])) == 1 and not u.get("is_array") else u.get("values")) for u in d.get("update_fields", [])]
    q.changes += [(f, "drop", None) for f in d.get("drop_fields", [])]
    return q


def _entry(f: dict) -> Entry:
    f = {k.lower(): v for k, v in f.items()}
    op = (f.get("op") or "and").lower()
    if "join_query" in f:
        j = f["join_query"]
        sub = _query({k: v for k, v in j.items() if k.lower() not in ("type", "op", "on")})
        on = [((o.get("op") or "and").lower(), o["left_field"], {"eq": "eq"}.get(o["cond"].lower(), o["cond"].lower()), o["right_field"]) for o in j.get("on", [])]
        kind = j.get("type", "inner").lower()
        return Entry("or" if kind == "orinner" else op, Join("left" if kind == "left" else "inner", sub, on))
    if "filters" in f:
        return Entry(op, Bracket([_entry(x) for x in f["filters"]], [p["positions"] if isinstance(p, dict) else p for p in f.get("equal_positions", [])]))
    cond = f["cond"].lower()
    if cond == "knn":
        p = {k.lower(): v for k, v in (f.get("params") or {}).items()}
        return Entry(op, Knn(f["field"], f["value"], p.pop("k", None), p.pop("radius", None), p))
    if "first_field" in f:
        return Entry(op, Filter(f["first_field"], cond, FieldRef(f["second_field"])))
    left: Any = _query(f["subquery"]) if "subquery" in f and "field" not in f else f.get("field")
    if "function" in f and "field" not in f:
        left = Func(f["function"]["name"], list(f["function"].get("args", [])))
    value: Any = f.get("value")
    if "subquery" in f and "field" in f:
        value = _query(f["subquery"])
    if isinstance(value, dict):
        value = Func(value["name"], list(value.get("args", [])))
    if cond == "dwithin" and isinstance(value, Query):
        value = (value, float(f["value"]))
    elif cond == "dwithin":
        value = sorted(value, key=lambda v: not isinstance(v, list))
        value = (tuple(map(float, value[0])), value[1])
    if cond in ("set", "allset", "range") and not isinstance(value, (list, Query)):
        value = [value]
    return Entry(op, Filter(left, cond, value))


def encode(q: Query) -> dict:
    """A dict whose ``parse`` is an equal query."""

    def entry(e: Entry) -> dict:
        i, out = e.item, {"op": e.op}
        if isinstance(i, Bracket):
            return out | {"filters": [entry(x) for x in i.entries]} | ({"equal_positions": i.equal_positions} if i.equal_positions else {})
        if isinstance(i, Join):
            return out | {"join_query": encode(i.query) | {"type": i.kind, "on": [{"op": o, "left_field": a, "cond": c, "right_field": b} for o, a, c, b in i.on]}}
        if isinstance(i, Knn):
            return out | {"cond": "knn", "field": i.field, "value": i.vector, "params": {k: v for k, v in ({"k": i.k, "radius": i.radius} | i.params).items() if v is not None}}
        out["cond"] = i.cond
        if isinstance(i.value, FieldRef):
            return out | {"first_field": i.left, "second_field": i.value.name}
        if isinstance(i.left, Query):
            out["subquery"] = encode(i.left)
        elif isinstance(i.left, Func):
            out["function"] = {"name": i.left.name, "args": i.left.args}
        else:
            out["field"] = i.left
        if isinstance(i.value, Query):
            out["subquery"] = encode(i.value)
        elif isinstance(i.value, Func):
            out["value"] = {"name": i.value.name, "args": i.value.args}
        elif i.cond == "dwithin":
            out |= {"subquery": encode(i.value[0]), "value": i.value[1]} if isinstance(i.value[0], Query) else {"value": [list(i.value[0]), i.value[1]]}
        elif i.cond not in ("any", "empty"):
            out["value"] = i.value
        return out

    sort = lambda rows: [{"field": s.expr, "desc": s.desc} | ({"values": s.forced} if s.forced else {}) for s in rows]
    out: dict[str, Any] = {"namespace": q.namespace, "limit": q.limit, "offset": q.offset, "filters": [entry(e) for e in q.where] + [entry(Entry("and", j)) for j in q.joins], "sort": sort(q.sort), "select_filter": q.select, "select_functions": q.functions, "select_with_rank": q.with_rank, "explain": q.explain, "strict_mode": q.strict, "req_total": {v: k for k, v in TOTALS.items()}[q.total], "merge_queries": [encode(m) for m in q.merge]}
    out["aggregations"] = [{"type": a.kind, "fields": a.fields, "sort": sort(a.sort), "limit": a.limit, "offset": a.offset} for a in q.aggregates]
    if q.equal_positions:
        out["equal_positions"] = q.equal_positions
    if q.kind != "select":
        out["type"] = q.kind
        out["update_fields"] = [{"name": f, "type": "expression" if how == "expr" else "value", "values": v if isinstance(v, list) else [v], "is_array": isinstance(v, list)} for f, how, v in q.changes if how != "drop"]
        out["drop_fields"] = [f for f, how, _ in q.changes if how == "drop"]
    return out
