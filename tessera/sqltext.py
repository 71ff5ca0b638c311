"""SQL text to ``Query`` and back."""

from __future__ import annotations

import json
import re
from typing import Any

from .spec import Aggregate, Bracket, Entry, FieldRef, Filter, Func, Join, Knn, Query, QueryError, Sort, validate

TOKEN = re.compile(
    r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*')|(?P<quoted>"[^"]*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"""
    r"""|(?P<word>[A-Za-z_\#@][\w\#@]*(?:\.[\w\#]+|\[(?:\d+|\*|\#)\])*)|(?P<op>==|<>|!=|>=|<=|\|\||[-+*/=<>(),{}\[\];:]))""",
    re.X,
)
COMPARE = {"=": "eq", "==": "eq", "is": "eq", "<": "lt", ">": "gt", "<=": "le", ">=": "ge", "in": "set", "range": "range", "like": "like", "allset": "allset", "match": "match"}
AGGREGATES = {"sum", "avg", "min", "max", "facet", "distinct", "count", "count_cached"}
STOP = {"where", "limit", "offset", "order", "join", "left", "inner", "merge", "or", "and", "not", "on", "equal_position", "set", "drop"}


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at, text = 0, text.strip().rstrip(";")
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                if not text[at:].strip():
                    break
                raise QueryError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.text, self.at = text, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1].lower() if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise QueryError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise QueryError(f"expected {word!r}, got {self.peek()!r}")

    def name(self) -> str:
        kind = self.kind()
        word = self.next()
        if kind not in ("word", "quoted", "str"):
            raise QueryError(f"expected a name, got {word!r}")
        return word if kind == "word" else word[1:-1]

    def value(self) -> Any:
        kind, word = self.kind(), self.next()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", word[1:-1])
        if kind == "num":
            return float(word) if re.search(r"[.eE]", word) else int(word)
        if word == "{":
            return tuple(self.listed("}"))
        if word == "[":
            return self.listed("]")
        low = word.lower()
        if low in ("true", "false"):
            return low == "true"
        if low == "null":
            return None
        if low in ("now", "flat_array_len") and self.peek() == "(":
            return self.call(low)
        if kind in ("quoted", "word"):
            return FieldRef(word.strip('"'))
        raise QueryError(f"expected a value, got {word!r}")

    def listed(self, end: str) -> list:
        out = []
        while not self.take(end):
            out.append(self.value())
            if not self.take(","):
                self.need(end)
                break
        return out

    def call(self, name: str) -> Func:
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.next().strip("'\""))
            self.take(",")
        return Func(name, args)

    # statements

    def statement(self) -> Query:
        explain = self.take("explain")
        word = self.next().lower()
        if word == "select":
            q = self.select()
        elif word == "update":
            q = self.update()
        elif word == "delete":
            self.need("from")
            q = self.clauses(Query(self.name(), kind="delete"))
        elif word == "truncate":
            q = Query(self.name(), kind="truncate")
        else:
            raise QueryError(f"unknown statement {word!r}")
        q.explain = explain
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.peek()!r}")
        return q

    def select(self) -> Query:
        q = Query("")
        while True:
            self.item(q)
            if not self.take(","):
                break
        self.need("from")
        q.namespace = self.name()
        if q.total and not q.select and not q.aggregates:
            q.limit = 0
        return self.clauses(q)

    def item(self, q: Query) -> None:
        low = self.peek()
        if low == "*":
            self.next()
            q.select.append("*")
        elif self.peek(1) == "(" and low in AGGREGATES:
            self.next()
            self.need("(")
            if low in ("count", "count_cached"):
                self.need("*")
                q.total = "accurate" if low == "count" else "cached"
            else:
                a = Aggregate(low)
                while self.peek() not in (")", "order", "limit", "offset"):
                    a.fields.append(self.name())
                    self.take(",")
                if self.take("order", "by"):
                    a.sort = self.sorts()
                if self.take("limit"):
                    a.limit = int(self.next())
                if self.take("offset"):
                    a.offset = int(self.next())
                q.aggregates.append(a)
            self.need(")")
        elif self.peek(1) == "(" and low in ("rank", "vectors"):
            self.at += 2
            self.need(")")
            if low == "rank":
                q.with_rank = True
            else:
                q.vectors = True
        elif self.peek(1) == "(" or re.match(r".*\.(highlight|snippet|snippet_n|debug_rank)$", low):
            start = self.tokens[self.at][2]
            self.name()
            self.need("(")
            while not self.take(")"):
                self.next()
            end = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
            q.functions.append(self.text[start:end].strip().rstrip(",").strip())
        else:
            q.select.append(self.name())

    def clauses(self, q: Query, inner: bool = False) -> Query:
        while True:
            if self.take("where"):
                q.where += self.conditions(q)
            elif self.take("limit"):
                q.limit = int(self.next())
            elif self.take("offset"):
                q.offset = int(self.next())
            elif self.take("order", "by"):
                q.sort += self.sorts()
            elif self.peek() in ("join", "left") or (self.peek() == "inner") or self.take("or", "inner"):
                was_or = self.tokens[self.at - 1][1].lower() == "inner" and self.tokens[self.at - 2][1].lower() == "or" and self.at >= 2
                kind = "inner" if was_or or self.take("inner") else "left"
                if kind == "left":
                    self.take("left")
                join = self.join(kind)
                if kind == "left":
                    q.joins.append(join)
                else:
                    q.where.append(Entry("or" if was_or else "and", join))
            elif self.take("merge"):
                self.need("(")
                self.need("select")
                q.merge.append(self.select())
                self.need(")")
            elif self.take("equal_position"):
                q.equal_positions.append(self.names())
            else:
                return q

    def names(self) -> list[str]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.name())
            self.take(",")
        return out

    def join(self, kind: str) -> Join:
        self.need("join")
        if self.take("("):
            self.need("select")
            sub = self.select()
            self.need(")")
        else:
            sub = Query(self.name(), select=["*"])
        self.need("on")
        bracket = self.take("(")
        on = []
        op = "and"
        while True:
            if self.take("not"):
                op = "not"
            a, cond, b = self.name(), self.next().lower(), self.name()
            cond = COMPARE.get(cond)
            if cond not in ("eq", "set", "lt", "le", "gt", "ge"):
                raise QueryError("ON takes =, IN, <, <=, > and >=")
            if not a.startswith(sub.namespace + ".") and b.startswith(sub.namespace + "."):
                left, right = a, b
            else:
                left, right = b, a
                cond = {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}.get(cond, cond)
            strip = lambda n, ns: n[len(ns) + 1 :] if n.startswith(ns + ".") else n
            on.append((op, left.partition(".")[2] or left, cond, strip(right, sub.namespace)))
            if not (bracket and self.peek() in ("and", "or")):
                break
            op = self.next().lower()
        if bracket:
            self.need(")")
        return Join(kind, sub, on)

    def sorts(self) -> list[Sort]:
        out = []
        while True:
            if self.take("field", "("):
                s = Sort(self.name())
                while self.take(","):
                    s.forced.append(self.value())
                self.need(")")
            else:
                start, depth = self.tokens[self.at][2], 0
                if self.kind() in ("str", "quoted"):
                    expr = self.next()[1:-1]
                else:
                    while self.at < len(self.tokens) and (depth or self.peek() not in (",", "asc", "desc", "limit", "offset", "where", ")", "merge", "left", "inner", "join")):
                        depth += (self.peek() == "(") - (self.peek() == ")")
                        self.next()
                    end = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
                    expr = self.text[start:end].strip()
                s = Sort(expr)
            s.desc = self.take("desc")
            if not s.desc:
                self.take("asc")
            out.append(s)
            if not self.take(","):
                return out

    # conditions

    def conditions(self, owner: Query | Bracket) -> list[Entry]:
        out: list[Entry] = []
        op = "and"
        while True:
            if self.take("not"):
                if op == "or":
                    raise QueryError("NOT and OR can't share an entry")
                op = "not"
            if self.peek() == "equal_position":
                self.next()
                owner.equal_positions.append(self.names())
            else:
                out.append(self.condition(op))
            while self.peek() == "equal_position":
                self.next()
                owner.equal_positions.append(self.names())
            if self.peek() == "or" and self.peek(1) == "inner" and self.peek(2) == "join":
                op = self.next().lower()
            elif self.peek() in ("and", "or"):
                op = self.next().lower()
            else:
                return out

    def condition(self, op: str) -> Entry:
        low = self.peek()
        if low == "inner":
            self.next()
            return Entry(op, self.join("inner"))
        if low == "(" and self.peek(1) == "select":
            self.at += 2
            sub = self.select()
            self.need(")")
            return self.compared(op, sub)
        if low == "(":
            self.next()
            b = Bracket([])
            b.entries = self.conditions(b)
            self.need(")")
            return Entry(op, b)
        if low == "st_dwithin":
            self.next()
            self.need("(")
            a = self.point_or_field()
            self.need(",")
            b = self.point_or_field()
            self.need(",")
            d = self.value()
            self.need(")")
            name, point = (a, b) if isinstance(a, str) else (b, a)
            return Entry(op, Filter(name, "dwithin", (point, d)))
        if low == "knn":
            self.next()
            self.need("(")
            k = Knn(self.name(), [])
            self.need(",")
            k.vector = self.value()
            while self.take(","):
                word = self.next().lower()
                self.need("=")
                v = self.value()
                if word == "k":
                    k.k = v
                elif word == "radius":
                    k.radius = v
                else:
                    k.params[word] = v
            self.need(")")
            if "ef" in k.params and "nprobe" in k.params:
                raise QueryError("ef and nprobe exclude each other")
            return Entry(op, k)
        if low in ("flat_array_len", "now") and self.peek(1) == "(":
            self.next()
            return self.compared(op, self.call(low))
        return self.compared(op, self.name())

    def point_or_field(self) -> Any:
        if self.take("st_geomfromtext", "("):
            text = self.value()
            self.need(")")
            m = re.fullmatch(r"\s*point\s*\(\s*(\S+)\s+(\S+)\s*\)\s*", text, re.I)
            if not m:
                raise QueryError(f"not a point: {text!r}")
            return (float(m[1]), float(m[2]))
        if self.take("(", "select"):
            sub = self.select()
            self.need(")")
            return sub
        return self.name()

    def compared(self, op: str, left: Any) -> Entry:
        word = self.next().lower()
        negated = word in ("<>", "!=")
        if word == "is" and self.take("not"):
            if self.take("null") or self.take("empty"):
                return Entry(op, Filter(left, "any"))
            negated = True
        if negated and op == "or":
            raise QueryError("<> can't follow OR")
        if self.take("null") or self.take("empty"):
            return Entry("not" if negated else op, Filter(left, "empty"))
        if self.take("not"):
            if not (self.take("null") or self.take("empty")):
                raise QueryError("expected NULL or EMPTY after NOT")
            return Entry(op, Filter(left, "any"))
        cond = "eq" if negated else COMPARE.get(word)
        if not cond:
            raise QueryError(f"unknown condition {word!r}")
        if self.peek() == "(" and self.peek(1) == "select":
            self.at += 2
            value: Any = self.select()
            self.need(")")
        elif self.take("("):
            value = self.listed(")")
        else:
            value = self.value()
        if cond in ("set", "allset", "range") and not isinstance(value, (list, Query)):
            value = [value]
        if cond == "range" and isinstance(value, list) and len(value) != 2:
            raise QueryError("RANGE takes two values")
        return Entry("not" if negated else op, Filter(left, cond, value))

    # update

    def update(self) -> Query:
        q = Query(self.name(), kind="update")
        while self.peek() in ("set", "drop"):
            how = self.next().lower()
            while True:
                name = self.name()
                if how == "drop":
                    q.changes.append((name, "drop", None))
                else:
                    self.need("=")
                    q.changes.append((name, *self.assigned()))
                if not self.take(","):
                    break
        return self.clauses(q)

    def assigned(self) -> tuple[str, Any]:
        start, depth, first = self.at, 0, self.tokens[self.at][2]
        while self.at < len(self.tokens) and (depth or self.peek() not in (",", "where", "set", "drop", "order", "limit", "offset")):
            depth += (self.peek() in "([{") - (self.peek() in ")]}") if self.peek() else 0
            self.next()
        end = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
        raw = self.text[first:end].strip()
        if self.at - start == 1 or raw[:1] in "[{":
            stop, self.at = self.at, start
            if raw[:1] == "{":
                self.at = stop
                return "set", json.loads(raw)
            try:
                v = self.value()
            finally:
                done, self.at = self.at, stop
            if done == stop and not isinstance(v, (FieldRef, Func)):
                return "set", v
        return "expr", raw


def parse(text: str) -> Query:
    return validate(Parser(text).statement())


def literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, FieldRef):
        return f'"{v.name}"'
    if isinstance(v, Func):
        return f"{v.name}({', '.join(v.args)})"
    if isinstance(v, Query):
        return f"({encode(v)})"
    if isinstance(v, tuple):
        return "{" + ", ".join(map(literal, v)) + "}"
    if isinstance(v, list):
        return "(" + ", ".join(map(literal, v)) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


_NAME = re.compile(r"[A-Za-z_\#@][\w\#@]*(?:\.[\w\#]+|\[(?:\d+|\*|\#)\])*")


def _name(n: str) -> str:
    return n if _NAME.fullmatch(n) and n.lower() not in STOP else f'"{n}"'


def _condition(item: Any) -> str:
    spell = {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "set": "IN", "allset": "ALLSET", "range": "RANGE", "like": "LIKE", "match": "MATCH"}
    if isinstance(item, Bracket):
        return f"({_entries(item.entries, item.equal_positions)})"
    if isinstance(item, Join):
        return _join(item)
    if isinstance(item, Knn):
        vector = "[" + ", ".join(map(repr, item.vector)) + "]" if not isinstance(item.vector, str) else literal(item.vector)
        extra = {"k": item.k, "radius": item.radius} | item.params
        return f"KNN({_name(item.field)}, {vector}{''.join(f', {k}={v!r}' for k, v in extra.items() if v is not None)})"
    left = _name(item.left) if isinstance(item.left, str) else literal(item.left)
    if item.cond in ("empty", "any"):
        return f"{left} IS {'NOT ' if item.cond == 'any' else ''}NULL"
    if item.cond == "dwithin":
        if isinstance(item.value[0], Query):
            return f"ST_DWithin({left}, ({encode(item.value[0])}), {item.value[1]!r})"
        (x, y), d = item.value
        return f"ST_DWithin({left}, ST_GeomFromText('point({x!r} {y!r})'), {d!r})"
    return f"{left} {spell[item.cond]} {literal(item.value)}"


def _entries(entries: list[Entry], positions: list[list[str]]) -> str:
    out = ""
    for i, e in enumerate(entries):
        out += (" OR " if e.op == "or" else " AND ") * bool(i) + "NOT " * (e.op == "not") + _condition(e.item)
    return out + "".join(f" EQUAL_POSITION({', '.join(map(_name, p))})" for p in positions)


def _join(j: Join) -> str:
    spell = {"eq": "=", "set": "IN", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    on = "".join(f"{'' if not i else ' OR ' if op == 'or' else ' AND '}{'NOT ' * (op == 'not')}{_name(a)} {spell[c]} {_name(j.query.namespace + '.' + b)}" for i, (op, a, c, b) in enumerate(j.on))
    return f"{j.kind.upper()} JOIN ({encode(j.query)}) ON ({on})"


def _sorts(sorts: list[Sort]) -> str:
    return ", ".join((f"FIELD({_name(s.expr)}, {', '.join(map(literal, s.forced))})" if s.forced else f"'{s.expr}'") + " DESC" * s.desc for s in sorts)


def encode(q: Query) -> str:
    """SQL text that parses to an equal query."""
    if q.kind == "truncate":
        return f"TRUNCATE {_name(q.namespace)}"
    if q.kind == "select":
        items = [_name(s) if s != "*" else s for s in q.select]
        for a in q.aggregates:
            tail = f" ORDER BY {_sorts(a.sort)}" * bool(a.sort) + (f" LIMIT {a.limit}" if a.limit is not None else "") + f" OFFSET {a.offset}" * bool(a.offset)
            items.append(f"{a.kind.upper()}({', '.join(map(_name, a.fields))}{tail})")
        items += q.functions + ["rank()"] * q.with_rank + ["vectors()"] * q.vectors
        only = bool(q.total) and not items
        items += [{"accurate": "COUNT(*)", "cached": "COUNT_CACHED(*)"}[q.total]] if q.total else []
        out = f"SELECT {', '.join(items or ['*'])} FROM {_name(q.namespace)}"
    elif q.kind == "delete":
        out, only = f"DELETE FROM {_name(q.namespace)}", False
    else:
        sets = [f"{_name(f)} = {v if how == 'expr' else json.dumps(v) if isinstance(v, dict) else '[' + ', '.join(map(literal, v)) + ']' if isinstance(v, list) else literal(v)}" for f, how, v in q.changes if how != "drop"]
        drops = [_name(f) for f, how, _ in q.changes if how == "drop"]
        out, only = f"UPDATE {_name(q.namespace)}" + f" SET {', '.join(sets)}" * bool(sets) + f" DROP {', '.join(drops)}" * bool(drops), False
    if q.where:
        out += " WHERE " + _entries(q.where, q.equal_positions)
    out += "".join(" " + _join(j) for j in q.joins) + "".join(f" MERGE ({encode(m)})" for m in q.merge)
    out += f" ORDER BY {_sorts(q.sort)}" * bool(q.sort)
    if q.limit is not None and not (only and q.limit == 0):
        out += f" LIMIT {q.limit}"
    return "EXPLAIN " * q.explain + out + f" OFFSET {q.offset}" * bool(q.offset)


KEYWORDS = ["select", "from", "where", "and", "or", "not", "order by", "limit", "offset", "left join", "inner join", "merge", "on", "in", "range", "like", "allset", "is", "null", "empty", "facet", "distinct", "sum", "avg", "min", "max", "count", "equal_position", "st_dwithin", "knn", "update", "set", "drop", "delete", "truncate", "explain"]


def suggest(text: str, namespaces: dict[str, list[str]]) -> list[str]:
    """Words that may go on at the end of ``text``: keywords, namespaces and their fields."""
    head = re.search(r"[\w.#@]*$", text)[0].lower()
    before = text[: len(text) - len(head)].lower()
    named = [n for n in namespaces if re.search(rf"\b{re.escape(n.lower())}\b", before)]
    if re.search(r"\b(from|update|join)\s+$", before):
        words = [*namespaces]
    else:
        words = KEYWORDS + [f for n in named or namespaces for f in namespaces[n]]
    return sorted({w for w in words if w.lower().startswith(head)})
