"""Scalar functions of conditions, updates and sort expressions, as Columns."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import QueryError

UNITS = {"sec": 10**9, "msec": 10**6, "usec": 10**3, "nsec": 1}


def now(unit: str = "sec", at_ns: int | None = None) -> Column:
    """One value a query, taken when it is planned."""
    if unit not in UNITS:
        raise QueryError(f"now() takes {', '.join(UNITS)}")
    return F.lit((time.time_ns() if at_ns is None else at_ns) // UNITS[unit])


def flat_array_len(col: Column, kind: T.DataType | None) -> Column:
    """Elements of a (nested) array; 1 for a scalar, 0 for a missing one."""
    if kind is None:
        return F.lit(0)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            inner = F.transform(col, lambda x: flat_array_len(x, kind.elementType))
            return F.coalesce(F.aggregate(inner, F.lit(0), lambda a, x: a + x), F.lit(0))
        return F.coalesce(F.when(col.isNotNull(), F.size(col)), F.lit(0))
    return F.when(col.isNull(), 0).otherwise(1)


def array_remove(arr: Column, items: Column) -> Column:
    """All occurrences of each item."""
    return F.filter(arr, lambda x: ~F.coalesce(F.exists(items, lambda y: y == x), F.lit(False)))


def array_remove_once(arr: Column, items: Column) -> Column:
    """The first occurrence of each item in turn."""

    def drop(acc: Column, x: Column) -> Column:
        at = F.array_position(acc, x).cast("int")
        return F.when(at == 0, acc).otherwise(F.concat(F.slice(acc, F.lit(1), at - 1), F.slice(acc, at + 1, F.size(acc))))

    return F.aggregate(items, arr, drop)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point(col: Column, kind: T.DataType) -> tuple[Column, Column]:
    """x and y of a struct<x, y> or an array of two."""
    if isinstance(kind, T.StructType):
        return col["x"].cast("double"), col["y"].cast("double")
    return F.get(col, F.lit(0)).cast("double"), F.get(col, F.lit(1)).cast("double")


# arithmetic of sort and update expressions

LEX = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|('(?:[^']*)')|(\"[^\"]+\")|([A-Za-z_#][\w#.]*(?:\[\d+\])*)|(\|\||[-+*/(),\[\]=]))")


class Arithmetic:
    """A recursive parser of ``+ - * / ( )``, numbers, names and calls to Columns.

    ``name`` resolves a field, ``call`` a function with its raw argument
    texts; ``concat`` joins arrays for the ``||`` of updates.
    """

    def __init__(self, text: str, name: Callable[[str], Column], call: Callable[[str, list[str]], Column], concat: bool = False):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = LEX.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at:]!r}")
            self.tokens.append((("num", "str", "name", "name", "op")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at, self.name, self.call, self.concat = 0, name, call, concat

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise QueryError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Column:
        out = self.sum()
        while self.concat and self.peek() == "||":
            self.take()
            out = F.concat(out, self.sum())
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.peek()!r}")
        return out

    def sum(self) -> Column:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take()[1] == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.unary()
        while self.peek() in ("*", "/"):
            out = out * self.unary() if self.take()[1] == "*" else out / self.unary()
        return out

    def unary(self) -> Column:
        if self.peek() == "-":
            self.take()
            return -self.unary()
        kind, word = self.take()
        if word == "(":
            out = self.sum()
            if self.take()[1] != ")":
                raise QueryError("missing )")
            return out
        if kind == "num":
            return F.lit(float(word))
        if word == "[":
            return self.array()
        if kind == "str":
            return F.lit(word[1:-1])
        if kind != "name":
            raise QueryError(f"unexpected {word!r}")
        if self.peek() == "(":
            self.take()
            args, depth, part = [], 0, ""
            while True:
                k, w = self.take()
                if w == ")" and not depth:
                    break
                if w == "," and not depth:
                    args.append(part.strip())
                    part = ""
                    continue
                depth += (w in "([") - (w in ")]")
                part += w + (" " if k != "op" else "")
            return self.call(word.lower(), [*args, part.strip()] if part.strip() else args)
        return self.name(word.strip('"'))

    def array(self) -> Column:
        out = []
        while self.peek() != "]":
            kind, word = self.take()
            sign = -1 if word == "-" else 1
            if word == "-":
                kind, word = self.take()
            out.append(F.lit(word[1:-1]) if kind == "str" else F.lit(sign * (float(word) if "." in word else int(word))))
            if self.peek() == ",":
                self.take()
        self.take()
        return F.array(*out)
