"""From a query to DataFrames.

Order of steps: subqueries, rank conditions, WHERE with joins, DISTINCT filter,
total, sort, limit, joined rows, aggregations, projection.
"""

from __future__ import annotations

import contextlib
import io
import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates, fulltext, joins, sorting, vector
from ..functions import scalar
from ..operators.predicates import Field, compile_entries, element_test, leaf, resolve, truth
from ..spec import Bracket, Entry, Filter, Func, Join, Knn, Query, QueryError, validate, walk


#: Cached totals of a database.
COUNTS_KEPT = 1000


@dataclass
class Result:
    """Rows, aggregations in the query's order, and the total on demand."""

    df: DataFrame
    aggregations: list[DataFrame] = field(default_factory=list)
    counted: DataFrame | None = None
    db: Any = None
    query: Query | None = None

    def total(self) -> int:
        """Rows before limit and offset; cached totals are kept by query and versions."""
        from .. import sqltext

        if self.query.total == "cached":
            versions = tuple(sorted((n.name, n.version) for n in self.db.namespaces.values()))
            key = (sqltext.encode(self.query), versions)
            if key not in self.db.counts:
                self.db.counts[key] = self.counted.count()
            self.db.counts[key] = self.db.counts.pop(key)  # the last used ones stay
            while len(self.db.counts) > COUNTS_KEPT:
                del self.db.counts[next(iter(self.db.counts))]
            return self.db.counts[key]
        return self.counted.count()

    def batches(self) -> Iterator[list]:
        """Rows by ``fetch_count``, a partition at a time."""
        held: list = []
        for row in self.df.toLocalIterator():
            held.append(row)
            if len(held) >= self.query.fetch_count:
                yield held
                held = []
        if held:
            yield held

    def objects(self, handlers: dict[str, Callable[[dict, list[dict]], bool]] | None = None) -> Iterator[dict]:
        """Rows as dicts; a handler by namespace gets each row with its joined rows, which stay only if it says so."""
        for batch in self.batches():
            for row in batch:
                item = row.asDict(recursive=True)
                for ns, handle in (handlers or {}).items():
                    if f"joined_{ns}" in item and not handle(item, item[f"joined_{ns}"]):
                        del item[f"joined_{ns}"]
                yield item

    def explain(self, matched: bool = False) -> dict[str, Any]:
        """Spark's plan, the conditions in order, and with ``matched`` how many rows each passes (one more scan)."""
        with contextlib.redirect_stdout(said := io.StringIO()):
            self.df.explain("formatted")
        plain = [(e, e.item) for e in walk(self.query.where) if isinstance(e.item, Filter) and not isinstance(e.item.left, Query) and not isinstance(e.item.value, (Query, tuple))]
        selectors = [{"op": e.op, "field": f.left if isinstance(f.left, str) else f.left.name, "cond": f.cond, "value": str(f.value)} for e, f in plain]
        ns = self.db.get(self.query.namespace)
        if matched and plain:
            tests = [F.sum(F.when(truth(leaf(ns.df, f, ns, self.query.strict)), 1).otherwise(0)).alias(f"m{i}") for i, (_, f) in enumerate(plain)]
            for told, n in zip(selectors, ns.df.agg(*tests).head(), strict=True):
                told["matched"] = n or 0
        return {"plan": said.getvalue(), "selectors": selectors, "sort": [s.expr for s in self.query.sort], "joins": [e.item.query.namespace for e in walk(self.query.where) if isinstance(e.item, Join)] + [j.query.namespace for j in self.query.joins]}


def run(db, q: Query) -> Result:
    validate(q)
    if any(isinstance(e.item, Filter) and e.item.left == "#lsn" for e in q.where):
        return logged(db, q)
    out = merged(db, q) if q.merge else Plan(db, q).result()
    if q.debug > 0:
        logging.getLogger("tessera").info("%s: %s", q.namespace, out.explain()["plan"])
    return out


def logged(db, q: Query) -> Result:
    """``#lsn > n``: the namespace's changes behind a place in its log."""
    if len(q.where) != 1 or q.where[0].item.cond not in ("gt", "any") or q.aggregates or q.joins or q.merge:
        raise QueryError("#lsn takes one condition, > or NOT NULL, and nothing else")
    if db.log is None:
        raise QueryError("the database keeps no log")
    item = q.where[0].item
    rows = db.log.since(q.namespace, 0 if item.cond == "any" else int(item.value))
    out = rows.orderBy("lsn").limit(q.limit) if q.limit is not None else rows
    return Result(out, counted=rows, db=db, query=q)


def _joined_name(q: Query, ns: str, seen: dict[str, int]) -> str:
    seen[ns] = seen.get(ns, 0) + 1
    return f"joined_{ns}" if seen[ns] == 1 else f"joined_{ns}_{seen[ns]}"


class Plan:
    def __init__(self, db, q: Query):
        self.db, self.q, self.ns = db, q, db.get(q.namespace)
        self.df: DataFrame = self.ns.df
        self.base = list(self.df.columns)
        self.flags: list[str] = []
        self.attached: list[tuple[str, Join, DataFrame, Any]] = []
        self.names: dict[str, str] = {}
        self.ranks: dict[str, Any] = {}
        self.metric = ""
        self.texts: list[tuple[str, list[str], str, Any]] = []

    # where

    def right(self, join: Join) -> tuple[DataFrame, Any]:
        sub = Plan(self.db, join.query)
        return sub.filtered(), sub.ns

    def note(self, join: Join, right: DataFrame, ns, seen: dict[str, int]) -> None:
        if join.kind == "inner" and join.query.limit == 0:
            return
        name = _joined_name(self.q, ns.name, seen)
        self.names.setdefault(ns.name, name)
        self.attached.append((name, join, right, ns))

    def is_text(self, e: Entry) -> bool:
        i = e.item
        index = self.ns.index(i.left) if isinstance(i, Filter) and isinstance(i.left, str) else None
        return bool(index and index.kind == "text" and i.cond in ("eq", "match", "set"))

    def filtered(self) -> DataFrame:
        q, seen = self.q, {}
        entries = list(q.where)
        ranked = [e for e in walk(entries) if isinstance(e.item, Knn) or self.is_text(e)]
        if sum(self.is_text(e) for e in ranked) > 1:
            raise QueryError("one full-text condition a query")
        for e in ranked:
            if isinstance(e.item, Knn) and vector.streamed(self.ns, e.item) and (len(ranked) > 1 or q.sort or q.limit is None):
                raise QueryError("KNN without k or a radius needs a limit, and excludes ORDER BY and hybrid search")
        flags: dict[int, Any] = {}
        # ranks come before all other conditions: the nearest are taken first, then filtered
        only_knn = next((e for e in entries if isinstance(e.item, Knn) and e.op == "and"), None) if len(ranked) == 1 else None
        if only_knn is not None and not any(n.op == "or" for n in entries[entries.index(only_knn) + 1 : entries.index(only_knn) + 2]):
            self.df = vector.nearest(self.df, self.ns, only_knn.item, self.db.embedders.get(only_knn.item.field))
            self.rank_knn(only_knn.item)
            entries.remove(only_knn)
            ranked = []
        for e in ranked:
            if not self.ns.pk:
                raise QueryError("a rank condition needs a primary key")
            if isinstance(e.item, Knn):
                near = vector.nearest(self.ns.df, self.ns, e.item, self.db.embedders.get(e.item.field))
                found = near.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(self.ns.pk)), "_knn")
                self.rank_knn(e.item)
                flags[id(e)] = "_knn"
            else:
                index = self.ns.index(e.item.left)
                fields = index.config.get("fields") or index.fields
                text = " ".join(e.item.value) if isinstance(e.item.value, list) else e.item.value
                config = index.config.get("config") or fulltext.Config()
                why = any(f.endswith("debug_rank()") or ".debug_rank" in f for f in q.functions)
                built = self.ns.text_index(fields, config)
                found = fulltext.ask(built, text, config, self.preselected(e) if config.preselect else None, why)
                self.texts.append((index.name, fields, text, config, built))
                self.ranks[index.name] = F.col("_ft")
                flags[id(e)] = "_ft"
            self.df = self.df.join(found, joins._same(self.ns.pk), "left").drop(*(f"_k{i}" for i in range(len(self.ns.pk))))
        if {"_ft", "_knn"} <= {*flags.values()}:
            asc = self.metric in vector.ASCENDING
            asked = [m for s in q.sort if (m := re.search(r"rrf\s*\(\s*(?:rank_const\s*=\s*([\d.]+))?", s.expr, re.I))]
            self.fusion = (asc, float(asked[0][1]) if asked and asked[0][1] else 60.0)
            self.ranks["rrf"] = lambda const: F.col("_rrf")
        elif "_ft" in flags.values():
            self.ranks["rank"] = F.col("_ft")
        # joins at the top level that no OR touches are semi and anti joins
        kept: list[Entry] = []
        for i, e in enumerate(entries):
            nxt = entries[i + 1].op if i + 1 < len(entries) else "and"
            if isinstance(e.item, Join) and e.op in ("and", "not") and nxt != "or":
                right, rns = self.right(e.item)
                shown = len(self.attached)
                if e.op == "and":
                    self.note(e.item, right, rns, seen)
                if len(self.attached) > shown and q.kind == "select" and q.limit is None and not q.merge and self.ns.pk:
                    self.df = self.attach(self.df)  # one join both tests and shows
                    self.df = self.df.where(F.size(f"`{self.attached[-1][0]}`") > 0)
                else:
                    self.df = joins.matching(self.df, self.ns, right, rns, e.item, e.op == "and")
            else:
                kept.append(e)

        def prepared(entries: list[Entry]) -> None:
            for e in entries:
                if isinstance(e.item, Bracket):
                    prepared(e.item.entries)
                elif isinstance(e.item, Join):
                    right, rns = self.right(e.item)
                    name = f"_j{len(self.flags)}"
                    self.df = joins.flagged(self.df, self.ns, right, rns, e.item, name)
                    self.flags.append(name)
                    flags[id(e)] = name
                    if e.op != "not":
                        self.note(e.item, right, rns, seen)
                elif isinstance(e.item, Filter) and e.item.cond == "dwithin" and isinstance(e.item.value[0], Query):
                    flags[id(e)] = self.near_points(e.item)
                elif isinstance(e.item, Filter) and isinstance(e.item.value, Query) and not isinstance(e.item.left, Query):
                    flags[id(e)] = self.subquery_value(e.item)
                elif isinstance(e.item, Filter) and isinstance(e.item.left, Query):
                    flags[id(e)] = F.lit(self.subquery_truth(e.item))

        prepared(kept)

        def special(e: Entry):
            f = flags.get(id(e))
            if f is None:
                if isinstance(e.item, (Join, Knn)):
                    raise QueryError("a join or KNN can't stand here")
                return None
            if isinstance(f, str):
                return F.col(f) if f.startswith("_j") else F.col(f).isNotNull()
            return f

        if kept or q.equal_positions:
            self.df = self.df.where(compile_entries(self.df, kept, q.equal_positions, self.ns, q.strict, special, bare=True))
        if "rrf" in self.ranks:  # positions are among the rows that passed
            self.df = vector.fuse_rrf(self.df, "_ft", "_knn", *self.fusion)
        return self.df

    def preselected(self, text: Entry) -> DataFrame | None:
        """Keys of the rows that pass the plain conditions beside a text condition, if these are all that is left."""
        others = [e for e in self.q.where if e is not text]
        if not any(e is text for e in self.q.where) or text.op != "and" or not others or self.q.equal_positions:
            return None
        if any(e.op == "or" or not isinstance(e.item, Filter) or isinstance(e.item.left, Query) or isinstance(e.item.value, Query) for e in others):
            return None
        rows = self.ns.df.where(compile_entries(self.ns.df, others, [], self.ns, self.q.strict, lambda e: None, bare=True))
        return rows.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(self.ns.pk)))

    def rank_knn(self, k: Knn) -> None:
        index = self.ns.index(k.field)
        self.metric = index.metric if index else "l2"
        self.ranks[k.field] = F.col("_knn")
        self.ranks["rank"] = F.col("_knn")

    # subqueries

    def values(self, sub: Query) -> tuple[DataFrame, bool]:
        """The one column of a subquery, ``v``; is it a single value?"""
        if sub.total and not sub.aggregates:
            return run(self.db, sub.copy(limit=None)).counted.agg(F.count("*").alias("v")), True
        if sub.aggregates:
            return run(self.db, sub).aggregations[0].select(F.col("value").alias("v")), True
        plan = Plan(self.db, sub)
        rows = plan.limited()
        names = [s for s in sub.select if s != "*"]
        if len(names) != 1:
            raise QueryError("a subquery has one of: an aggregation, a field, a total")
        f = resolve(rows, names[0], plan.ns)
        return rows.select((F.explode(f.values()) if f.is_array else f.col).alias("v")), False

    def subquery_truth(self, f: Filter) -> bool:
        if f.cond in ("any", "empty"):
            return Plan(self.db, f.left).limited().isEmpty() == (f.cond == "empty")
        rows, _ = self.values(f.left)
        field = Field(F.col("v"), rows.schema["v"].dataType)
        if f.cond == "range":  # no value outside
            return rows.where(~truth(element_test(field, "range", f.value)(F.col("v")))).isEmpty()
        if f.cond == "allset":
            return rows.where(F.col("v").isin(*f.value)).distinct().count() == len({*f.value})
        cond = "set" if isinstance(f.value, list) and f.cond == "eq" else f.cond
        return not rows.where(truth(element_test(field, cond, f.value)(F.col("v")))).isEmpty()

    def subquery_value(self, f: Filter) -> Any:
        """A field (or function) against a subquery's value or values."""
        rows, single = self.values(f.value)
        if single or f.cond in ("lt", "le", "gt", "ge"):
            pick = {"lt": F.max, "le": F.max, "gt": F.min, "ge": F.min}.get(f.cond)
            value = rows.agg(pick("v")).head()[0] if pick else rows.head()[0]
            if value is None:
                return F.lit(False)
            return leaf(self.df, Filter(f.left, "eq" if f.cond == "set" else f.cond, value), self.ns, self.q.strict)
        if isinstance(f.left, Func):
            if f.left.name != "flat_array_len":
                raise QueryError(f"{f.left.name} compares with a single value")
            inner = resolve(self.df, f.left.args[0], self.ns, "none")
            field = Field(scalar.flat_array_len(inner.col, inner.kind).cast("long"), T.LongType())
        else:
            field = resolve(self.df, f.left, self.ns, self.q.strict)
        name = f"_j{len(self.flags)}"
        self.flags.append(name)
        found = rows.distinct().select(F.col("v").alias("_v"), F.lit(True).alias(name))
        if field.is_array:
            keys = [f"_k{i}" for i in range(len(self.ns.pk))]
            exploded = self.df.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(self.ns.pk, keys, strict=True)), F.explode(field.values()).alias("_e"))
            hit = exploded.join(found, F.col("_e") == F.col("_v")).groupBy(*keys).agg(F.count("*").alias("_c"))
            need = rows.distinct().count() if f.cond == "allset" else 1
            self.df = self.df.join(hit, joins._same(self.ns.pk), "left").drop(*keys).withColumn(name, truth(F.col("_c") >= need)).drop("_c")
        else:
            self.df = self.df.join(found, field.col == F.col("_v"), "left").drop("_v").withColumn(name, truth(F.col(name)))
        return F.col(name)

    def near_points(self, f: Filter) -> Any:
        """Within a distance of any point of a subquery: points meet in cells as wide as the distance, then by distance."""
        sub, distance = f.value[0], float(f.value[1])
        plan = Plan(self.db, validate(sub, "subquery"))
        rows = plan.limited()
        names = [s for s in sub.select if s != "*"]
        if len(names) != 1:
            raise QueryError("a subquery of points selects one field")
        if distance < 0:
            return F.lit(False)
        if not self.ns.pk:
            raise QueryError("a condition on a query's points needs a primary key")
        g = resolve(rows, names[0], plan.ns)
        px, py = scalar.point(g.col, g.kind)
        wide = distance or 1.0
        spots = rows.select(px.alias("_px"), py.alias("_py")).where("_px is not null and _py is not null").distinct()
        around = F.explode(F.array(*(F.struct((F.floor(F.col("_px") / wide) + i).alias("i"), (F.floor(F.col("_py") / wide) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        spots = spots.withColumn("_c", around).select("_px", "_py", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"))
        field = resolve(self.df, f.left, self.ns, self.q.strict)
        x, y = scalar.point(field.col, field.kind)
        keys = [f"_k{i}" for i in range(len(self.ns.pk))]
        own = self.df.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(self.ns.pk, keys, strict=True)), x.alias("_x"), y.alias("_y")).where("_x is not null and _y is not null")
        own = own.withColumn("_i", F.floor(F.col("_x") / wide)).withColumn("_j", F.floor(F.col("_y") / wide))
        close = own.join(spots, ["_i", "_j"]).where((F.col("_x") - F.col("_px")) ** 2 + (F.col("_y") - F.col("_py")) ** 2 <= distance * distance)
        name = f"_j{len(self.flags)}"
        self.flags.append(name)
        found = close.select(*keys).distinct().withColumn(name, F.lit(True))
        self.df = self.df.join(found, joins._same(self.ns.pk), "left").drop(*keys).withColumn(name, truth(F.col(name)))
        return F.col(name)

    # after where

    def ordered(self, df: DataFrame) -> list:
        q = self.q
        if q.sort:
            return sorting.order(df, q.sort, self.ns, self.ranks, self.names, q.strict)
        if "rrf" in self.ranks:
            return [self.ranks["rrf"](60.0).desc(), *(k.desc() for k in self.ns.key())]
        if "_knn" in df.columns:
            return [F.col("_knn").asc() if self.metric in vector.ASCENDING else F.col("_knn").desc(), *self.ns.key()]
        if "_ft" in df.columns:
            return [F.col("_ft").desc(), *self.ns.key()]
        return []

    def limited(self) -> DataFrame:
        df = aggregates.distinct_filter(self.filtered(), self.q.aggregates, self.ns)
        self.counted = df
        joined_sort = any(re.match(rf"{re.escape(n)}\.", s.expr) or f"{n}." in s.expr for s in self.q.sort for n in self.names)
        if joined_sort:
            df = self.attach(df)
        by = self.ordered(df)
        if not by and (self.q.limit is not None or self.q.offset):
            by = self.ns.key()  # a limit without an order is by key, to be repeatable
        if by and self.q.limit != 0:
            df = df.orderBy(*by)
        if self.q.offset:
            df = df.offset(self.q.offset)
        if self.q.limit is not None:
            df = df.limit(self.q.limit)
        return df

    def attach(self, df: DataFrame) -> DataFrame:
        for name, join, right, rns in self.attached:
            if name in df.columns:
                continue
            sub = join.query
            fields = [s for s in sub.select if s != "*"] or [c for c in rns.df.columns if not self._vector(rns, c)]
            order = []
            if sub.sort:
                for s in sub.sort:
                    order.append((sorting.key(right, s, rns, {}, {}, sub.strict), s.desc))
            df = joins.attach(df, self.ns, right, rns, join, name, order, fields)
        return df

    @staticmethod
    def _vector(ns, column: str) -> bool:
        index = ns.index(column)
        return bool(index and index.kind in ("hnsw", "vec_bf", "ivf"))

    def result(self) -> Result:
        q = self.q
        for j in q.joins:
            right, rns = self.right(j)
            self.note(j, right, rns, {k: 1 for k in self.names})
        df = self.limited()
        out = Result(df, counted=self.counted, db=self.db, query=q)
        out.aggregations = aggregates.all_of(df, q.aggregates, self.ns, self.counted)
        df = self.attach(df)
        for text in q.functions:
            name, function = text.split(".", 1)
            found = next((x for x in self.texts if x[0] == name or name in x[1]), None)
            if not found:
                raise QueryError(f"{name} isn't searched")
            if function.startswith("debug_rank"):
                if function.replace(" ", "") not in ("debug_rank", "debug_rank()"):
                    raise QueryError("debug_rank takes no arguments")
                df = df.withColumn(found[1][0], F.col("_why"))
                continue
            for f in found[1]:
                if f in df.columns:
                    df = fulltext.show(df, f, found[2], function, found[3], found[4])
        out.df = self.project(df)
        return out

    def project(self, df: DataFrame) -> DataFrame:
        q = self.q
        cols = []
        names = [s for s in q.select if s != "*"]
        if names and "*" not in q.select:
            for n in names:
                if n in df.columns:
                    cols.append(F.col(f"`{n}`"))
                else:
                    f = resolve(df, n, self.ns, "none")
                    cols.append(_nested(n, f.col if f.kind else F.lit(None).cast("string")))
            cols += [F.col(f"`{c}`") for c in self.base if q.vectors and c not in names and self._vector(self.ns, c)]
        else:
            cols += [F.col(f"`{c}`") for c in self.base if q.vectors or c in names or not self._vector(self.ns, c)]
        cols += [F.col(f"`{n}`") for n, *_ in self.attached if n in df.columns]
        if q.with_rank:
            rank = self.ranks["rrf"](60.0) if "rrf" in self.ranks else self.ranks.get("rank")
            if rank is None:
                raise QueryError("rank() needs a ranked query")
            cols.append(rank.alias("rank()"))
        return df.select(*cols)


def _nested(path: str, col) -> Any:
    """``a.b`` keeps its nesting."""
    parts = path.split(".")
    for p in reversed(parts[1:]):
        col = F.struct(col.alias(p))
    return col.alias(parts[0])


def merged(db, q: Query) -> Result:
    """A ranked union of queries over several namespaces: by rank, then id, then place of the member."""
    members = [q.copy(merge=[], limit=None, offset=0, aggregates=[], total=""), *q.merge]
    plans, frames, kinds = [Plan(db, m) for m in members], [], set()
    for i, p in enumerate(plans):
        for j in p.q.joins:
            right, rns = p.right(j)
            p.note(j, right, rns, {})
        df = p.filtered()
        fused = "rrf" in p.ranks
        if fused and p.q.sort:
            sort = p.q.sort[0]
            rank, kind = sorting.key(df, sort, p.ns, p.ranks, p.names, p.q.strict), f"hybrid {'desc' if sort.desc else 'asc'}"
        else:
            rank = p.ranks["rrf"](60.0) if fused else p.ranks.get("rank")
            kind = "hybrid desc" if fused else "none" if rank is None else p.metric or "text"
        if p.q.sort and not fused:
            raise QueryError("MERGE can't be sorted but by the rank of hybrid queries")
        kinds.add(kind)
        df = p.attach(df)
        cols = [F.col(f"`{c}`") for c in p.base if not p._vector(p.ns, c)] + [F.col(f"`{n}`") for n, *_ in p.attached]
        keys = F.struct(*(x for k in p.ns.key() for x in (k.cast("string").try_cast("double"), k.cast("string"))))
        place = F.struct(keys[keys_name(0)].alias("n"), F.to_json(keys).alias("s"), F.lit(i).alias("m"))
        frames.append(df.select(F.lit(p.ns.name).alias("_ns"), (rank if rank is not None else F.lit(None)).cast("double").alias("_rank"), place.alias("_id"), *cols))
    if len(kinds) > 1:
        raise QueryError("merged queries need one kind of rank, in one order")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    counted = out
    result = Result(out, counted=counted, db=db, query=q)
    result.aggregations = aggregates.all_of(out, q.aggregates, db.get(q.namespace), counted)
    up = kinds & {*vector.ASCENDING, "hybrid asc"}
    if q.limit is not None or q.offset or "none" not in kinds:
        out = out.orderBy(F.col("_rank").asc() if up else F.col("_rank").desc(), F.col("_id.n").asc_nulls_last(), "_id.s", "_id.m")
    if q.offset:
        out = out.offset(q.offset)
    if q.limit is not None:
        out = out.limit(q.limit)
    result.df = out.drop("_id") if q.with_rank else out.drop("_id", "_rank")
    return result


def keys_name(i: int) -> str:
    """The name of an unnamed struct field."""
    return f"col{i + 1}"
