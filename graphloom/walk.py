"""Walks: a fluent way to write traversals, each step of which adds to one plan that nothing runs before it is read.

    walk(g).V("customer:1").out("placed").out("contains").has("size", gt(10)).group_count("brand")

A walk is a bag of traversers: a row each, with the element or value it is at, the path it took and what was marked on it. A vertex
reached twice is there twice; `dedup` makes a set of it. Values are text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.coercion import definite, in_range, match_value
from graphloom.model import Direction, GraphError, PropertyGraph, text_of
from graphloom.operators.adjacency import walks
from graphloom.operators.criteria import Criterion, on_row
from graphloom.operators.scan import by_label, edges_by_ids, vertices_by_ids

#: A test of a value in a column of the given type.
Test = Callable[[Column, str], Column]


def eq(value: Any) -> Test:
    return lambda c, kind: match_value(c, kind, value)


def neq(value: Any) -> Test:
    return lambda c, kind: c.isNotNull() & ~match_value(c, kind, value)


def gt(low: Any) -> Test:
    return lambda c, kind: in_range(c, kind, low, None, False)


def gte(low: Any) -> Test:
    return lambda c, kind: in_range(c, kind, low)


def lt(high: Any) -> Test:
    return lambda c, kind: in_range(c, kind, None, high)


def lte(high: Any) -> Test:
    return lambda c, kind: in_range(c, kind, None, high, True, True)


def between(low: Any, high: Any) -> Test:
    """The lower bound included, the upper one not."""
    return lambda c, kind: in_range(c, kind, low, high)


def within(*values: Any) -> Test:
    return lambda c, kind: reduce(lambda a, b: a | b, [match_value(c, kind, v) for v in values], F.lit(False))


def without(*values: Any) -> Test:
    return lambda c, kind: c.isNotNull() & ~within(*values)(c, kind)


def walk(g: PropertyGraph) -> "Source":
    return Source(g)


class Source:
    def __init__(self, g: PropertyGraph):
        self.g = g

    def V(self, *ids: str) -> "Walk":  # noqa: N802
        return self._from(vertices_by_ids(self.g, list(ids)) if ids else self.g.vertices, "vertex")

    def E(self, *ids: str) -> "Walk":  # noqa: N802
        return self._from(edges_by_ids(self.g, list(ids)) if ids else self.g.edges, "edge")

    def _from(self, elements: DataFrame, kind: str) -> "Walk":
        return Walk(self.g, elements.select(F.col("id").alias("at"), F.array("id").alias("path"), F.create_map().cast("map<string,string>").alias("marks")), kind)

    def match(self, *patterns: tuple[str, str, str, str]) -> DataFrame:
        """A column per name: all ways to give vertices to names so that each pattern (name, "out", "in" or "both", label, name) holds."""
        found: DataFrame | None = None
        for n, (a, direction, label, b) in enumerate(patterns):
            pair = walks(self.g.edges, direction, *([label] if label else [])).select(F.col("source").alias(f"__a{n}"), F.col("target").alias(f"__b{n}")).distinct()
            if a == b:
                pair = pair.where(F.col(f"__a{n}") == F.col(f"__b{n}"))
            ends = {a: f"__a{n}"} | ({b: f"__b{n}"} if a != b else {})
            if found is None:
                found = pair.select(*[F.col(c).alias(x) for x, c in ends.items()])
                continue
            known = [x for x in ends if x in found.columns]
            joined = found.join(pair, reduce(lambda p, q: p & q, [F.col(x) == F.col(ends[x]) for x in known])) if known else found.crossJoin(pair)
            found = joined.select(*found.columns, *[F.col(c).alias(x) for x, c in ends.items() if x not in known])
        if found is None:
            raise GraphError("no pattern to match")
        return found.distinct()


class Walk:
    def __init__(self, g: PropertyGraph, rows: DataFrame, kind: str):
        self.g, self.rows, self.kind = g, rows, kind

    def _with(self, rows: DataFrame, kind: str | None = None) -> "Walk":
        return Walk(self.g, rows.select("at", "path", "marks"), kind or self.kind)

    def _elements(self) -> DataFrame:
        if self.kind not in ("vertex", "edge"):
            raise GraphError("values have no properties, labels or edges")
        return self.g.vertices if self.kind == "vertex" else self.g.edges

    def _only(self, ids: DataFrame) -> "Walk":
        return self._with(self.rows.join(ids.select(F.col("id").alias("at")).distinct(), "at", "left_semi"))

    # filters

    def has(self, key: str, test: Any = None) -> "Walk":
        """Elements with that property, or with a value of it that equals the given one or passes the test; any live value counts."""
        e = self._elements()
        passes = (lambda c, kind: c.isNotNull()) if test is None else test if callable(test) else eq(test)
        kinds = dict(e.dtypes)
        found = [e.where(passes(F.col(f"`{key}`"), kinds[key])).select("id")] if key in kinds else []
        if self.kind == "vertex" and (key not in kinds or key in self.g.multiple({key})):
            own = definite(on_row(Criterion("exact", key, test))) if test is not None and not callable(test) else passes(F.col("value"), "string")
            found.append(self.g.vprops.where((F.col("key") == key) & own).select(F.col("vertex_id").alias("id")))
        return self._only(reduce(DataFrame.union, found) if found else e.limit(0))

    def has_label(self, *labels: str) -> "Walk":
        return self._only(by_label(self._elements(), *labels))

    def where(self, test: Callable[["Walk"], "Walk"]) -> "Walk":
        """Traversers from whose place the given walk leads anywhere."""
        return self._with(self._split(test, "left_semi"))

    def not_(self, test: Callable[["Walk"], "Walk"]) -> "Walk":
        return self._with(self._split(test, "left_anti"))

    def _split(self, test: Callable[["Walk"], "Walk"], how: str) -> DataFrame:
        start = self.rows.select("at").distinct().select("at", F.array("at").alias("path"), F.create_map(F.lit("~"), F.col("at")).alias("marks"))
        led = test(Walk(self.g, start, self.kind)).rows.select(F.col("marks")["~"].alias("at")).distinct()
        return self.rows.join(led, "at", how)

    def dedup(self) -> "Walk":
        """One traverser for each place, with the smallest path."""
        first = self.rows.groupBy("at").agg(F.min(F.struct("path", F.to_json("marks").alias("m"))).alias("x"))
        return self._with(first.select("at", "x.path", F.from_json("x.m", "map<string,string>").alias("marks")))

    def limit(self, n: int) -> "Walk":
        """The first in the order of place and path."""
        return self._with(self.rows.orderBy("at", "path").limit(n))

    # moves

    def _move(self, direction: Direction, labels: tuple[str, ...], to: str) -> "Walk":
        if self.kind != "vertex":
            raise GraphError("only vertices have edges")
        step = walks(self.g.edges, direction, *labels).select(F.col("source").alias("at"), F.col(to).alias("to"))
        rows = self.rows.join(step, "at").select(F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), "marks")
        return self._with(rows, "vertex" if to == "target" else "edge")

    def out(self, *labels: str) -> "Walk":
        return self._move(Direction.OUT, labels, "target")

    def in_(self, *labels: str) -> "Walk":
        return self._move(Direction.IN, labels, "target")

    def both(self, *labels: str) -> "Walk":
        return self._move(Direction.BOTH, labels, "target")

    def out_e(self, *labels: str) -> "Walk":
        return self._move(Direction.OUT, labels, "edge")

    def in_e(self, *labels: str) -> "Walk":
        return self._move(Direction.IN, labels, "edge")

    def both_e(self, *labels: str) -> "Walk":
        return self._move(Direction.BOTH, labels, "edge")

    def _end(self, end: Column) -> "Walk":
        if self.kind != "edge":
            raise GraphError("only edges have ends")
        ends = self.g.edges.select(F.col("id").alias("at"), "src", "dst")
        rows = self.rows.join(ends, "at").withColumn("to", end).where("to is not null")
        return self._with(rows.select(F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), "marks"), "vertex")

    def out_v(self) -> "Walk":
        return self._end(F.col("src"))

    def in_v(self) -> "Walk":
        return self._end(F.col("dst"))

    def other_v(self) -> "Walk":
        """The end that the walk didn't come from."""
        before = F.try_element_at("path", F.lit(-2))
        return self._end(F.when(F.col("src") == before, F.col("dst")).when(F.col("dst") == before, F.col("src")))

    def values(self, *keys: str) -> "Walk":
        """All live values of the keys."""
        e = self._elements()
        parts = [e.select(F.col("id").alias("at"), F.col(f"`{k}`").cast("string").alias("to")) for k in keys if k in e.columns and not (self.kind == "vertex" and k in self.g.multiple({k}))]
        rest = [k for k in keys if k not in e.columns or k in self.g.multiple({k})]
        if self.kind == "vertex" and rest:
            parts.append(self.g.vprops.where(F.col("key").isin(rest)).select(F.col("vertex_id").alias("at"), F.col("value").alias("to")))
        found = reduce(DataFrame.union, parts) if parts else e.limit(0).select(F.col("id").alias("at"), F.col("id").alias("to"))
        rows = self.rows.join(found.where("to is not null"), "at")
        return self._with(rows.select(F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), "marks"), "value")

    def repeat(self, step: Callable[["Walk"], "Walk"], times: int, emit: bool = False) -> "Walk":
        """The step so many times; `emit`: with all traversers on the way after the first time."""
        now, passed = self, []
        for _ in range(times):
            now = step(now)
            passed.append(now.rows)
        return now._with(reduce(DataFrame.unionByName, passed)) if emit and passed else now

    def choose(self, test: Callable[["Walk"], "Walk"], then: Callable[["Walk"], "Walk"], otherwise: Callable[["Walk"], "Walk"] = lambda w: w) -> "Walk":
        yes, no = then(self.where(test)), otherwise(self.not_(test))
        if yes.kind != no.kind:
            raise GraphError("both ways have to lead to the same kind of place")
        return yes._with(yes.rows.unionByName(no.rows))

    def union(self, *ways: Callable[["Walk"], "Walk"]) -> "Walk":
        ends = [way(self) for way in ways]
        if len({w.kind for w in ends}) != 1:
            raise GraphError("all ways have to lead to the same kind of place")
        return ends[0]._with(reduce(DataFrame.unionByName, [w.rows for w in ends]))

    def as_(self, name: str) -> "Walk":
        """Marks the place."""
        kept = F.map_filter("marks", lambda k, _: k != name)
        return self._with(self.rows.withColumn("marks", F.map_concat(kept, F.create_map(F.lit(name), F.col("at")))))

    # results

    def select(self, *names: str) -> DataFrame:
        """A column per mark."""
        return self.rows.select(*[F.col("marks")[n].alias(n) for n in names])

    def ids(self) -> DataFrame:
        return self.rows.select(F.col("at").alias("id"))

    def elements(self) -> DataFrame:
        """The rows of the elements, as often as they were reached."""
        return self.ids().join(self._elements(), "id")

    def paths(self) -> DataFrame:
        return self.rows.select("path")

    def count(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("count"))

    def fold(self) -> DataFrame:
        """One row: all places, sorted."""
        return self.rows.agg(F.array_sort(F.collect_list("at")).alias("list"))

    def _by(self, key: str | None) -> DataFrame:
        if key is None:
            return self.rows.select(F.col("at").alias("value"), "at")
        e = self._elements()
        if key not in e.columns:
            raise GraphError(f"{key!r} is no column")
        return self.rows.join(e.select(F.col("id").alias("at"), F.col(f"`{key}`").cast("string").alias("value")), "at")

    def group_count(self, key: str | None = None) -> DataFrame:
        """(value, count) by place, or by a property of it; one without it is a group of its own."""
        return self._by(key).groupBy("value").agg(F.count("*").alias("count"))

    def group(self, key: str | None = None) -> DataFrame:
        """(value, list): the sorted places."""
        return self._by(key).groupBy("value").agg(F.array_sort(F.collect_list("at")).alias("list"))

    def order(self, key: str | None = None, ascending: bool = True) -> DataFrame:
        """(id, value), sorted by the value and then the id; none comes first, or last if descending."""
        rows = self._by(key).select(F.col("at").alias("id"), "value")
        if key is not None:
            kind = dict(self._elements().dtypes)[key]
            rows = rows.withColumn("value", F.col("value").cast(kind))
        return rows.orderBy(F.col("value").asc_nulls_first() if ascending else F.col("value").desc_nulls_last(), "id")


def search(g: PropertyGraph, text: str, kind: str = "vertex") -> DataFrame:
    """(id, key, value): properties whose text holds the given one, case aside."""
    wanted = F.lit(text_of(text).lower())
    elements = g.vertices if kind == "vertex" else g.edges
    own = [c for c in elements.columns if c not in ("id", "src", "dst", "label")]
    rows = elements.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in own])).alias("p")).select("id", "p.*") if own else elements.select("id", F.lit("").alias("key"), F.lit(None).cast("string").alias("value"))
    if kind == "vertex":
        rows = rows.union(g.vprops.select("vertex_id", "key", "value"))
    return rows.where(definite(F.contains(F.lower("value"), wanted))).distinct()
