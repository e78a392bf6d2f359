"""Property criteria, compiled to one Column per tree.

Keys that are vertex columns become plain expressions, which Catalyst pushes down to the scan. Keys that only `vprops` has
become flags of one grouping of the rows of those keys, left-joined to the vertices: any live value of a key may match. Keys with
a column for first values and several values in `vprops` (PropertyGraph.multi) get both. What can't be evaluated, such as a bound that isn't
a number or a pattern that isn't one, is false. Logic is two-valued throughout: an absent key fails any test but not_exists and exact(key, None), and NOT of a failure holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.coercion import definite, in_range, is_number, match_value, matches, typed_match
from graphloom.model import Cardinality, PropertyGraph


@dataclass(frozen=True)
class Criterion:
    kind: str
    key: str = ""
    value: Any = None
    options: tuple = ()
    parts: tuple["Criterion", ...] = ()

    def keys(self) -> set[str]:
        return {self.key} - {""} | {k for p in self.parts for k in p.keys()}


def exact(key: str, value: Any) -> Criterion:
    """A value equals the given one; None: the key is absent."""
    return Criterion("exact", key, value)


def between(key: str, low: Any = None, high: Any = None, include_low: bool = True, include_high: bool = False) -> Criterion:
    return Criterion("range", key, None, (low, high, include_low, include_high))


def exists(key: str) -> Criterion:
    return Criterion("exists", key)


def not_exists(key: str) -> Criterion:
    return Criterion("not_exists", key)


def contains(key: str, part: str, ignore_case: bool = False) -> Criterion:
    return Criterion("contains", key, part, (ignore_case,))


def contains_element(key: str, element: Any) -> Criterion:
    """A collection value holds the element; LIST and SET properties are collections of their values."""
    return Criterion("element", key, element)


def regex(key: str, pattern: str) -> Criterion:
    """The whole string matches."""
    return Criterion("regex", key, pattern)


def all_of(*parts: Criterion) -> Criterion:
    return Criterion("and", parts=parts)


def any_of(*parts: Criterion) -> Criterion:
    return Criterion("or", parts=parts)


def negated(part: Criterion) -> Criterion:
    return Criterion("not", parts=(part,))


def on_column(c: Criterion, column: Column, kind: str) -> Column:
    """A leaf on a single typed column."""
    if c.kind == "exact":
        return match_value(column, kind, c.value)
    if c.kind == "range":
        return in_range(column, kind, *c.options)
    if c.kind in ("exists", "not_exists"):
        return column.isNotNull() if c.kind == "exists" else column.isNull()
    if c.kind == "contains":
        if kind != "string":
            return F.lit(False)
        return definite(F.contains(F.lower(column), F.lit(c.value.lower())) if c.options[0] else F.contains(column, F.lit(c.value)))
    if c.kind == "regex":
        return matches(column, c.value) if kind == "string" else F.lit(False)
    if c.kind == "element":
        return definite(F.array_contains(column, c.value)) if kind.startswith("array") else match_value(column, kind, c.value)
    raise ValueError(c.kind)


def on_row(c: Criterion) -> Column:
    """A leaf on a row of vprops; coercion as for vertices."""
    value, kind = F.col("value"), F.col("type")
    if c.kind in ("exact", "element") and c.value is not None:
        return typed_match(value, kind, c.value)
    if c.kind == "range":
        return in_range(value, "string", *c.options)
    if c.kind == "contains":
        return definite((kind == "string") & (F.contains(F.lower(value), F.lit(c.value.lower())) if c.options[0] else F.contains(value, F.lit(c.value))))
    if c.kind == "regex":
        return definite(kind == "string") & matches(value, c.value)
    return F.lit(True)


def query_vertices(g: PropertyGraph, *criteria: Criterion) -> DataFrame:
    """The vertices that meet all criteria."""
    kinds = dict(g.vertices.dtypes)
    several = g.multiple({k for c in criteria for k in c.keys()} & kinds.keys())
    flags: dict[Criterion, str] = {}

    def compiled(c: Criterion) -> Column:
        if c.kind in ("and", "or"):
            return reduce(lambda a, b: a & b if c.kind == "and" else a | b, map(compiled, c.parts), F.lit(c.kind == "and")) if c.parts else F.lit(c.kind == "and")
        if c.kind == "not":
            return ~compiled(c.parts[0])
        absent = c.kind == "not_exists" or c.kind == "exact" and c.value is None
        first = on_column(c, F.col(f"`{c.key}`"), kinds[c.key]) if c.key in kinds else F.lit(absent)
        if c.key in kinds and c.key not in several:
            return first
        some = F.coalesce(F.col(flags.setdefault(c, f"__flag{len(flags)}")), F.lit(False))
        return first & ~some if absent else first | some

    condition = reduce(lambda a, b: a & b, map(compiled, criteria), F.lit(True))
    if not flags:
        return g.vertices.where(condition)
    keys = sorted({c.key for c in flags})
    rows = g.vprops.where(F.col("key").isin(keys))
    tests = rows.groupBy("vertex_id").agg(*[F.max((F.col("key") == c.key) & on_row(c)).alias(name) for c, name in flags.items()])
    joined = g.vertices.join(tests, g.vertices["id"] == tests["vertex_id"], "left")
    return joined.where(condition).select(*[g.vertices[c] for c in g.vertices.columns])


def query_properties(vprops: DataFrame, *criteria: Criterion) -> DataFrame:
    """The property rows that meet any criterion. Types are strict here, and a range without bounds holds for numbers."""
    value, kind = F.col("value"), F.col("type")

    def strict(c: Criterion) -> Column:
        mine = F.col("key") == c.key
        if c.kind == "exact":
            name = "boolean" if isinstance(c.value, bool) else "long" if isinstance(c.value, int) else "double" if isinstance(c.value, float) else "string"
            same = value == F.lit(str(c.value).lower() if isinstance(c.value, bool) else str(c.value)) if name in ("string", "boolean", "long") else value.try_cast("double") == F.lit(c.value)
            return mine & (kind == name) & same
        if c.kind == "range":
            return mine & kind.isin("long", "double") & in_range(value, "string", *c.options, open_is=True)
        if c.kind == "not":
            return ~definite(strict(c.parts[0]))
        if c.kind in ("and", "or"):
            return reduce(lambda a, b: a & b if c.kind == "and" else a | b, map(strict, c.parts))
        return mine & on_row(c)

    return vprops.where(reduce(lambda a, b: a | b, [definite(strict(c)) for c in criteria], F.lit(False)))


def query_by_meta(g: PropertyGraph, key: str, meta_key: str, value: str | None = None) -> DataFrame:
    """Vertices with a value of key that has the meta-property, or has it with the given value."""
    meta = F.col("meta").getItem(meta_key)
    rows = g.vprops.where((F.col("key") == key) & (meta.isNotNull() if value is None else definite(meta == F.lit(value)))).select(F.col("vertex_id").alias("id"))
    return g.vertices.join(rows, "id", "left_semi")


def query_by_cardinality(g: PropertyGraph, key: str, cardinality: Cardinality | str) -> DataFrame:
    """Vertices whose key has the cardinality; one without the key counts as SINGLE."""
    own = g.vprops.where(F.col("key") == key).groupBy(F.col("vertex_id").alias("id")).agg(F.max("cardinality").alias("__c"))
    return g.vertices.join(own, "id", "left").where(F.coalesce("__c", F.lit("SINGLE")) == Cardinality.of(cardinality).value).drop("__c")


def query_range(g: PropertyGraph, key: str, low: Any, high: Any, include_low: bool = True, include_high: bool = True) -> DataFrame:
    kinds = dict(g.vertices.dtypes)
    if key in kinds and not is_number(kinds[key]) and kinds[key] != "string":
        return g.vertices.limit(0)
    return query_vertices(g, between(key, low, high, include_low, include_high))
