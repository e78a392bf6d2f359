"""Scans and look-ups of vertices and edges."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Direction, PropertyGraph


def by_ids(elements: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each id given, as often as it is given; unknown ids are left out. Of graphs whose ids are made of several columns, use vertices_by_ids and edges_by_ids."""
    if len(set(ids)) == len(ids):
        return elements.where(F.col("id").isin(ids)) if ids else elements.limit(0)
    wanted = elements.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return wanted.join(elements.where(F.col("id").isin(sorted(set(ids)))), "id").select(*elements.columns)


def vertices_by_ids(g: PropertyGraph, ids: list[str]) -> DataFrame:
    """As by_ids, by filters on the source's own keys where the graph knows how."""
    return by_ids(g.vertices if g.lookup is None else g.lookup.vertices(sorted(set(ids))), ids)


def edges_by_ids(g: PropertyGraph, ids: list[str]) -> DataFrame:
    return by_ids(g.edges if g.lookup is None else g.lookup.edges(sorted(set(ids))), ids)


def vertex(g: PropertyGraph, id: str) -> DataFrame:
    return vertices_by_ids(g, [id]).limit(1)


def edge(g: PropertyGraph, id: str) -> DataFrame:
    return edges_by_ids(g, [id]).limit(1)


def by_label(elements: DataFrame, *labels: str) -> DataFrame:
    """No label: all."""
    return elements.where(F.col("label").isin(list(labels))) if labels else elements


def by_property(elements: DataFrame, key: str, value: Any) -> DataFrame:
    """Strict equality; None finds elements without the key."""
    return by_properties(elements, {key: value})


def by_properties(elements: DataFrame, properties: dict[str, Any]) -> DataFrame:
    """All of the pairs; no pair: all elements. Equality with null is IS NULL, so the filter is pushed down."""
    tests = [F.lit(None).isNotNull() if k not in elements.columns and v is not None else F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in properties.items() if k in elements.columns or v is not None]
    return elements.where(reduce(lambda a, b: a & b, tests)) if tests else elements


def filtered(elements: DataFrame, *predicates: Column) -> DataFrame:
    return elements.where(reduce(lambda a, b: a & b, predicates)) if predicates else elements


def between(g: PropertyGraph, out: str, into: str, *labels: str) -> DataFrame:
    edges = by_label(g.edges, *labels) if g.lookup is None else g.lookup.between(out, into, *labels)
    return edges.where((F.col("src") == out) & (F.col("dst") == into))


def first_by_name(g: PropertyGraph, name: str, key: str = "name") -> DataFrame:
    """Of the vertices with that name, the one with the smallest id."""
    return g.vertices.where(F.col(key) == name).orderBy("id").limit(1)


def incident(g: PropertyGraph, id: str, direction: Direction | str = Direction.BOTH, *labels: str) -> DataFrame:
    """A vertex's edges; a self-loop once."""
    test = {Direction.OUT: F.col("src") == id, Direction.IN: F.col("dst") == id, Direction.BOTH: (F.col("src") == id) | (F.col("dst") == id)}
    return by_label(g.edges, *labels).where(test[Direction.of(direction)])
