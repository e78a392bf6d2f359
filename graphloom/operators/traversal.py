"""Breadth-first loops, paths and closures. A level is one join of the frontier with the edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Direction, GraphError, MissingElement, PropertyGraph
from graphloom.operators.adjacency import walks, weight
from graphloom.operators.components import connected, is_connected
from graphloom.plans.iterate import cut, iterate, small

#: Levels whose union makes up the visited set before it is cut anew.
LEVELS = 16


def levels(g: PropertyGraph, start: DataFrame, direction: Direction | str = Direction.BOTH, *labels: str, depth: int | None = None, until: str | None = None) -> DataFrame:
    """(id, depth, parent) of what can be reached from start(id): the fewest steps, and the smallest id one step before.

    Stops at `depth`, or with the level that holds `until`. Edges are kept as they are, once, as no task can hold a grouping of all of them:
    parallel ones make no difference to the least source.
    """
    one = cut(walks(g.edges, Direction.OUT, *labels).where("source <> target").select("source", "target"))
    back, direction = one.select(F.col("target").alias("source"), F.col("source").alias("target")), Direction.of(direction)
    edges = one if direction is Direction.OUT else back if direction is Direction.IN else one.unionByName(back)
    first = cut(start.select("id").distinct().join(g.vertices.select("id"), "id", "left_semi").select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))

    def step(state: tuple, k: int) -> tuple[tuple, bool]:
        visited, front, rows = state
        if rows == 0 or depth is not None and k >= depth or until is not None and not front.where(F.col("id") == until).isEmpty():
            return state, False
        reached = small(front.select(F.col("id").alias("source")), rows).join(edges, "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        new = cut(reached.join(visited.select("id"), "id", "left_anti").select("id", F.lit(k + 1).alias("depth"), "parent"))
        visited = visited.unionByName(new)
        if k % LEVELS == LEVELS - 1:
            visited = cut(visited)
        return (visited, new, new.count()), True

    return iterate((first, first, first.count()), step)[0]


def _one(g: PropertyGraph, id: str) -> DataFrame:
    return g.spark.createDataFrame([(id,)], "id string")


def bfs(g: PropertyGraph, start: str, direction: Direction | str = Direction.BOTH, *labels: str) -> DataFrame:
    """(id, depth), in that order of depth and id once sorted by them."""
    return levels(g, _one(g, start), direction, *labels).select("id", "depth")


def at_distance(g: PropertyGraph, start: str, distance: int) -> DataFrame:
    """(id) exactly so many steps away; none for negative distances."""
    if distance < 0:
        return g.vertices.select("id").limit(0)
    return levels(g, _one(g, start), depth=distance).where(F.col("depth") == distance).select("id")


def reachable(g: PropertyGraph, start: str, direction: Direction | str = Direction.OUT) -> DataFrame:
    return levels(g, _one(g, start), direction).select("id")


def bounded(g: PropertyGraph, starts: list[str], depth: int, *process: Column) -> DataFrame:
    """(id, depth, ...) within `depth` steps out of any start, with the given columns of the vertices."""
    found = levels(g, g.spark.createDataFrame([(i,) for i in starts], "id string"), Direction.OUT, depth=depth).select("id", "depth")
    return found.join(g.vertices, "id").select("id", "depth", *process) if process else found


def bounded_both(g: PropertyGraph, start: str, depth: int) -> DataFrame:
    """(id, depth) within `depth` steps, direction aside."""
    return levels(g, _one(g, start), depth=depth).select("id", "depth")


def shortest_path(g: PropertyGraph, start: str, end: str, direction: Direction | str = Direction.BOTH) -> list[str] | None:
    """The ids of a shortest path; among equals, back from the end, always over the smallest id. None if there is none.

    The way back looks up a row per step, which is less than the search, a join per step, has cost already.
    """
    if start == end:
        return [start] if not g.vertices.where(F.col("id") == start).isEmpty() else None
    found = cut(levels(g, _one(g, start), direction, until=end))
    path, at = [], end
    while at is not None:
        row = found.where(F.col("id") == at).select("parent").first()
        if row is None:
            return None
        path.append(at)
        at = row["parent"]
    return path[::-1]


def path_frame(g: PropertyGraph, path: list[str] | None) -> DataFrame:
    return g.spark.createDataFrame([(">".join(path), len(path) - 1)] if path else [], "path string, hops int")


def dijkstra(g: PropertyGraph, start: str, direction: Direction | str = Direction.OUT, property: str = "weight", depth: int | None = None) -> DataFrame:
    """(id, distance, parent) of what can be reached, by relaxing the edges of what changed until nothing does.

    A missing or non-numeric weight is 1. Raises on negative weights, for which there may be no shortest path.
    """
    e = g.edges.withColumn("__w", weight(property) if property in g.edges.columns else F.lit(1.0))
    edges = cut(walks(e, direction, extra=("__w",)).where("source <> target").groupBy("source", "target").agg(F.min("__w").alias("w")))
    if not edges.where("w < 0").isEmpty():
        raise GraphError("a weight is negative")
    first = cut(_one(g, start).join(g.vertices.select("id"), "id", "left_semi").select("id", F.lit(0.0).alias("distance"), F.lit(None).cast("string").alias("parent")))

    def step(state: tuple, _: int) -> tuple[tuple, bool]:
        best, front, rows = state
        if rows == 0:
            return state, False
        tried = small(front.select(F.col("id").alias("source"), "distance"), rows).join(edges, "source").groupBy(F.col("target").alias("id")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("source").alias("p"))).alias("n"))
        old = best.select("id", F.col("distance").alias("o"))
        new = cut(tried.join(old, "id", "left").where("o is null or n.d < o").select("id", F.col("n.d").alias("distance"), F.col("n.p").alias("parent")))
        best = cut(best.join(new.select("id"), "id", "left_anti").unionByName(new))
        return (best, new, new.count()), True

    return iterate((first, first, first.count()), step)[0]


def weighted_path(g: PropertyGraph, start: str, end: str, direction: Direction | str = Direction.OUT, property: str = "weight") -> tuple[list[str], float] | None:
    """The path of least weight and that weight; None if there is none."""
    found = cut(dijkstra(g, start, direction, property))
    path, at, total = [], end, None
    while at is not None:
        row = found.where(F.col("id") == at).first()
        if row is None:
            return None
        total = row["distance"] if total is None else total
        path.append(at)
        at = row["parent"]
    return path[::-1], total


def closure(g: PropertyGraph, direction: Direction | str = Direction.OUT) -> DataFrame:
    """(src, dst): everything each vertex can reach but itself. Paths double in length every round, and only new ones are joined."""
    start = cut(walks(g.edges, direction).where("source <> target").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct())

    def step(state: tuple, _: int) -> tuple[tuple, bool]:
        paths, new = state
        left, right = (lambda x: x.select("src", F.col("dst").alias("m"))), (lambda x: x.select(F.col("src").alias("m"), "dst"))
        found = left(new).join(right(paths), "m").select("m", "src", "dst").unionByName(left(paths).join(right(new), "m").select("m", "src", "dst"))
        more = cut(found.where("src <> dst").select("src", "dst").distinct().join(paths, ["src", "dst"], "left_anti"))
        return (cut(paths.unionByName(more)), more), not more.isEmpty()

    return iterate((start, start), step)[0]


def diameter(g: PropertyGraph, most: int = 20_000) -> DataFrame:
    """One row: the longest shortest path, direction aside; -1 if not connected, 0 for up to one vertex.

    It needs a row per pair of vertices, so graphs of more than `most` vertices raise.
    """
    n = g.vertices.count()
    if n > most:
        raise GraphError(f"{n} vertices make too many pairs; {most} at most")
    row = lambda d: g.spark.createDataFrame([(d,)], "diameter int")
    if n <= 1:
        return row(0)
    if not is_connected(g).first()["connected"]:
        return row(-1)
    edges = cut(walks(g.edges, Direction.BOTH).where("source <> target").select("source", "target").distinct())
    first = cut(g.vertices.select(F.col("id").alias("s"), F.col("id").alias("t")))

    def step(state: tuple, k: int) -> tuple[tuple, bool]:
        pairs, front, _ = state
        new = cut(front.join(edges, F.col("t") == F.col("source")).select("s", F.col("target").alias("t")).distinct().join(pairs, ["s", "t"], "left_anti"))
        return (cut(pairs.unionByName(new)), new, k), not new.isEmpty()

    return row(iterate((first, first, 0), step)[2])


def dfs_order(g: PropertyGraph, start: str) -> DataFrame:
    """(id, place): preorder of an iterative search that visits larger ids first. One task holds the start's component."""
    if g.vertices.where(F.col("id") == start).isEmpty():
        raise MissingElement(start)
    component = connected(g)
    own = component.where(F.col("id") == start).select("component")
    members = component.join(F.broadcast(own), "component", "left_semi").select("id")
    e = walks(g.edges, Direction.BOTH).select("source", "target").distinct().join(members.select(F.col("id").alias("source")), "source")
    rows = e.unionByName(g.spark.createDataFrame([(start, start)], "source string, target string")).withColumn("one", F.lit(1))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: sorted(set(v)) for k, v in pdf.groupby("source")["target"]}
        seen, out, stack = set(), [], [start]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                out.append(v)
                stack += [w for w in near.get(v, []) if w not in seen]
        return pd.DataFrame({"id": out, "place": range(len(out))})

    return rows.groupBy("one").applyInPandas(order, "id string, place int")
