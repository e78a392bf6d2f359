"""Spanning forests, layers, strongly connected components, cut vertices and bridges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Direction, PropertyGraph
from graphloom.operators.adjacency import walks, weight
from graphloom.operators.components import connected, stars
from graphloom.plans.iterate import cut, iterate, small


def spanning_forest(g: PropertyGraph, property: str = "weight") -> DataFrame:
    """(id, src, dst, weight) of the edges of least weight that connect what is connected, by Boruvka rounds.

    Equal weights are ordered by edge id, so the forest is unique. Self-loops are never chosen; a missing weight is 1.
    """
    w = weight(property) if property in g.edges.columns else F.lit(1.0)
    edges = cut(g.edges.where("src <> dst").select("id", "src", "dst", w.alias("weight")))
    label = cut(g.vertices.select("id", F.col("id").alias("c")))

    def step(state: tuple, _: int) -> tuple[tuple, bool]:
        label, chosen = state
        a, b = label.select(F.col("id").alias("src"), F.col("c").alias("ca")), label.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        open_ = edges.join(a, "src").join(b, "dst").where("ca <> cb")
        ends = F.explode(F.array(F.struct(F.col("ca").alias("c")), F.struct(F.col("cb").alias("c"))))
        least = cut(open_.select(ends.alias("x"), F.struct("weight", "id", "src", "dst", "ca", "cb").alias("e")).groupBy("x.c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if least.isEmpty():
            return state, False
        roots = stars(least.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = cut(label.join(roots, label["c"] == roots["node"], "left").select("id", F.coalesce("root", "c").alias("c")))
        return (moved, cut(chosen.unionByName(least.select("id", "src", "dst", "weight")))), True

    return iterate((label, edges.limit(0)), step)[1]


def _chains(v: DataFrame) -> tuple[DataFrame, bool]:
    """v(id, up, many) to (id, up, hops) and whether all got one: how far up the nearest vertex is that has no or many sources.

    Reaches double every round; what has arrived stays as it is.
    """
    done = v.where("up is null or many").select("id", F.col("id").alias("up"), F.lit(0).alias("hops"))
    open_ = v.where("not many").select("id", "up", F.lit(1).alias("hops"))

    def step(state: tuple, _: int) -> tuple[tuple, bool]:
        done, open_, rows, _ = state
        if rows == 0:
            return state, False
        known = done.withColumn("over", F.lit(True)).unionByName(open_.withColumn("over", F.lit(False)))
        known = known.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("hops").alias("more"), "over")
        new = cut(open_.join(known, "up").select("id", F.col("further").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), "over"))
        left = new.where("not over").count()
        if not left < rows:  # only circles, and what hangs on them, arrive nowhere
            return (done, open_, 0, False), True
        return (done.unionByName(new.where("over").drop("over")), new.where("not over").drop("over"), left, True), True

    done, _, _, whole = iterate((done, open_, open_.count(), True), step)
    return done, whole


def topological(g: PropertyGraph, direction: Direction | str = Direction.OUT) -> DataFrame | None:
    """(id, level): how many rounds of removing vertices without incoming edges come before. None if there is a cycle.

    That is the longest way to a vertex. Vertices with one source are as far from the nearest one above that has none or several as
    doubling reaches tell, in rounds that grow with the logarithm of the chains; rounds of removal go over the others only.
    """
    walked = walks(g.edges, direction).select("source", "target")
    into = walked.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("up"), (F.min("source") < F.max("source")).alias("many"))
    v = cut(g.vertices.select("id").join(into, "id", "left"))
    chains, whole = _chains(v)
    if not whole:
        return None
    joints = cut(v.where("many").select("id"))
    if joints.isEmpty():
        return chains.select("id", F.col("hops").alias("level")) if chains.count() == v.count() else None
    chains = cut(chains)
    inner = walked.join(joints.select(F.col("id").alias("target")), "target", "left_semi").join(chains.select(F.col("id").alias("source"), "up", "hops"), "source", "left")
    # of a source that is no vertex, nothing is known: it never goes
    edges = cut(inner.groupBy(F.coalesce("up", "source").alias("source"), "target").agg(F.max(F.coalesce("hops", F.lit(0)) + 1).alias("far")))
    into = cut(edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")))
    free = cut(v.where("up is null").select("id", F.lit(0).alias("level")))
    left = cut(into.select("id", "n", F.lit(0).alias("level")).limit(0))

    def step(state: tuple, k: int) -> tuple[tuple, bool]:
        left, free, done, rows = state
        if rows == 0:
            return state, False
        gone = small(free.select(F.col("id").alias("source"), "level"), rows)
        fewer = edges.join(gone, "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("less"), F.max(F.col("level") + F.col("far")).alias("far"))
        before = fewer.join(left.select("id", F.col("n").alias("had"), "level"), "id", "left").join(into, "id")
        touched = cut(before.select("id", (F.coalesce("had", "n") - F.col("less")).alias("n"), F.greatest("level", "far").alias("level")))
        new = cut(touched.where("n = 0").select("id", "level"))
        left = cut(left.join(touched.select("id"), "id", "left_anti").unionByName(touched.where("n > 0")))
        done = done.unionByName(new)
        return (left, new, cut(done) if k % 8 == 7 else done, new.count()), True

    _, _, done, _ = iterate((left, free, free, free.count()), step)
    out = cut(chains.join(done.select(F.col("id").alias("up"), "level"), "up").select("id", (F.col("level") + F.col("hops")).alias("level")))
    return out if out.count() == v.count() else None


def strong(g: PropertyGraph, direction: Direction | str = Direction.OUT) -> DataFrame:
    """(id, component): the smallest id that a vertex reaches and is reached from.

    Vertices without edges in or out are taken away as components of their own. Then every vertex gets the smallest id that
    reaches it; what in a colour reaches the vertex of that id is one component; the rest goes round again.
    """
    direction = Direction.of(direction)
    if direction is Direction.BOTH:
        return connected(g)
    edges = cut(walks(g.edges, direction).where("source <> target").select("source", "target").distinct())
    left = cut(g.vertices.select("id"))
    done = left.limit(0).select("id", F.col("id").alias("component"))

    def within(e: DataFrame, v: DataFrame) -> DataFrame:
        return e.join(v.select(F.col("id").alias("source")), "source", "left_semi").join(v.select(F.col("id").alias("target")), "target", "left_semi")

    def round_(state: tuple, _: int) -> tuple[tuple, bool]:
        left, edges, done = state
        if left.isEmpty():
            return state, False
        inner = edges.select(F.col("source").alias("id")).intersect(edges.select(F.col("target").alias("id")))
        alone = cut(left.join(inner, "id", "left_anti"))
        if not alone.isEmpty():
            rest = cut(left.join(alone, "id", "left_anti"))
            return (rest, cut(within(edges, rest)), cut(done.unionByName(alone.select("id", F.col("id").alias("component"))))), True

        def color(state: tuple, _: int) -> tuple[tuple, bool]:
            now, front = state
            tried = front.join(edges, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(F.min("c").alias("n"))
            new = cut(tried.join(now, "id").where("n < c").select("id", F.col("n").alias("c")))
            return (cut(now.join(new.select("id"), "id", "left_anti").unionByName(new)), new), not new.isEmpty()

        start = cut(left.select("id", F.col("id").alias("c")))
        colors, _ = iterate((start, start), color)
        same = cut(
            edges.join(colors.select(F.col("id").alias("source"), F.col("c").alias("x")), "source").join(colors.select(F.col("id").alias("target"), F.col("c").alias("y")), "target").where("x = y").select("source", "target", "x")
        )
        roots = cut(colors.where("id = c"))

        def back(state: tuple, _: int) -> tuple[tuple, bool]:
            found, front = state
            new = cut(same.join(front.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), F.col("x").alias("c")).distinct().join(found.select("id"), "id", "left_anti"))
            return (cut(found.unionByName(new)), new), not new.isEmpty()

        found, _ = iterate((roots, roots), back)
        rest = cut(left.join(found.select("id"), "id", "left_anti"))
        return (rest, cut(within(edges, rest)), cut(done.unionByName(found.select("id", F.col("c").alias("component"))))), True

    return iterate((left, edges, done), round_)[2]


def _low_link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cut vertices and bridges of one component's edges, by an iterative depth-first search."""
    near: dict[str, list[tuple[str, str]]] = {}
    for e, a, b in zip(pdf["id"], pdf["src"], pdf["dst"], strict=True):
        near.setdefault(a, []).append((b, e))
        near.setdefault(b, []).append((a, e))
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    out: set[tuple[str, str]] = set()
    for root in sorted(near):
        if root in order:
            continue
        children = 0
        order[root] = low[root] = len(order)
        stack = [(root, "", iter(near[root]))]
        while stack:
            v, by, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[v])
                    if low[v] > order[up]:
                        out.add(("bridge", by))
                    if up == root:
                        children += 1
                    elif low[v] >= order[up]:
                        out.add(("vertex", up))
                continue
            w, e = step
            if e == by:
                continue
            if w in order:
                low[v] = min(low[v], order[w])
            else:
                order[w] = low[w] = len(order)
                stack.append((w, e, iter(near[w])))
        if children > 1:
            out.add(("vertex", root))
    return pd.DataFrame(sorted(out), columns=["kind", "id"])


def low_links(g: PropertyGraph) -> DataFrame:
    """(kind, id): cut vertices and bridges. Components are worked on side by side, each within one task's memory."""
    c = connected(g)
    edges = g.edges.where("src <> dst").join(c.select(F.col("id").alias("src"), "component"), "src").select("component", "id", "src", "dst")
    return edges.groupBy("component").applyInPandas(_low_link, "kind string, id string")


def articulation_points(g: PropertyGraph) -> DataFrame:
    return low_links(g).where("kind = 'vertex'").select("id")


def bridges(g: PropertyGraph) -> DataFrame:
    """Parallel edges are never bridges."""
    return low_links(g).where("kind = 'bridge'").select("id")
