"""Connected components by alternating large-star and small-star rounds: each halves paths, and no task holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.plans.iterate import cut, iterate


def _least(edges: DataFrame) -> DataFrame:
    """edges(a, b) with the least b of each a as m: a minimum combined before it travels, and a join that adaptive execution can split at hubs."""
    least = edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    return edges.join(least, F.col("a") == F.col("c")).select("a", "b", "m")


def _alternate(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root) by star rounds over all of them."""
    start = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def step(state: tuple, _: int) -> tuple[tuple, bool]:
        now, before = state
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        least = _least(large)
        after = cut(least.select("a", F.col("m").alias("b")).unionByName(least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        sign = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        return (after, sign), sign != before

    now, _ = iterate((start, None), step)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _sparse(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): star rounds over two edges of each node, its least and its greatest neighbour; then the same over edges between what these connect.

    In graphs with many more edges than nodes, two connect almost all, and the other edges are read once.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.groupBy("a").agg(F.min("b").alias("l"), F.max("b").alias("g"))
    roots = _alternate(ends.select("a", F.explode(F.array("l", "g")).alias("b")))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    moved = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    rest = cut(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if rest.isEmpty():
        return roots
    more = _sparse(rest)
    up = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(more))


def stars(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """edges(a, b) to (node, root): each node that isn't the least of its component, with the least. ids(id), if known, holds every node.

    Rounds go over hashes of 64 bits instead of texts; should two nodes share one, over the nodes themselves.
    """
    edges = edges.where("a <> b").select("a", "b")
    if ids is None:
        edges = cut(edges)
        ids = edges.select(F.explode(F.array("a", "b")).alias("id"))
    names = cut(ids.select("id", F.xxhash64("id").alias("h")).distinct())
    code = F.xxhash64 if names.groupBy("h").count().where("count > 1").isEmpty() else F.col
    roots = _sparse(cut(edges.select(code("a").alias("a"), code("b").alias("b"))))
    groups = cut(names.select("id", code("id").alias("node")).join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")))
    least = groups.groupBy("root").agg(F.min("id").alias("least"))
    return groups.join(least, "root").where("id <> least").select(F.col("id").alias("node"), F.col("least").alias("root"))


def connected(g: PropertyGraph) -> DataFrame:
    """(id, component): the smallest id that can be reached, direction aside; isolated vertices are their own."""
    ids = cut(g.vertices.select("id"))
    roots = stars(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ids)
    return ids.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def is_connected(g: PropertyGraph) -> DataFrame:
    """One row: at most one component."""
    return connected(g).agg((F.countDistinct("component") <= 1).alias("connected"))


def has_cycle(g: PropertyGraph) -> DataFrame:
    """One row. Direction aside, self-loops and parallel edges being cycles: more edges than vertices less components."""
    c = connected(g).agg(F.count("*").alias("v"), F.countDistinct("component").alias("c"))
    return c.crossJoin(g.edges.agg(F.count("*").alias("e"))).select((F.col("e") > F.col("v") - F.col("c")).alias("has_cycle"))


def bipartite(g: PropertyGraph) -> DataFrame:
    """(id, component, bipartite, color) by components of the double cover; color is null where there is none.

    The smallest id of each component has color 0.
    """
    zero = "\u0000"
    node = lambda c, s: F.concat(F.col(c), F.lit(zero + s))
    e = g.edges
    cover = e.select(node("src", "0").alias("a"), node("dst", "1").alias("b")).unionByName(e.select(node("src", "1").alias("a"), node("dst", "0").alias("b")))
    roots = stars(cover)
    sides = g.vertices.select("id", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("s")).select("id", "s", F.concat("id", F.lit(zero), "s").alias("n"))
    sides = sides.join(roots, F.col("n") == F.col("node"), "left").select("id", "s", F.coalesce("root", "n").alias("r"))
    v = sides.groupBy("id").agg(F.max(F.when(F.col("s") == "0", F.col("r"))).alias("r0"), F.max(F.when(F.col("s") == "1", F.col("r"))).alias("r1"))
    odd = F.col("r0") == F.col("r1")
    least = F.least("r0", "r1")
    return v.select("id", F.expr("substring(least(r0, r1), 1, length(least(r0, r1)) - 2)").alias("component"), (~odd).alias("bipartite"), F.when(~odd, F.when(F.col("r0") == least, 0).otherwise(1)).cast("int").alias("color"))


def is_bipartite(g: PropertyGraph) -> DataFrame:
    return bipartite(g).agg(F.coalesce(F.min("bipartite"), F.lit(True)).alias("bipartite"))
