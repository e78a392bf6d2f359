"""Neighbours, incident edges and degrees: joins and groupings on edge ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Direction, PropertyGraph
from graphloom.operators.scan import by_label

#: Members of a class that travel in one row, about.
BLOCK = 1024

def walks(edges: DataFrame, direction: Direction | str, *labels: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, edge): each edge in the directions walked. A self-loop is walked once in BOTH."""
    direction = Direction.of(direction)
    e = by_label(edges, *labels)
    more = [F.col(c) for c in extra]
    out = e.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("id").alias("edge"), *more)
    if direction is Direction.OUT:
        return out
    back = e.select(F.col("dst").alias("source"), F.col("src").alias("target"), F.col("id").alias("edge"), *more)
    return back if direction is Direction.IN else out.unionByName(back.where("source <> target"))


def incident_edges(g: PropertyGraph, start: DataFrame, direction: Direction | str, *labels: str) -> DataFrame:
    """(source, edge, target) for each vertex of start(id): its edges, parallel ones kept."""
    return walks(g.edges, direction, *labels).join(start.select(F.col("id").alias("source")), "source").select("source", "edge", "target")


def neighbours(g: PropertyGraph, start: DataFrame, direction: Direction | str, *labels: str) -> DataFrame:
    """(source, target) for each vertex of start(id): its distinct neighbours."""
    return incident_edges(g, start, direction, *labels).select("source", "target").distinct()


def endpoints(g: PropertyGraph, edges: DataFrame | None = None, columns: tuple[str, ...] = ("label",)) -> DataFrame:
    """Edges with both ends' columns, as src_... and dst_..."""
    e = g.edges if edges is None else edges
    src = g.vertices.select(F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in columns])
    dst = g.vertices.select(F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in columns])
    return e.join(src, "src").join(dst, "dst").select(*e.columns, *[f"src_{c}" for c in columns], *[f"dst_{c}" for c in columns])


def other_end(id: str) -> Column:
    """The other end of an edge row; null if it isn't incident."""
    return F.when(F.col("src") == id, F.col("dst")).when(F.col("dst") == id, F.col("src"))


def direction_from(id: str) -> Column:
    return F.when((F.col("src") == id) & (F.col("dst") == id), "BOTH").when(F.col("src") == id, "OUT").when(F.col("dst") == id, "IN")


def is_incident(id: str) -> Column:
    return (F.col("src") == id) | (F.col("dst") == id)


def connects(a: str, b: str) -> Column:
    """Whichever way the edge points."""
    return ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))


def parallel_edges(edges: DataFrame, opposite: bool = False) -> DataFrame:
    """(a, b): pairs of edges, a < b by id, with the same ends the same way; or, if `opposite`, the other way round."""
    other = edges.select(F.col("id").alias("b"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
    same = (F.col("src") == F.col("__d" if opposite else "__s")) & (F.col("dst") == F.col("__s" if opposite else "__d"))
    return edges.select(F.col("id").alias("a"), "src", "dst").join(other, same).where("a < b").select("a", "b")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def weight(column: str = "weight", default: float = 1.0) -> Column:
    return F.coalesce(F.col(column).try_cast("double"), F.lit(default))


def two_hop(g: PropertyGraph, start: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """(source, target): reached by a step (direction, labels...) and then another, without the source itself."""
    a = neighbours(g, start, first[0], *first[1:]).select("source", F.col("target").alias("middle"))
    b = walks(g.edges, second[0], *second[1:]).select(F.col("source").alias("middle"), "target")
    return a.join(b, "middle").where("source <> target").select("source", "target").distinct()


def co_neighbours(g: PropertyGraph, *labels: str) -> DataFrame:
    """(a, b, shared): pairs of sources of labelled edges and how many targets they share, a < b.

    Sources with the same targets are a class, and only pairs of classes are counted. Members travel in blocks; tasks of equal shares unfold
    pairs of blocks row by row, so that no grouping and no sort holds pairs of members.
    """
    e = by_label(g.edges, *labels).where("src is not null and dst is not null").select("src", "dst").distinct()
    members = e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    classes = members.groupBy("targets").agg(F.min("src").alias("c"), F.count("*").alias("n"), blocks.alias("k"))
    ends = classes.select("c", "n", "k", F.explode("targets").alias("dst"))
    side = lambda df, x: df.select(*[F.col(c) if c == "dst" else F.col(c).alias(f"{c}{x}") for c in df.columns])
    pairs = side(ends, "a").join(side(ends, "b"), "dst").where("ca < cb or ca = cb and na > 1").groupBy("ca", "na", "ka", "cb", "nb", "kb").agg(F.count("*").alias("shared"))
    single = pairs.where("na = 1 and nb = 1").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "shared")
    block = members.join(classes, "targets").select("c", F.expr("cast(pmod(xxhash64(src), k) as int)").alias("i"), "src").groupBy("c", "i").agg(F.collect_list("src").alias("ids"))
    of = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    both = pairs.where("na > 1 or nb > 1").select("ca", "ka", "cb", "kb", "shared").withColumn("ia", of("ka")).withColumn("ib", of("kb")).where("ca < cb or ia <= ib")
    tasks = max(int(g.spark.conf.get("spark.sql.shuffle.partitions")), 4 * g.spark.sparkContext.defaultParallelism)
    both = both.join(side(block, "a"), ["ca", "ia"]).join(side(block, "b"), ["cb", "ib"]).repartition(tasks, "ca", "ia", "cb", "ib")
    rows = both.withColumn("x", F.explode("idsa")).withColumn("y", F.explode("idsb")).where("ca < cb or ia < ib or x < y")
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared").unionByName(single)


def degrees(g: PropertyGraph, direction: Direction | str, *labels: str, vertices: DataFrame | None = None) -> DataFrame:
    """(id, degree) of every vertex; a self-loop counts twice in BOTH. Ends are counted map-side before the join."""
    direction = Direction.of(direction)
    e = by_label(g.edges, *labels)
    out, into = e.select(F.col("src").alias("id")), e.select(F.col("dst").alias("id"))
    ends = out if direction is Direction.OUT else into if direction is Direction.IN else out.unionByName(into)
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    v = g.vertices if vertices is None else vertices
    return v.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def distinct_degrees(g: PropertyGraph, direction: Direction | str, *labels: str, vertices: DataFrame | None = None) -> DataFrame:
    """(id, neighbours): how many distinct neighbours every vertex has."""
    pairs = walks(g.edges, direction, *labels).select(F.col("source").alias("id"), "target").distinct()
    counts = pairs.groupBy("id").agg(F.count("*").alias("neighbours"))
    v = g.vertices if vertices is None else vertices
    return v.select("id").join(counts, "id", "left").select("id", F.coalesce("neighbours", F.lit(0).cast("long")).alias("neighbours"))


def edge_labels(g: PropertyGraph, direction: Direction | str) -> DataFrame:
    """(id, labels): the sorted labels of a vertex's edges as text; vertices without edges are left out."""
    pairs = by_label(g.edges)
    ends = {Direction.OUT: ["src"], Direction.IN: ["dst"], Direction.BOTH: ["src", "dst"]}[Direction.of(direction)]
    rows = pairs.select(F.col(ends[0]).alias("id"), "label")
    for c in ends[1:]:
        rows = rows.unionByName(pairs.select(F.col(c).alias("id"), "label"))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
