"""Property rows, aggregates, statistics and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph

NUMERIC = ("long", "double")


def values(vprops: DataFrame, key: str) -> DataFrame:
    """(vertex_id, ord, value) of all live values of a key."""
    return vprops.where(F.col("key") == key).select("vertex_id", "ord", "value")


def first_value(vprops: DataFrame, key: str) -> DataFrame:
    """(vertex_id, value) of each vertex's first value of a key."""
    return vprops.where(F.col("key") == key).groupBy("vertex_id").agg(F.min_by("value", "ord").alias("value"))


def properties(vprops: DataFrame, *keys: str, hidden: bool = False, where: Column | None = None, cardinality: str | None = None, has_meta: bool | None = None) -> DataFrame:
    """All rows, or those of the given keys; with a condition on value and type, a cardinality, or with or without meta-properties. Hidden keys (~...) only if asked for."""
    rows = vprops.where(F.col("key").isin(list(keys))) if keys else vprops
    if where is not None:
        rows = rows.where(where)
    if cardinality is not None:
        rows = rows.where(F.col("cardinality") == cardinality.upper())
    if has_meta is not None:
        rows = rows.where((F.size("meta") > 0) == has_meta)
    return rows if hidden else rows.where(~F.col("key").startswith("~"))


def keys(vprops: DataFrame, hidden: bool = False) -> DataFrame:
    """(vertex_id, keys): the sorted keys of each vertex that has any."""
    return properties(vprops, hidden=hidden).groupBy("vertex_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def property_counts(g: PropertyGraph, *keys: str) -> DataFrame:
    """(id, properties): how many property rows, of all keys or the given ones, every vertex has."""
    counts = properties(g.vprops, *keys, hidden=True).groupBy(F.col("vertex_id").alias("id")).agg(F.count("*").alias("properties"))
    return g.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("properties", F.lit(0).cast("long")).alias("properties"))


def value_map(vprops: DataFrame) -> DataFrame:
    """(id, properties): every vertex's first values, as key=value pairs sorted by key."""
    firsts = vprops.groupBy("vertex_id", "key").agg(F.min_by("value", "ord").alias("value"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "key", "value")))
    return firsts.groupBy(F.col("vertex_id").alias("id")).agg(F.array_join(pairs, ";").alias("properties"))


def meta_values(vprops: DataFrame, *meta_keys: str) -> DataFrame:
    """(vertex_id, key, ord, meta_key, meta_value)."""
    rows = vprops.select("vertex_id", "key", "ord", F.explode("meta").alias("meta_key", "meta_value"))
    return rows.where(F.col("meta_key").isin(list(meta_keys))) if meta_keys else rows


def _number() -> Column:
    return F.when(F.col("type").isin(*NUMERIC), F.col("value").try_cast("double"))


AGGREGATES = {
    "count": lambda: F.count("value"),
    "distinct": lambda: F.countDistinct("value", "type"),
    "min": lambda: F.coalesce(F.min(_number()), F.lit(0.0)),
    "max": lambda: F.coalesce(F.max(_number()), F.lit(0.0)),
    "sum": lambda: F.coalesce(F.sum(_number()), F.lit(0.0)),
    # over all values, numeric or not
    "avg": lambda: F.coalesce(F.sum(_number()) / F.nullif(F.count("value"), F.lit(0)), F.lit(0.0)),
    "variance": lambda: F.coalesce(F.var_samp(_number()), F.lit(0.0)),
}


def aggregate(vprops: DataFrame, key: str, *names: str) -> DataFrame:
    """One row: the named aggregates of all values of a key."""
    return vprops.where(F.col("key") == key).agg(*[AGGREGATES[n]().alias(n) for n in names])


def column_aggregate(elements: DataFrame, key: str, *names: str) -> DataFrame:
    """The same over a typed column, without going through property rows."""
    x = F.col(key).cast("double")
    of = {
        "count": F.count(key), "distinct": F.countDistinct(key), "min": F.coalesce(F.min(x), F.lit(0.0)), "max": F.coalesce(F.max(x), F.lit(0.0)),
        "sum": F.coalesce(F.sum(x), F.lit(0.0)), "avg": F.coalesce(F.avg(x), F.lit(0.0)), "variance": F.coalesce(F.var_samp(x), F.lit(0.0)),
    }
    return elements.agg(*[of[n].alias(n) for n in names])


def statistics(g: PropertyGraph) -> DataFrame:
    """(key, properties, vertices, has_meta, single, list, set): vertices by cardinality; one without the key is single."""
    per = g.vprops.groupBy("key", "vertex_id").agg(F.count("*").alias("n"), F.max(F.size("meta") > 0).alias("m"), F.max("cardinality").alias("c"))
    total = g.vertices.agg(F.count("*").alias("__all"))
    out = per.groupBy("key").agg(
        F.sum("n").alias("properties"), F.count("*").alias("vertices"), F.max("m").alias("has_meta"),
        F.sum((F.col("c") == "LIST").cast("long")).alias("list"), F.sum((F.col("c") == "SET").cast("long")).alias("set"),
    )
    return out.crossJoin(F.broadcast(total)).select("key", "properties", "vertices", "has_meta", (F.col("__all") - F.col("list") - F.col("set")).alias("single"), "list", "set")


def vertex_statistics(vprops: DataFrame) -> DataFrame:
    return vprops.groupBy("vertex_id", "key").agg(F.count("*").alias("values"), F.max(F.size("meta") > 0).alias("has_meta"), F.max("cardinality").alias("cardinality"))


def cardinality_analysis(vprops: DataFrame) -> DataFrame:
    """(vertex_id, key, cardinality) that the values suggest: one at most SINGLE, all different LIST, else SET."""
    n = vprops.groupBy("vertex_id", "key").agg(F.count("value").alias("n"), F.countDistinct("value").alias("d"))
    return n.select("vertex_id", "key", F.when(F.col("n") <= 1, "SINGLE").when(F.col("n") == F.col("d"), "LIST").otherwise("SET").alias("cardinality"))


def violations(vprops: DataFrame) -> DataFrame:
    """(vertex_id, key, problem): SINGLE with several values, SET with repeated ones."""
    n = vprops.groupBy("vertex_id", "key").agg(F.count("value").alias("n"), F.countDistinct("value").alias("d"), F.max("cardinality").alias("c"))
    problem = F.when((F.col("c") == "SINGLE") & (F.col("n") > 1), "several values").when((F.col("c") == "SET") & (F.col("n") > F.col("d")), "repeated values")
    return n.select("vertex_id", "key", problem.alias("problem")).where("problem is not null")


def group_by(elements: DataFrame, key: str) -> DataFrame:
    """(value, elements): how many elements have each value of a column; none is a group of its own."""
    return elements.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("elements"))


def inverted(vprops: DataFrame, key: str) -> DataFrame:
    """(value, vertices, ids): which vertices have each value of a key."""
    rows = vprops.where(F.col("key") == key)
    return rows.groupBy("value").agg(F.countDistinct("vertex_id").alias("vertices"), F.array_sort(F.collect_set("vertex_id")).alias("ids"))


def summary(g: PropertyGraph) -> DataFrame:
    """(vertices, edges, avg_degree, density)."""
    v, e = g.vertices.agg(F.count("*").alias("vertices")), g.edges.agg(F.count("*").alias("edges"))
    n, m = F.col("vertices").cast("double"), F.col("edges").cast("double")
    return v.crossJoin(e).select("vertices", "edges", F.when(n > 0, 2 * m / n).otherwise(F.lit(0.0)).alias("avg_degree"), F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """(id, label, src, dst, properties, self_loop, weight)."""
    own = [c for c in edges.columns if c not in ("id", "src", "dst", "label")]
    n = sum((F.col(c).isNotNull().cast("int") for c in own), F.lit(0))
    w = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) if "weight" in own else F.lit(1.0)
    return edges.select("id", "label", "src", "dst", n.alias("properties"), (F.col("src") == F.col("dst")).alias("self_loop"), w.alias("weight"))
