"""Graphs over the star-schema tables. Sources read Parquet; nothing is materialised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, unpivoted

#: Vertex properties and their types.
COLUMNS = {"name": "string", "balance": "double", "segment": "string", "price": "double", "size": "int", "brand": "string", "status": "string", "priority": "string", "total": "double"}
EDGE_COLUMNS = {"weight": "double", "discount": "double"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(label: str, column: str | Column) -> Column:
    return F.concat(F.lit(label + ":"), (F.col(column) if isinstance(column, str) else column).cast("string"))


#: Of each vertex label: table, key, and columns by property.
VERTEX_SOURCES: dict[str, tuple[str, str, dict[str, str]]] = {
    "region": ("region", "r_regionkey", {"name": "r_name"}),
    "nation": ("nation", "n_nationkey", {"name": "n_name"}),
    "customer": ("customer", "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
    "supplier": ("supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}),
    "part": ("part", "p_partkey", {"name": "p_name", "price": "p_retailprice", "size": "p_size", "brand": "p_brand"}),
    "orders": ("orders", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice"}),
}
_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
#: Of each edge label: table, columns that make up its id, label and key of both ends, and columns of weight and discount.
EDGE_SOURCES: dict[str, tuple[str, tuple[str, ...], tuple[str, str], tuple[str, str], str | None, str | None]] = {
    "in_region": ("nation", ("n_nationkey",), ("nation", "n_nationkey"), ("region", "n_regionkey"), None, None),
    "lives_in": ("customer", ("c_custkey",), ("customer", "c_custkey"), ("nation", "c_nationkey"), None, None),
    "based_in": ("supplier", ("s_suppkey",), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), None, None),
    "placed": ("orders", ("o_orderkey",), ("customer", "o_custkey"), ("orders", "o_orderkey"), None, None),
    "contains": ("lineitem", _LINE, ("orders", "l_orderkey"), ("part", "l_partkey"), "l_quantity", "l_discount"),
    "supplies": ("lineitem", _LINE, ("supplier", "l_suppkey"), ("part", "l_partkey"), "l_quantity", "l_discount"),
}


def _vertices(df: DataFrame, label: str) -> DataFrame:
    _, pk, props = VERTEX_SOURCES[label]
    own = [(F.col(props[c]) if c in props else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]
    return df.select(key(label, pk).alias("id"), F.lit(label).alias("label"), *own)


def _edges(df: DataFrame, label: str, id: Column, src: Column, dst: Column, weight: Column | None = None, discount: Column | None = None) -> DataFrame:
    return df.select(
        F.concat(F.lit(label + ":"), id.cast("string")).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"), (F.lit(None) if discount is None else discount).cast("double").alias("discount"),
    )


def _edges_from(df: DataFrame, label: str) -> DataFrame:
    _, parts, src, dst, weight, discount = EDGE_SOURCES[label]
    return _edges(df, label, F.concat_ws(":", *[F.col(c).cast("bigint") for c in parts]), key(*src), key(*dst), *[None if c is None else F.col(c) for c in (weight, discount)])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def vertices_of(spark: SparkSession, sf_dir: str, labels: list[str]) -> DataFrame:
    return _union([_vertices(table(spark, sf_dir, VERTEX_SOURCES[x][0]), x) for x in labels])


def edges_of(spark: SparkSession, sf_dir: str, labels: list[str]) -> DataFrame:
    """A lineitem's edges are told apart by its line number and quantity; no window numbers them, so that filters reach the scan."""
    return _union([_edges_from(table(spark, sf_dir, EDGE_SOURCES[x][0]), x) for x in labels])


def _numbers(id: str) -> tuple[str, list[int]] | None:
    """Label and whole numbers of an id like part:7; None if it isn't written like that."""
    label, _, rest = id.partition(":")
    try:
        numbers = [int(x) for x in rest.split(":")]
    except ValueError:
        return None
    return (label, numbers) if ":".join(map(str, numbers)) == rest and all(abs(x) < 1 << 63 for x in numbers) else None


class Lookup:
    """Elements by id: ids are taken apart, and their keys become filters on the tables' own columns, which Parquet can use."""

    def __init__(self, spark: SparkSession, sf_dir: str, vertices: list[str], edges: list[str]):
        self.spark, self.sf_dir, self.labels, self.edge_labels = spark, sf_dir, vertices, edges

    def vertices(self, ids: list[str]) -> DataFrame:
        found = {}
        for label, numbers in filter(None, map(_numbers, ids)):
            if label in self.labels and len(numbers) == 1:
                found.setdefault(label, []).append(numbers[0])
        parts = [_vertices(table(self.spark, self.sf_dir, VERTEX_SOURCES[x][0]).where(F.col(VERTEX_SOURCES[x][1]).isin(keys)), x) for x, keys in found.items()]
        return _union(parts) if parts else vertices_of(self.spark, self.sf_dir, self.labels).limit(0)

    def edges(self, ids: list[str]) -> DataFrame:
        found = {}
        for label, numbers in filter(None, map(_numbers, ids)):
            if label in self.edge_labels and len(numbers) == len(EDGE_SOURCES[label][1]):
                found.setdefault(label, []).append(numbers)
        parts = []
        for label, keys in found.items():
            rows = table(self.spark, self.sf_dir, EDGE_SOURCES[label][0])
            for c, values in zip(EDGE_SOURCES[label][1], zip(*keys, strict=True), strict=True):
                rows = rows.where(F.col(c).isin(list(values)))
            parts.append(_edges_from(rows, label).where(F.col("id").isin(ids)))
        return _union(parts) if parts else edges_of(self.spark, self.sf_dir, self.edge_labels).limit(0)

    def between(self, out: str, into: str, *labels: str) -> DataFrame:
        ends, parts = (_numbers(out), _numbers(into)), []
        for label in self.edge_labels:
            name, _, src, dst, *_ = EDGE_SOURCES[label]
            if (not labels or label in labels) and all(e and e[0] == end[0] and len(e[1]) == 1 for e, end in zip(ends, (src, dst), strict=True)):
                rows = table(self.spark, self.sf_dir, name).where((F.col(src[1]) == ends[0][1][0]) & (F.col(dst[1]) == ends[1][1][0]))
                parts.append(_edges_from(rows, label))
        return _union(parts) if parts else edges_of(self.spark, self.sf_dir, self.edge_labels).limit(0)


VERTEX_LABELS = ["region", "nation", "customer", "supplier", "part", "orders"]
EDGE_LABELS = ["in_region", "lives_in", "based_in", "placed", "contains", "supplies"]


def commerce(spark: SparkSession, sf_dir: str, vertices: list[str] = VERTEX_LABELS, edges: list[str] = EDGE_LABELS) -> PropertyGraph:
    v = vertices_of(spark, sf_dir, vertices)
    return PropertyGraph(v, edges_of(spark, sf_dir, edges), vprops(spark, sf_dir, vertices), multi=frozenset({"priorities"}), lookup=Lookup(spark, sf_dir, vertices, edges))


def vprops(spark: SparkSession, sf_dir: str, vertices: list[str] = VERTEX_LABELS) -> DataFrame:
    """Single properties of all vertices; and of customers a LIST of their orders' priorities, each with its order's status as meta-property."""
    out = unpivoted(vertices_of(spark, sf_dir, vertices))
    if "customer" in vertices:
        w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        id = key("customer", "o_custkey")
        listed = table(spark, sf_dir, "orders").withColumn("n", (F.row_number().over(w) - 1).cast("long")).select(
            id.alias("vertex_id"), F.concat_ws("/", id, F.lit("priorities"), F.col("n").cast("string")).alias("prop_id"), F.lit("priorities").alias("key"), F.col("o_orderpriority").alias("value"),
            F.lit("string").alias("type"), F.lit("LIST").alias("cardinality"), F.col("n").alias("ord"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("meta"),
        )
        out = out.unionByName(listed)
    return out


def geo(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.of(vertices_of(spark, sf_dir, ["region", "nation", "supplier"]), edges_of(spark, sf_dir, ["in_region", "based_in"]))


def trade(spark: SparkSession, sf_dir: str, top: int = 2) -> PropertyGraph:
    """Nations; from each, the `top` nations to which its suppliers shipped most, weighted by quantity."""
    t = lambda name: table(spark, sf_dir, name)
    flow = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.sum("l_quantity").alias("q"))
    )
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("q"), "c_nationkey")
    best = flow.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    e = _edges(best, "trades", F.concat_ws(">", "s_nationkey", "c_nationkey"), key("nation", "s_nationkey"), key("nation", "c_nationkey"), F.col("q"))
    return PropertyGraph.of(vertices_of(spark, sf_dir, ["nation"]), e)


def purchases(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers that ordered and parts that were ordered; an edge for each such pair, weighted by the quantity."""
    t = lambda name: table(spark, sf_dir, name)
    pairs = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    ends = pairs.select(F.explode(F.array(F.struct(key("customer", "o_custkey").alias("id"), F.lit("customer").alias("label")), F.struct(key("part", "l_partkey").alias("id"), F.lit("part").alias("label")))).alias("v"))
    return PropertyGraph.of(ends.select("v.*").distinct(), _edges(pairs, "ordered", F.concat_ws(">", "o_custkey", "l_partkey"), key("customer", "o_custkey"), key("part", "l_partkey"), F.col("q")))


def order_chain(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders; from each to its customer's next."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("after", F.lead("o_orderkey").over(w)).where("after is not null")
    return PropertyGraph.of(vertices_of(spark, sf_dir, ["orders"]), _edges(o, "next", F.col("o_orderkey"), key("orders", "o_orderkey"), key("orders", "after")))
