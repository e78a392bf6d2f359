"""Typed graph JSON (GraphSON 3.0): element lines, which many tasks read and write, and single documents.

Numbers are written as {"@type": ..., "@value": ...}, strings and booleans plainly (booleans as g:Boolean, lest they read as strings).
Untyped JSON values read as strings. Lists, sets and maps as single values keep their typed JSON as text, with the types list, set and map;
`plain_value` makes Python values of it. A property with several values reads as a LIST. Property ids are made anew.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import GraphError, PropertyGraph
from graphloom.operators.mutate import Conflict, merge

VERSION = "3.0"
NAMES = {"long": "g:Int64", "double": "g:Double", "boolean": "g:Boolean", "list": "g:List", "set": "g:Set", "map": "g:Map"}
#: Texts that are written as cardinalities; they read as texts again.
CARDINALITIES = ["single", "list", "set"]
KINDS = {"g:Int32": "long", "g:Int64": "long", "gx:Byte": "long", "gx:Int16": "long", "g:Float": "double", "g:Double": "double", "g:Boolean": "boolean", "g:List": "list", "g:Set": "set", "g:Map": "map"}
UNSUPPORTED = ["g:UUID", "g:Date", "g:Timestamp", "gx:BigDecimal", "gx:BigInteger", "g:Path", "g:Traverser", "g:Bytecode", "g:Lambda"]


class InvalidGraphSON(GraphError):
    """Not a document of this format, or a type that it can't hold."""


def _quoted(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _typed(value: Column, kind: Column) -> Column:
    out = F.when(value.isin(CARDINALITIES), F.concat(F.lit('{"@type":"g:Cardinality","@value":'), _quoted(value), F.lit("}"))).otherwise(_quoted(value))
    for k, name in NAMES.items():
        out = F.when(kind == k, F.concat(F.lit(f'{{"@type":"{name}","@value":'), value, F.lit("}"))).otherwise(out)
    return out


def vertex_lines(g: PropertyGraph) -> DataFrame:
    """(id, line): a JSON object per vertex, its properties by key and order."""
    meta = F.concat_ws(",", F.transform(F.map_entries("meta"), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _quoted(e["value"]))))
    one = F.concat(
        F.lit('{"@type":"g:VertexProperty","@value":{"id":'), _quoted(F.col("prop_id")), F.lit(',"value":'), _typed(F.col("value"), F.col("type")), F.lit(',"label":'), _quoted(F.col("key")),
        F.when(F.size("meta") > 0, F.concat(F.lit(',"properties":{'), meta, F.lit("}"))).otherwise(F.lit("")), F.lit("}}"),
    )
    values = g.vprops.groupBy("vertex_id", "key").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("j")))).alias("l"))
    by_key = values.select("vertex_id", F.struct("key", F.concat(_quoted(F.col("key")), F.lit(":["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("j")).alias("p"))
    props = by_key.groupBy(F.col("vertex_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["j"]), ",").alias("p"))
    line = F.concat(F.lit('{"@type":"g:Vertex","@value":{"id":'), _quoted(F.col("id")), F.lit(',"label":'), _quoted(F.col("label")), F.lit(',"properties":{'), F.coalesce("p", F.lit("")), F.lit("}}}"))
    return g.vertices.select("id", "label").join(props, "id", "left").select("id", line.alias("line"))


def edge_lines(g: PropertyGraph) -> DataFrame:
    kinds = {"bigint": "long", "int": "long", "float": "double", "double": "double", "boolean": "boolean"}
    own = [(c, kinds.get(t, "string")) for c, t in g.edges.dtypes if c not in ("id", "src", "dst", "label")]
    parts = [
        F.when(F.col(c).isNotNull(), F.concat(_quoted(F.lit(c)), F.lit(':{"@type":"g:Property","@value":{"key":'), _quoted(F.lit(c)), F.lit(',"value":'), _typed(F.col(c).cast("string"), F.lit(t)), F.lit("}}")))
        for c, t in own
    ]
    line = F.concat(
        F.lit('{"@type":"g:Edge","@value":{"id":'), _quoted(F.col("id")), F.lit(',"label":'), _quoted(F.col("label")), F.lit(',"outV":'), _quoted(F.col("src")), F.lit(',"inV":'), _quoted(F.col("dst")),
        F.lit(',"properties":{'), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}}}"),
    )
    return g.edges.select("id", line.alias("line"))


def write(g: PropertyGraph, path: str, mode: str = "overwrite") -> None:
    """Element lines under path/vertices and path/edges, variables in path/variables."""
    vertex_lines(g).select("line").write.mode(mode).text(f"{path}/vertices")
    edge_lines(g).select("line").write.mode(mode).text(f"{path}/edges")
    g.spark.createDataFrame([(json.dumps({"version": VERSION, "variables": g.variables}),)], "line string").coalesce(1).write.mode(mode).text(f"{path}/variables")


def document(g: PropertyGraph) -> str:
    """The single-document form; the graph must fit the driver."""
    v = [r["line"] for r in vertex_lines(g).orderBy("id").collect()]
    e = [r["line"] for r in edge_lines(g).orderBy("id").collect()]
    head = f'{{"version":"{VERSION}","vertices":[{",".join(v)}],"edges":[{",".join(e)}]'
    return head + (f',"variables":{json.dumps(g.variables)}' if g.variables else "") + "}"


def typed_value(value: Any) -> Any:
    """A Python value as typed JSON."""
    if value is None or isinstance(value, (bool, str)):
        if value in CARDINALITIES:
            return {"@type": "g:Cardinality", "@value": value}
        return {"@type": "g:Boolean", "@value": value} if isinstance(value, bool) else value
    if isinstance(value, int):
        return {"@type": "g:Int64", "@value": value}
    if isinstance(value, float):
        return {"@type": "g:Double", "@value": value}
    if isinstance(value, dict):
        return {"@type": "g:Map", "@value": [typed_value(x) for pair in value.items() for x in pair]}
    if isinstance(value, (set, frozenset)):
        return {"@type": "g:Set", "@value": [typed_value(x) for x in sorted(value, key=str)]}
    if isinstance(value, (list, tuple)):
        return {"@type": "g:List", "@value": [typed_value(x) for x in value]}
    raise InvalidGraphSON(f"unsupported type {type(value).__name__}")


def plain_value(json_value: Any) -> Any:
    """The Python value of typed JSON."""
    if isinstance(json_value, list):
        return [plain_value(x) for x in json_value]
    if not isinstance(json_value, dict):
        return json_value
    kind, value = json_value.get("@type"), json_value.get("@value")
    if kind in UNSUPPORTED:
        raise InvalidGraphSON(f"unsupported type {kind}")
    if kind in ("g:List", "g:Set"):
        items = [plain_value(x) for x in value]
        return items if kind == "g:List" else set(items)
    if kind == "g:Map":
        items = [plain_value(x) for x in value]
        return dict(zip(items[::2], items[1::2], strict=True))
    return value


def write_value(value: Any) -> str:
    return json.dumps(typed_value(value))


def read_value(text: str) -> Any:
    try:
        return plain_value(json.loads(text))
    except ValueError as e:
        raise InvalidGraphSON(str(e)) from e


def write_vertex(g: PropertyGraph, id: str) -> str | None:
    """A vertex as a JSON object; None if there is none of that id."""
    row = vertex_lines(g.replace(vertices=g.vertices.where(F.col("id") == id), vprops=g.vprops.where(F.col("vertex_id") == id))).first()
    return row and row["line"]


def write_edge(g: PropertyGraph, id: str) -> str | None:
    row = edge_lines(g.replace(edges=g.edges.where(F.col("id") == id))).first()
    return row and row["line"]


def read_elements(spark: SparkSession, vertices: list[str] = (), edges: list[str] = ()) -> PropertyGraph:
    """A graph of single elements' JSON."""
    table = lambda lines: spark.createDataFrame([(x,) for x in lines], "line string")
    return parse(table(vertices), table(edges))


def _value(c: Column) -> Column:
    return F.coalesce(F.get_json_object(c, "$['@value']"), c)


def _kind(c: Column) -> Column:
    name = F.get_json_object(c, "$['@type']")
    out = F.lit("string")
    for k, t in KINDS.items():
        out = F.when(name == k, F.lit(t)).otherwise(out)
    refused = F.concat(F.lit("unsupported type "), name)
    return F.when(name.isin(UNSUPPORTED), F.raise_error(refused)).otherwise(out)


_ELEMENT = "struct<`@type`:string,`@value`:struct<id:string,label:string,inV:string,outV:string,properties:map<string,string>>>"


def _elements(lines: DataFrame, kind: str) -> DataFrame:
    e = F.from_json("line", _ELEMENT)
    body = F.coalesce(e["@value"], F.from_json("line", "struct<id:string,label:string,inV:string,outV:string,properties:map<string,string>>"))
    rows = lines.select(e["@type"].alias("kind"), body.alias("x"))
    wrong = F.concat(F.lit("not a "), F.lit(kind), F.lit(": "), F.coalesce("kind", F.lit("?")))
    return rows.select(F.when(F.coalesce(F.col("kind"), F.lit(kind)) == kind, F.col("x")).otherwise(F.raise_error(wrong)).alias("x"))


def parse(vertices: DataFrame, edges: DataFrame, variables: dict[str, Any] | None = None) -> PropertyGraph:
    """From tables of lines."""
    v = _elements(vertices, "g:Vertex").select(_value(F.col("x.id")).alias("id"), F.coalesce("x.label", F.lit("vertex")).alias("label"), F.col("x.properties").alias("p"))
    lists = v.select("id", F.explode("p").alias("key", "j")).select("id", "key", F.coalesce(F.from_json("j", "array<string>"), F.array("j")).alias("l"))
    one = lists.select("id", "key", F.size("l").alias("n"), F.posexplode("l").alias("ord", "j")).withColumn("b", F.coalesce(F.get_json_object("j", "$['@value']"), F.col("j")))
    value = F.coalesce(F.get_json_object("b", "$.value"), F.col("b"))
    meta = F.coalesce(F.transform_values(F.from_json(F.get_json_object("b", "$.properties"), "map<string,string>"), lambda _, x: _value(x)), F.create_map().cast("map<string,string>"))
    vprops = one.select(
        F.col("id").alias("vertex_id"), F.concat_ws("/", "id", "key", F.col("ord").cast("string")).alias("prop_id"), "key", _value(value).alias("value"), _kind(value).alias("type"),
        F.when(F.col("n") > 1, "LIST").otherwise("SINGLE").alias("cardinality"), F.col("ord").cast("long").alias("ord"), meta.alias("meta"),
    )
    x = _elements(edges, "g:Edge")
    raw = F.transform_values(F.col("x.properties"), lambda _, j: F.coalesce(F.get_json_object(F.get_json_object(j, "$['@value']"), "$.value"), j))
    e = x.select(_value(F.col("x.id")).alias("id"), _value(F.col("x.outV")).alias("src"), _value(F.col("x.inV")).alias("dst"), F.coalesce("x.label", F.lit("edge")).alias("label"), F.transform_values(raw, lambda _, j: _value(j)).alias("properties"))
    return PropertyGraph(v.select("id", "label"), e, vprops, variables or {})


def read(spark: SparkSession, path: str) -> PropertyGraph:
    """What write wrote. Properties are in vprops and the edges' properties map; `typed` makes columns of them."""
    v = spark.read.text(f"{path}/vertices").withColumnRenamed("value", "line")
    e = spark.read.text(f"{path}/edges").withColumnRenamed("value", "line")
    head = json.loads(spark.read.text(f"{path}/variables").first()[0])
    return parse(v, e, head["variables"])


def read_document(spark: SparkSession, path: str) -> PropertyGraph:
    """Single documents: a file is parsed by one task, its elements by many."""
    text = spark.read.text(path, wholetext=True)
    d = text.select(F.from_json("value", "struct<version:string,vertices:array<string>,edges:array<string>,variables:string>").alias("d"))
    if not d.where("d is null or d.vertices is null and d.edges is null").isEmpty():
        raise InvalidGraphSON(f"{path} isn't such a document")
    variables: dict[str, Any] = {}
    for r in d.where("d.variables is not null").select("d.variables").collect():
        variables |= json.loads(r["variables"])
    spread = lambda c: d.select(F.explode(f"d.{c}").alias("line")).repartition(spark.sparkContext.defaultParallelism)
    return parse(spread("vertices"), spread("edges"), variables)


def read_into(g: PropertyGraph, path: str, conflict: Conflict | str | None = None) -> PropertyGraph:
    other = read_document(g.spark, path)
    keys = [c for c in g.edges.columns if c not in ("id", "src", "dst", "label")]
    other = other.replace(edges=typed_edges(other.edges, {c: t for c, t in g.edges.dtypes if c in keys}))
    return merge(g, other, conflict)


def typed_edges(edges: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The properties map as columns."""
    return edges.select("id", "src", "dst", "label", *[F.col("properties").getItem(c).try_cast(t).alias(c) for c, t in columns.items()])


def typed(g: PropertyGraph, vertices: dict[str, str], edges: dict[str, str] | None = None) -> PropertyGraph:
    """With first values as typed columns: {"age": "long"}."""
    firsts = g.vprops.where(F.col("key").isin(list(vertices))).groupBy(F.col("vertex_id").alias("id")).pivot("key", list(vertices)).agg(F.min_by("value", "ord"))
    v = g.vertices.select("id", "label").join(firsts, "id", "left").select("id", "label", *[F.col(c).try_cast(t).alias(c) for c, t in vertices.items()])
    return g.replace(vertices=v, edges=g.edges if edges is None else typed_edges(g.edges, edges))


def is_graphson(text: str) -> bool:
    try:
        d = json.loads(text)
    except ValueError:
        return False
    return isinstance(d, dict) and "version" in d and ("vertices" in d or "edges" in d)
