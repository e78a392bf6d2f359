"""GraphML: one XML document for a graph that fits the driver; reading is distributed.

Vertex properties are first values; keys are declared with their types. Labels are the data keys labelV and labelE.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import GraphError, PropertyGraph, unpivoted

TYPES = {"bigint": "long", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "float", "boolean": "boolean"}
KINDS = {"long": "bigint", "int": "int", "double": "double", "float": "float", "boolean": "boolean", "string": "string"}


def document(g: PropertyGraph) -> str:
    own = {kind: [(c, TYPES.get(t, "string")) for c, t in df.dtypes if c not in ("id", "src", "dst", "label")] for kind, df in (("node", g.vertices), ("edge", g.edges))}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for kind, label in (("node", "labelV"), ("edge", "labelE")):
        out.append(f'<key id="{label}" for="{kind}" attr.name="{label}" attr.type="string"/>')
        out += [f'<key id={quoteattr(f"{kind}.{c}")} for="{kind}" attr.name={quoteattr(c)} attr.type="{t}"/>' for c, t in own[kind]]
    out.append('<graph id="G" edgedefault="directed">')
    for kind, df, label in (("node", g.vertices, "labelV"), ("edge", g.edges, "labelE")):
        for row in df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).orderBy("id").collect():
            ends = f" source={quoteattr(row['src'])} target={quoteattr(row['dst'])}" if kind == "edge" else ""
            data = [f'<data key="{label}">{escape(row["label"])}</data>'] + [f"<data key={quoteattr(f'{kind}.{c}')}>{escape(row[c])}</data>" for c, _ in own[kind] if row[c] is not None]
            out.append(f"<{kind} id={quoteattr(row['id'])}{ends}>{''.join(data)}</{kind}>")
    return "\n".join([*out, "</graph>", "</graphml>"])


def read(spark: SparkSession, path: str) -> PropertyGraph:
    """Columns by the declared types; untyped keys are text."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    rows = lambda tag, schema: spark.read.schema(schema).option("rowTag", tag).option("ignoreSurroundingSpaces", "false").format("xml").load(path)
    keys = rows("key", "_id string, _for string, `_attr.name` string, `_attr.type` string").collect()

    def elements(df: DataFrame, kind: str, label: str) -> DataFrame:
        found = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
        value: dict[str, Column] = {}
        for k in keys:
            if k["_for"] in (kind, "all") and k["_id"] != label:
                value[k["_attr.name"]] = F.col("m")[k["_id"]].try_cast(KINDS.get(k["_attr.type"], "string"))
        ends = [F.col("_source").alias("src"), F.col("_target").alias("dst")] if kind == "edge" else []
        default = "vertex" if kind == "node" else "edge"
        return df.withColumn("m", found).select(F.col("_id").alias("id"), *ends, F.coalesce(F.col("m")[label], F.lit(default)).alias("label"), *[c.alias(n) for n, c in value.items()])

    if not spark.read.text(path, wholetext=True).where(F.contains("value", F.lit("<graphml"))).count():
        raise GraphError(f"{path} isn't GraphML")
    v = elements(rows("node", f"_id string, {data}"), "node", "labelV")
    e = elements(rows("edge", f"_id string, _source string, _target string, {data}"), "edge", "labelE")
    return PropertyGraph(v, e, unpivoted(v), multi=frozenset())
