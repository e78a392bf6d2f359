"""The graph: three tables and a dictionary.

vertices  id STRING, label STRING, one typed column per homogeneous property
edges     id STRING, src STRING, dst STRING, label STRING, typed property columns
vprops    vertex_id STRING, prop_id STRING, key STRING, value STRING, type STRING, cardinality STRING, ord BIGINT,
          meta MAP<STRING,STRING>: a row per property value, for multi-valued and annotated properties
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VPROPS = "vertex_id string, prop_id string, key string, value string, type string, cardinality string, ord long, meta map<string,string>"
VERTICES = "id string, label string"
EDGES = "id string, src string, dst string, label string"
DEFAULT_VERTEX_LABEL, DEFAULT_EDGE_LABEL = "vertex", "edge"
RESERVED = {"id", "label"}


class GraphError(Exception):
    """Any error of this library."""


class DuplicateId(GraphError):
    """An element with that id is there already."""


class MissingElement(GraphError):
    """No element has that id, or an edge's end is missing."""


class InvalidProperty(GraphError):
    """A blank or reserved key, a null value, or a repeated value of a SET."""


class Direction(Enum):
    OUT = "OUT"
    IN = "IN"
    BOTH = "BOTH"

    def opposite(self) -> "Direction":
        return {Direction.OUT: Direction.IN, Direction.IN: Direction.OUT}.get(self, self)

    @classmethod
    def of(cls, name: "Direction | str") -> "Direction":
        return name if isinstance(name, cls) else cls[name.upper()]


class Cardinality(Enum):
    SINGLE = "SINGLE"
    LIST = "LIST"
    SET = "SET"

    @classmethod
    def of(cls, name: "Cardinality | str") -> "Cardinality":
        return name if isinstance(name, cls) else cls[name.upper()]


def type_name(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {int: "long", float: "double", str: "string"}.get(type(value), "string")


def text_of(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    vprops: DataFrame
    variables: dict[str, Any] = field(default_factory=dict)
    #: Keys of which a vertex may have several values, in vprops; None: not known.
    multi: frozenset[str] | None = None
    #: Finds elements by id at their source; see sources.tables.Lookup.
    lookup: Any = None

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> "PropertyGraph":
        return cls(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES), spark.createDataFrame([], VPROPS))

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, vprops: DataFrame | None = None, **variables: Any) -> "PropertyGraph":
        if vprops is None:
            return cls(vertices, edges, vertices.sparkSession.createDataFrame([], VPROPS), variables, frozenset())
        return cls(vertices, edges, vprops, variables)

    @classmethod
    def literal(cls, spark: SparkSession, vertices: list[dict], edges: list[dict] | None = None) -> "PropertyGraph":
        """From dictionaries. A vertex's property may be a value, a list or set of values, or (value, meta)."""
        names = dict.fromkeys(k for v in vertices for k in v if k not in ("id", "label"))
        rows, props, typed = [], [], {}
        for v in vertices:
            row = {"id": text_of(v["id"]), "label": v.get("label", DEFAULT_VERTEX_LABEL)}
            for k in names:
                if (given := v.get(k)) is None:
                    continue
                kind = "LIST" if isinstance(given, list) else "SET" if isinstance(given, (set, frozenset)) else "SINGLE"
                values = given if kind == "LIST" else sorted(given) if kind == "SET" else [given]
                for n, x in enumerate(values):
                    x, meta = x if isinstance(x, tuple) else (x, {})
                    props.append((row["id"], f"{row['id']}/{k}/{n}", k, text_of(x), type_name(x), kind, n, {a: text_of(b) for a, b in meta.items()}))
                    if n == 0:
                        row[k] = x
                        typed.setdefault(k, set()).add(type_name(x))
            rows.append(row)
        kinds = {k: next(iter(t)) if len(t) == 1 else "double" if t <= {"long", "double"} else "string" for k, t in typed.items()}
        cast = {"string": text_of, "double": float, "long": int, "boolean": bool}
        table = [tuple([r["id"], r["label"]] + [cast[t](r[k]) if k in r else None for k, t in kinds.items()]) for r in rows]
        own = spark.createDataFrame(table, ", ".join([VERTICES, *(f"`{k}` {t}" for k, t in kinds.items())]))
        return cls(own, edge_table(spark, edges or []), spark.createDataFrame(props, VPROPS), multi=frozenset(p[2] for p in props if p[5] != "SINGLE"))

    def replace(self, **changes: Any) -> "PropertyGraph":
        """With other tables. What was known of the old ones doesn't hold for them, unless it is said again."""
        forget: dict[str, Any] = {"lookup": None} if changes.keys() & {"vertices", "edges"} else {}
        if "vprops" in changes:
            forget["multi"] = None
        return replace(self, **forget | changes)

    def multiple(self, keys: set[str]) -> set[str]:
        """Those of the keys of which a vertex may have several values; read from vprops where it isn't known."""
        if self.multi is not None or not keys:
            return keys & (self.multi or set())
        rows = self.vprops.where(F.col("key").isin(sorted(keys)) & (F.col("cardinality") != "SINGLE")).select("key").distinct()
        return {x["key"] for x in rows.collect()}

    def property_columns(self, of: str = "vertices") -> list[str]:
        return [c for c in getattr(self, of).columns if c not in ("id", "label", "src", "dst")]


def edge_table(spark: SparkSession, edges: list[dict]) -> DataFrame:
    """Edges from dictionaries with src and dst; id counts up where it isn't given."""
    names = dict.fromkeys(k for e in edges for k in e if k not in ("id", "src", "dst", "label"))
    kinds = {k: {type_name(e[k]) for e in edges if e.get(k) is not None} for k in names}
    kinds = {k: next(iter(t)) if len(t) == 1 else "double" if t <= {"long", "double"} else "string" for k, t in kinds.items()}
    cast = {"string": text_of, "double": float, "long": int, "boolean": bool}
    rows = [
        tuple([text_of(e.get("id", f"e{n}")), text_of(e["src"]), text_of(e["dst"]), e.get("label", DEFAULT_EDGE_LABEL)] + [None if e.get(k) is None else cast[t](e[k]) for k, t in kinds.items()])
        for n, e in enumerate(edges)
    ]
    return spark.createDataFrame(rows, ", ".join([EDGES, *(f"`{k}` {t}" for k, t in kinds.items())]))


def unpivoted(vertices: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Single-valued properties as rows of vprops."""
    kinds = dict(vertices.dtypes)
    columns = [c for c in (columns or vertices.columns) if c not in RESERVED]
    names = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "float": "double", "double": "double", "boolean": "boolean"}
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"), F.lit(names.get(kinds[c], "string")).alias("type")) for c in columns])
    rows = vertices.select("id", F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("p"))
    return rows.select(
        F.col("id").alias("vertex_id"), F.concat_ws("/", "id", "p.key", F.lit("0")).alias("prop_id"), "p.key", "p.value", "p.type",
        F.lit("SINGLE").alias("cardinality"), F.lit(0).cast("long").alias("ord"), F.create_map().cast("map<string,string>").alias("meta"),
    )
