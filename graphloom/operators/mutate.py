"""New graphs from old ones: additions, removals, property changes and merges. DataFrames don't change; each call returns a graph."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.coercion import match_value
from graphloom.model import RESERVED, Cardinality, DuplicateId, InvalidProperty, MissingElement, PropertyGraph, text_of, type_name


class Conflict(Enum):
    """What happens to an incoming vertex whose id is taken."""

    STRICT = "STRICT"
    GENERATE_NEW_ID = "GENERATE_NEW_ID"
    MERGE_PROPERTIES = "MERGE_PROPERTIES"
    REPLACE_ELEMENT = "REPLACE_ELEMENT"

    @classmethod
    def of(cls, name: "Conflict | str | None") -> "Conflict":
        if isinstance(name, cls):
            return name
        return cls[name.upper().replace("-", "_")] if name else cls.GENERATE_NEW_ID

    @property
    def changes_existing(self) -> bool:
        return self in (Conflict.MERGE_PROPERTIES, Conflict.REPLACE_ELEMENT)

    @property
    def may_break_edges(self) -> bool:
        return self is Conflict.REPLACE_ELEMENT


def _taken(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("id").join(old.select("id"), "id", "left_semi")


def add_vertices(g: PropertyGraph, vertices: DataFrame, vprops: DataFrame | None = None) -> PropertyGraph:
    if not _taken(g.vertices, vertices).isEmpty() or not vertices.groupBy("id").count().where("count > 1").isEmpty():
        raise DuplicateId("a vertex with such an id is there already")
    more = g.vprops if vprops is None else g.vprops.unionByName(vprops)
    return g.replace(vertices=g.vertices.unionByName(vertices, allowMissingColumns=True), vprops=more)


def add_edges(g: PropertyGraph, edges: DataFrame) -> PropertyGraph:
    if not _taken(g.edges, edges).isEmpty() or not edges.groupBy("id").count().where("count > 1").isEmpty():
        raise DuplicateId("an edge with such an id is there already")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if not ends.join(g.vertices.select("id"), "id", "left_anti").isEmpty():
        raise MissingElement("an edge's end isn't a vertex")
    return g.replace(edges=g.edges.unionByName(edges, allowMissingColumns=True))


def remove_vertices(g: PropertyGraph, gone: DataFrame) -> PropertyGraph:
    """Without the vertices of gone(id), their edges and their properties."""
    ids = gone.select("id").distinct()
    edges = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return g.replace(vertices=g.vertices.join(ids, "id", "left_anti"), edges=edges.select(*g.edges.columns), vprops=g.vprops.join(ids.select(F.col("id").alias("vertex_id")), "vertex_id", "left_anti").select(*g.vprops.columns))


def remove_edges(g: PropertyGraph, gone: DataFrame) -> PropertyGraph:
    return g.replace(edges=g.edges.join(gone.select("id"), "id", "left_anti").select(*g.edges.columns))


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Ends swapped; properties aren't copied."""
    return edges.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label")


def copied_edges(edges: DataFrame, suffix: str = "'") -> DataFrame:
    return edges.select(F.concat("id", F.lit(suffix)).alias("id"), "src", "dst", "label")


def _checked(key: str, value: Any) -> None:
    if not key.strip() or key in RESERVED or value is None:
        raise InvalidProperty(f"{key!r} can't be set to {value!r}")


def set_property(g: PropertyGraph, where: Column, key: str, value: Any, cardinality: Cardinality | str = Cardinality.SINGLE, meta: dict[str, Any] | None = None) -> PropertyGraph:
    """On every vertex that meets the condition: SINGLE replaces, LIST appends, SET appends and raises if the value is there."""
    _checked(key, value)
    kind, text = Cardinality.of(cardinality), text_of(value)
    hit = g.vertices.where(where).select(F.col("id").alias("vertex_id"))
    mine = g.vprops.where(F.col("key") == key).join(hit, "vertex_id", "left_semi")
    if kind is Cardinality.SET and not mine.where(F.col("value") == text).isEmpty():
        raise InvalidProperty(f"{key} holds {text!r} already")
    last = mine.groupBy("vertex_id").agg((F.max("ord") + 1).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long")) if kind is not Cardinality.SINGLE else F.lit(0).cast("long")
    pairs = [x for a, b in (meta or {}).items() for x in (F.lit(a), F.lit(text_of(b)))]
    row = hit.join(last, "vertex_id", "left").select(
        "vertex_id", F.concat_ws("/", "vertex_id", F.lit(key), n.cast("string")).alias("prop_id"), F.lit(key).alias("key"), F.lit(text).alias("value"), F.lit(type_name(value)).alias("type"),
        F.lit(kind.value).alias("cardinality"), n.alias("ord"), F.create_map(*pairs).cast("map<string,string>").alias("meta"),
    )
    kept = g.vprops
    if kind is Cardinality.SINGLE:
        other = g.vprops.where(F.col("key") == key).join(hit, "vertex_id", "left_anti").select(*g.vprops.columns)
        kept = g.vprops.where(F.col("key") != key).unionByName(other)
    multi = None if g.multi is None else g.multi | ({key} if kind is not Cardinality.SINGLE else set())
    out = g.replace(vprops=kept.unionByName(row), multi=multi)
    if key in g.vertices.columns:
        new = where if kind is Cardinality.SINGLE else where & F.col(key).isNull()
        out = out.replace(vertices=_with_value(g.vertices, key, new, value))
    return out


def _with_value(vertices: DataFrame, key: str, where: Column, value: Any) -> DataFrame:
    """The value in a typed column. One that doesn't fit makes a column of numbers double, any other a column of text."""
    kind, own = dict(vertices.dtypes)[key], {"long": "bigint"}.get(type_name(value), type_name(value))
    whole = {"tinyint", "smallint", "int", "bigint"}
    if kind == own or kind in whole and own == "bigint" or kind == "float" and own == "double":
        new, old = F.lit(value).cast(kind), F.col(key)
    elif {kind, own} <= whole | {"float", "double"}:
        new, old = F.lit(float(value)), F.col(key).cast("double")
    else:
        new, old = F.lit(text_of(value)), F.col(key).cast("string")
    return vertices.withColumn(key, F.when(where, new).otherwise(old))


def remove_property(g: PropertyGraph, key: str, value: Any = None, where: Column | None = None) -> PropertyGraph:
    """A key's values, or those equal to the given one, of all vertices or those that meet the condition. A typed column takes the first value that stays."""
    test = F.col("key") == key
    if value is not None:
        test = test & (F.col("value") == text_of(value))
    rows = g.vprops.where(test)
    if where is not None:
        rows = rows.join(g.vertices.where(where).select(F.col("id").alias("vertex_id")), "vertex_id", "left_semi")
    place = ["vertex_id", "key", "ord"]
    out = g.replace(vprops=g.vprops.join(rows.select(*place).distinct(), place, "left_anti").select(*g.vprops.columns), multi=g.multi)
    if key in g.vertices.columns:
        hit, kind = F.lit(True) if where is None else where, dict(g.vertices.dtypes)[key]
        vertices, rest = g.vertices, F.lit(None).cast(kind)
        if value is not None:
            hit = hit & match_value(F.col(key), kind, value)
            first = out.vprops.where(F.col("key") == key).groupBy(F.col("vertex_id").alias("__v")).agg(F.min_by("value", "ord").alias("__rest"))
            vertices, rest = g.vertices.join(first, F.col("id") == F.col("__v"), "left"), F.col("__rest").try_cast(kind)
        out = out.replace(vertices=vertices.withColumn(key, F.when(F.coalesce(hit, F.lit(False)), rest).otherwise(F.col(key))).select(*g.vertices.columns), vprops=out.vprops, multi=g.multi)
    return out


def update_property(g: PropertyGraph, where: Column, key: str, old: Any, new: Any) -> PropertyGraph:
    """The value old becomes new, in place, and in a typed column, where it comes first."""
    _checked(key, new)
    hit = g.vertices.where(where).select(F.col("id").alias("vertex_id"), F.lit(True).alias("__hit"))
    rows = g.vprops.join(hit, "vertex_id", "left")
    test = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("key") == key) & (F.col("value") == text_of(old))
    rows = rows.withColumns({"value": F.when(test, F.lit(text_of(new))).otherwise(F.col("value")), "type": F.when(test, F.lit(type_name(new))).otherwise(F.col("type"))})
    out = g.replace(vprops=rows.select(*g.vprops.columns), multi=g.multi)
    if key in g.vertices.columns:
        same = match_value(F.col(key), dict(g.vertices.dtypes)[key], old)
        out = out.replace(vertices=_with_value(g.vertices, key, where & same, new), vprops=out.vprops, multi=g.multi)
    return out


class Manager:
    """Property changes one after another, with those who want to know told of each: listener(what, key, old, new)."""

    def __init__(self, g: PropertyGraph, *listeners: Callable[[str, str, Any, Any], None]):
        self.g, self.listeners = g, list(listeners)

    def _tell(self, g: PropertyGraph, *what: Any) -> "Manager":
        self.g = g
        for listener in self.listeners:
            listener(*what)
        return self

    def add(self, where: Column, key: str, value: Any, cardinality: Cardinality | str = Cardinality.SINGLE, meta: dict[str, Any] | None = None) -> "Manager":
        return self._tell(set_property(self.g, where, key, value, cardinality, meta), "add", key, None, value)

    def update(self, where: Column, key: str, old: Any, new: Any) -> "Manager":
        return self._tell(update_property(self.g, where, key, old, new), "update", key, old, new)

    def remove(self, key: str, value: Any = None, where: Column | None = None) -> "Manager":
        return self._tell(remove_property(self.g, key, value, where), "remove", key, value, None)


def key_values(*pairs: Any) -> dict[str, Any]:
    """A dictionary of keys and values in turn."""
    if len(pairs) % 2 or not all(isinstance(k, str) for k in pairs[::2]):
        raise InvalidProperty("keys and values have to take turns, and keys are text")
    for k, v in zip(pairs[::2], pairs[1::2], strict=True):
        if k not in RESERVED:
            _checked(k, v)
    return dict(zip(pairs[::2], pairs[1::2], strict=True))


def find_properties(g: PropertyGraph, key: str | None = None, value: Any = None, id: str | None = None, has_meta: bool | None = None) -> DataFrame:
    """Property rows by key, value, property id and whether they have meta-properties; what isn't given doesn't count."""
    rows = g.vprops
    for column, wanted in (("key", key), ("value", None if value is None else text_of(value)), ("prop_id", id)):
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    return rows if has_meta is None else rows.where((F.size("meta") > 0) == has_meta)


def copied_properties(g: PropertyGraph, source: str, target: str, *keys: str) -> PropertyGraph:
    """A vertex's property rows, or those of the given keys, on another vertex too, with their meta-properties, after what it has."""
    mine = g.vprops.where(F.col("vertex_id") == source)
    mine = mine.where(F.col("key").isin(list(keys))) if keys else mine
    last = g.vprops.where(F.col("vertex_id") == target).groupBy("key").agg((F.max("ord") + 1).alias("__n"))
    rows = mine.join(last, "key", "left").withColumns({"vertex_id": F.lit(target), "ord": F.col("ord") + F.coalesce("__n", F.lit(0).cast("long"))})
    rows = rows.withColumns({"prop_id": _prop_id(), "cardinality": F.when(F.col("ord") > 0, "LIST").otherwise(F.col("cardinality"))})
    return g.replace(vprops=g.vprops.unionByName(rows.select(*g.vprops.columns)))


def _prop_id() -> Column:
    return F.concat_ws("/", "vertex_id", "key", F.col("ord").cast("string"))


def new_ids(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, new): for incoming ids that are taken, one made of the id itself and a number that isn't."""
    taken = _taken(old, incoming).distinct()
    root = F.concat(F.col("id"), F.lit("~"))
    used = old.select("id").unionByName(incoming.select("id")).select(F.regexp_extract("id", r"^(.*)~([0-9]+)$", 1).alias("k"), F.regexp_extract("id", r"^(.*)~([0-9]+)$", 2).try_cast("long").alias("n")).where("n is not null").groupBy("k").agg(F.max("n").alias("n"))
    return taken.join(used, taken["id"] == used["k"], "left").select("id", F.concat(root, (F.coalesce("n", F.lit(0).cast("long")) + 1).cast("string")).alias("new"))


def merge(g: PropertyGraph, other: PropertyGraph, conflict: Conflict | str | None = None) -> PropertyGraph:
    """g with other's elements. Incoming edges follow their vertices' new ids; edge ids that are taken get new ones, too."""
    conflict = Conflict.of(conflict)
    if conflict is Conflict.STRICT and not (_taken(g.vertices, other.vertices).isEmpty() and _taken(g.edges, other.edges).isEmpty()):
        raise DuplicateId("an incoming id is taken")
    incoming, edges, props = other.vertices, other.edges, other.vprops
    if conflict is Conflict.GENERATE_NEW_ID:
        ids = new_ids(g.vertices, incoming)
        to = {c: ids.select(F.col("id").alias(c), F.col("new").alias(f"__{c}")) for c in ("id", "src", "dst", "vertex_id")}
        incoming = incoming.join(to["id"], "id", "left").withColumn("id", F.coalesce("__id", "id")).select(*other.vertices.columns)
        edges = edges.join(to["src"], "src", "left").join(to["dst"], "dst", "left").withColumns({"src": F.coalesce("__src", "src"), "dst": F.coalesce("__dst", "dst")}).select(*other.edges.columns)
        props = props.join(to["vertex_id"], "vertex_id", "left").withColumns({"vertex_id": F.coalesce("__vertex_id", "vertex_id"), "__moved": F.col("__vertex_id").isNotNull()})
        props = props.withColumn("prop_id", F.when(F.col("__moved"), _prop_id()).otherwise(F.col("prop_id"))).select(*other.vprops.columns)
    if conflict is Conflict.REPLACE_ELEMENT:
        g = remove_vertices(g, _taken(g.vertices, incoming))
    if conflict is Conflict.MERGE_PROPERTIES:
        return _merged(g, incoming, edges, props, other)
    ids = new_ids(g.edges, edges).select("id", F.col("new").alias("__new"))
    edges = edges.join(ids, "id", "left").withColumn("id", F.coalesce("__new", "id")).select(*other.edges.columns)
    return PropertyGraph(g.vertices.unionByName(incoming, allowMissingColumns=True), g.edges.unionByName(edges, allowMissingColumns=True), g.vprops.unionByName(props), g.variables | other.variables, _multi(g, other))


def _multi(*graphs: PropertyGraph) -> frozenset[str] | None:
    return None if any(g.multi is None for g in graphs) else frozenset().union(*(g.multi for g in graphs))


def _merged(g: PropertyGraph, incoming: DataFrame, edges: DataFrame, props: DataFrame, other: PropertyGraph) -> PropertyGraph:
    """Existing labels stay; incoming single values replace, lists append, sets add what they lack."""
    own, new = g.vertices.columns, [c for c in incoming.columns if c not in ("id", "label")]
    right = incoming.select(F.col("id").alias("__id"), F.col("label").alias("__label"), *[F.col(c).alias(f"__{c}") for c in new])
    both = g.vertices.join(right, F.col("id") == F.col("__id"), "full_outer")
    columns = [F.coalesce("id", "__id").alias("id"), F.coalesce("label", "__label").alias("label")]
    columns += [F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in own if c not in ("id", "label")]
    columns += [F.col(f"__{c}").alias(c) for c in new if c not in own]
    single = props.where("cardinality = 'SINGLE'").select("vertex_id", "key").distinct()
    kept = g.vprops.join(single, ["vertex_id", "key"], "left_anti").select(*g.vprops.columns)
    have = kept.select("vertex_id", "key", "value").distinct()
    sets = props.where("cardinality = 'SET'").join(have, ["vertex_id", "key", "value"], "left_anti").select(*props.columns)
    rest = props.where("cardinality <> 'SET'").unionByName(sets)
    last = kept.groupBy("vertex_id", "key").agg(F.max("ord").alias("__last"))
    rest = rest.join(last, ["vertex_id", "key"], "left").withColumn("ord", F.col("ord") + F.coalesce(F.col("__last") + 1, F.lit(0).cast("long")))
    rest = rest.withColumn("prop_id", _prop_id()).select(*props.columns)
    fresh = edges.join(g.edges.select("id"), "id", "left_anti").select(*edges.columns)
    return PropertyGraph(both.select(*columns), g.edges.unionByName(fresh, allowMissingColumns=True), kept.unionByName(rest), g.variables | other.variables, _multi(g, other))
