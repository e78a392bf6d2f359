"""Saving and loading whole graphs: Parquet (the binary form), ORC, JSON, XML and typed graph JSON; backups by version."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import GraphError, PropertyGraph
from graphloom.sources import graphson

TABLES = ("vertices", "edges", "vprops")
FORMATS = ("parquet", "orc", "json", "xml", "graphson")


def save(g: PropertyGraph, path: str, format: str = "parquet", compress: str | None = None) -> None:
    """Tables go into a new folder under the path; then a marker that names it is moved over the old one, in one step.

    A save that fails leaves the graph that was there. The version before stays for those who read it still; older ones go.
    Begin and end of a save are noted in a log.
    """
    if format not in FORMATS:
        raise GraphError(f"{format!r} is none of {', '.join(FORMATS)}")
    spark, version = g.spark, f"v{time.time_ns():020d}"
    at = f"{path}/{version}"
    _note(spark, path, version, "begin")
    if format == "graphson":
        graphson.write(g, at)
    else:
        for name in TABLES:
            df = getattr(g, name)
            if format in ("json", "xml") and name == "vprops":
                df = df.withColumn("meta", F.to_json("meta"))
            w = df.write.format(format)
            if compress:
                w = w.option("compression", compress)
            if format == "xml":
                w = w.option("rowTag", "row").option("rootTag", name)
            w.save(f"{at}/{name}")
    multi = None if g.multi is None else sorted(g.multi)
    _put(spark, f"{path}/_graph", {"format": format, "at": version, "variables": g.variables, "multi": multi, "schemas": {n: getattr(g, n).schema.json() for n in TABLES}})
    _note(spark, path, version, "end")
    for old in [x for x in _names(spark, path) if x[0] == "v" and x[1:].isdigit() and x < version][:-1]:
        _fs(spark, path).delete(_path(spark, f"{path}/{old}"), True)


def load(spark: SparkSession, path: str) -> PropertyGraph:
    """With the schemas that were saved; nothing is inferred."""
    from pyspark.sql.types import StringType, StructField, StructType

    head = _get(spark, f"{path}/_graph")
    at = f"{path}/{head['at']}"
    if head["format"] == "graphson":
        return graphson.read(spark, at)
    tables: dict[str, DataFrame] = {}
    for name in TABLES:
        schema = StructType.fromJson(json.loads(head["schemas"][name]))
        flat = StructType([StructField("meta", StringType()) if f.name == "meta" else f for f in schema]) if head["format"] in ("json", "xml") else schema
        r = spark.read.schema(flat).format(head["format"])
        df = (r.option("rowTag", "row") if head["format"] == "xml" else r).load(f"{at}/{name}")
        tables[name] = df.withColumn("meta", F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>"))) if flat is not schema and name == "vprops" else df
    return PropertyGraph(**tables, variables=head["variables"], multi=None if head["multi"] is None else frozenset(head["multi"]))


def _put(spark: SparkSession, path: str, content: Any) -> None:
    """A small JSON file, which replaces one of that name in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new = f"{path}.{uuid.uuid4().hex}"
    out = _fs(spark, path).create(_path(spark, new), True)
    out.write(json.dumps(content).encode())
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = _fs(spark, path).makeQualified(_path(spark, new))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(where, _fs(spark, path).makeQualified(_path(spark, path)), how)


def _get(spark: SparkSession, path: str) -> Any:
    """What `_put` wrote. Spark's own readers pass over names that begin with an underscore."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(_path(spark, path))) if fs.exists(_path(spark, path)) else []


def _note(spark: SparkSession, path: str, version: str, what: str) -> None:
    _put(spark, f"{path}/_log/{version}-{what}", {"version": version, "what": what, "time": time.time()})


def transactions(spark: SparkSession, path: str) -> list[dict]:
    """What the log of saves says, oldest first: version, what (begin or end), time."""
    rows = [_get(spark, f"{path}/_log/{x}") for x in _names(spark, f"{path}/_log") if x[0] == "v"]
    return sorted(rows, key=lambda x: (x["version"], x["what"]))


def clean_log(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Entries of all but the newest `keep` saves go."""
    names = _names(spark, f"{path}/_log")
    names = [x for x in names if x[0] == "v"]
    versions = sorted({x.partition("-")[0] for x in names})
    for x in names:
        if x.partition("-")[0] in versions[: max(0, len(versions) - keep)]:
            _fs(spark, path).delete(_path(spark, f"{path}/_log/{x}"), False)


def recover(spark: SparkSession, path: str) -> str:
    """Removes what saves that never ended left behind, none of which may be under way, and says what it did."""
    seen: dict[str, set[str]] = {}
    for x in transactions(spark, path):
        seen.setdefault(x["version"], set()).add(x["what"])
    current = _get(spark, f"{path}/_graph")["at"] if "_graph" in _names(spark, path) else None
    broken = [v for v, what in seen.items() if what == {"begin"} and v != current]
    for v in broken:
        _fs(spark, path).delete(_path(spark, f"{path}/{v}"), True)
        _fs(spark, path).delete(_path(spark, f"{path}/_log/{v}-begin"), False)
    return f"{len(broken)} unfinished saves removed; the graph is {current or 'not there'}"


def export(g: PropertyGraph, path: str, formats: tuple[str, ...] = FORMATS) -> None:
    for f in formats:
        save(g, f"{path}/{f}", f)


def _path(spark: SparkSession, path: str) -> Any:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str) -> Any:
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def backup(g: PropertyGraph, folder: str, keep: int = 5, format: str = "parquet") -> str:
    """A new version under the folder; of all complete ones the newest `keep` stay."""
    path = f"{folder}/{time.time_ns():020d}"
    save(g, path, format)
    for old in backups(g.spark, folder)[keep:]:
        _fs(g.spark, old).delete(_path(g.spark, old), True)
    return path


def backups(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions, newest first."""
    fs = _fs(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(_path(spark, folder)) if s.isDirectory()]
    return sorted((p for p in found if fs.exists(_path(spark, f"{p}/_graph"))), reverse=True)


def restore(spark: SparkSession, folder: str, version: int = 0) -> PropertyGraph:
    """The newest version, or an older one by number."""
    found = backups(spark, folder)
    if version >= len(found):
        raise GraphError(f"no backup {version} in {folder}")
    return load(spark, found[version])


def compact(spark: SparkSession, path: str, to: str, files: int) -> None:
    """A Parquet graph rewritten into so many files a table."""
    g = load(spark, path)
    save(g.replace(vertices=g.vertices.coalesce(files), edges=g.edges.coalesce(files), vprops=g.vprops.coalesce(files)), to)


class Catalog:
    """Named graphs under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, name: str) -> str:
        if not name or name[0] in "._" or "/" in name:
            raise GraphError(f"{name!r} can't be a graph's name")
        return f"{self.folder}/{name}"

    def save(self, name: str, g: PropertyGraph, format: str = "parquet") -> None:
        save(g, self._at(name), format)

    def load(self, name: str) -> PropertyGraph:
        if not self.exists(name):
            raise GraphError(f"no graph {name!r}")
        return load(self.spark, self._at(name))

    def exists(self, name: str) -> bool:
        return _fs(self.spark, self.folder).exists(_path(self.spark, f"{self._at(name)}/_graph"))

    def list(self) -> list[str]:
        return [x for x in _names(self.spark, self.folder) if x[0] not in "._" and self.exists(x)]

    def delete(self, name: str) -> bool:
        """Whether it was there."""
        there = self.exists(name)
        _fs(self.spark, self.folder).delete(_path(self.spark, self._at(name)), True)
        return there

    def clear(self) -> None:
        for name in self.list():
            self.delete(name)

    def info(self, name: str) -> dict[str, Any]:
        """Format, version, bytes with earlier versions, and variables."""
        head = _get(self.spark, f"{self._at(name)}/_graph")
        size = _fs(self.spark, self.folder).getContentSummary(_path(self.spark, self._at(name))).getLength()
        return {"name": name, "format": head["format"], "version": head["at"], "bytes": size, "variables": head["variables"]}
