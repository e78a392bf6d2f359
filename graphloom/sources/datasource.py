"""Element lines as a Spark data source: spark.read.format("graphson").option("element", "vertex").load(path)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class GraphSONSource(DataSource):
    """Files on a path that all executors see; a task per file. For object stores use graphson.read."""

    @classmethod
    def name(cls) -> str:
        return "graphson"

    def schema(self) -> str:
        if self.options.get("element", "vertex") == "edge":
            return "id string, src string, dst string, label string, properties map<string,string>"
        return "id string, label string, properties map<string,array<string>>"

    def reader(self, schema: Any) -> DataSourceReader:
        return GraphSONReader(self.options["path"], self.options.get("element", "vertex"))


class FilePart(InputPartition):
    def __init__(self, file: str):
        self.file = file


class GraphSONReader(DataSourceReader):
    def __init__(self, path: str, element: str):
        self.path, self.element = path.removeprefix("file:"), element

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        files = sorted(x for x in ([p] if p.is_file() else p.rglob("*")) if x.is_file() and x.name[0] not in "._")
        return [FilePart(str(x)) for x in files]

    def read(self, partition: FilePart | None) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        with open(partition.file, encoding="utf-8") as lines:
            for line in filter(str.strip, lines):
                x = json.loads(line)
                x = x.get("@value", x)
                props = x.get("properties", {})
                if self.element == "edge":
                    yield plain(x["id"]), plain(x["outV"]), plain(x["inV"]), x.get("label", "edge"), {k: plain(v["@value"]["value"] if isinstance(v, dict) and "@value" in v else v) for k, v in props.items()}
                else:
                    yield plain(x["id"]), x.get("label", "vertex"), {k: [plain(v["@value"]["value"] if isinstance(v, dict) and "@value" in v else v) for v in (values if isinstance(values, list) else [values])] for k, values in props.items()}


def plain(value: Any) -> str:
    value = value["@value"] if isinstance(value, dict) and "@value" in value else value
    return value if isinstance(value, str) else json.dumps(value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GraphSONSource)
