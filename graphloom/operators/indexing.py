"""What indexes answer, as pushed-down filters; layouts on disk that make them selective; and advice on which to keep."""

from __future__ import annotations

from collections import Counter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import InvalidProperty


def in_list(elements: DataFrame, key: str, values: list[Any]) -> DataFrame:
    return elements.where(F.col(key).isin(values))


def has_key(elements: DataFrame, key: str) -> DataFrame:
    return elements.where(F.col(key).isNotNull())


def composite(elements: DataFrame, keys: list[str], values: list[Any]) -> DataFrame:
    """All keys equal; fewer values than keys look up a prefix."""
    if len(keys) < 2 or len(set(keys)) < len(keys):
        raise InvalidProperty("a composite index has two or more different keys")
    if not 0 < len(values) <= len(keys):
        raise InvalidProperty("as many values as keys at most, one at least")
    for k, v in zip(keys, values, strict=False):
        elements = elements.where(F.col(k) == F.lit(v))
    return elements


def in_range(elements: DataFrame, key: str, low: Any = None, high: Any = None, include_low: bool = True, include_high: bool = True) -> DataFrame:
    """Inclusive unless told otherwise. A bound that doesn't compare with the column gives nothing."""
    kind = dict(elements.dtypes)[key]
    if kind != "string" and any(isinstance(x, str) for x in (low, high)):
        return elements.limit(0)
    if low is not None:
        elements = elements.where(F.col(key) >= F.lit(low) if include_low else F.col(key) > F.lit(low))
    if high is not None:
        elements = elements.where(F.col(key) <= F.lit(high) if include_high else F.col(key) < F.lit(high))
    return elements.where(F.col(key).isNotNull())


def greater(elements: DataFrame, key: str, than: Any, inclusive: bool = False) -> DataFrame:
    return in_range(elements, key, low=than, include_low=inclusive)


def less(elements: DataFrame, key: str, than: Any, inclusive: bool = False) -> DataFrame:
    return in_range(elements, key, high=than, include_high=inclusive)


def range_count(elements: DataFrame, key: str, low: Any = None, high: Any = None) -> DataFrame:
    return in_range(elements, key, low, high).agg(F.count("*").alias("elements"))


def sorted_values(elements: DataFrame, key: str) -> DataFrame:
    return elements.where(F.col(key).isNotNull()).select(F.col(key).alias("value")).distinct().orderBy("value")


def min_max(elements: DataFrame, key: str) -> DataFrame:
    return elements.agg(F.min(key).alias("least"), F.max(key).alias("greatest"))


def statistics(elements: DataFrame, *keys: str) -> DataFrame:
    """(key, values, elements, mean): distinct values, elements that have one, elements per value; in one pass."""
    row = elements.agg(*[F.struct(F.lit(k).alias("key"), F.countDistinct(k).alias("values"), F.count(k).alias("elements")).alias(k) for k in keys])
    out = row.select(F.inline(F.array(*[F.col(k) for k in keys])))
    return out.select("key", "values", "elements", F.when(F.col("values") > 0, F.col("elements") / F.col("values")).otherwise(F.lit(0.0)).alias("mean"))


def best_composite(indexes: list[list[str]], keys: set[str]) -> list[str] | None:
    """The longest composite whose keys are all asked for."""
    fit = [x for x in indexes if set(x) <= keys]
    return max(fit, key=len, default=None)


class Advisor:
    """Counts the keys that queries filter on, and names those worth clustering by."""

    def __init__(self, indexed: tuple[str, ...] = (), threshold: int = 5):
        self.indexed, self.threshold = set(indexed), threshold
        self.seen: Counter[tuple[str, ...]] = Counter()

    def saw(self, *keys: str) -> None:
        self.seen[tuple(sorted(keys))] += 1

    def recommendations(self) -> list[tuple[str, str, int]]:
        """(kind, keys, times) of patterns seen more often than the threshold and not indexed."""
        out = []
        for keys, n in sorted(self.seen.items(), key=lambda x: (-x[1], x[0])):
            name = ",".join(keys)
            if n > self.threshold and name not in self.indexed:
                out.append(("composite" if len(keys) > 1 else "single", name, n))
        return out


class Indexes:
    """Copies of elements clustered by a key, under a folder: created, dropped, listed and asked."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.seen = Advisor()

    def _at(self, kind: str, *keys: str) -> str:
        return f"{self.folder}/{kind}-{'+'.join(keys)}"

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def create(self, elements: DataFrame, kind: str, *keys: str) -> None:
        if kind not in ("vertex", "edge") or not keys or any(not k.replace("_", "").isalnum() or k not in elements.columns for k in keys):
            raise InvalidProperty(f"no index of {kind} by {', '.join(keys)}")
        clustered(elements, self._at(kind, *keys), list(keys))

    def list(self, kind: str) -> list[tuple[str, ...]]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder)) if fs.exists(path(f"{s.getPath().toString()}/_SUCCESS"))]
        return sorted(tuple(n.removeprefix(f"{kind}-").split("+")) for n in names if n.startswith(f"{kind}-"))

    def drop(self, kind: str, *keys: str) -> bool:
        """Whether it was there."""
        fs, path = self._fs()
        return fs.delete(path(self._at(kind, *keys)), True)

    def get(self, elements: DataFrame, kind: str, **values: Any) -> DataFrame:
        """Elements with these values: from the index by most of these keys, else from the elements themselves."""
        self.seen.saw(*values)
        best = best_composite([list(x) for x in self.list(kind)], set(values))
        rows = self.spark.read.parquet(self._at(kind, *best)).select(*elements.columns) if best else elements
        for k, v in values.items():
            rows = rows.where(F.col(k) == F.lit(v))
        return rows

    def report(self, kind: str) -> dict[str, Any]:
        """Which indexes there are, what was asked, and what else would be worth one."""
        have = self.list(kind)
        self.seen.indexed = {",".join(sorted(x)) for x in have}
        return {"indexes": have, "asked": dict(self.seen.seen), "recommended": self.seen.recommendations()}


def clustered(elements: DataFrame, path: str, keys: list[str], partition_by: str | None = "label", files: int | None = None) -> None:
    """Writes elements as Parquet, partitioned and sorted so that filters on the keys skip files and row groups."""
    df = elements.repartitionByRange(files, *keys) if files else elements.repartitionByRange(*keys)
    writer = df.sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.bloom.filter.enabled", "true")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
