"""Sorting and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.iterate import cut


def by_property(elements: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Elements without the key come first (last, if descending); equals are ordered by id."""
    c = F.col(key)
    return elements.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), "id")


def batches(elements: DataFrame, size: int, key: str = "id") -> DataFrame:
    """(batch, elements, first, last): chunks of `size` in the order of the key, the last one partial.

    The order is total, so places come from sorted ranges: each range's count is added to the ranges after it.
    """
    ordered = elements.select(F.col(key).alias("k"))
    n = ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")
    local = ordered.repartitionByRange(int(n), "k").withColumn("p", F.spark_partition_id())
    local = cut(local)
    counts = local.groupBy("p").agg(F.count("*").alias("c"))
    before = counts.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("b"))
    placed = local.join(F.broadcast(before), "p").withColumn("at", F.col("b") + F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1)
    return placed.groupBy(F.floor(F.col("at") / size).alias("batch")).agg(F.count("*").alias("elements"), F.min("k").alias("first"), F.max("k").alias("last"))


def in_batches(elements: DataFrame, size: int, process: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """process on chunks of at most `size` rows, wherever they are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k in range(0, len(p), size):
                yield process(p.iloc[k : k + size])

    return elements.mapInPandas(run, schema)
