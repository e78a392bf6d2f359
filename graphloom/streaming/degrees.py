"""Degree counts kept up by Structured Streaming over an edge stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.iterate import shared_folder


def degree_stream(edges: DataFrame, end: str = "dst") -> DataFrame:
    """(target, degree) of a streaming edge table: running counts, state kept per vertex."""
    return edges.groupBy(F.col(end).alias("target")).agg(F.count("*").alias("degree"))


def windowed_degree_stream(edges: DataFrame, time: str, end: str = "dst", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, target, degree): degrees by time window; edges later than `late` no longer count, so state stays bounded."""
    return edges.withWatermark(time, late).groupBy(F.window(time, window), F.col(end).alias("target")).agg(F.count("*").alias("degree"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming edges from users to the types of their events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("dst"), "ts")


def in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts once the stream has taken in all there is. Each batch writes the changed counts by number; the last of each target stays."""
    at = f"{shared_folder(spark)}/degrees-{uuid.uuid4().hex}"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/rows/part={batch}")

    run = degree_stream(event_edges(spark, sf_dir)).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("target string, degree long, batch long").parquet(f"{at}/rows")
    return rows.groupBy("target").agg(F.max_by("degree", "batch").alias("degree"))
