"""Loops of supersteps: each step is one plan, its result is cut off from what it came from."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import GraphError

#: Rows up to which a frontier is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000
MOST_ROUNDS = 10_000
S = TypeVar("S")


class NotConverged(GraphError):
    """A loop reached its cap. Results are never cut short in silence."""


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the checkpoint folder that the cluster names, so that a lost executor costs no more than a re-read.

    Only a local session that names none gets a temporary folder; a cluster's has to. Spent folders go if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors reach."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise GraphError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def iterate(state: S, step: Callable[[S, int], tuple[S, bool]], rounds: int = MOST_ROUNDS) -> S:
    """Applies step until it says that nothing changed."""
    for k in range(rounds):
        state, changed = step(state, k)
        if not changed:
            return state
    raise NotConverged(f"not done after {rounds} rounds")
