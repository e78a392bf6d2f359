"""Arithmetic on numeric columns and on arrays of numbers; all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(values: Column, threshold: float, array: bool = False) -> Column:
    """Whether each value exceeds the threshold."""
    return F.transform(values, lambda x: x > threshold) if array else values > threshold


def fused(a: Column, b: Column, weight: float, array: bool = False) -> Column:
    """a + b * weight; of arrays, element by element, null beyond the shorter one."""
    return F.zip_with(a, b, lambda x, y: x + y * weight) if array else a + b * weight
