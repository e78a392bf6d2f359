"""How property values compare with given ones, as Column expressions that stay inside code generation.

Strings and numbers compare as doubles, strings and booleans through true/1/yes/on and false/0/no/off; numbers and booleans
never match. All results are two-valued: an absent or unparsable value doesn't match.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double", "long", "byte", "short"}
TRUE, FALSE = ["true", "1", "yes", "on"], ["false", "0", "no", "off"]


def is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def definite(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def number(column: Column, kind: str) -> Column:
    """The value as a double: numbers, and strings that parse."""
    if is_number(kind):
        return column.cast("double")
    return column.try_cast("double") if kind == "string" else F.lit(None).cast("double")


def truth(column: Column) -> Column:
    low = F.lower(column)
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)


def match_value(column: Column, kind: str, value: Any) -> Column:
    """Whether a value of type kind equals the given one."""
    if value is None:
        return column.isNull()
    if isinstance(value, bool):
        return definite(column == F.lit(value)) if kind == "boolean" else definite(truth(column) == F.lit(value)) if kind == "string" else F.lit(False)
    if isinstance(value, (int, float)):
        if is_number(kind):
            return definite(column == F.lit(value))
        return definite(number(column, kind) == F.lit(float(value))) if kind == "string" else F.lit(False)
    if kind == "string":
        return definite(column == F.lit(str(value)))
    if is_number(kind):
        try:
            return definite(column.cast("double") == F.lit(float(value)))
        except (TypeError, ValueError):
            return F.lit(False)
    if kind == "boolean":
        low = str(value).lower()
        return definite(column == F.lit(low in TRUE)) if low in TRUE + FALSE else F.lit(False)
    return definite(column == F.lit(value))


def in_range(column: Column, kind: str, low: Any = None, high: Any = None, include_low: bool = True, include_high: bool = False, open_is: bool = False) -> Column:
    """Numbers, and strings that parse, within bounds; without any bound, open_is."""
    if low is None and high is None:
        return F.lit(open_is)
    try:
        low, high = (float(x) if isinstance(x, str) else x for x in (low, high))
    except ValueError:
        return F.lit(False)
    if isinstance(low, bool) or isinstance(high, bool):
        return F.lit(False)
    # a plain comparison of a numeric column reaches the Parquet reader
    x = column if is_number(kind) else number(column, kind)
    test = F.lit(True)
    if low is not None:
        test = test & ((x >= F.lit(low)) if include_low else (x > F.lit(low)))
    if high is not None:
        test = test & ((x <= F.lit(high)) if include_high else (x < F.lit(high)))
    return definite(test)


def matches(column: Column, pattern: str) -> Column:
    """Whether the whole string matches; nothing matches a pattern that isn't one."""
    if not is_pattern(pattern):
        return F.lit(False)
    return definite(column.rlike(f"^(?:{pattern})$"))


def is_pattern(pattern: str) -> bool:
    """As the JVM sees it, where there is one at hand."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    context = SparkContext._active_spark_context
    if context is None:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(f"^(?:{pattern})$")
    except (Py4JJavaError, PySparkException):
        return False
    return True


def typed_match(value: Column, kind: Column, wanted: Any) -> Column:
    """match_value for a row of vprops, whose type is a column."""
    if isinstance(wanted, bool):
        return definite(kind.isin("boolean", "string") & (truth(value) == F.lit(wanted)))
    if isinstance(wanted, (int, float)):
        return definite((kind != "boolean") & (value.try_cast("double") == F.lit(float(wanted))))
    text = str(wanted)
    same = (kind == "string") & (value == F.lit(text))
    try:
        same = same | (kind.isin("long", "double") & (value.try_cast("double") == F.lit(float(text))))
    except ValueError:
        pass
    if text.lower() in TRUE + FALSE:
        same = same | ((kind == "boolean") & (value.cast("boolean") == F.lit(text.lower() in TRUE)))
    return definite(same)


def percentage(part: Column, whole: Column) -> Column:
    return F.concat(F.format_number(F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0)), 1), F.lit("%"))
