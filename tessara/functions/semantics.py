"""Null-on-error operators of the SQL dialect, as Column builders over JVM built-ins.

Integers are bigint and floats double.  Integer overflow, division and
remainder by zero, and casts that do not fit give null instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"long": "bigint", "double": "double", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz"}


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column, kind: str = "double") -> Column:
    """Null when a bigint product overflows.  Products that surely do are told by their doubles: an exception for each row is slow."""
    product = F.try_multiply(a, b)
    return F.when(F.abs(a.cast("double") * b.cast("double")) < 9.3e18, product) if kind == "long" else product


def divide(a: Column, b: Column) -> Column:
    """Always a double; null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def remainder(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def negate(a: Column, kind: str) -> Column:
    """Null for the smallest bigint, whose negation does not fit."""
    return F.try_subtract(F.lit(0).cast("bigint"), a) if kind == "long" else -a


def like(text: Column, pattern: Column) -> Column:
    """% and _ only; a backslash is an ordinary character."""
    return F.call_function("like", text, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


def sum_(a: Column, distinct: bool = False, kind: str = "double") -> Column:
    """Null when a bigint sum overflows; kind: of a."""
    if not distinct:
        return F.try_sum(a)
    # 38 digits hold the sum of any 10**19 bigints, and distinct ones are fewer.
    return F.sum_distinct(a.cast("decimal(38,0)")).try_cast("bigint") if kind == "long" else F.sum_distinct(a)


def cast(a: Column, source: str, target: str) -> Column:
    """Soft casts between the dialect's types."""
    if source == target:
        return a
    if source == "null":
        return F.lit(None).cast(TYPES[target])
    if target == "string":
        if source == "double":
            whole = (a == F.floor(a)) & (F.abs(a) < 1e15)
            return F.when(whole, F.concat(F.format_string("%.0f", a), F.lit(".0"))).otherwise(a.cast("string"))
        return a.cast("string")
    if source == "string":
        text = F.trim(a)
        if target == "boolean":
            low = F.lower(text)
            return F.when(low.isin("true", "t", "1", "yes"), True).when(low.isin("false", "f", "0", "no"), False)
        if target == "date":
            return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        if target == "long":
            return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
        return text.try_cast(TYPES[target])
    if source == "double" and target == "long":
        fits = (a >= F.lit(-(2.0**63))) & (a < F.lit(2.0**63))
        return F.when(fits, a).cast("bigint")
    if target == "boolean" and source != "long" or "date" in (source, target) or "timestamp" in (source, target):
        if {source, target} == {"date", "timestamp"}:
            return a.cast(TYPES[target])
        return F.lit(None).cast(TYPES[target])
    return a.cast(TYPES[target])


def ordered(a: Column, ascending: bool = True) -> Column:
    """Nulls last when ascending, first when descending."""
    return a.asc_nulls_last() if ascending else a.desc_nulls_first()
