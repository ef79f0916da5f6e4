"""Sorting, limits, top-k, sets and percentiles with the engine's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import ordered


def order_by(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Sort by (column, ascending) keys: nulls last when ascending, first when descending."""
    return df.orderBy(*[ordered(F.col(c), up) for c, up in keys])


def limit_offset(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + n of a sorted DataFrame."""
    if offset < 0 or (n is not None and n < 0):
        raise ValueError("limit and offset must not be negative")
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def top_k_per_group(df: DataFrame, groups: list[str], keys: list[tuple[str, bool]], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group with their rank; partitions keep k rows per group before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(*groups).orderBy(*[ordered(F.col(c), up) for c, up in keys])
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def multiset_overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, n: the size of the multiset intersection of items per key."""
    count = lambda df, name: df.groupBy(*keys, item).agg(F.count("*").alias(name))
    both = count(a, "__a").join(count(b, "__b"), [*keys, item])
    return both.groupBy(*keys).agg(F.sum(F.least("__a", "__b")).alias("n"))


def missing_keys(rows: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys do not occur in `among`."""
    return rows.join(among.select(*keys), keys, "left_anti")


def quorum(values: Column, majority: Column | None = None) -> Column:
    """The majority-th largest of an array: what more than half of its members have reached."""
    place = F.floor(F.size(values) / 2).cast("int") + 1 if majority is None else majority
    return F.get(F.sort_array(values, asc=False), place - 1)
