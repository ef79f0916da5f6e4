"""Ordered scans that stay parallel when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values that one task scans; only one row per key and block is scanned above that.
BLOCK = 100_000


def running_max(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with `name`: the greatest `value` of rows of the same keys with a smaller `order` (a whole number).

    Blocks of `block` order values are summarised by partial aggregates, the
    summaries are scanned, and then each block on its own.  Keys are not null.
    """
    at = F.floor(F.col(order) / F.lit(block)).alias("__block")
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, at).agg(F.max(value).alias("__top")).select(*keys, "__block", F.max("__top").over(before).alias("__before"))
    own = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = df.withColumn("__block", at).withColumn("__own", F.max(value).over(own))
    return scanned.join(blocks, [*keys, "__block"]).withColumn(name, F.greatest("__before", "__own")).drop("__block", "__own", "__before")
