"""Safety invariants of replicated logs, as queries that list violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def election_safety(leaders: DataFrame) -> DataFrame:
    """term with more than one leader in leaders(term, node)."""
    return leaders.groupBy("term").agg(F.count_distinct("node").alias("leaders")).filter("leaders > 1")


def append_only(applied: DataFrame) -> DataFrame:
    """node, seq, idx of applied(node, seq, idx) whose index does not grow."""
    before = F.lag("idx").over(Window.partitionBy("node").orderBy("seq"))
    return applied.withColumn("before", before).filter("idx <= before").select("node", "seq", "idx")


def log_matching(logs: DataFrame) -> DataFrame:
    """a, b, idx: pairs of nodes of logs(node, idx, term, data) that agree on a later (idx, term) but differ at idx."""
    x, y = logs.toDF("a", "idx", "term_a", "data_a"), logs.toDF("b", "idx", "term_b", "data_b")
    both = x.join(y, "idx").filter("a < b")
    anchor = both.filter("term_a = term_b").groupBy("a", "b").agg(F.max("idx").alias("anchor"))
    same = F.col("term_a").eqNullSafe(F.col("term_b")) & F.col("data_a").eqNullSafe(F.col("data_b"))
    return both.join(anchor, ["a", "b"]).filter((F.col("idx") <= F.col("anchor")) & ~same).select("a", "b", "idx")


def state_machine_safety(applied: DataFrame) -> DataFrame:
    """idx at which nodes of applied(node, idx, term, data) applied different entries."""
    return applied.groupBy("idx").agg(F.count_distinct(F.struct("term", "data")).alias("entries")).filter("entries > 1")


def applied_committed(status: DataFrame) -> DataFrame:
    """Rows of status(node, applied, commit) that applied more than is committed."""
    return status.filter("applied > commit")
