"""Fusion of rankings(query_id, source, rank, chunk_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import ranked


def _weight(weights: dict[str, float] | None) -> Column:
    if weights is None:
        return F.lit(1.0)
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col("source") == name, F.lit(float(w))).otherwise(out)
    return out


def _combine(parts: DataFrame, k: int) -> DataFrame:
    summed = parts.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.map_from_entries(F.collect_list(F.struct("source", "part"))).alias("components"))
    return ranked(summed, k, carry=["components"])


def reciprocal_rank_fusion(rankings: DataFrame, k: int = 10, rrf_k: float = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight / (rrf_k + rank); a weight of 0 leaves a list out.  Ties by id."""
    if rrf_k < 0:
        raise ValueError("rrf_k is negative")
    parts = rankings.withColumn("w", _weight(weights)).filter("w > 0").withColumn("part", F.col("w") / (F.lit(float(rrf_k)) + F.col("rank")))
    return _combine(parts, k)


def normalized(rankings: DataFrame, method: str = "minmax") -> DataFrame:
    """score within each list to [0, 1], or to z-scores; lists of one score become 1 or 0."""
    own = Window.partitionBy("query_id", "source")
    s = F.col("score")
    if method == "minmax":
        low, high = F.min(s).over(own), F.max(s).over(own)
        value = F.when(high == low, 1.0).otherwise((s - low) / (high - low))
    elif method == "zscore":
        spread = F.stddev_pop(s).over(own)
        value = F.when(spread == 0, 0.0).otherwise((s - F.avg(s).over(own)) / spread)
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return rankings.withColumn("score", value)


def weighted_fusion(rankings: DataFrame, k: int = 10, weights: dict[str, float] | None = None, method: str = "minmax") -> DataFrame:
    """Sum of weight * normalised score; a list that lacks an id adds nothing."""
    parts = normalized(rankings, method).withColumn("w", _weight(weights)).filter("w > 0").withColumn("part", F.col("w") * F.col("score"))
    return _combine(parts, k)


def overlap(rankings: DataFrame) -> DataFrame:
    """query_id, overlap: the Jaccard index of the ids of all its lists' common and joint items; 0 if there are none."""
    n = rankings.select("query_id", "source").distinct().groupBy("query_id").agg(F.count("*").alias("lists"))
    by_id = rankings.groupBy("query_id", "chunk_id").agg(F.count_distinct("source").alias("in_"))
    return by_id.join(n, "query_id").groupBy("query_id").agg((F.count(F.when((F.col("in_") == F.col("lists")) & (F.col("lists") > 1), 1)) / F.count("*")).alias("overlap"))


def first_per_document(ranking: DataFrame) -> DataFrame:
    """query_id, rank, doc_id: documents by their best chunk, ranked anew."""
    best = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", "doc_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "doc_id")
