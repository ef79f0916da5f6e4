"""Retrieval metrics for all queries in one plan.

rankings(query_id, rank, doc_id) against labels(query_id, doc_id, gain); queries
without labels are left out, labelled ones without results score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_words, let, trimmed

CUTOFFS = (1, 3, 5, 10, 20)


def outcomes(rankings: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row per labelled query: recall@k, precision@k, hit@k, ndcg@k, rr and ap."""
    if any(k <= 0 for k in cutoffs):
        raise ValueError("cutoffs must be positive")
    relevant = labels.filter("gain > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id"))
    ideal = relevant.withColumn("place", ideal_rank)
    per_query = ideal.groupBy("query_id").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1))).alias(f"ideal{k}") for k in cutoffs])
    hits = rankings.join(relevant, ["query_id", "doc_id"]).withColumn("found", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    at = lambda k, x: F.coalesce(F.sum(F.when(F.col("rank") <= k, x)), F.lit(0.0))
    got = hits.groupBy("query_id").agg(
        *[at(k, F.lit(1.0)).alias(f"hits{k}") for k in cutoffs],
        *[at(k, F.col("gain") / F.log2(F.col("rank") + 1)).alias(f"gain{k}") for k in cutoffs],
        (1 / F.min("rank")).alias("rr"),
        F.sum(F.col("found") / F.col("rank")).alias("ap"),
    )
    both = per_query.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out: list[Column] = [F.col("query_id")]
    for k in cutoffs:
        h = zero(F.col(f"hits{k}"))
        out += [(h / F.col("n")).alias(f"recall@{k}"), (h / k).alias(f"precision@{k}"), F.when(h > 0, 1.0).otherwise(0.0).alias(f"hit@{k}"), (zero(F.col(f"gain{k}")) / F.col(f"ideal{k}")).alias(f"ndcg@{k}")]
    return both.select(*out, zero(F.col("rr")).alias("rr"), (zero(F.col("ap")) / F.col("n")).alias("ap"))


def means(scored: DataFrame) -> DataFrame:
    """The mean of every metric, and the number of queries."""
    metrics = [c for c in scored.columns if c != "query_id"]
    return scored.agg(F.count("*").alias("queries"), *[F.avg(f"`{c}`").alias(c) for c in metrics])


def failures(scored: DataFrame, metric: str, threshold: float = 0.0) -> DataFrame:
    if metric not in scored.columns:
        raise ValueError(f"{metric} was not computed; add its cutoff")
    return scored.filter(F.coalesce(F.col(f"`{metric}`"), F.lit(0.0)) <= threshold)


def compare(scored: DataFrame, metric: str) -> DataFrame:
    """config, mean, best, spread of scored(config, ..., metric) over its configurations."""
    by = scored.groupBy("config").agg(F.avg(f"`{metric}`").alias("mean"))
    # One row per configuration, and each mean is taken once: sums of doubles differ in their last bits when they are taken again.
    all_ = Window.partitionBy(F.lit(0))
    top, low = F.max("mean").over(all_), F.min("mean").over(all_)
    return by.select("config", "mean", (F.col("mean") == top).alias("best"), (top - low).alias("spread"))


def percentiles(values: DataFrame, column: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles, mean and maximum in one pass."""
    return values.agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{column}`)").alias(f"p{p}") for p in points], F.avg(column).alias("mean"), F.max(column).alias("max"))


def token_f1(prediction: Column, truth: Column) -> Column:
    """Multiset overlap of answer words: harmonic mean of precision and recall; 1 if both are empty."""
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))

    def judged(p: Column, t: Column) -> Column:
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(t, w)))
        some = let(same, lambda n: F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(p) + F.size(t))))
        return F.when((F.size(p) == 0) | (F.size(t) == 0), (F.size(p) == F.size(t)).cast("double")).otherwise(some)

    return let(answer_words(prediction), lambda p: let(answer_words(truth), lambda t: judged(p, t)))


def exact_match(prediction: Column, truth: Column) -> Column:
    return (answer_words(prediction) == answer_words(truth)).cast("double")


def groundedness(answer: Column, context: Column, span: int = 24) -> Column:
    """The fraction of the answer's sentences of which some run of `span` characters stands in the context."""
    parts = trimmed(F.split(answer, r"(?<=[.!?])\s+"))

    def found(sentence: Column, low: Column) -> Column:
        def inside(t: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(t) - span + 1, F.lit(1)), F.lit(max(1, span // 2)))
            return F.when(F.length(t) < span, F.contains(low, t)).otherwise(F.exists(starts, lambda i: F.contains(low, F.substring(t, i, F.lit(span)))))

        return let(F.regexp_replace(F.lower(sentence), r"\s+", " "), inside)

    share = let(F.lower(context), lambda low: let(parts, lambda p: F.size(F.filter(p, lambda s: found(s, low))) / F.greatest(F.size(p), F.lit(1))))
    return F.when(F.size(parts) == 0, 0.0).otherwise(share)
