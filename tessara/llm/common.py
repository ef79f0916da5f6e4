"""Shared helpers: staging tables in the shared folder, content keys, and reading inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_dir, staged

__all__ = ["bucketed", "labelled", "least_hashed", "small_batches", "stage_path", "staged", "table", "text_key"]

#: Bytes of the Arrow batches that go to Python workers (a longer row goes alone): texts vary too much for a count of rows to bound memory.
BATCH_BYTES = 4 << 20
#: What counts as white space between words.
WORD = r"[^\x20\x09-\x0D]+"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df in the shared folder as a table of as many buckets of key as there are shuffle partitions: joins and groups by key need not move it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    title = f"tessara_{path.rsplit('/', 1)[1].replace('-', '_')}"
    written = df.repartition(buckets, key).write.option("path", path).option("compression", "zstd")
    written.format("parquet").bucketBy(buckets, key).saveAsTable(title)
    return spark.table(title)


def text_key(text: Column) -> Column:
    """A 128-bit content key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key")


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches were bounded in bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(rows: DataFrame, key: str, most: int, *ties: str) -> DataFrame:
    """The `most` rows of the smallest hashes of key (ties by key, then `ties`): a bounded sample that no partitioning changes.

    Rows above a hash bound that surely are not among them go first, so that
    about twice `most` rows meet in one task, however many there are.
    """
    h, n = F.xxhash64(key), rows.count()
    share, some = 2 * most / max(n, 1), rows
    while share < 1:
        some = rows.filter(h < F.lit(int(-(2**63) + share * 2**64)))
        if some.count() >= most:
            break
        share, some = 2 * share, rows  # one key on many rows
    return some.withColumn("__h", h).orderBy("__h", key, *ties).limit(most).drop("__h")


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """label, text: at most `most` rows, those of the labelled ids with the least hashes.

    Of labels(doc_id, label), an id's least label counts; of docs(doc_id, text),
    an id that names several texts gives the one with the least key.
    """
    known = labels.groupBy("doc_id").agg(F.min("label").alias("label"))
    found = docs.select("doc_id", "text").join(F.broadcast(least_hashed(known, "doc_id", most)), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", text_key(F.col("text"))).alias("text")).select("label", "text")
