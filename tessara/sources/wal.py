"""An append-only log as files: records with checksums, read up to the first damaged one.

A record is a row (segment, offset, idx, term, payload, crc) where crc is the
CRC-32 of the payload.  Segments are append batches; the intact prefix ends at
the first record, in (segment, offset) order, whose checksum or sequence fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "segment long, offset long, idx long, term long, payload binary, crc long"


def append(entries: DataFrame, path: str, segment: int) -> None:
    """Append entries(idx, term, payload) as one segment, in order of idx; a later segment may overlap and replaces the tail."""
    rows = entries.select(F.lit(segment).cast("long").alias("segment"), F.col("idx").alias("offset"), "idx", "term", "payload", F.crc32("payload").alias("crc"))
    rows.write.mode("append").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def intact_prefix(records: DataFrame) -> DataFrame:
    """Records before the first that is damaged or missing.

    Within a segment, offsets run without gaps; a segment starts at most one
    past the greatest offset of those before it.  Only the first position that
    breaks this is looked for, so no global sort is needed: gaps inside segments
    are found by a join on the offset before, gaps between them among one row
    per segment.
    """
    place = F.struct("segment", "offset").alias("at")
    damaged = records.filter(F.coalesce(F.crc32("payload") != F.col("crc"), F.lit(True))).select(place)
    bounds = records.groupBy("segment").agg(F.min("offset").alias("offset"), F.max("offset").alias("last"))
    before = records.select("segment", (F.col("offset") + 1).alias("offset")).union(bounds.select("segment", "offset"))
    gaps = records.join(before, ["segment", "offset"], "left_anti").select(place)
    earlier = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    late = bounds.withColumn("reached", F.max("last").over(earlier)).filter(F.col("offset") > F.col("reached") + 1).select(place)
    first = damaged.union(gaps).union(late).agg(F.min("at").alias("cut")).first().cut
    if first is None:
        return records
    return records.filter((F.col("segment") < first.segment) | ((F.col("segment") == first.segment) & (F.col("offset") < first.offset)))


def replay(records: DataFrame) -> DataFrame:
    """The effective log: in the intact prefix, a record stands unless a later segment starts at or before its index."""
    intact = intact_prefix(records)
    starts = intact.groupBy("segment").agg(F.min("idx").alias("first"))
    # One row per append batch: what later batches truncate is the least of their first indices.
    later = Window.orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = starts.select("segment", F.min("first").over(later).alias("cut"))
    return intact.join(cuts, "segment").filter("cut is null or idx < cut").select("idx", "term", "payload")


def newest_intact(snapshots: DataFrame) -> DataFrame:
    """Of snapshots(idx, payload, crc), the intact one of the greatest index."""
    return snapshots.filter(F.crc32("payload") == F.col("crc")).orderBy(F.desc("idx")).limit(1)


def retained(snapshots: DataFrame, keep: int = 3) -> DataFrame:
    """The newest `keep` snapshots."""
    return snapshots.orderBy(F.desc("idx")).limit(keep)
