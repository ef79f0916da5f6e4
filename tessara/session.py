"""A SparkSession with the settings that the engine's semantics rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a staged file, where their number is about known.
FILE_ROWS = 8192


def session(name: str = "tessara", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI errors, AQE with skew handling, Arrow.  On a cluster leave master and partitions to the submission."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where it is unset, one of our own if all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), f'tessara-{os.getuid()}')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """What this application stages is under one folder of its own, which `clean` deletes."""
    return f"{shared_dir(spark)}/tessara-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged; frames that read from it end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: computed once, short in lineage, safe from lost executors.

    rows: about how many there are, if that is known.  Then files hold about
    FILE_ROWS, however many shuffle partitions there are.  For every small file
    an executor may start several processes (Hadoop's local file system sets
    permissions that way), each the size of its JVM until it runs its program.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
