"""Streaming twins: the keyed fold with replay protection, and event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import own_dir
from .log import fold_key, with_replays

COMMAND = "idx long, op string, key string, value string, expect string, expect_absent boolean, client_id long, request_id long"
OUT = "key string, idx long, value string, exists boolean"


def read_commands(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The log as a stream of Parquet files."""
    return spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drop_replays(commands: DataFrame) -> DataFrame:
    """Per client, requests above the greatest id so far; client 0 passes.

    A stream again, for small micro-batches: a client's rows of one are held and
    sorted together.  run_without_replays takes those of any size.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("idx")
        if key[0]:
            greatest = state.get[0] if state.exists else -(2**63)
            seen = rows["request_id"].cummax().shift(fill_value=greatest).clip(lower=greatest)
            state.update((max(greatest, int(rows["request_id"].max())),))
            rows = rows[rows["request_id"] > seen]
        yield rows

    shape = commands.schema
    # Client 0 keeps no state; its commands are dealt out by key.
    spread = F.when(F.col("client_id") == 0, F.pmod(F.xxhash64("key"), F.lit(1024))).otherwise(0)
    return commands.withColumn("spread", spread).groupBy("client_id", "spread").applyInPandasWithState(lambda k, f, s: run(k, (x[[c.name for c in shape]] for x in f), s), shape, "greatest long", "append", GroupStateTimeout.NoTimeout)


def fold_state(commands: DataFrame) -> DataFrame:
    """Updates (key, idx, value, exists) of the key-value state; late and repeated indices of a key are passed over."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, value, exists = state.get if state.exists else (-(2**63), None, False)
        rows = pd.concat(list(frames)).sort_values("idx").drop_duplicates("idx")
        rows = rows[rows["idx"] > at]
        if not len(rows):
            return
        rows = rows.astype(object).where(rows.notna(), None)
        _, value, exists = fold_key(rows.to_dict("records"), value, exists)
        at = int(rows["idx"].iloc[-1])
        state.update((at, value, exists))
        yield pd.DataFrame({"key": [key[0]], "idx": [at], "value": [value], "exists": [exists]})

    return commands.groupBy("key").applyInPandasWithState(run, OUT, "at long, value string, exists boolean", "update", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by event-time window and type, with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str, limit: float = 600) -> DataFrame:
    """Process all that is available into an in-memory table and return it (for tests and small states)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(limit):
        query.stop()
        raise TimeoutError(f"the stream had not ended after {limit} s")
    return stream.sparkSession.table(name)


def run_through(stream: DataFrame, mode: str, each: Callable[[DataFrame, int, str], DataFrame] = lambda batch, number, at: batch) -> str:
    """Process all that is available; what `each` makes of a micro-batch is written to a folder of its own, under the path that is returned.

    A batch that runs again after a failure overwrites its own folder, so results are exactly once.
    """
    at = f"{own_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        each(batch, number, at).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{at}/out"


def run_without_replays(commands: DataFrame) -> str:
    """Like run_through of drop_replays, for micro-batches of any size: no client's rows are held.

    Within a micro-batch the running maximum of a client is taken in two levels,
    as in log.with_replays.  The greatest id of each client so far is a table of
    the micro-batch before, written anew for each.
    """
    seen = "client_id long, greatest long"

    def each(batch: DataFrame, number: int, at: str) -> DataFrame:
        spark = batch.sparkSession
        before = spark.read.schema(seen).parquet(f"{at}/seen/{number - 1}") if number else spark.createDataFrame([], seen)
        named = batch.filter("coalesce(client_id, 0) <> 0")
        greatest = before.unionByName(named.groupBy("client_id").agg(F.max("request_id").alias("greatest")))
        greatest.groupBy("client_id").agg(F.max("greatest").alias("greatest")).write.mode("overwrite").parquet(f"{at}/seen/{number}")
        fresh = with_replays(batch).filter("not replayed").drop("replayed").join(before, "client_id", "left")
        return fresh.filter("greatest is null or request_id is null or request_id > greatest").select(*batch.columns)

    return run_through(commands, "append", each)


def fresh(commands: DataFrame) -> DataFrame:
    """Process all that is available; the commands that are no replays."""
    return commands.sparkSession.read.schema(commands.schema).option("recursiveFileLookup", "true").parquet(run_without_replays(commands))


def run_to_files(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Process all that is available; the last row of every key."""
    path = run_through(stream, mode)
    written = stream.sparkSession.read.schema(stream.schema.add("batch", "integer")).option("recursiveFileLookup", "true").parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def fold_once(commands: DataFrame) -> DataFrame:
    """key, idx, value, exists after a stream of commands, each request of a client applied once.

    Replays are dropped by client, and what passes is folded by key.  Both keep
    state, so they are two streams: the first writes each micro-batch to the
    shared folder, the second reads these as they come, all of a batch at once,
    so that the commands of a key keep their order.
    """
    passed = run_without_replays(commands)
    again = commands.sparkSession.readStream.schema(commands.schema).option("recursiveFileLookup", "true").parquet(passed)
    return run_to_files(fold_state(again), ["key"])
