"""Batch operators over a command log: dedupe, folds, as-of reads, effective logs, quorums.

commands(idx, op, key, value, expect, expect_absent, client_id, request_id);
op is put, delete or cas.  The log is ordered by idx.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import quorum
from ..operators.scans import running_max

#: No group: a null is one.
_NONE = object()
RESULT = "idx long, key string, client_id long, request_id long, applied boolean, previous string, existed boolean"


def with_replays(commands: DataFrame) -> DataFrame:
    """Adds replayed: a client's request id at or below its greatest so far; client 0 is exempt.

    This depends on ids alone, not on any key's state, so it is one running maximum per client.
    """
    named = F.coalesce(F.col("client_id"), F.lit(0)) != 0
    # Anonymous commands need no scan; they stay out of its shuffle, where they would be one hot key.
    mine = running_max(commands.filter(named), ["client_id"], "idx", F.col("request_id"), "__seen")
    mine = mine.withColumn("replayed", F.coalesce(F.col("request_id") <= F.col("__seen"), F.lit(False))).drop("__seen")
    return mine.unionByName(commands.filter(~named).withColumn("replayed", F.lit(False)))


def effective(commands: DataFrame) -> DataFrame:
    """Commands that the state machine applies: no replays, no leader no-ops (null op)."""
    return with_replays(commands.filter("op is not null")).filter("not replayed").drop("replayed")


def state_as_of(commands: DataFrame, idx: int | None = None) -> DataFrame:
    """key, value after the log, or after its entries up to idx.

    Per key the entries after the last put or delete are all that count; only
    compare-and-swap runs are folded, in order, inside one expression.
    """
    upto = effective(commands if idx is None else commands.filter(F.col("idx") <= idx))
    last = upto.filter("op in ('put', 'delete')").groupBy("key").agg(F.max("idx").alias("from"))
    kept = upto.join(last, "key", "left").filter("from is null or idx >= from")
    step = F.struct("idx", "op", "value", "expect", "expect_absent")
    folded = kept.groupBy("key").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    none = F.struct(F.lit(None).cast("string").alias("v"), F.lit(False).alias("e"))

    def apply(s, c):
        holds = F.coalesce(F.when(F.coalesce(c.expect_absent, F.lit(False)), ~s.e).otherwise(s.e & (s.v == c.expect)), F.lit(False))
        there = F.struct(F.coalesce(c.value, F.lit("")).alias("v"), F.lit(True).alias("e"))
        return F.when(c.op == "put", there).when(c.op == "delete", none).when(holds, there).otherwise(s)

    return folded.select("key", F.aggregate("steps", none, apply).alias("s")).filter("s.e").select("key", F.col("s.v").alias("value"))


def fold_key(steps: list[dict], value: str | None = None, existed: bool = False) -> tuple[list[tuple[bool, str | None, bool]], str | None, bool]:
    """Results (applied, previous, existed) of ordered commands on one key, and its final state."""
    out = []
    for c in steps:
        before, there = value, existed
        if c["op"] == "put":
            applied = True
        elif c["op"] == "delete":
            applied = existed
        else:
            applied = not existed if c["expect_absent"] else existed and value == c["expect"]
        if applied:
            value, existed = (None, False) if c["op"] == "delete" else (c["value"] or "", True)
        out.append((applied, before if there else None, there))
    return out, value, existed


def results(commands: DataFrame) -> DataFrame:
    """The result of every applied command; the fold of a key is sequential by nature, keys run in parallel."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
        done, _, _ = fold_key(rows)
        return pa.Table.from_pylist([{k: r[k] for k in ("idx", "key", "client_id", "request_id")} | dict(zip(("applied", "previous", "existed"), d, strict=True)) for r, d in zip(rows, done, strict=True)], pa.schema([("idx", pa.int64()), ("key", pa.string()), ("client_id", pa.int64()), ("request_id", pa.int64()), ("applied", pa.bool_()), ("previous", pa.string()), ("existed", pa.bool_())]))

    columns = ["idx", "op", "key", "value", "expect", "expect_absent", "client_id", "request_id"]
    return effective(commands).select(*columns).groupBy("key").applyInArrow(run, RESULT)


def all_results(commands: DataFrame) -> DataFrame:
    """Results of all commands; a replay gets the result of its client's latest request before it."""
    marked = with_replays(commands.filter("op is not null"))
    own = results(commands).select("idx", "applied", "previous", "existed")
    named = marked.filter("coalesce(client_id, 0) <> 0")
    replays = running_max(named, ["client_id"], "idx", F.when(~F.col("replayed"), F.col("idx")), "source").filter("replayed").select(F.col("idx").alias("at"), "source")
    fresh = marked.filter("not replayed").select(F.col("idx").alias("at"), F.col("idx").alias("source"))
    every = fresh.withColumn("replayed", F.lit(False)).unionByName(replays.withColumn("replayed", F.lit(True)))
    return every.join(own, F.col("source") == F.col("idx")).select(F.col("at").alias("idx"), "replayed", "applied", "previous", "existed")


def members_after(changes: DataFrame, initial: list[int]) -> DataFrame:
    """[grp,] node: the voters after changes([grp,] idx, op add|remove, node); adding twice is one, the last voter stays.

    Membership changes of a group are few and serial; each group is folded in one expression, groups run in parallel.
    """
    by = [c for c in ("grp",) if c in changes.columns]
    start = F.array(*[F.lit(n).cast("long") for n in initial]).cast("array<bigint>")
    steps = changes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", "op", F.col("node").cast("long").alias("node")))).alias("steps"))

    def apply(voters, c):
        without = F.array_remove(voters, c.node)
        return F.when(c.op == "add", F.array_union(voters, F.array(c.node))).when(F.size(without) > 0, without).otherwise(voters)

    return steps.select(*by, F.explode(F.aggregate("steps", start, apply)).alias("node"))


def admitted(proposals: DataFrame, initial: list[int]) -> DataFrame:
    """[grp,] idx: the membership changes that stand, of proposals([grp,] idx, op add|remove, node, applied).

    One change of a group is in flight at a time: a proposal stands only if the
    last one that stood is at or below `applied`, what its log had applied then.
    A voter is removed only if it is one, and not the last.
    """
    by = [c for c in ("grp",) if c in proposals.columns]
    dealt = proposals.repartition("grp") if by else proposals.repartition(1)
    rows = dealt.select(*by, "idx", "op", F.col("node").cast("long").alias("node"), "applied")
    kinds = dict(proposals.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in (*by, "idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, voters, last = _NONE, set(initial), None
        for batch in batches:
            stood = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("idx", "op", "node", "applied")]
            groups = batch.column(0).to_pylist() if by else [None] * batch.num_rows
            for at, (g, idx, op, node, applied) in enumerate(zip(groups, *columns, strict=True)):
                if g != grp:
                    grp, voters, last = g, set(initial), None
                if last is not None and applied is not None and last > applied:
                    continue
                if op == "add":
                    voters.add(node)
                elif node is not None and node in voters and len(voters) > 1:
                    voters.remove(node)
                else:
                    continue
                stood.append(at)
                last = idx
            yield batch.select([*by, "idx"]).take(pa.array(stood, pa.int64()))

    # A group is one task's by its nature, but only its voters and its last change are held.
    return rows.sortWithinPartitions(*by, "idx", "op", "node", "applied").mapInArrow(run, shape)


def commit_to(committed: Column, to: Column, last: Column) -> Column:
    """The commit index after a leader names `to`: it never moves back, nor past the last index held."""
    return F.greatest(committed, F.least(to, last))


def stale_state(commands: DataFrame, progress: DataFrame, node: int) -> DataFrame:
    """key, value as one node of progress(node, applied) sees them: the log up to what that node has applied, be it behind."""
    seen = progress.filter(F.col("node") == node).agg(F.max("applied").alias("applied")).first().applied
    return state_as_of(commands, -1 if seen is None else seen)


def quorum_commit(progress: DataFrame, log: DataFrame, term: int) -> DataFrame:
    """grp, commit: the greatest index on a majority of progress(grp, node, match), if log(grp, idx, term) has it in this term."""
    at = progress.groupBy("grp").agg(quorum(F.collect_list("match")).alias("idx"))
    return at.join(log.filter(F.col("term") == term), ["grp", "idx"]).select("grp", F.col("idx").alias("commit"))


def effective_log(arrivals: DataFrame) -> DataFrame:
    """idx, term, data of arrivals(arrival, idx, term, data): an entry that conflicts with a held one truncates from there on.

    An arrival equal to the held entry changes nothing.  An entry stands if it
    is the last change at its index and no later change came at or below it.
    """
    changes = arrivals.withColumn("before", F.lag("term").over(Window.partitionBy("idx").orderBy("arrival"))).filter("before is null or before <> term")
    newest = changes.groupBy("idx").agg(F.max_by(F.struct("arrival", "term", "data"), "arrival").alias("e"))
    below = running_max(newest.select("idx", "e.*"), [], "idx", F.col("arrival"), "cut")
    return below.filter("cut is null or cut < arrival").select("idx", "term", "data")


def next_applicable(log: DataFrame, applied: int, commit: int, most: int = 256) -> DataFrame:
    """The next at most `most` committed entries after the applied index."""
    return log.filter((F.col("idx") > applied) & (F.col("idx") <= min(commit, applied + most)))


def log_slice(log: DataFrame, first: int, most: int = 64) -> DataFrame:
    """At most `most` entries from index `first` on, as one append carries."""
    return log.filter((F.col("idx") >= first) & (F.col("idx") < first + most))


def find_conflict(log: DataFrame, idx: int) -> DataFrame:
    """term, first: the term of the entry at idx, and the first index of the run of that term which holds idx."""
    here = log.filter(F.col("idx") == idx).select(F.col("term").alias("__term"))
    before = log.filter(F.col("idx") <= idx).join(F.broadcast(here), F.lit(True))  # one row
    cut = F.coalesce(F.max(F.when(F.col("term") != F.col("__term"), F.col("idx"))), F.lit(-1).cast("long"))
    last_other = before.agg(cut.alias("__cut"))
    run = before.join(F.broadcast(last_other), F.col("idx") > F.col("__cut"))
    return run.groupBy("__term").agg(F.min("idx").alias("first")).withColumnRenamed("__term", "term")


def bounds(log: DataFrame) -> DataFrame:
    """first, last, n of a log's indices; nulls and 0 for an empty one."""
    return log.agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))


def get(state: DataFrame, key: str) -> str:
    """The value of a key; an absent one is a KeyError."""
    found = state.filter(F.col("key") == key).first()
    if found is None:
        raise KeyError(key)
    return found.value


def keys(state: DataFrame) -> DataFrame:
    return state.select("key").orderBy("key")


def compact(log: DataFrame, snapshot_idx: int) -> DataFrame:
    return log.filter(F.col("idx") > snapshot_idx)


def restore(snapshot: DataFrame, tail: DataFrame, snapshot_idx: int) -> DataFrame:
    """State of snapshot(key, value) with the commands after snapshot_idx applied."""
    base = snapshot.select(F.lit(snapshot_idx).cast("long").alias("idx"), F.lit("put").alias("op"), "key", "value", F.lit(None).cast("string").alias("expect"), F.lit(False).alias("expect_absent"), F.lit(0).cast("long").alias("client_id"), F.lit(0).cast("long").alias("request_id"))
    return state_as_of(base.unionByName(tail.filter(F.col("idx") > snapshot_idx).select(*base.columns)))


def is_up_to_date(term: Column, idx: Column, last_term: Column, last_idx: Column) -> Column:
    """Whether a candidate's last (term, idx) is at least the voter's."""
    return (term > last_term) | ((term == last_term) & (idx >= last_idx))
