import random

import pytest
from pyspark.sql import functions as F

from tessara.sources import wal
from tessara.streaming import invariants, log, stream

SCHEMA = stream.COMMAND


def history(seed, n=400):
    r, out, ids = random.Random(seed), [], {c: 0 for c in range(4)}
    for i in range(1, n + 1):
        c = r.randrange(4)
        if not r.random() < 0.25:
            ids[c] += 1
        op = r.choice(["put", "put", "delete", "cas", "cas", None] if r.random() < 0.2 else ["put", "delete", "cas", "cas"])
        out.append((i, op, f"k{r.randrange(7)}", f"v{r.randrange(4)}", f"v{r.randrange(4)}", r.random() < 0.3, c, max(0, ids[c] - (r.random() < 0.1))))
    return out


def model(commands, upto=None):
    state, seen, results = {}, {}, {}
    for i, op, key, value, expect, absent, client, request in commands:
        if upto is not None and i > upto or op is None:
            continue
        if client and client in seen and request <= seen[client][0]:
            results[i] = (True, *seen[client][1])
            continue
        before = state.get(key)
        applied = {"put": True, "delete": before is not None, "cas": before is None if absent else before == expect}[op]
        if applied:
            state.pop(key, None)
            if op != "delete":
                state[key] = value
        results[i] = (False, applied, before, before is not None)
        if client:
            seen[client] = (request, results[i][1:])
    return state, results


@pytest.mark.parametrize("seed", range(3))
def test_batch_fold(spark, seed):
    commands = history(seed)
    df = spark.createDataFrame(commands, SCHEMA).repartition(5)
    state, results = model(commands)
    assert {r.key: r.value for r in log.state_as_of(df).collect()} == state
    for at in (0, 57, 200):
        assert {r.key: r.value for r in log.state_as_of(df, at).collect()} == model(commands, at)[0]
    assert {r.idx: (r.replayed, r.applied, r.previous, r.existed) for r in log.all_results(df).collect()} == results
    snapshot = log.state_as_of(df.filter("client_id = 0"), 200)
    tail = df.filter("client_id = 0 and idx > 200")
    assert {r.key: r.value for r in log.restore(snapshot, tail, 200).collect()} == {r.key: r.value for r in log.state_as_of(df.filter("client_id = 0")).collect()}


def test_stream_equals_batch(spark, tmp_path):
    commands = history(7, 300)
    df = spark.createDataFrame(commands, SCHEMA).filter("op is not null")
    for k in range(3):  # one file per part, so that three triggers see them in order
        df.filter((F.col("idx") > k * 100) & (F.col("idx") <= (k + 1) * 100)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    clean = log.effective(df)
    for k in range(3):
        clean.filter((F.col("idx") > k * 100) & (F.col("idx") <= (k + 1) * 100)).select(*df.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/clean")
    updates = stream.run_to_table(stream.fold_state(stream.read_commands(spark, f"{tmp_path}/clean")), "folded", "update", f"{tmp_path}/cp1")
    last = updates.groupBy("key").agg(F.max_by(F.struct("value", "exists"), "idx").alias("s")).filter("s.exists")
    assert {r.key: r.s.value for r in last.collect()} == model(commands)[0]
    kept = stream.run_to_table(stream.drop_replays(stream.read_commands(spark, f"{tmp_path}/log")), "kept", "append", f"{tmp_path}/cp2")
    assert sorted(r.idx for r in kept.collect()) == sorted(r.idx for r in clean.collect())


def test_windows(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/*events.parquet")
    got = stream.run_to_table(stream.tumbling(source), "windows", "complete", f"{tmp_path}/cp")
    rows = lambda df: {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in df.collect()}
    assert rows(got) == rows(stream.tumbling(batch)) and rows(got)


def test_effective_log(spark):
    r = random.Random(3)
    arrivals, held, n = [], {}, 0
    for _ in range(60):
        start, term = r.randint(1, max([0, *held]) + 1), r.randint(1, 4)
        for i in range(start, start + r.randint(1, 4)):
            n += 1
            arrivals.append((n, i, term, f"{term}@{i}"))
            if held.get(i, (None,))[0] != term:
                held = {k: v for k, v in held.items() if k < i}
                held[i] = (term, f"{term}@{i}")
    got = log.effective_log(spark.createDataFrame(arrivals, "arrival long, idx long, term long, data string"))
    assert {x.idx: (x.term, x.data) for x in got.collect()} == held


def test_quorum_and_members(spark):
    progress = spark.createDataFrame([(g, n, m) for g, ms in enumerate([[5, 4, 3], [9, 9, 1, 2, 3], [7, 1]]) for n, m in enumerate(ms)], "grp long, node long, match long")
    entries = spark.createDataFrame([(0, 4, 2), (1, 3, 1), (2, 1, 2)], "grp long, idx long, term long")
    assert {(r.grp, r.commit) for r in log.quorum_commit(progress, entries, 2).collect()} == {(0, 4), (2, 1)}
    changes = spark.createDataFrame([(1, "add", 4), (2, "add", 4), (3, "remove", 1), (4, "remove", 2), (5, "remove", 3), (6, "remove", 4)], "idx long, op string, node long")
    assert [r.node for r in log.members_after(changes, [1, 2, 3]).collect()] == [4]
    entries = spark.range(1, 1000).withColumnRenamed("id", "idx")
    assert log.next_applicable(entries, 10, 900).count() == 256 and log.next_applicable(entries, 10, 20).count() == 10 and log.compact(entries, 990).count() == 9


def test_invariants(spark):
    ok = spark.createDataFrame([(n, i, 1, f"d{i}") for n in (1, 2, 3) for i in range(1, 5)], "node long, idx long, term long, data string")
    bad = ok.withColumn("data", F.when((F.col("node") == 2) & (F.col("idx") == 2), "x").otherwise(F.col("data")))
    assert invariants.log_matching(ok).count() == 0 and {(r.a, r.b, r.idx) for r in invariants.log_matching(bad).collect()} == {(1, 2, 2), (2, 3, 2)}
    assert invariants.state_machine_safety(ok).count() == 0 and [r.idx for r in invariants.state_machine_safety(bad).collect()] == [2]
    leaders = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 3)], "term long, node long")
    assert [r.term for r in invariants.election_safety(leaders).collect()] == [2]
    applied = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 1, 5)], "node long, seq long, idx long")
    assert [(r.node, r.seq) for r in invariants.append_only(applied).collect()] == [(1, 3)]
    assert invariants.applied_committed(spark.createDataFrame([(1, 3, 3), (2, 4, 3)], "node long, applied long, commit long")).first().node == 2


def test_wal(spark, tmp_path):
    path = str(tmp_path / "wal")
    make = lambda rows: spark.createDataFrame([(i, t, p.encode()) for i, t, p in rows], "idx long, term long, payload binary")
    wal.append(make([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]), path, 0)
    wal.append(make([(2, 2, "B"), (3, 2, "C"), (4, 2, "D")]), path, 1)
    records = wal.read_raw(spark, path)
    assert [(r.idx, r.term, bytes(r.payload)) for r in wal.replay(records).orderBy("idx").collect()] == [(1, 1, b"a"), (2, 2, b"B"), (3, 2, b"C"), (4, 2, b"D")]
    torn = records.withColumn("crc", F.when((F.col("segment") == 1) & (F.col("offset") == 3), F.col("crc") + 1).otherwise(F.col("crc")))
    assert [r.idx for r in wal.replay(torn).orderBy("idx").collect()] == [1, 2]
    snaps = records.select("idx", "payload", "crc").filter("idx > 1")
    assert wal.newest_intact(snaps.withColumn("crc", F.when(F.col("idx") == 4, 0).otherwise(F.col("crc")))).first().idx == 3 and wal.retained(snaps).count() == 3


def test_admitted_changes_hold_no_log_of_a_group(spark, capsys):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2]), i, r.choice(["add", "remove", None]), r.choice([None, 1, 2, 3, 4]), r.choice([None, i - 1, i - r.randint(1, 9)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp long, idx long, op string, node long, applied long").repartition(7)
    for by in (True, False):
        want, state = set(), {}
        for g, idx, op, node, applied in rows:
            voters, last = state.setdefault(g if by else None, ({1, 2, 3}, []))
            if last and applied is not None and last[-1] > applied:
                continue
            if op != "add" and (node is None or node not in voters or len(voters) < 2):
                continue
            (voters.add if op == "add" else voters.remove)(node)
            last.append(idx)
            want.add((g, idx) if by else (idx,))
        got = log.admitted(df if by else df.drop("grp"), [1, 2, 3])
        assert {tuple(x) for x in got.collect()} == want
        got.explain()
        assert "collect_list" not in capsys.readouterr().out


def test_replays_of_a_stream_hold_no_rows_of_a_client(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "drop_replays", None)  # it holds a client's rows of a micro-batch
    df = spark.createDataFrame([x for x in history(11, 300) if x[1]] + [(900 + i, "put", f"n{i}", "v", "v", False, c, r) for i, (c, r) in enumerate([(None, 1), (None, 0), (1, None), (0, 0), (1, -5), (77, 3)])], SCHEMA)
    for k in range(3):
        df.filter((F.col("idx") > k * 100) & ((F.col("idx") <= (k + 1) * 100) | (k == 2))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    want = sorted(r.idx for r in log.effective(df).collect())
    for files in (1, 9):
        commands = stream.read_commands(spark, f"{tmp_path}/log", files)
        assert sorted(r.idx for r in stream.fresh(commands).collect()) == want
        got = {r.key: r.value for r in stream.fold_once(commands).filter("exists").collect()}
        assert got == {r.key: r.value for r in log.state_as_of(df).collect()}
