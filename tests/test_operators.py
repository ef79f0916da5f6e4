import random

import pytest
from pyspark.sql import functions as F

from tessara.operators import relational as R
from tessara.operators.scans import running_max
from tessara.streaming import cli, log


@pytest.mark.parametrize("block", [3, 1000])
def test_running_max_under_a_hot_key(spark, block):
    r = random.Random(block)
    rows = [(i, 0 if r.random() < 0.7 else r.randrange(4), r.choice([None, r.randrange(50)])) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "idx long, k int, v int").repartition(7)
    for keys in (["k"], []):
        got = {x.idx: x.m for x in running_max(df, keys, "idx", F.col("v"), "m", block).collect()}
        for i, k, _ in rows:
            before = [v for j, o, v in rows if j < i and (o == k or not keys) and v is not None]
            assert got[i] == max(before, default=None)


def test_sets_and_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "k int, i string")
    b = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, "q")], "k int, i string")
    assert {tuple(r) for r in R.multiset_overlap(a, b, ["k"], "i").collect()} == {(1, 2)}
    assert {tuple(r) for r in R.missing_keys(a, b, ["k", "i"]).collect()} == {(1, "y"), (2, "z")}
    j = spark.range(1).select(R.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("j"), R.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("none"), R.quorum(F.array(F.lit(5), F.lit(1), F.lit(3), F.lit(2))).alias("q")).first()
    assert (j.j, j.none, j.q) == (0.5, 0.0, 2)
    v = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "i int, v double")
    assert [r.i for r in R.order_by(v, ("v", True)).collect()] == [3, 2, 1]
    assert [r.i for r in R.limit_offset(R.order_by(v, ("v", False)), 1, 1).collect()] == [2]
    with pytest.raises(ValueError):
        R.limit_offset(v, -1)
    with pytest.raises(ValueError):
        R.top_k_per_group(v, ["i"], [("v", True)], 0)


def test_log_lookups(spark):
    entries = spark.createDataFrame([(i, 1 + (i > 3) + (i > 7)) for i in range(1, 11)], "idx long, term int")
    assert [r.idx for r in log.log_slice(entries, 4, 3).orderBy("idx").collect()] == [4, 5, 6]
    for at, want in ((2, (1, 1)), (6, (2, 4)), (10, (3, 8))):
        assert tuple(log.find_conflict(entries, at).first()) == want
    assert log.find_conflict(entries, 99).collect() == []
    assert tuple(log.bounds(entries).first()) == (1, 10, 10)


def test_kv_command_line(spark, tmp_path):
    kv = lambda *argv: cli.run(spark, ["--log", f"{tmp_path}/log", *argv])
    assert kv("status").endswith("entries 0")
    assert kv("put", "a", "1") == "applied"
    assert kv("cas", "a", "2", "--expect", "1") == "applied, was 1"
    assert kv("--client", "7", "--request", "1", "put", "b", "x") == "applied"
    assert kv("--client", "7", "--request", "1", "put", "b", "y") == "applied (a repeated request)"
    assert kv("get", "b") == "x" and kv("--at", "1", "get", "a") == "1" and kv("keys") == "a\nb"
    with pytest.raises(KeyError):
        kv("get", "zzz")
