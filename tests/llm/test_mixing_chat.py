import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessara.llm import chat, mixing

SF = "/root/testdata/sf0.001"


def against_sql(got, sql, tables, sf=SF):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = sorted((tuple(r) for r in got.select(names).collect()), key=repr)
    assert rows == sorted(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall(), key=repr) and rows


def test_mix_against_sql(spark):
    against_sql(mixing.op6_poisson_mix(spark, SF), mixing.OP6_SQL, ["documents"])


def test_mix_draws_poisson_counts(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 5000, "a").when(F.col("id") < 15000, "b").alias("source"), F.lit("c").alias("copy"))
    mixed = mixing.mix_sources(docs, {"a": 3.0, None: 1.0}, total=1.0)
    by = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(by) == {"a", None} and abs(by["a"] - 15000) < 5 * math.sqrt(15000) and abs(by[None] - 5000) < 5 * math.sqrt(5000)
    counts = dict.fromkeys(range(30), 0)
    for r in mixed.filter("source = 'a'").groupBy("doc_id").count().groupBy("count").count().toDF("k", "n").collect():
        counts[r.k] = r.n
    for k in range(1, 7):
        want = 5000 * math.exp(-3) * 3**k / math.factorial(k)
        assert abs(counts[k] - want) < 5 * math.sqrt(want)
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys)
    again = mixing.mix_sources(docs.repartition(3), {"a": 3.0, None: 1.0})
    assert again.exceptAll(mixed).count() == 0 and again.count() == mixed.count()
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": -1.0})


def test_mix_reaches_targets_of_small_sources(spark):
    docs = spark.range(10000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") < 100, "small").otherwise("big").alias("source"))
    assert {r.source: round(r.rate, 9) for r in mixing.source_rates(docs, {"small": 1, "big": 1}).collect()}["small"] == 50
    counts = [r["count"] for r in mixing.mix_sources(docs, {"small": 1, "big": 1}).filter("source = 'small'").groupBy("doc_id").count().collect()]
    assert len(counts) == 100 and abs(sum(counts) - 5000) < 5 * math.sqrt(5000)
    spread = sum((c - 50) ** 2 for c in counts) / 100
    assert 20 < spread < 100
    cut = {r.source: r.rate for r in mixing.source_rates(docs, {"small": 1, "big": 1}, max_rate=20).collect()}
    assert cut["small"] == 20


def test_mix_nulls(spark):
    docs = spark.createDataFrame([(None, None, None), (None, "t", None), (1, "", "s"), (1, "", "s")], "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, {None: 1, "s": 1}, total=8.0)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "shuffle_key"] and mixed.count() > 4


def test_mix_of_a_rare_source_against_sql(spark, tmp_path):
    """One source in 400 documents has a rate far over PART_RATE."""
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of source "), F.col("id").cast("string"), F.repeat(F.lit("x"), F.lit(500))).alias("text"), F.lit("en").alias("lang"), F.lit("big").alias("source"), F.lit(1).alias("n_chars"))
    rare = spark.createDataFrame([(900, "t", "en", "rare", 1), (900, "t", "en", "rare", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars int")
    rows.union(rare).write.parquet(f"{tmp_path}/documents.parquet/")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.source: r.rate for r in mixing.source_rates(docs).collect()}["rare"] > 100
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(mixing.OP6_SQL).fetchall(), key=repr)
    assert want and sorted(map(tuple, mixing.op6_poisson_mix(spark, str(tmp_path)).collect()), key=repr) == want


def test_mix_keeps_columns_of_any_name(spark):
    names = ["doc", "parts", "cdf", "u", "count", "rate", "who"]
    docs = spark.createDataFrame([(1, "t", "s", *range(len(names)))], ["doc_id", "text", "source", *names])
    got = mixing.mix_sources(docs, total=4.0).collect()
    assert got and all([r[n] for n in names] == list(range(len(names))) for r in got)


def test_chat_against_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        against_sql(chat.op5_chat_snapshots(spark, sf), chat.OP5_SQL, ["conversations"], sf)


def test_chat_collapse(spark):
    rows = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", "yo"), (3, 1, "a", "yo"), (3, 0, "u", "hi"), (3, 2, "u", "<|im_end|>"), (4, 0, "u", "hi"), (4, 1, "a", "yo!"), (5, 0, None, "x"), (6, 0, "x", None), (None, None, "u", "hi"), (None, None, "u", "alone"), (None, 1, "u", "alone"), (7, 0, "u", "z"), (7, 0, "u", "z"), (8, 0, "u", "z"), (9, 0, "u", "w"), (10, 3, "u", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as turns", "3 as a")
    got = chat.format_chats(df).collect()
    assert [r.rendered for r in got if r.conv_id is None] == ["<|im_start|>u\nalone<|im_end|>\n"] * 2
    got = {r.conv_id: r for r in got if r.conv_id is not None}
    assert set(got) == {3, 4, 5, 6, 7, 9, 10}
    assert got[3].n_turns == 3 and got[3].rendered.endswith("<|im_start|>u\n< |im_end|><|im_end|>\n")
    assert chat.format_chats(df.limit(0)).collect() == []
