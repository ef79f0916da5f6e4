from pyspark.sql import functions as F

from tessara.llm.common import least_hashed


def test_least_hashed_is_what_a_full_sort_gives(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 2).alias("label"))
    want = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label")
    for most in (1, 40, 900, 4000, 6000):
        got = least_hashed(rows, "doc_id", most, "label")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.drop("h").limit(most).collect()))
    assert least_hashed(rows.limit(0), "doc_id", 10).collect() == []
