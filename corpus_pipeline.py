"""A corpus pipeline over `documents`: rules, near copies, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.llm import bpe, minhash_dedup, mixing, quality, secrets
from tessara.llm.common import staged, table, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest, carry=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of 5 words, similarity 0.8 or more), that of the smallest id.

    Ids do not tell documents apart: different texts under a null or shared id
    are different documents.  Of texts of one group under its id, that of the
    least key stays; rows equal in id and text leave one row, the least.  Texts
    without words are in no group; of them only equal rows leave one row.
    """
    found = minhash_dedup.grouped(docs, n=5).filter("kept")
    # Rows of one group that are kept have one id, that of the group.
    chosen = found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("id"), F.min("text_key").alias("key"))
    free = found.filter("root is null").select("doc_id", "text_key").distinct()
    kept = staged(chosen.select("id", "key", F.lit(False).alias("free")).union(free.select("doc_id", "text_key", F.lit(True))), "kept", docs.count())
    same = docs["doc_id"].eqNullSafe(kept["id"]) & (text_key(docs["text"]) == kept["key"])
    rest = docs.select(*COLUMNS).join(kept, same)
    if not _repeated(docs):
        return rest.select(*COLUMNS)
    more = F.struct("lang", "source", "n_chars")
    one = rest.groupBy("doc_id", "text", F.when(F.col("free"), more).alias("own")).agg(F.min(more).alias("more"))
    return one.select("doc_id", "text", "more.*").select(*COLUMNS)


def _repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark and n_chars counted anew."""
    found = secrets.scan(docs.select(*COLUMNS), secrets.train(secrets.labelled_samples(docs)))
    clean = secrets.redact(F.coalesce("text", F.lit("")), F.col("spans"))
    return found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by Poisson counts, so that a source's share follows the square root of its mass; shuffled."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of every copy in the mixture."""
    return bpe.round_trip(docs, carry=["doc_id", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_to_weights),
    ("byte-level BPE", encode_tokens),
]

#: SQL cannot express boosted trees or minimum hashes; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{k}")
    return docs
