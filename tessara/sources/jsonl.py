"""JSON lines: documents, labelled queries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import SourceError

DOCUMENTS = "doc_id string, text string, metadata map<string,string>"
QUERIES = "query_id string, query string, relevant_doc_ids array<string>, gains map<string,double>, reference_answer string"


def _checked(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = df.filter(" or ".join(f"{c} is null or {c} = ''" for c in required)).limit(1).collect()
    if bad:
        raise SourceError(f"{path}: a row lacks {' or '.join(required)}: {bad[0].asDict()}")
    return df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, metadata; a row without id or text is an error."""
    return _checked(spark, path, DOCUMENTS, ["doc_id", "text"])


def read_queries(spark: SparkSession, path: str, documents: DataFrame | None = None) -> DataFrame:
    """Labelled queries; with documents given, a label that names none of them is an error."""
    queries = _checked(spark, path, QUERIES, ["query_id", "query"])
    if documents is not None:
        missing = dangling_labels(queries, documents).limit(1).collect()
        if missing:
            raise SourceError(f"query {missing[0].query_id} refers to {missing[0].doc_id}, which is no document")
    return queries


def labels_of(queries: DataFrame) -> DataFrame:
    """query_id, doc_id, gain: relevant ids and graded ones; gain 1 where none is given."""
    ids = F.array_distinct(F.concat(F.coalesce("relevant_doc_ids", F.array()), F.coalesce(F.map_keys("gains"), F.array())))
    return queries.select("query_id", "gains", F.explode(ids).alias("doc_id")).select("query_id", "doc_id", F.coalesce(F.try_element_at("gains", F.col("doc_id")), F.lit(1.0)).alias("gain"))


def dangling_labels(queries: DataFrame, documents: DataFrame) -> DataFrame:
    return labels_of(queries).join(documents.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id")


def write_dataset(documents: DataFrame, queries: DataFrame, folder: str) -> None:
    """documents under corpus.jsonl and labelled queries, their ids sorted, under queries.jsonl, as the readers take them."""
    write_jsonl(documents.select(*[c for c in documents.columns if c in T.StructType.fromDDL(DOCUMENTS).names]), f"{folder}/corpus.jsonl")
    named = [c for c in queries.columns if c in T.StructType.fromDDL(QUERIES).names]
    if "relevant_doc_ids" in named:
        queries = queries.withColumn("relevant_doc_ids", F.array_sort("relevant_doc_ids"))
    write_jsonl(queries.select(*named), f"{folder}/queries.jsonl")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)
