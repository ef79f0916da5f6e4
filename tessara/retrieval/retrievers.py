"""Lexical, dense and hybrid retrievers over one set of chunks; a batch of queries is one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import fusion
from .chunking import chunk_documents
from .dense import HashingEmbedder, nearest
from .lexical import Bm25


@dataclass
class Index:
    chunks: DataFrame
    bm25: Bm25
    embedder: HashingEmbedder
    vectors: DataFrame

    def lexical(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self.bm25.search(queries, k)

    def dense(self, queries: DataFrame, k: int = 10) -> DataFrame:
        q = self.embedder.embed(queries.select("query_id", F.col("query").alias("text")), "query_id")
        return nearest(q, self.vectors.select(F.col("chunk_id").alias("vec_id"), "embedding"), k).withColumnRenamed("vec_id", "chunk_id")

    def hybrid(self, queries: DataFrame, k: int = 10, method: str = "rrf", weights: dict[str, float] | None = None, rrf_k: float = 60, overfetch: int = 3) -> DataFrame:
        """Both sides fetch k * overfetch, then fuse: rrf, minmax or zscore."""
        if overfetch < 1:
            raise ValueError("overfetch must be at least 1")
        sides = {"dense": self.dense(queries, k * overfetch), "lexical": self.lexical(queries, k * overfetch)}
        both = [df.withColumn("source", F.lit(name)) for name, df in sides.items()]
        rankings = both[0].unionByName(both[1])
        if method == "rrf":
            return fusion.reciprocal_rank_fusion(rankings, k, rrf_k, weights)
        return fusion.weighted_fusion(rankings, k, weights, method)

    def status(self) -> DataFrame:
        """Counts of documents, chunks and terms, and the mean chunk length to one decimal."""
        counts = self.chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"))
        return counts.withColumn("terms", F.lit(self.bm25.vocabulary_size()).cast("long"))


def build_index(docs: DataFrame, size: int = 400, overlap: int = 60, strategy: str = "recursive", dim: int = 384, keep: bool = True) -> Index:
    """Chunk docs(doc_id, text) and index the chunks for all retrievers.

    Vectors and terms take more disk than the texts; where an index is asked
    once, with a block of queries at most, they need not be kept.
    """
    chunks = staged(chunk_documents(docs, strategy, size, overlap), "chunks")
    embedder = HashingEmbedder(dim).fit_idf(chunks)
    vectors = embedder.embed(chunks, "chunk_id")
    return Index(chunks, Bm25.fit(chunks, keep=keep), embedder, staged(vectors, "vectors") if keep else vectors)
