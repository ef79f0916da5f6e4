"""Evaluation of whole retrievers: document rankings of all queries in one plan, and sweeps over configurations."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import evaluate
from .fusion import first_per_document
from .retrievers import Index, build_index

#: A retriever takes queries(query_id, query) and k, and gives query_id, rank, chunk_id, score.
Retriever = Callable[[DataFrame, int], DataFrame]
#: The chunkings (size, overlap) and the weights (dense, lexical) of the published comparison.
CHUNKINGS = ((200, 40), (400, 60), (800, 100))
WEIGHTS = ((1.0, 1.0), (2.0, 1.0), (1.0, 2.0))


def retriever(index: Index, name: str = "hybrid", dense_weight: float = 1.0, lexical_weight: float = 1.0, method: str = "rrf") -> Retriever:
    """One of dense, lexical and hybrid."""
    if name == "hybrid":
        return functools.partial(index.hybrid, method=method, weights={"dense": dense_weight, "lexical": lexical_weight})
    if name not in ("dense", "lexical"):
        raise ValueError(f"unknown retriever {name!r}; there are dense, lexical, hybrid")
    return getattr(index, name)


def document_rankings(chunks: DataFrame, retrieve: Retriever, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id: documents by their best chunk among the k best chunks."""
    found = retrieve(queries, k).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    return first_per_document(found)


def evaluate_retriever(chunks: DataFrame, retrieve: Retriever, queries: DataFrame, labels: DataFrame, k: int = 10, cutoffs: tuple[int, ...] = evaluate.CUTOFFS) -> DataFrame:
    """The outcomes of every labelled query; k is added to the cutoffs, and the largest of them is fetched."""
    cutoffs = tuple(sorted({k, *cutoffs}))
    return evaluate.outcomes(document_rankings(chunks, retrieve, queries, cutoffs[-1]), labels, cutoffs)


def configurations(docs: DataFrame, dim: int = 512, chunkings: tuple = CHUNKINGS, weights: tuple = WEIGHTS):
    """(name, index, retriever) of every configuration; one index per chunking."""
    for size, overlap in chunkings:
        index = build_index(docs, size, overlap, dim=dim)
        yield f"vectors/{size}", index, retriever(index, "dense")
        yield f"terms/{size}", index, retriever(index, "lexical")
        for d, w in weights:
            yield f"both/{size}/{d:g}:{w:g}", index, retriever(index, "hybrid", d, w)


def sweep(docs: DataFrame, queries: DataFrame, labels: DataFrame, k: int = 10, dim: int = 512, **options) -> DataFrame:
    """config and all outcomes of every configuration; evaluate.compare() ranks them."""
    parts = [evaluate_retriever(i.chunks, r, queries, labels, k).withColumn("config", F.lit(name)) for name, i, r in configurations(docs, dim, **options)]
    return staged(functools.reduce(DataFrame.unionByName, parts), "sweep")


def summary(outcomes: DataFrame) -> DataFrame:
    """config, queries and the mean of every metric."""
    metrics = [c for c in outcomes.columns if c not in ("config", "query_id")]
    return outcomes.groupBy("config").agg(F.count("*").alias("queries"), *[F.avg(f"`{c}`").alias(c) for c in metrics])
