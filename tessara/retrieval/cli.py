"""search, ask, eval and sweep over JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.context import Result
from ..plans.errors import SourceError
from ..session import session
from ..sources import jsonl
from . import evaluate, harness, rag
from .retrievers import build_index

COMMANDS = ("search", "ask", "eval", "sweep")


def _parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    # Names and defaults of the flags.
    common.add_argument("--corpus", required=True)
    common.add_argument("--chunk-size", type=int, default=400)
    common.add_argument("--chunk-overlap", type=int, default=60)
    common.add_argument("--dim", type=int, default=512)
    common.add_argument("--fusion", choices=["rrf", "minmax", "zscore"], default="rrf")
    common.add_argument("--retriever", choices=["dense", "lexical", "hybrid"], default="hybrid")
    common.add_argument("-k", type=int, default=10)
    parser = argparse.ArgumentParser(prog="tessara")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name, parents=[common])
        if name in ("search", "ask"):
            p.add_argument("query")
        else:
            p.add_argument("--queries", required=True)
            p.add_argument("--json", help="a folder for the report as JSON lines")
        if name == "ask":
            p.add_argument("--show-prompt", action="store_true")
        if name == "sweep":
            p.add_argument("--primary", default="ndcg@10")
    return parser


def _report(df: DataFrame, path: str | None) -> str:
    if path:
        jsonl.write_jsonl(df, path)
    rounded = [F.round(f"`{c}`", 4).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    return Result(df.select(*rounded)).to_table()


def run(spark: SparkSession, argv: list[str]) -> str:
    args = _parser().parse_args(argv)
    docs = jsonl.read_documents(spark, args.corpus)
    if args.command in ("eval", "sweep"):
        queries = jsonl.read_queries(spark, args.queries, docs)
        labels = jsonl.labels_of(queries)
    if args.command == "sweep":
        outcomes = harness.sweep(docs, queries, labels, args.k, args.dim)
        ranked = evaluate.compare(outcomes, args.primary).orderBy(F.desc("mean"), "config")
        if args.json:
            jsonl.write_jsonl(harness.summary(outcomes), args.json)
        return _report(ranked, None)
    index = build_index(docs, args.chunk_size, args.chunk_overlap, dim=args.dim)
    retrieve = harness.retriever(index, args.retriever, method=args.fusion) if args.retriever == "hybrid" else harness.retriever(index, args.retriever)
    if args.command == "eval":
        outcomes = harness.evaluate_retriever(index.chunks, retrieve, queries, labels, args.k)
        missed = evaluate.failures(outcomes, f"recall@{args.k}").select("query_id")
        return _report(evaluate.means(outcomes), args.json) + "\n\nnothing relevant found for:\n" + _report(missed.orderBy("query_id"), None)
    one = spark.createDataFrame([("q", args.query)], "query_id string, query string")
    found = retrieve(one, args.k).join(index.chunks, "chunk_id")
    if args.command == "search":
        return _report(found.select("rank", "chunk_id", "score", F.substring("text", 1, 80).alias("text")).orderBy("rank"), None)
    questions = one.withColumnRenamed("query", "question")
    ranked = found.select("query_id", "rank", "chunk_id", "text")
    answer = rag.answers(questions, ranked).first()
    prompt = rag.prompts(questions, ranked).first().context + "\n\n" if args.show_prompt else ""
    return prompt + answer.answer + "\n" + "\n".join(answer.citations)


def main(argv: list[str]) -> int:
    try:
        print(run(session(), argv))
    except (SourceError, ValueError) as e:
        print(f"error: {e}")
        return 1
    return 0
