"""get, put, del, cas, keys and status over a command log kept as Parquet."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..session import session
from . import log
from .stream import COMMAND


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessara kv")
    parser.add_argument("--log", required=True)
    parser.add_argument("--client", type=int, default=0)
    parser.add_argument("--request", type=int, default=0, help="with a client: a number that repeats only when a request does")
    parser.add_argument("--at", type=int, help="read as of this index")
    sub = parser.add_subparsers(dest="op", required=True)
    for name, fields in (("get", ["key"]), ("put", ["key", "value"]), ("del", ["key"]), ("cas", ["key", "value"]), ("keys", []), ("status", [])):
        p = sub.add_parser(name)
        for f in fields:
            p.add_argument(f)
        if name == "cas":
            expected = p.add_mutually_exclusive_group(required=True)
            expected.add_argument("--expect")
            expected.add_argument("--absent", action="store_true")
    return parser


def run(spark: SparkSession, argv: list[str]) -> str:
    args = _parser().parse_args(argv)
    try:
        commands = spark.read.schema(COMMAND).parquet(args.log)
    except AnalysisException:
        commands = spark.createDataFrame([], COMMAND)
    if args.op == "status":
        r = log.bounds(commands).first()
        return f"first {r.first}  last {r['last']}  entries {r.n}"
    if args.op == "keys":
        return "\n".join(r.key for r in log.keys(log.state_as_of(commands, args.at)).collect())
    if args.op == "get":
        return log.get(log.state_as_of(commands, args.at), args.key)
    idx = (log.bounds(commands).first()["last"] or 0) + 1
    op = {"del": "delete"}.get(args.op, args.op)
    row = (idx, op, args.key, getattr(args, "value", None), getattr(args, "expect", None), bool(getattr(args, "absent", False)), args.client, args.request)
    spark.createDataFrame([row], COMMAND).coalesce(1).write.mode("append").parquet(args.log)
    done = log.all_results(spark.read.schema(COMMAND).parquet(args.log)).filter(f"idx = {idx}").first()
    return f"{'applied' if done.applied else 'not applied'}" + (f", was {done.previous}" if done.existed else "") + (" (a repeated request)" if done.replayed else "")


def main(argv: list[str]) -> int:
    try:
        print(run(session(), argv))
    except KeyError as e:
        print(f"no key {e}")
        return 1
    return 0
