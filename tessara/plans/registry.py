"""Where catalogue queries register under their names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .context import Context

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a (spark, sf_dir) callable under its name, and its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """Register a statement of the engine's SQL dialect; without an oracle of its own DuckDB runs the same text."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text, re.IGNORECASE)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = Context(spark)
        for t in used:
            ctx.register_parquet(t, f"{sf_dir}/{t}.parquet")
        return ctx.plan(text)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or text
