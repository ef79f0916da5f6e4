"""Prompts within a budget, extractive answers and citations, over whole batches of questions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citations, let, sentences, tokenize

REFUSAL = "I don't have enough information in the provided context to answer that."
BUDGET = 6000


def packed(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """ranked(query_id, rank, chunk_id, text) cut before the first block "[i] text" that does not fit; blocks cost two more characters."""
    order = Window.partitionBy("query_id").orderBy("rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    block = F.concat(F.lit("["), F.row_number().over(order).cast("string"), F.lit("] "), F.col("text"))
    out = ranked.withColumn("block", block).withColumn("used", F.coalesce(F.sum(F.length("block") + 2).over(before), F.lit(0)))
    fits = F.length("block") <= budget - F.col("used")
    return out.withColumn("fits", F.min(fits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("fits = 1").drop("used", "fits")


def prompts(questions: DataFrame, ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, question, context, chunks (ids in order) of questions(query_id, question)."""
    blocks = packed(ranked, budget).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block", "chunk_id", "text"))).alias("b"))
    joined = questions.join(blocks, "query_id", "left")
    none = F.lit("(no context)")
    text = F.coalesce(F.array_join(F.col("b.block"), "\n\n"), none)
    return joined.select("query_id", "question", text.alias("context"), F.coalesce("b.chunk_id", F.array().cast("array<string>")).alias("chunks"), F.coalesce("b.text", F.array().cast("array<string>")).alias("texts"))


def extract(question: Column, texts: Column, most: int = 3) -> Column:
    """The `most` sentences with the largest overlap / sqrt(terms), in their order; a refusal where none overlaps."""
    every = F.flatten(F.transform(texts, sentences))

    def judged(q: Column, s: Column, i: Column) -> Column:
        def scored(t: Column) -> Column:
            score = F.when(F.size(t) == 0, -1.0).otherwise(F.size(F.array_intersect(q, t)) / F.sqrt(F.greatest(F.size(t), F.lit(1))))
            return F.struct((-score).alias("order"), i.alias("i"), s.alias("s"))

        return let(F.array_distinct(tokenize(s, remove_stopwords=True)), scored)

    def chosen(scored: Column) -> Column:
        in_order = F.array_sort(F.transform(F.slice(scored, 1, most), lambda x: F.struct(x.i.alias("i"), x.s.alias("s"))))
        best = F.get(scored, F.lit(0)).order
        return F.when(best.isNull() | (best == 0), REFUSAL).otherwise(F.array_join(F.transform(in_order, lambda x: x.s), " "))

    terms = F.array_distinct(tokenize(question, remove_stopwords=True))
    ranked = let(terms, lambda q: F.filter(F.array_sort(F.transform(every, lambda s, i: judged(q, s, i))), lambda x: x.order <= 0))
    return let(ranked, chosen)


class Generator(Protocol):
    """Makes an answer, as an expression, from a question and the texts of its prompt."""

    name: str

    def __call__(self, question: Column, texts: Column) -> Column: ...


@dataclass(frozen=True)
class Extractive:
    most: int = 3
    name: str = "extractive"

    def __call__(self, question: Column, texts: Column) -> Column:
        return extract(question, texts, self.most)


@dataclass(frozen=True)
class Echo:
    """One fixed reply, to measure retrieval apart from generation."""

    reply: str = "ok"
    name: str = "echo"

    def __call__(self, question: Column, texts: Column) -> Column:
        return F.lit(self.reply)


def answers(questions: DataFrame, ranked: DataFrame, most: int = 3, budget: int = BUDGET, generate: Generator | None = None) -> DataFrame:
    """query_id, question, answer, citations: ids cited as [n], or all used ones where the answer cites none in range."""
    p = prompts(questions, ranked, budget).withColumn("answer", (generate or Extractive(most))(F.col("question"), F.col("texts")))
    cited = F.filter(citations(F.col("answer")), lambda n: (n >= 1) & (n <= F.size("chunks")))
    ids = F.transform(cited, lambda n: F.get("chunks", (n - 1).cast("int")))
    return p.select("query_id", "question", "answer", F.when(F.size(ids) > 0, ids).otherwise(F.col("chunks")).alias("citations"))
