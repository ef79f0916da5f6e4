"""Chat formatting with collapse of cumulative snapshots.

Chat logs often save a conversation anew after every turn.  Each turn gets a
hash of the whole prefix up to it (an exclusive-or of position-salted turn
hashes, twice 64 bits, rolled along the conversation); a conversation whose
full hash is a proper prefix of another one goes in an anti-join, and the
maximal conversations that remain are rendered.  Hashes are made distinct
before they meet prefixes (128 bits decide; turns are not compared), so a conversation logged very often is one row there;
in the anti-join itself, nothing is aggregated and its copies may be split.

Defined cases: a null role or text counts as empty; turns are ordered by turn
(null first), then role and text, so ties and repeated rows have one order;
a row with a null conv_id is a conversation of its own; equal conversations prefix no
longer one, so all stay; "<|" inside contents becomes "< |" so that contents
cannot pose as markers; an empty table gives an empty result; other columns are
ignored.  One conversation is one row of the result and must fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (pos, role, text, a, b), where a and b hash the prefix that ends there."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    unnamed, t = t.filter("conv_id is null"), t.filter("conv_id is not null")
    own = lambda salt: F.xxhash64(F.lit(salt), F.lit(1), "role", "text")
    unnamed = unnamed.select("conv_id", F.array(F.struct(F.lit(1).alias("pos"), "role", "text", own(1).alias("a"), own(2).alias("b"))).alias("turns"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rolled = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("pos", F.row_number().over(order))
    for name, salt in (("a", 1), ("b", 2)):
        t = t.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "pos", "role", "text")).over(rolled))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text", "a", "b"))).alias("turns")).union(unnamed)


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations of with_prefix_hashes() that are no proper prefix of another."""
    logged = staged(with_prefix_hashes(turns), "conversations")
    last = F.element_at("turns", -1)
    whole = logged.withColumns({"n": F.size("turns"), "a": last.a, "b": last.b})
    prefixes = logged.filter(F.size("turns") > 1).select(F.explode(F.transform(F.slice("turns", F.lit(1), F.size("turns") - 1), lambda t: F.struct(t.pos.alias("n"), t.a.alias("a"), t.b.alias("b")))).alias("p")).select("p.*").distinct()
    key = ["n", "a", "b"]
    absorbed = staged(whole.select(*key).distinct().join(prefixes, key, "left_semi"), "absorbed")
    return whole.join(absorbed, key, "left_anti").select("conv_id", "turns")


def render(turns: Column) -> Column:
    safe = lambda s: F.replace(s, F.lit("<|"), F.lit("< |"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), safe(t.role), F.lit("\n"), safe(t.text), F.lit("<|im_end|>\n"))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of every maximal conversation of turns(conv_id, turn, role, text)."""
    return maximal(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("rendered"))


def op5_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    """One row per maximal conversation of the whole table: conv_id, n_turns, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, 1, [{'r': role, 't': text}] FROM t WHERE conv_id IS NULL)
SELECT conv_id, n AS n_turns,
  list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || replace(x.r, '<|', '< |') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.n > c.n AND d.turns[1] = c.turns[1] AND d.turns[1:c.n] = c.turns)
"""
