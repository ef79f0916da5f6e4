"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the corpus over its own mass
(characters, plus one for each document).  Each document draws its number of
copies by inverting the Poisson distribution with that mean at a uniform number
hashed from a seed and its id, so a rerun or a lost executor draws the same.
A large mean is split into equal parts, whose independent draws are added.
Copies are exploded and dealt over all partitions by a random key, sorted by it.

Defined cases: a null source is a source of its own; a source that `weights`
does not name has weight 0; null and empty texts have mass 1; documents with
one id draw alike, and null ids draw by their text; an empty table gives an
empty result; input columns named copy or shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: Means up to this are drawn at once, larger ones in parts.
PART_RATE = 16.0
#: Terms of the distribution: P(more | rate <= PART_RATE) is under 1e-30.
TERMS = 96
BITS = 13 * 4


def hashed(*parts: Column) -> Column:
    """A uniform integer of 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, BITS // 4), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, total: float = 1.0, max_rate: float | None = None) -> DataFrame:
    """source, mass, rate: one row per source.

    weights: target shares (any scale); by default each source's mass to the
    power alpha.  total: the mass of the mixture, in corpora.  With a
    max_rate, rates over it are cut to it, and the mixture misses the shares.
    """
    if (max_rate is not None and max_rate <= 0) or total <= 0:
        raise ValueError("max_rate and total must be positive")
    mass = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + F.lit(1)).alias("mass"))
    if weights is None:
        share = F.pow(F.col("mass").cast("double"), F.lit(alpha))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("a weight is negative")
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name).cast("string")), F.lit(float(w))).otherwise(share)
    mass = staged(mass.withColumn("share", share), "source-mass")
    sums = mass.agg(F.sum("mass").alias("mass"), F.sum("share").alias("share")).first()
    rate = F.lit(float(total)) * F.col("share") / F.lit(float(sums.share or 1)) * F.lit(float(sums.mass or 1)) / F.col("mass")
    return mass.select("source", "mass", (rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))).alias("rate"))


def poisson_cdf(rate: Column, terms: int = TERMS) -> Column:
    """array: P(X <= 0), P(X <= 1), ... of the Poisson distribution with this mean."""
    first = F.exp(-rate)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(F.array(first).alias("cdf"), first.alias("p"), first.alias("sum")),
        lambda acc, k: F.struct(
            F.concat(acc.cdf, F.array(acc.sum + acc.p * rate / k)).alias("cdf"),
            (acc.p * rate / k).alias("p"),
            (acc.sum + acc.p * rate / k).alias("sum"),
        ),
        lambda acc: acc.cdf,
    )


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 0, **rates) -> DataFrame:
    """All columns of docs, plus copy (from 1) and shuffle_key, in random order."""
    docs = docs.drop("copy", "shuffle_key")
    # One row per source, staged so that its true size decides whether it is broadcast.
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART_RATE)), F.lit(1)).cast("int")
    split = source_rates(docs, weights, **rates).withColumn("parts", parts)
    table_ = staged(split.select("source", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf")), "rates")
    # All columns of docs travel inside one, so that none can clash.
    rows = docs.select(F.struct("*").alias("doc"))
    doc_id, text = F.col("doc.doc_id").cast("string"), F.coalesce("doc.text", F.lit(""))
    who = F.coalesce(doc_id, F.md5(text))
    uniform = lambda *parts: hashed(F.lit(str(seed)), F.lit("count"), who, *parts) / F.lit(float(1 << BITS))
    below = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    # The numbers of further parts are an array, so that each is hashed once and not for every term.
    others = F.transform(F.sequence(F.lit(2), F.col("parts")), lambda k: uniform(k.cast("string")))
    further = F.when(F.col("parts") > 1, F.aggregate(others, F.lit(0), lambda n, u: n + below(u))).otherwise(0)
    drawn = rows.join(table_, F.col("doc.source").eqNullSafe(F.col("source"))).withColumn("u", uniform())
    count = below(F.col("u")) + further
    copies = drawn.withColumn("count", count).filter("count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    key = hashed(F.lit(str(seed)), F.lit("order"), who, F.col("copy").cast("string"))
    mixed = copies.select("doc", "copy", key.alias("shuffle_key"))
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy").select("doc.*", "copy", "shuffle_key")


def op6_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixture, whole."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH m AS (SELECT source, sum(length(coalesce(text, '')) + 1) AS mass FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * sqrt(mass::DOUBLE) / (SELECT sum(sqrt(mass::DOUBLE)) FROM m) * (SELECT sum(mass)::DOUBLE FROM m) / mass::DOUBLE AS rate FROM m),
s AS (SELECT source, rate, greatest(ceil(rate / 16.0), 1)::INTEGER AS parts FROM r),
p AS (SELECT source, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1) AS p FROM s, range(97) t(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM p),
d AS (SELECT row_number() OVER () AS place, *, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS who FROM documents),
u AS (SELECT d.place, d.source, ('0x' || substr(md5('0/count/' || d.who || CASE WHEN part > 1 THEN '/' || part ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(range(1, s.parts + 1)) AS part)),
n AS (SELECT u.place, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.place)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, ('0x' || substr(md5('0/order/' || who || '/' || copy), 1, 13))::BIGINT AS shuffle_key
FROM d JOIN n USING (place), LATERAL (SELECT unnest(range(1, n.n + 1)) AS copy)
"""
