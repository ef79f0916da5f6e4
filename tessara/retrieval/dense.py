"""Hashed embeddings, exact nearest neighbours by blocked matrix products, and an LSH option."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

_TOKEN = re.compile(r"[a-z0-9]+(?:[-_'][a-z0-9]+)*")
METRICS = ("cosine", "l2", "dot")
#: Queries that meet all vectors at once, and vectors that meet them in one step; more are taken in blocks.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 2048
#: Texts that are read at a time; features, and rows of features, that a task holds; the frequent features whose idf every task knows.
TEXTS, HELD, FREQUENT = 64, 100_000, 100_000


def features(text: str, char_ngrams: int = 4) -> list[str]:
    low = text.lower()
    out = _TOKEN.findall(low)
    if char_ngrams > 0:
        clean = re.sub(r"\s+", " ", low)
        out += [clean[i : i + char_ngrams] for i in range(len(clean) - char_ngrams + 1)]
    return out


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A few rows at a time, and their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            yield some, [t or "" for t in some.column(column).to_pylist()]


def bucket(feature: str, dim: int, seed: int) -> tuple[int, float]:
    """Coordinate and sign of a feature, the same in every process."""
    value = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8, key=str(seed).encode()).digest(), "little")
    return value % dim, 1.0 if value >> 63 else -1.0


class HashingEmbedder:
    """Signed feature hashing with (1 + ln tf) weights, optional idf and unit length."""

    def __init__(self, dim: int = 384, seed: int = 0, char_ngrams: int = 4, idf: DataFrame | None = None):
        if dim <= 0 or char_ngrams < 0:
            raise ValueError("dim must be positive and char_ngrams not negative")
        self.dim, self.seed, self.char_ngrams, self.idf = dim, seed, char_ngrams, idf
        self._kept: tuple[DataFrame, dict[str, float]] | None = None

    @property
    def name(self) -> str:
        return f"hashing-{self.dim}d"

    def fit_idf(self, texts: DataFrame) -> HashingEmbedder:
        """A new embedder with idf = ln(1 + n / (1 + df)) over texts(text), kept as a table."""
        gram = self.char_ngrams

        def rows(df: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["feature", "df"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df: Counter[str] = Counter()
            for _, some in _texts(batches, 0):
                for t in some:
                    df.update(set(features(t, gram)))
                    if len(df) > HELD:
                        yield rows(df)
                        df.clear()
            yield rows(df)

        n = texts.count()
        counts = texts.select("text").mapInArrow(run, "feature string, df long").groupBy("feature").agg(F.sum("df").alias("df"))
        return HashingEmbedder(self.dim, self.seed, gram, counts.select("feature", F.log(1 + F.lit(float(n)) / (1 + F.col("df"))).alias("idf")))

    def _known(self) -> tuple[DataFrame, dict[str, float]]:
        """The idf table, written once, and its entries for the most frequent features."""
        if self._kept is None:
            idf = staged(self.idf, "idf")
            top = idf.orderBy("idf", "feature").limit(FREQUENT).toArrow()
            self._kept = idf, dict(zip(top["feature"].to_pylist(), top["idf"].to_pylist(), strict=True))
        return self._kept

    def embed(self, texts: DataFrame, id_column: str) -> DataFrame:
        """id, embedding of every row of texts(id, text).  Ids must be unique.

        Most occurrences are of few features, whose idf every task knows; only
        those of the others are shuffled to the idf table, and come back to their
        text as sums by coordinate.
        """
        dim, seed, gram, kind = self.dim, self.seed, self.char_ngrams, dict(texts.dtypes)[id_column]
        given, known = texts.select(id_column, "text"), {}
        if self.idf is not None:
            idf, known = self._known()

            def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for some, read in _texts(batches, 1):
                    rows, names, at, weights = [], [], [], []

                    def part(some=some, rows=rows, names=names, at=at, weights=weights) -> pa.RecordBatch:
                        out = pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(weights, pa.float64())], [id_column, "feature", "at", "weight"])
                        for x in (rows, names, at, weights):
                            x.clear()
                        return out

                    for i, t in enumerate(read):
                        counts = Counter(features(t, gram))
                        for f in (f for f in counts if f not in known):
                            index, sign = bucket(f, dim, seed)
                            rows.append(i)
                            names.append(f)
                            at.append(index)
                            weights.append(sign * (1 + math.log(counts[f])))
                        if len(rows) > HELD:
                            yield part()
                    yield part()

            parts = given.mapInArrow(rare, f"{id_column} {kind}, feature string, at int, weight double").join(idf, "feature", "left")
            # The work after the join is Python's, so it is dealt out by number: by bytes it would be few tasks.  The sums are dealt out alike, once.
            tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            weighed = parts.select(id_column, "at", (F.col("weight") * F.coalesce("idf", F.lit(1.0))).alias("weight")).repartition(tasks, id_column)
            sums = weighed.groupBy(id_column, "at").agg(F.sum("weight").alias("weight"))
            sums = sums.groupBy(id_column).agg(F.collect_list(F.struct("at", "weight")).alias("s"))
            given = given.repartition(tasks, id_column).join(sums, id_column, "left").select(id_column, "text", F.col("s.at").alias("at"), F.col("s.weight").alias("weight"))
        weighted = self.idf is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, tuple[int, float]] = {}
            for some, read in _texts(batches, 1):
                v = np.zeros((len(read), dim))
                for i, t in enumerate(read):
                    at, weights = [], []
                    for f, tf in Counter(features(t, gram)).items():
                        if weighted and f not in known:
                            continue
                        if f not in cache:
                            if len(cache) > 2 * FREQUENT:
                                cache.clear()
                            index, sign = bucket(f, dim, seed)
                            cache[f] = index, sign * known.get(f, 1.0)
                        index, weight = cache[f]
                        at.append(index)
                        weights.append(weight * (1 + math.log(tf)))
                    if at:
                        v[i] = np.bincount(at, weights, dim)
                    if weighted and some.column(2)[i].is_valid:
                        v[i] += np.bincount(some.column(2)[i].as_py(), some.column(3)[i].as_py(), dim)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = (v / np.where(n == 0, 1, n)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(range(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel()))], [id_column, "embedding"])

        return given.mapInArrow(run, f"{id_column} {kind}, embedding array<float>")


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T))
    if metric == "cosine":
        unit = lambda a: a / np.where((n := np.linalg.norm(a, axis=1, keepdims=True)) == 0, 1, n)
        q, x = unit(q), unit(x)
    return q @ x.T


def _best(s: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each row of scores with their ids, ties by id."""
    if s.shape[1] > k:
        row, at = np.nonzero(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])  # the k-th best and its ties
        order = np.lexsort((v[row, at], -s[row, at], row))
        begin = np.searchsorted(row, np.arange(len(s)))  # row is ascending, before and after
        order = order[(begin[:, None] + np.arange(k)).ravel()]
        s, v = s[row[order], at[order]].reshape(-1, k), v[row[order], at[order]].reshape(-1, k)
    return s, v


def _sides(planes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(rows, tables): the bucket of every row in every table."""
    tables, bits, dim = planes.shape
    return ((x @ planes.reshape(-1, dim).T).reshape(len(x), tables, bits) > 0) @ (1 << np.arange(bits))


def _scan(queries: DataFrame, vectors: DataFrame, k: int, metric: str, planes: np.ndarray | None = None) -> DataFrame:
    """The best k of all vectors for every query, or of those that share a bucket of the planes with it.

    The stated query set (query_id, embedding) goes out in blocks of bounded
    size; each partition of vectors keeps its best k for each query, so what is
    shuffled is k rows for each query and partition.  No pairs are made.
    """
    if metric not in METRICS or k <= 0:
        raise ValueError(f"metric must be one of {METRICS} and k positive")
    kind = dict(vectors.dtypes)["vec_id"]
    qkind = dict(queries.dtypes)["query_id"]
    vectors = vectors.filter("embedding is not null")
    rows, out = queries.filter("embedding is not null").select("query_id", "embedding").toLocalIterator(), None
    while True:
        block = list(itertools.islice(rows, QUERY_BLOCK))
        if not block and out is not None:
            return out
        ids, q = [r.query_id for r in block], np.array([r.embedding for r in block], float)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best: tuple[np.ndarray, np.ndarray] | None = None
            mine = _sides(planes, q) if planes is not None and len(ids) else None
            for batch in (b.slice(at, VECTOR_BLOCK) for b in batches for at in range(0, b.num_rows, VECTOR_BLOCK)):
                if not len(ids):
                    continue
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors have {x.shape[1]} dimensions, queries {q.shape[1]}")
                s = np.round(_scores(q, x, metric), 9)
                s[np.isnan(s)] = -np.inf  # behind all others
                v = np.broadcast_to(batch.column(0).to_numpy(zero_copy_only=False), (len(ids), batch.num_rows))
                if mine is not None:
                    met = np.zeros(s.shape, bool)
                    for own, theirs in zip(mine.T, _sides(planes, x).T, strict=True):
                        met |= own[:, None] == theirs[None, :]
                    s[~met] = -np.inf
                if best:
                    s, v = np.hstack([best[0], s]), np.hstack([best[1], v])
                best = _best(s, v, k)
            if best:
                s, v = best
                own, at = np.nonzero((s > -np.inf) | (mine is None))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own]), pa.array(own), pa.array(v[own, at].tolist()), pa.array(s[own, at])], ["query_id", "row", "vec_id", "score"])

        local = vectors.select("vec_id", "embedding").mapInArrow(run, f"query_id {qkind}, row long, vec_id {kind}, score double")
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        top = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = top if out is None else out.unionByName(top)
        if len(block) < QUERY_BLOCK:
            return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, rank, vec_id, score: exact neighbours, larger scores nearer, to nine decimals; ties by id.

    Every row of queries is answered, also where ids repeat or are null; null
    embeddings are left out.
    """
    return _scan(queries, vectors, k, metric)


def nearest_lsh(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 24, bits: int = 4, seed: int = 42) -> DataFrame:
    """Approximate cosine neighbours: random-hyperplane buckets name candidates, which are scored exactly.

    The defaults find 0.97 of the ten nearest of vectors without any structure,
    with three quarters of them as candidates; fewer tables or more bits name
    less and find less.
    """
    first = vectors.filter("embedding is not null").select("embedding").first()
    planes = np.random.RandomState(seed).randn(tables, bits, len(first.embedding) if first else 1)
    return _scan(queries, vectors, k, "cosine", planes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall of found against exact neighbours."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
