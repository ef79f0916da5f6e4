"""MinHash near-dedup with sequential Bayesian verification.

1. Documents become sets of hashed word shingles.  Equal sets form one node of
   the graph, so exact copies cost one row each and no pairs.
2. 128 minimum hashes in 32 bands of 4 name candidate buckets; a pair at the
   threshold misses all buckets with probability 5e-8.
3. Candidates are compared batch by batch of their signatures.  With m values
   compared and k equal, the posterior of the similarity is Beta(1 + k, 1 + m - k);
   a pair goes once its chance of reaching the threshold is under `miss`.
4. Survivors are verified on full shingle sets, made anew from their texts and
   compared word by word, not by hashes.  Texts are what travels: they compress,
   and hashes of their shingles do not.
5. Each node first meets one bucket leader, that it shares most bands with.  A
   bucket is led by the member with the most company over all its buckets.
   After that only members of different components are compared, in blocks of
   bounded size: one pass over signatures names the members with a possible
   partner, and only these bring their texts to a second pass, which gives back
   at most a spanning tree of links.  So no pairs of a large group are listed
   and no link between components is lost.

Defined cases: null and word-free texts are linked with nothing and keep their
own id; texts under n words are one shingle; equal rows are copies; a null
doc_id never names a component that has another id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, staged, table, text_key

BANDS, BAND_ROWS = 32, 4
BATCH = 32
#: Members of a bucket that meet in one place; larger buckets are cut into blocks.
BLOCK = 512
SHARD_ROWS = 4000
PERMUTATIONS = BANDS * BAND_ROWS
_RNG = np.random.RandomState(20240229)
_FLIP = _RNG.randint(0, 1 << 32, size=(PERMUTATIONS, 1), dtype=np.uint32)
_ODD = _RNG.randint(0, 1 << 32, size=(PERMUTATIONS, 1), dtype=np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row, A-Z lower-cased."""
    for rows in K.slices(column):
        rows.data = K.lower_ascii(rows.data)
        words = K.find_words(rows)
        wh = K.span_hashes(rows.data, words.starts, words.ends)
        grams = K.gram_hashes(wh, n)
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield K.gram_hashes(wh[lo:hi], hi - lo)
            else:
                yield np.empty(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def exact_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """For every row the sorted distinct numbers of its shingles: equal in any two rows if and only if the words are."""
    out: list[np.ndarray] = []
    whole: dict[tuple, int] = {}  # sequences under n words get numbers below zero
    for rows in K.slices(column, 1 << 62):
        rows.data = K.lower_ascii(rows.data)
        words = K.find_words(rows)
        codes = K.span_codes(rows.data, words.starts, words.ends)
        grams = K.gram_codes(codes, n)
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if hi - lo >= n:
                out.append(np.unique(grams[lo : hi - n + 1]))
            else:
                out.append(np.array([whole.setdefault(tuple(codes[lo:hi].tolist()), -1 - len(whole))] if hi > lo else [], np.int64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low halves of 128 minimum 32-bit hashes; unequal minima agree there once in 65,536."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        h = (low[None, at : at + 1024] ^ _FLIP) * _ODD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(best, h.min(axis=1), out=best)
    return best.astype(np.uint16)


def posterior_floors(threshold: float, miss: float) -> list[int]:
    """For m = BATCH, 2 BATCH, ...: the fewest equal values with P(similarity >= threshold) >= miss."""

    def reaches(k: int, m: int) -> float:  # P(Beta(1 + k, 1 + m - k) >= t) = P(Binomial(m + 1, t) <= k)
        return sum(math.comb(m + 1, i) * threshold**i * (1 - threshold) ** (m + 1 - i) for i in range(k + 1))

    return [next(k for k in range(m + 1) if reaches(k, m) >= miss or k == m) for m in range(BATCH, PERMUTATIONS + 1, BATCH)]


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sizes, keys, signs = [], [], []
                for s in shingle_sets(part.column(1), n):
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    signs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "key", "sign"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 rows of each node; the lowest five bits of a band are its number."""
    slot = np.arange(BANDS, dtype=np.uint64)[None, :]
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            part = batch.slice(lo, 4000)
            rows = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
            h = K.mix(rows ^ K.mix(slot + np.uint64(1))) & ~np.uint64(BANDS - 1) | slot
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["band", "node"])


def _prune(floors: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS) for i in (2, 3))
                alive, equal = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                for step, floor in enumerate(floors):
                    cut = slice(step * BATCH, (step + 1) * BATCH)
                    equal[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
                    alive = alive[equal[alive] >= floor]
                take = pa.array(alive)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take)], ["a", "b"])

    return run


def _verify(n: int, percent: int):
    """The pairs (a, b, x, y) whose texts x and y are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(sum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False) for i in (2, 3)))
            starts = np.unique(np.searchsorted(size, np.arange(0, size[-1] + 1, K.SLICE), side="left")) if len(size) else []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                sets = exact_sets(pa.concat_arrays([part.column(2), part.column(3)]), n)
                good = []
                for x, y in zip(sets[: len(part)], sets[len(part) :], strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def _agreeing(signs: np.ndarray, one: np.ndarray, among: np.ndarray, floors: list[int]) -> np.ndarray:
    """Those of `among` (indices) that stay possible partners of signature `one`, batch by batch."""
    equal = np.zeros(len(among), np.int64)
    for step, floor in enumerate(floors):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        equal += (signs[among, cut] == one[cut]).sum(axis=1)
        good = equal >= floor
        among, equal = among[good], equal[good]
    return among


def _candidates(rows: pa.Table, floors: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): members of other components in query i's block that may be linked with it; a pair comes in the first band that it shares."""
    block = np.stack([rows[c].to_numpy() for c in ("band", "q", "m")])
    starts = np.flatnonzero(np.r_[True, (block[:, 1:] != block[:, :-1]).any(axis=0)]) if rows.num_rows else np.empty(0, int)
    node, root, slot = rows["node"].to_numpy(), rows["root"].to_numpy(), rows["band"].to_numpy() & (BANDS - 1)
    query, member = (rows[c].to_numpy(zero_copy_only=False) for c in ("query", "member"))
    signs = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
    bands = signs.view("<u8")
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
        members = lo + np.flatnonzero(member[lo:hi])
        for i in (lo + np.flatnonzero(query[lo:hi])).tolist():
            # Of two queries in one block, the one with the larger node looks at the other.
            rest = members[(root[members] != root[i]) & (~query[members] | (node[members] < node[i]))]
            rest = _agreeing(signs, signs[i], rest, floors)
            if len(rest):
                rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == slot[i]]
            if len(rest):
                yield i, rest


_BLOCK_ORDER = [("band", "ascending"), ("q", "ascending"), ("m", "ascending"), ("node", "ascending")]
_BLOCK = ["band", "node", "root", "q", "m", "query", "member"]
_BLOCK_SCHEMA = "band long, node long, root long, q long, m long, query boolean, member boolean"


def _promising(floors: list[int]):
    """The rows of a shard that have a possible partner in their block."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(_BLOCK_ORDER).combine_chunks()
        marked = np.zeros(rows.num_rows, bool)
        for i, rest in _candidates(rows, floors):
            marked[i] = True
            marked[rest] = True
        return rows.filter(pa.array(marked)).select(_BLOCK)

    return run


def _compare(floors: list[int], n: int, percent: int):
    """Links between components inside the blocks of a shard."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(_BLOCK_ORDER).combine_chunks()
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        _, first, own = np.unique(node, return_index=True, return_inverse=True)
        sets = exact_sets(rows["text"].combine_chunks().take(pa.array(first)), n)
        above: dict[int, int] = {}

        def find(r: int) -> int:
            while r in above:
                r = above[r]
            return r

        out: list[tuple[int, int]] = []
        for i, rest in _candidates(rows, floors):
            x = sets[own[i]]
            for j in rest.tolist():
                a, b = find(int(root[i])), find(int(root[j]))
                y = sets[own[j]]
                if a == b or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    above[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b), a staged table: alternating large-star and small-star steps until nothing moves.

    Each step is a partial aggregate and a join, staged in the shared folder; no component is gathered in one task.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    def least_neighbour(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", edges.count())
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
        large = both.join(least_neighbour(both), "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = staged(large, "large", before[0])
        least = least_neighbour(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.toDF("a", "b")).distinct()
        edges = staged(small, "edges", before[0])
        now = state(edges)
        if now == before:
            return edges.toDF("node", "root")
        before = now


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text); see `grouped`."""
    return grouped(docs, n, percent, miss).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, text_key, n_shingles, root, component_id, kept for every row of docs(doc_id, text).

    root numbers the component, also where ids are null or name several texts;
    it is null for texts without words, which are in none.  Links sets with 100 * intersection >= percent * union; miss: the chance at
    which the posterior bound may drop a pair that holds.
    """
    kind = dict(docs.dtypes)["doc_id"]
    floors = posterior_floors(percent / 100, miss)
    keyed = small_batches(docs).select("doc_id", "text", text_key(F.col("text")))
    signed = staged(keyed.mapInArrow(_sign(n), f"doc_id {kind}, text_key binary, n_shingles long, key binary, sign binary"), "signed")
    # Numbers given once, in a written table, stay what they are.
    nodes = staged(
        signed.filter("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("sign").alias("sign"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
        signed.count(),
    )
    n_nodes = nodes.count()
    signs = nodes.select("node", "sign")
    members = signs.mapInArrow(_bands, "band long, node long")
    shared = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(members.join(shared, "band"), "members", 4 * n_nodes)
    n_members = members.count()
    # A bucket is led by its most central member: the one with the most company over all its buckets.
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    central = members.join(company, "node").groupBy("band").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("leader"))
    led = members.select("band", "node").join(central, "band")

    # A node meets the leader that it shares most bands with.
    counted = led.filter("node <> leader").repartition("node").groupBy("node", "leader").agg(F.count("*").alias("n"))
    pairs = counted.groupBy(F.col("node").alias("b")).agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a"))
    survivors = pairs.join(signs.toDF("b", "y"), "b").join(signs.toDF("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(_prune(floors), "a long, b long")
    involved = members.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    texts = staged(keyed.groupBy("text_key").agg(F.first("text").alias("text")).join(involved, "text_key").select("node", "text"), "texts", n_nodes)
    compared = survivors.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = staged(small_batches(compared).mapInArrow(_verify(n, percent), "a long, b long"), "links")

    # In buckets that hold several components, members outside the largest meet all others, in blocks.
    rooted = staged(_rooted(members.select("band", "node"), components(links)), "rooted", n_members)
    by_root = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = (
        by_root.groupBy("band")
        .agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
        .filter("roots > 1")
        .withColumn("nq", F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil((F.col("n") - F.col("top.n")) / (BLOCK // 2))))
        .withColumn("nm", F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK)))
        .select("band", F.col("top.root").alias("top"), "nq", "nm")
    )
    open_ = rooted.join(mixed, "band").withColumn("outside", F.col("root") != F.col("top"))
    single = F.col("nq") * F.col("nm") == 1
    numbers = lambda count: F.sequence(F.lit(0).cast("long"), count - F.lit(1).cast("long"))
    cell = lambda q, m, query, member: F.struct(q.cast("long").alias("q"), m.cast("long").alias("m"), query.alias("query"), member.alias("member"))
    own_q, own_m = F.pmod(F.xxhash64("node"), F.col("nq")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("nm"))
    as_query = F.when(F.col("outside"), F.transform(numbers(F.col("nm")), lambda m: cell(own_q, m, F.lit(True), F.lit(False)))).otherwise(F.array())
    as_member = F.transform(numbers(F.col("nq")), lambda q: cell(q, own_m, F.lit(False), F.lit(True)))
    cells = F.when(single, F.array(cell(F.lit(0), F.lit(0), F.col("outside"), F.lit(True)))).otherwise(F.concat(as_query, as_member))
    blocks = staged(open_.select("band", "node", "root", F.explode(cells).alias("cell")).select("band", "node", "root", "cell.*"), "blocks", n_members)

    def dealt(rows: DataFrame):
        shards = max(1, -(-rows.count() // SHARD_ROWS))
        return rows.join(signs, "node").withColumn("shard", F.pmod(F.xxhash64("band", "q", "m"), F.lit(shards)))

    promising = staged(dealt(blocks).groupBy("shard").applyInArrow(_promising(floors), _BLOCK_SCHEMA), "promising")
    more = dealt(promising).join(texts, "node").groupBy("shard").applyInArrow(_compare(floors, n, percent), "a long, b long")
    roots = components(links.union(staged(more, "more")))

    owner = _rooted(nodes.select("node", "key", "first_id"), roots)
    named = owner.join(owner.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("key", "root", "component_id")
    out = signed.select("doc_id", "text_key", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", "root", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; shingles of 4 words, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=4)


def brute_force(rows: list[tuple[int, str | None]], n: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) over all pairs; for tests."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
