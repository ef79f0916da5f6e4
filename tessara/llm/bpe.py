"""Byte-level BPE by DuckDB queries inside each partition.

The distinct words of a slice of texts go through one recursive query: their
tokens are unnested to (word, position) rows, neighbours join the merge table,
and each word's leftmost pair of minimum rank is contracted until no pair
merges.  Words stay cached between slices, in bounded number.  Decoding joins
(document, position, id) rows to the vocabulary and aggregates the bytes in
order.

Long words save steps by contracting many pairs at once.  A pair may go ahead of
its turn if its rank is the least among all pairs as near as the longest token
of that rank or less could reach, and if its token makes no pair of a smaller
rank with its neighbours or itself: contracting one by one, nothing could take
a part of it before its turn, nor would anything done before its turn see it.  Pairs of its rank to its left
go before it, so these must make no pair of a smaller rank either.  Of overlapping pairs of one
rank every other goes, from the left.  The leftmost minimum of the whole word
always goes.

Defined cases: null text is empty and has no tokens; special tokens are
ordinary text; repeated rows stay; ids that the vocabulary lacks raise
ValueError in decoding; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct words that a worker remembers; beyond it starts over.
CACHE_WORDS = 400_000
SLICE_BYTES = 1 << 20
#: Long words are encoded in queries of their own, so that they alone repeat many steps.
LONG_WORD = 64

#: The leftmost minimum of each word is the minimum of (rank, position), packed into one number.
_ENCODE = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM fresh
  UNION ALL
  (WITH pairs AS (SELECT word, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS next, generate_subscripts(toks[2:], 1) AS pos FROM state),
  best AS (SELECT word, min(m.rank << 16 | pos) AS b FROM pairs p JOIN merges m ON m.pair = (p.tok << 32 | p.next) GROUP BY word)
  SELECT s.word, s.toks[:(b & 65535) - 1] || [b >> 16] || s.toks[(b & 65535) + 2:] FROM state s JOIN best ON best.word = s.word)
)
SELECT word, toks FROM state
"""
_ENCODE_LONG = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM fresh
  UNION ALL
  (WITH rows AS (SELECT word, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM state),
  pairs AS (SELECT word, pos, tok, lag(tok) OVER place AS left, lead(tok) OVER place AS next, lead(tok, 2) OVER place AS right FROM rows WINDOW place AS (PARTITION BY word ORDER BY pos)),
  ranked AS (SELECT p.*, coalesce(m.rank, 4294967295) AS rank, coalesce(r.reach, 0) + 1 AS reach,
    m.calm AND coalesce(x.rank > m.rank, TRUE) AND coalesce(y.rank > m.rank, TRUE) AS free
    FROM pairs p LEFT JOIN merges m ON m.pair = (p.tok << 32 | p.next) LEFT JOIN reaches r ON r.rank = m.rank
    LEFT JOIN merges x ON x.pair = (p.left << 32 | m.rank) LEFT JOIN merges y ON y.pair = (m.rank << 32 | p.right)),
  near AS (SELECT *, min(rank) OVER (PARTITION BY word) AS best, lag(rank) OVER (PARTITION BY word ORDER BY pos) AS before,
    coalesce(free, FALSE) AND rank = min(rank) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN reach PRECEDING AND reach FOLLOWING)
      AND rank < coalesce(min(CASE WHEN NOT free THEN rank END) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN reach PRECEDING AND 1 PRECEDING), 4294967296) AS hit FROM ranked),
  runs AS (SELECT *, pos - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS run, min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY word) AS leftmost FROM near WHERE best < 4294967295),
  marked AS (SELECT *, pos = leftmost OR (hit AND first_value(before IS DISTINCT FROM rank) OVER same AND (row_number() OVER same) % 2 = 1) AS merge FROM runs
    WINDOW same AS (PARTITION BY word, hit, run ORDER BY pos)),
  folded AS (SELECT word, pos, CASE WHEN merge THEN rank ELSE tok END AS tok, coalesce(lag(merge) OVER (PARTITION BY word ORDER BY pos), FALSE) AS gone FROM marked)
  SELECT word, list(tok ORDER BY pos) FROM folded WHERE NOT gone GROUP BY word)
)
SELECT word, toks FROM state
"""
_DECODE = "SELECT doc, string_agg(v.hex, '' ORDER BY pos) AS hex, count(*) AS n, count(v.hex) AS known FROM tokens t LEFT JOIN vocabulary v ON t.id = v.id GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base-64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes slices of texts; one per worker process and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        self.pattern, self.cache_words = regex.compile(pattern), cache_words
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        a, b, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                x, y = ranks.get(token[:cut]), ranks.get(token[cut:])
                if x is not None and y is not None:
                    a.append(x)
                    b.append(y)
                    rank.append(r)
        twins = {x: r for x, y, r in zip(a, b, rank, strict=True) if x == y}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "preserve_insertion_order": False})
        merges = pa.table({"pair": np.array(a, np.int64) << 32 | np.array(b, np.int64), "rank": rank, "calm": [twins.get(r, r + 1) > r for r in rank]})
        vocabulary = pa.table({"id": list(ranks.values()), "hex": [t.hex() for t in ranks]})
        by_rank = sorted((r, t) for t, r in ranks.items())
        self.ranks, self.lengths = np.array([r for r, _ in by_rank], np.int64), np.array([len(t) for _, t in by_rank], np.int64)
        self.used = np.zeros((len(by_rank), 4), np.uint64)  # the bytes of each token, as a set of 256 bits
        for i, (_, t) in enumerate(by_rank):
            bits = sum(1 << x for x in set(t))
            self.used[i] = [bits >> 64 * k & (1 << 64) - 1 for k in range(4)]
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.given: set[str] = set()
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _learn(self, fresh: list[str]) -> None:
        coded = [w.encode() for w in fresh]
        found: list[np.ndarray | None] = [None] * len(coded)
        short = [i for i, w in enumerate(coded) if len(w) <= LONG_WORD]
        long = [[i] for i, w in enumerate(coded) if len(w) > LONG_WORD]
        for group, sql in ((short, _ENCODE), *((g, _ENCODE_LONG) for g in long)):
            if group:
                data = np.frombuffer(b"".join([coded[i] for i in group]), np.uint8)
                offsets = np.r_[0, np.cumsum([len(coded[i]) for i in group])]
                if sql is _ENCODE_LONG:
                    self._reach(coded[group[0]])
                toks = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(self.byte_ids[data]))
                out = self._query(sql, "fresh", pa.table({"word": pa.array(group, pa.int64()), "toks": toks}))
                at = out["word"].to_numpy()
                lists = out["toks"].combine_chunks()
                ends, values = np.asarray(lists.offsets), lists.values.to_numpy()
                for k, i in enumerate(at.tolist()):
                    found[i] = values[ends[k] : ends[k + 1]]
        base = len(self.words)
        for i, w in enumerate(fresh):
            self.words[w] = base + i
        self.flat = np.concatenate([self.flat, *found]).astype(np.uint32)
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum([len(x) for x in found])]

    def _reach(self, word: bytes) -> None:
        """Tell queries the longest token up to each rank that the bytes of word could make."""
        bits = sum(1 << x for x in set(word))
        other = np.array([~(bits >> 64 * k) & (1 << 64) - 1 for k in range(4)], np.uint64)
        longest = np.maximum.accumulate(np.where((self.used & other).any(axis=1), 0, self.lengths))
        if "reaches" in self.given:
            self.db.unregister("reaches")
        self.db.register("reaches", pa.table({"rank": self.ranks, "reach": longest}))
        self.given.add("reaches")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (and the last end)."""
        if len(self.words) > self.cache_words:
            self._forget()
        pieces, counts = [], []
        for t in texts:
            found = self.pattern.findall(t)
            pieces += found
            counts.append(len(found))
        fresh = list(dict.fromkeys([p for p in pieces if p not in self.words]))
        if fresh:
            self._learn(fresh)
        words = self.words
        at = np.fromiter([words[p] for p in pieces], np.int64, len(pieces))
        size = np.diff(self.starts)[at]
        ends = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.r_[0, np.cumsum(counts, dtype=np.int64)].astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each run ids[offsets[i]:offsets[i + 1]]."""
        n = len(offsets) - 1
        rows = pa.table({"doc": np.repeat(np.arange(n), np.diff(offsets)), "pos": np.arange(len(ids)), "id": ids.astype(np.int64)})
        out: list[bytes] = [b""] * n
        for r in self._query(_DECODE, "tokens", rows).to_pylist():
            if r["n"] != r["known"]:
                raise ValueError("an id is not in the vocabulary")
            out[r["doc"]] = bytes.fromhex(r["hex"])
        return out


_CODECS: dict[tuple, Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, pattern)
    return _CODECS[key]


def _vocabulary(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:  # on the driver; under a megabyte goes out with the tasks
        return f.read(), pattern


def _encode(ranks: bytes, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for rows in K.slices(batch.column(0), SLICE_BYTES):
                blob, cut = rows.data.tobytes(), rows.offsets.tolist()
                ids, at = codec.encode([blob[a:b].decode() for a, b in zip(cut, cut[1:], strict=False)])
                rest = batch.slice(rows.first, len(rows)).columns[1:]
                if decoded:
                    data, cut = ids.astype("<u4").tobytes(), (at * 4).tolist()
                    made = [pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]), pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(ids, at)])]
                else:
                    made = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))]
                names = ["ids_sha256", "decoded_sha256"] if decoded else ["ids"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(at)), *made], [*batch.schema.names[1:], "n_tokens", *names])
        K.give_back()

    return run


def _decode(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids = part.column(0).fill_null([]) if part.column(0).null_count else part.column(0)
                offsets = ids.offsets.to_numpy()
                out = codec.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.binary())], [*part.schema.names[1:], "decoded"])

    return run


def encode(docs: DataFrame, carry: list[str] = ["doc_id"], path: str | None = None, pattern: str | None = None) -> DataFrame:  # noqa: B006
    """The columns in carry, n_tokens and ids of every document."""
    schema = docs.select(*carry).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return small_batches(docs).select(F.col("text").alias("__text"), *carry).mapInArrow(_encode(*_vocabulary(path, pattern), False), schema)


def decode(encoded: DataFrame, carry: list[str] = ["doc_id"], path: str | None = None, pattern: str | None = None) -> DataFrame:  # noqa: B006
    """The columns in carry and decoded: the bytes of ids."""
    schema = encoded.select(*carry).schema.add("decoded", "binary")
    return small_batches(encoded).select(F.col("ids").alias("__ids"), *carry).mapInArrow(_decode(*_vocabulary(path, pattern)), schema)


def round_trip(docs: DataFrame, carry: list[str] = ["doc_id"], path: str | None = None, pattern: str | None = None) -> DataFrame:  # noqa: B006
    """The columns in carry, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    schema = docs.select(*carry).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return small_batches(docs).select(F.col("text").alias("__text"), *carry).mapInArrow(_encode(*_vocabulary(path, pattern), True), schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(table(spark, sf_dir, "documents"))
