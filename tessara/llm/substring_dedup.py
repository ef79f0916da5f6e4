"""Substring dedup with repeated-phrase automata.

1. Texts.  Equal texts become one row with their number, in a table bucketed by
   text, so that what is found about a text later meets it without moving it.
2. Census.  Each 35-word window elects as anchor its smallest 9-word gram (by
   hash).  Equal windows elect equal anchors, so a recurring window has a
   recurring anchor; anchors are about a fourteenth as many as windows.
3. Segments.  Texts that hold recurring anchors are cut into runs of windows
   with one anchor (at most 27 windows, 61 words each), dealt to shards of
   bounded size by anchor; a frequent anchor is salted over many shards.
4. Confirmation.  A shard counts its windows word by word.  Only windows of
   salted anchors are counted across shards, by 128-bit hashes.  Of each window
   found twice or more the first place is kept; neighbouring places make
   passages, written as a table.
5. Automata.  A shard compiles the windows of its passages into an Aho-Corasick
   automaton over its words and streams all its segments through it.  Windows
   are not looked up again: what the automaton does not report stays.
6. The located spans are gathered per text and cut from every document.

A segment that holds no recurring anchor holds no passage; all others of all
documents are streamed, each through the one automaton that has its passages.

Defined cases: null text counts as no words; equal texts (repeated rows
included) are occurrences of each other; documents keep their row, null
doc_ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bucketed, small_batches, staged, table, text_key

WINDOW = 35
#: Segments that one automaton shard should hold; a more frequent anchor is split.
SHARD_ROWS = 2000


def _gram(window: int) -> int:
    return window // 4 + 1


def _anchors(wh: np.ndarray, words: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes; each window's anchor (0 where the window crosses rows); which windows are valid."""
    gram = _gram(window)
    grams = K.gram_hashes(wh, gram)
    valid = K.gram_valid(words, window)
    if not len(valid):
        return grams, np.empty(0, np.uint64), valid
    return grams, np.where(valid, K.sliding_min(grams, window - gram + 1), 0), valid


def _census(window: int):
    span = window - _gram(window) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.slices(batch.column(0)):
                words = K.find_words(rows)
                wh = K.span_hashes(rows.data, words.starts, words.ends)
                grams, anchor, valid = _anchors(wh, words, window)
                if not valid.any():
                    continue
                pad = np.zeros(span - 1, np.uint64)
                best = ~K.sliding_min(~np.concatenate([pad, anchor, pad]), span)
                at = np.flatnonzero(best == grams)
                row = words.row_of()[at]
                pairs = np.stack([row.astype(np.uint64), grams[at]])
                order = np.lexsort(pairs[::-1])
                pairs = pairs[:, order]
                new = np.flatnonzero(np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])
                keys = batch.column(1).take(pa.array(pairs[0][new].astype(np.int64) + rows.first))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(pairs[1][new].view(np.int64)), pa.array(np.diff(np.r_[new, len(order)])), batch.column(2).take(pa.array(pairs[0][new].astype(np.int64) + rows.first))],
                    ["text_key", "anchor", "n", "copies"],
                )

    return run


def _segments(window: int):
    span = window - _gram(window) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(3)
            known_offsets = known.offsets.to_numpy()
            fields = known.values.flatten()
            known_anchor, known_salts = fields[0].to_numpy(), fields[1].to_numpy()
            for rows in K.slices(batch.column(1)):
                words = K.find_words(rows)
                wh = K.span_hashes(rows.data, words.starts, words.ends)
                _, anchor, valid = _anchors(wh, words, window)
                out: dict[str, list] = {k: [] for k in ("row", "anchor", "salts", "start", "text")}
                blob = rows.data.tobytes()
                for i in range(len(rows)):
                    lo, hi = int(words.first[i]), int(words.first[i + 1]) - window + 1
                    if hi <= lo:
                        continue
                    r = rows.first + i
                    have = known_anchor[known_offsets[r] : known_offsets[r + 1]].view(np.uint64)
                    own = anchor[lo:hi]
                    order = np.argsort(have)
                    at = np.searchsorted(have, own, sorter=order)
                    at = order[np.minimum(at, len(have) - 1)]
                    hit = have[at] == own
                    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    ends = np.r_[begins[1:], len(own)]
                    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                        if hit[b]:
                            for s in range(b, e, span):
                                last = min(s + span, e) - 1 + window - 1
                                out["row"].append(r)
                                out["anchor"].append(int(own[b].view(np.int64)))
                                out["salts"].append(int(known_salts[known_offsets[r] + at[b]]))
                                out["start"].append(s)
                                out["text"].append(blob[words.starts[lo + s] : words.ends[lo + last]])
                if out["row"]:
                    take = pa.array(out["row"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(2).take(take), pa.array(out["anchor"], pa.int64()), pa.array(out["salts"], pa.int32()), pa.array(out["start"], pa.int32()), pa.array(out["text"], pa.binary()).cast(pa.string())],
                        ["text_key", "copies", "anchor", "salts", "start", "segment"],
                    )

    return run


def _confirm(window: int):
    """Distinct windows of a slice as two 64-bit hashes, with their anchor and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, salts, copies = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for rows in K.slices(batch.column(3)):
                words = K.find_words(rows)
                both = _window_hashes(rows, words, window)
                at = np.flatnonzero(K.gram_valid(words, window))
                row = words.row_of()[at] + rows.first
                both = both[at]
                order = np.lexsort((both["b"], both["a"]))
                both, row = both[order], row[order]
                new = np.flatnonzero(np.r_[True, (both["a"][1:] != both["a"][:-1]) | (both["b"][1:] != both["b"][:-1])])
                total = np.add.reduceat(copies[row], new) if len(new) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor[row[new]], salts[row[new]], np.ascontiguousarray(both["a"][new]), np.ascontiguousarray(both["b"][new]), total)],
                    ["anchor", "salts", "a", "b", "n"],
                )

    return run


def _window_hashes(rows: K.Rows, words: K.Words, window: int) -> np.ndarray:
    lanes = K.span_hashes(rows.data, words.starts, words.ends, lanes=2)
    out = np.empty(max(0, len(words.starts) - window + 1), dtype=[("a", np.int64), ("b", np.int64)])
    for name, lane in zip(("a", "b"), lanes, strict=True):
        out[name] = K.gram_hashes(lane, window).view(np.int64)
    return out


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _passages(window: int):
    """anchor, salts, passage: runs of the first places of a shard's windows that recur."""

    def run(segments: pa.Table, confirmed: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "salts": [], "passage": []}
        anchor, salts, copies = (segments[c].to_numpy() for c in ("anchor", "salts", "copies"))
        for rows in K.slices(segments["segment"].combine_chunks(), 1 << 62):
            words = K.find_words(rows)
            at = np.flatnonzero(K.gram_valid(words, window))
            row = words.row_of()[at]
            same = K.gram_codes(K.span_codes(rows.data, words.starts, words.ends), window)[at]
            again = np.bincount(same, copies[row])[same] >= 2 if len(at) else np.empty(0, bool)
            if confirmed.num_rows:
                have = set(zip(confirmed["a"].to_pylist(), confirmed["b"].to_pylist(), strict=True))
                both = _window_hashes(rows, words, window)[at]
                wide = np.flatnonzero(salts[row] > 1)
                again[wide] |= np.array([pair in have for pair in both[wide].tolist()], bool)
            own = np.zeros(len(words.starts) + 1, bool)
            first = np.unique(same, return_index=True)[1]
            own[at[first[again[first]]]] = True
            blob, of_word = rows.data.tobytes(), words.row_of()
            # The last windows of a row are never valid, so runs end in their row.
            for b, e in zip(*(x.tolist() for x in _runs(own)), strict=True):
                out["anchor"].append(int(anchor[of_word[b]]))
                out["salts"].append(int(salts[of_word[b]]))
                out["passage"].append(blob[words.starts[b] : words.ends[e + window - 2]])
        return pa.table([pa.array(out["anchor"], pa.int64()), pa.array(out["salts"], pa.int32()), pa.array(out["passage"], pa.binary()).cast(pa.string())], list(out))

    return run


def compiled(passages: list[str], window: int) -> ahocorasick.Automaton | None:
    """The automaton of all windows of passages, strings of one symbol for each word; None if there are none."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in passages:
        for at in range(len(p) - window + 1):
            automaton.add_word(p[at : at + window])
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _locate(window: int):
    """text_key, spans: where a shard's automaton finds windows of passages in its segments, as word numbers of the text."""
    empty = pa.table({"text_key": pa.array([], pa.binary()), "spans": pa.array([], pa.list_(pa.int32()))})

    def run(segments: pa.Table, passages: pa.Table) -> pa.Table:
        if not segments.num_rows or not passages.num_rows:
            return empty
        both = pa.concat_arrays([passages["passage"].combine_chunks(), segments["segment"].combine_chunks()])
        rows = next(K.slices(both, 1 << 62))
        words = K.find_words(rows)
        codes = K.span_codes(rows.data, words.starts, words.ends)
        # Words of no passage share one symbol, which also ends each segment; surrogates are no symbols.
        known, symbols = np.unique(codes[: words.first[passages.num_rows]], return_inverse=True)
        table_ = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)
        table_[known] = 1 + np.arange(len(known))
        text = lambda x: (x + 0x10000).astype("<u4").tobytes().decode("utf-32-le")
        phrases, cut = text(symbols + 1), words.first[: passages.num_rows + 1].tolist()
        automaton = compiled([phrases[a:b] for a, b in zip(cut, cut[1:], strict=False)], window)
        if automaton is None:
            return empty
        first = words.first[passages.num_rows :]
        stream = np.zeros(len(codes) - first[0] + segments.num_rows, np.int64)
        row = np.repeat(np.arange(segments.num_rows), np.diff(first))
        stream[np.arange(len(row)) + row] = table_[codes[first[0] :]]
        ends = np.fromiter((end for end, _ in automaton.iter(text(stream))), np.int64)
        marks = np.zeros(len(stream), bool)
        marks[ends - window + 1] = True
        begins, ends = _runs(K.covered(marks, window, len(stream)))
        begin_of = first[:-1] - first[0] + np.arange(segments.num_rows)
        row = np.searchsorted(begin_of, begins, side="right") - 1
        shift = segments["start"].to_numpy()[row] - begin_of[row]
        spans = np.stack([begins + shift, ends + shift], axis=1).astype(np.int32)
        owner, count = np.unique(row, return_counts=True)
        offsets = pa.array(np.r_[0, 2 * np.cumsum(count)].astype(np.int32))
        return pa.table({"text_key": segments["text_key"].take(pa.array(owner)), "spans": pa.ListArray.from_arrays(offsets, pa.array(spans.ravel()))})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2).to_pylist()
        n_words, n_removed, kept = [], [], []
        for rows in K.slices(batch.column(1)):
            words = K.find_words(rows)
            blob = rows.data.tobytes()
            for i in range(len(rows)):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                n, gone = hi - lo, np.zeros(hi - lo, bool)
                for a, b in zip(*[iter(x for s in spans[rows.first + i] or () for x in s)] * 2):
                    gone[a:b] = True
                at = lo + np.flatnonzero(~gone)
                n_words.append(n)
                n_removed.append(n - len(at))
                kept.append(b" ".join([blob[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["text_key", "n_words", "n_removed", "kept_text"],
        )


def recurring_spans(texts: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """text_key, spans: for each of texts(text_key, text, copies) with recurring windows, lists of word starts and ends to cut."""
    pairs = texts.select("text", "text_key", "copies").mapInArrow(_census(window), "text_key binary, anchor long, n long, copies long")
    recurring = staged(
        pairs.groupBy("anchor")
        .agg(F.sum("n").alias("places"), F.sum(F.col("n") * F.col("copies")).alias("n"))
        .filter("n >= 2")
        .select("anchor", "places", F.ceil(F.col("places") / shard_rows).cast("int").alias("salts")),
        "anchors",
    )
    shards = max(1, -(-(recurring.agg(F.sum("places")).first()[0] or 0) // shard_rows))
    lists = (
        pairs.select("text_key", "anchor")
        .join(recurring.drop("places"), "anchor")
        .groupBy("text_key")
        .agg(F.collect_set(F.struct("anchor", "salts")).alias("known"))
    )
    shard = lambda salt: F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).alias("shard")
    segments = (
        texts.join(lists, "text_key")
        .select("text_key", "text", "copies", "known")
        .mapInArrow(_segments(window), "text_key binary, copies long, anchor long, salts int, start int, segment string")
    )
    segments = bucketed(segments.select("*", shard(F.pmod(F.xxhash64("text_key", "start"), F.col("salts")))), "segments", "shard")
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - F.lit(1).cast("long"))).alias("salt")
    across = (
        segments.filter("salts > 1")
        .select("anchor", "salts", "copies", "segment")
        .mapInArrow(_confirm(window), "anchor long, salts int, a long, b long, n long")
        .groupBy("anchor", "salts", "a", "b")
        .agg(F.sum("n").alias("n"))
        .filter("n >= 2")
        .select("anchor", "a", "b", every_salt)
        .select(shard(F.col("salt")), "a", "b")
    )
    by_shard = segments.groupBy("shard")
    passages = staged(by_shard.cogroup(across.groupBy("shard")).applyInArrow(_passages(window), "anchor long, salts int, passage string"), "passages")
    wide = passages.filter("salts > 1").distinct()
    dealt = passages.filter("salts = 1").union(wide).select("anchor", "passage", every_salt).select(shard(F.col("salt")), "passage")
    located = by_shard.cogroup(dealt.groupBy("shard")).applyInArrow(_locate(window), "text_key binary, spans array<int>")
    return located.groupBy("text_key").agg(F.collect_list("spans").alias("spans"))


def cut_texts(docs: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """text_key, n_words, n_removed, kept_text of every distinct text of docs(text)."""
    keyed = small_batches(docs).select("text", text_key(F.col("text")))
    texts = bucketed(keyed.groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", "text_key")
    spans = recurring_spans(texts, window, shard_rows)
    return texts.join(spans, "text_key", "left").select("text_key", "text", "spans").mapInArrow(_cut, "text_key binary, n_words long, n_removed long, kept_text string")


def remove_recurring(docs: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: documents without the words of windows that occur elsewhere too."""
    found = cut_texts(docs, window, shard_rows)
    return docs.select("doc_id", text_key(F.col("text"))).join(found, "text_key").drop("text_key")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = table(spark, sf_dir, "documents")
    found = cut_texts(docs).select("text_key", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_key(F.col("text"))).join(found, "text_key").drop("text_key")


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 of each text by direct comparison; for tests."""
    import re
    from collections import Counter

    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
