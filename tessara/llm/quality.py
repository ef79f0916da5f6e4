"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from vectorised byte scans of whole texts; lines and windows of
words are compared by their bytes, not by hashes.  Trees are grown on
the driver from a bounded sample of labelled documents, with monotonic
constraints on chosen statistics, and flattened into numpy node arrays that
score a batch of documents level by level.

Defined cases: null and empty texts have no words and fail the base rules;
labels that are null or belong to no document are not used; of a document's
labels the least counts, and of its texts one; with no labels of one kind the base rules decide
alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import labelled, small_batches, table

#: At most this many labelled documents are used for training: those with the smallest hashes.
TRAIN_DOCS = 12000
#: A document goes if its probability of good quality is under this.
KEEP_FROM = 0.35
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bar_share", "bang_share", "comma_share", "stop_share", "line_words"]
#: -1: the probability of good quality never rises with this statistic.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bar_share": -1, "bang_share": -1}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(rows: K.Rows) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows, 5) and features (rows, 12) of a slice."""
    data, offsets, n = rows.data, rows.offsets, len(rows)
    words = K.find_words(rows)
    n_words = words.counts
    inside = ~K.SPACE[data]
    chars = (data & 0xC0) != 0x80
    word_chars = _per_row(inside & chars, offsets)
    n_symbols = _per_row(_SYMBOL[data], offsets)

    breaks = np.flatnonzero(data == 10)
    edge = np.unique(np.concatenate([offsets, breaks + 1]))
    edge = edge[edge < len(data)] if len(data) else edge[:0]
    ends = np.append(edge[1:], len(data))
    ends = ends - ((ends > edge) & (data[np.maximum(ends - 1, 0)] == 10)) if len(edge) else ends
    row_of = np.searchsorted(offsets, edge, side="right") - 1
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    has = filled[ends] > filled[edge] if len(edge) else np.empty(0, bool)
    lines, row_of, ends = edge[has], row_of[has], ends[has]
    _, first = np.unique(row_of << 32 | K.span_codes(data, lines, ends), return_index=True)
    n_lines = np.bincount(row_of, minlength=n)
    n_dup = n_lines - np.bincount(row_of[first], minlength=n)

    row = words.row_of()
    grams, valid = K.gram_codes(K.span_codes(data, words.starts, words.ends), WINDOW), K.gram_valid(words, WINDOW)
    marks = np.zeros(len(grams), bool)
    if valid.any():
        at = np.flatnonzero(valid)
        same = pd.factorize(row[at] << 32 | grams[at])[0]
        marks[at[np.bincount(same)[same] > 1]] = True
    n_repeat = np.bincount(row[K.covered(marks, WINDOW, len(row))], minlength=n) if len(row) else np.zeros(n, np.int64)

    base = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    count = lambda mask: _per_row(mask, offsets)
    short = np.bincount(row[(words.ends - words.starts) <= 3], minlength=n) if len(row) else np.zeros(n)
    features = np.stack(
        [
            np.log1p(n_words),
            word_chars / w,
            n_symbols / c,
            n_dup / np.maximum(n_lines, 1),
            n_repeat / w,
            count((data >= 65) & (data <= 90)) / c,
            count((data >= 48) & (data <= 57)) / c,
            count(data == 124) / w,
            count(data == 33) / w,
            count((data == 44) | (data == 46)) / w,
            short / w,
            n_words / np.maximum(n_lines, 1),
        ],
        axis=1,
    )
    return base, features


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 20.0, ridge: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss over quantile bins.

    A split on a constrained feature must order its children's values, and all
    values below it are bounded by their mean, so the whole forest is monotonic.
    `least`: the smallest number of rows in a leaf.
    """
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(p / (1 - p)))
    out: dict[str, list] = {k: [] for k in ("roots", "feature", "threshold", "left", "right", "value")}
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), bias)

    def node() -> int:
        at = len(out["feature"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", 0.0)):
            out[k].append(v)
        return at

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_depth: int) -> int:
        at = node()
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left_depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = (np.clip(-a / (s + ridge), low, high) for a, s in ((gl, hl), (gs - gl, hs - hl)))
                gain = -(gl * vl + (hl + ridge) * vl * vl / 2) - ((gs - gl) * vr + (hs - hl + ridge) * vr * vr / 2)
                gain[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        v = float(np.clip(-gs / (hs + ridge), low, high))
        if best[1] is None or best[0] <= -(gs * v + (hs + ridge) * v * v / 2) + 1e-6:
            out["value"][at] = rate * v
            score[rows] += rate * v
            return at
        f, k, vl, vr = best[1]
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[f]]
        goes = binned[rows, f] <= k
        out["feature"][at], out["threshold"][at] = f, float(cuts[f][k])
        out["left"][at] = build(rows[goes], g, h, *bounds[0], left_depth - 1)
        out["right"][at] = build(rows[~goes], g, h, *bounds[1], left_depth - 1)
        return at

    for _ in range(trees if len(y) else 0):
        prob = 1 / (1 + np.exp(-score))
        out["roots"].append(build(np.arange(len(y)), prob - y, prob * (1 - prob), -4.0, 4.0, depth))
    if not out["roots"]:
        out["roots"].append(node())
    kinds = {"threshold": np.float64, "value": np.float64}
    return Forest(**{k: np.array(v, kinds.get(k, np.int64)) for k, v in out.items()}, depth=depth, bias=bias)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in K.slices(batch.column(1)):
            _, x = statistics(rows)
            label = batch.column(0).slice(rows.first, len(rows))
            yield pa.RecordBatch.from_arrays([label, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])


def labelled_features(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of at most `most` labelled documents; that many rows reach the driver."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = labelled(small_batches(docs), known, most).mapInArrow(_features, "label int, x array<double>").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.empty((0, len(FEATURES)))
    y = rows["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # one order, however rows arrive
    return x[order], y[order]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, monotone: dict[str, int] = MONOTONE) -> Forest | None:
    """A forest for P(quality = 1); None if the sample lacks one of the two labels."""
    x, y = labelled_features(docs, labels, most)
    if len(np.unique(y)) < 2:
        return None
    return grow(x, y, [monotone.get(f, 0) for f in FEATURES])


def _judge(forest: Forest | None, keep_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.slices(batch.column(0)):
                base, x = statistics(rows)
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                p = forest.probability(x) if forest else np.ones(len(base))
                columns = [pa.array(np.ascontiguousarray(c)) for c in (*base.T, failed, p, ~failed & (p >= keep_from))]
                rest = batch.slice(rows.first, len(rows)).columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, *columns], [*batch.schema.names[1:], *BASE, "base_failed", "p_good", "kept"])

    return run


def judge(docs: DataFrame, forest: Forest | None, keep_from: float = KEEP_FROM, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns in carry, the base counts, base_failed, p_good and kept of every document."""
    schema = docs.select(*carry).schema
    for c in BASE:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("p_good", "double").add("kept", "boolean")
    return small_batches(docs).select(F.col("text").alias("__text"), *carry).mapInArrow(_judge(forest, keep_from), schema)


def op7_quality_trees(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, p_good, kept."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base counts and base_failed by plain Python; for tests."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1)]
    many = Counter(grams)
    repeat = len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(WINDOW)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, len(w) < 10 or 100 * repeat > 20 * len(w)
