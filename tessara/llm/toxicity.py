"""Toxicity: a counterfactually regularised logistic classifier.

Features are the presence of words and of their beginnings and ends, hashed.
For every sentence of a labelled text that mentions an identity term, a
counterfactual with the terms of other groups is made, and training adds
    strength * (logit(sentence) - logit(counterfactual))**2
to the loss, so that a group's name alone does not move a score.

Defined cases: null and empty texts get the score of no features; labels that
are null or belong to no document are not used, and of a document's labels the least counts; with no labels of one kind all
scores are 0; a null doc_id is held in; equal texts get equal scores; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import labelled, small_batches, staged, table

#: At most this many labelled documents are used for training: those with the smallest hashes.
TRAIN_DOCS = 12000
#: Features kept at most, by significance; a feature must be in LEAST documents.
MOST_FEATURES, LEAST, SIGNIFICANT = 600, 5, 4.0
STRENGTH = 10.0
#: Byte lengths of word beginnings and ends used as features.
HEADS, TAILS = (3, 4, 5, 6, 7, 8), (4, 6)
#: Groups of interchangeable identity terms; a counterfactual takes the next term of its group.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "african", "latino", "european"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "natives", "locals"], ["immigrant", "refugee", "foreigner", "native", "local"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["ausländer", "einwanderer", "flüchtlinge"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["étrangers", "immigrés", "réfugiés"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["extranjeros", "inmigrantes", "refugiados"],
]
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
_LETTER[128:] = True
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(1 + len(HEADS) + len(TAILS))]


def _rows(texts: list[str]) -> K.Rows:
    data = [t.encode() for t in texts]
    return K.Rows(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64), 0)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented Latin letters U+00C0 to U+00DE in UTF-8 bytes."""
    low = K.lower_ascii(data)
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    second &= (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low[second] += 0x20
    return low


def sentences(rows: K.Rows) -> K.Rows:
    """The sentences of all rows as rows: they end at a line break, or at . ! or ? before white space."""
    data = rows.data
    stop = (data == 46) | (data == 33) | (data == 63)
    ends = np.flatnonzero((data[:-1] == 10) | (stop[:-1] & K.SPACE[data[1:]])) + 1 if len(data) else np.empty(0, np.int64)
    return K.Rows(data, np.unique(np.concatenate([rows.offsets, ends])), 0)


def features(rows: K.Rows) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit feature of every word, word beginning and word end, repeats included; letters of either case count as one."""
    low = lower(rows.data)
    spaced = np.where(_LETTER[low], low, np.uint8(32))
    words = K.find_words(K.Rows(spaced, rows.offsets, rows.first))
    row, size = words.row_of(), words.ends - words.starts
    out_row, out = [row], [K.span_hashes(spaced, words.starts, words.ends) ^ _SALT[0]]
    for i, (k, head) in enumerate([(k, True) for k in HEADS] + [(k, False) for k in TAILS]):
        at = np.flatnonzero(size > k)
        starts = words.starts[at] if head else words.ends[at] - k
        out.append(K.span_hashes(spaced, starts, starts + k) ^ _SALT[i + 1])
        out_row.append(row[at])
    return np.concatenate(out_row), np.concatenate(out)


def _swaps(identity: list[list[str]]) -> dict[np.uint64, np.ndarray]:
    """word feature -> all features of the word, and of the next word of its group."""
    out = {}
    for group in identity:
        each = [features(_rows([t]))[1] for t in group]
        for mine, other in zip(each, each[1:] + each[:1], strict=True):
            out[mine[0]] = (mine, other)
    return out


@dataclass
class Model:
    keys: np.ndarray  # sorted features
    weights: np.ndarray
    bias: float

    def presence(self, rows: K.Rows) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature index) pairs of a slice."""
        row, feature = features(rows)
        at = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1) if len(self.keys) else np.zeros(len(feature), int)
        hit = self.keys[at] == feature if len(self.keys) else np.zeros(len(feature), bool)
        pair = np.unique(row[hit] * max(1, len(self.keys)) + at[hit])
        return np.divmod(pair, max(1, len(self.keys)))

    def scores(self, rows: K.Rows) -> np.ndarray:
        row, at = self.presence(rows)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, self.weights[at], minlength=len(rows)), -30, 30)))


def fit(documents: list[np.ndarray], y: np.ndarray, identity: list[list[str]] | None = None, strength: float = STRENGTH, ridge: float = 1.0, most: int = MOST_FEATURES, mentions: list[np.ndarray] | None = None) -> Model | None:
    """Newton's method on the penalised logistic loss.

    documents: distinct features of each labelled text; mentions: those of each
    of their sentences that has an identity term (by default, the texts themselves).
    """
    if len(np.unique(y)) < 2:
        return None
    flat = np.concatenate(documents)
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    keys, back = np.unique(flat, return_inverse=True)
    n, pos = np.bincount(back, minlength=len(keys)), np.bincount(back, y[owner], minlength=len(keys))
    p = y.mean()
    z = (pos - n * p) / np.sqrt(n * p * (1 - p) + 1)
    z[n < LEAST] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:most]
    chosen = chosen[np.abs(z[chosen]) >= SIGNIFICANT]
    swaps = _swaps(IDENTITY if identity is None else identity)
    terms = np.array([f for mine, _ in swaps.values() for f in mine], np.uint64)
    used = np.unique(np.concatenate([keys[chosen], terms[np.isin(terms, keys)]]))
    x = np.zeros((len(documents), len(used) + 1))
    x[:, -1] = 1
    at = np.minimum(np.searchsorted(used, flat), max(0, len(used) - 1))
    hit = used[at] == flat if len(used) else np.zeros(len(flat), bool)
    x[owner[hit], at[hit]] = 1
    moved = []
    words = np.array(list(swaps), np.uint64)
    for d in documents if mentions is None else mentions:
        found = d[np.isin(d, words)]
        if len(found):
            k = np.searchsorted(used, d)
            mine = np.zeros(x.shape[1])
            mine[k[(k < len(used)) & (used[np.minimum(k, len(used) - 1)] == d)]] = 1
            other = mine.copy()
            for f in found:
                for features_, on in zip(swaps[f], (0, 1), strict=True):
                    k = np.searchsorted(used, features_)
                    k = k[(k < len(used)) & (used[np.minimum(k, len(used) - 1)] == features_)]
                    other[k] = on
            moved.append(mine - other)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    extra = 2 * strength * np.array(moved).T @ np.array(moved) if moved else 0
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (q - y) + penalty * w + (extra @ w if moved else 0)
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty) + extra
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return Model(used, w[:-1], float(w[-1]))


def _distinct(row: np.ndarray, f: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features by row, and where those of each of n rows begin (and the last end)."""
    order = np.lexsort((f, row))
    row, f = row[order], f[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (f[1:] != f[:-1])] if len(f) else np.empty(0, bool)
    row, f = row[new], f[new]
    return f, np.searchsorted(row, np.arange(n + 1))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in K.slices(batch.column(1), K.SLICE // 4):
            f, offsets = _distinct(*features(rows), len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.first, len(rows)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f.view(np.int64)))], ["label", "x"])


#: The label of rows that are sentences with an identity term.
MENTION = -1


def _chosen(wanted: np.ndarray, terms: np.ndarray):
    """Of each labelled text the wanted features, and of each of its sentences with one of the terms as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.slices(batch.column(1), K.SLICE // 4):
                for mentions, part in ((False, rows), (True, sentences(rows))):
                    f, offsets = _distinct(*features(part), len(part))
                    values = f.view(np.int64)
                    hit = np.isin(values, wanted)
                    kept = np.r_[0, np.cumsum(hit)][offsets]
                    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(values[hit]))
                    if mentions:
                        some = np.r_[0, np.cumsum(np.isin(values, terms))][offsets]
                        lists = lists.filter(pa.array(np.diff(some) > 0))
                        labels = pa.array(np.full(len(lists), MENTION), pa.int32())
                    else:
                        labels = batch.column(0).slice(rows.first, len(rows))
                    yield pa.RecordBatch.from_arrays([labels, lists], ["label", "x"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sparse(batches):
        offsets = batch.column(1).offsets.to_numpy()
        label = np.repeat(batch.column(0).to_numpy().astype(np.int64), np.diff(offsets))
        keys, back = np.unique(batch.column(1).values.to_numpy(), return_inverse=True)
        n, pos = np.bincount(back, minlength=len(keys)), np.bincount(back, label, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(pos)], ["f", "n", "pos"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, identity: list[list[str]] | None = None, strength: float = STRENGTH) -> Model | None:
    """A model from at most `most` held-in labelled documents, of which only features of some frequency and difference reach the driver."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    sample = staged(labelled(small_batches(docs), known, most), "labelled")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    if not 0 < total.pos < total.n:
        return None
    p = total.pos / total.n
    swaps = _swaps(IDENTITY if identity is None else identity)
    terms = [int(np.uint64(f).view(np.int64)) for pair in swaps.values() for f in pair[0]]
    counts = sample.mapInArrow(_count, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    z = F.abs(F.col("pos") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) + 1)
    top = counts.filter(F.col("n") >= LEAST).select("f", z.alias("z")).filter(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "f").limit(MOST_FEATURES).collect()
    wanted = np.unique(np.array([r.f for r in top] + terms, np.int64))
    words = np.array(list(swaps), np.uint64).view(np.int64)
    rows = sample.mapInArrow(_chosen(wanted, words), "label int, x array<long>").toArrow()
    data = sorted((y, sorted(x)) for x, y in zip(rows["x"].to_pylist(), rows["label"].to_pylist(), strict=True))
    as_features = lambda keep: [np.array(x, np.int64).view(np.uint64) for y, x in data if keep(y)]
    return fit(as_features(lambda y: y != MENTION), np.array([y for y, _ in data if y != MENTION], float), identity, strength, mentions=as_features(lambda y: y == MENTION))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.slices(batch.column(0), K.SLICE // 4):
                s = model.scores(rows) if model else np.zeros(len(rows))
                rest = batch.slice(rows.first, len(rows)).columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns in carry, score and predicted of every document."""
    schema = docs.select(*carry).schema.add("score", "double").add("predicted", "integer")
    return small_batches(docs).select(F.col("text").alias("__text"), *carry).mapInArrow(_score(model), schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
