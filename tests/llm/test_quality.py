import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tessara.llm import kernels as K
from tessara.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_base_against_brute_force(spark):
    r = random.Random(4)
    bits = ["a", "b", "word", "é|", "#x", "\n", "\n\n", " ", "  ", "\t", "\x0b", "same line\n", "\r\n", " ", "<>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(500)] + [None, "", "\n", "a\na", "a\na\n", "\na b\nc", "x y z w v " * 3000, " ".join(map(str, range(20000)))]
    texts += pq.read_table(f"{SF}/documents.parquet").slice(0, 500)["text"].to_pylist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words")
    got = {r.doc_id: tuple(r)[1:7] for r in Q.judge(df, None).collect()}
    assert [got[i] for i in range(len(texts))] == [Q.brute_force(t) for t in texts]
    assert Q.judge(df.limit(0), None).collect() == []


def features(texts):
    return np.concatenate([Q.statistics(rows)[1] for rows in K.slices(pa.array(texts, pa.string()))])


def test_held_out_accuracy_and_monotonicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x, y = Q.labelled_features(docs, labels)
    held = np.arange(len(y)) % 4 == 0
    monotone = [Q.MONOTONE.get(f, 0) for f in Q.FEATURES]
    forest = Q.grow(x[~held], y[~held], monotone)
    kept = forest.probability(x[held]) >= Q.KEEP_FROM
    good = y[held] == 1
    print("kept of good", kept[good].mean(), "dropped of bad", (~kept[~good]).mean())
    assert kept[good].mean() > 0.97 and (~kept[~good]).mean() > 0.6
    probe = np.repeat(x[:300], 40, axis=0)
    for f, sign in enumerate(monotone):
        if sign:
            z = probe.copy()
            z[:, f] = np.tile(np.linspace(-0.1, 2, 40), 300)
            assert (sign * np.diff(forest.probability(z).reshape(300, 40), axis=1) >= -1e-12).all()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "w " * 5), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.train(docs, labels) is None


def test_words_and_lines_that_a_polynomial_hash_confuses(spark):
    def morse(n, a="a", b="b"):
        return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))

    texts = []
    for n in (1024, 2048, 4096):
        one, two = morse(n), morse(n, "b", "a")
        texts += [f"{one}\n{two}", f"{one} {two}\n{two} {one}", " ".join([one, "x", "y", "z", "v", two, "x", "y", "z", "v"]), f"{one}\n{two}\n{one}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in Q.judge(df, None).collect()}
    assert [got[i] for i in range(len(texts))] == [Q.brute_force(t) for t in texts]


def test_node_arrays_score_as_a_plain_walk():
    r = np.random.RandomState(0)
    x = r.rand(500, len(Q.FEATURES))
    forest = Q.grow(x, (x[:, 0] + x[:, 3] > r.rand(500) * 2).astype(float), [0] * len(Q.FEATURES))

    def walk(row):
        total = forest.bias
        for at in forest.roots.tolist():
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.probability(x), [walk(row) for row in x], atol=1e-12)
    assert (forest.left != np.arange(len(forest.left))).sum() > 60


def test_labels_of_repeated_ids_are_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 7} of some words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 5, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    x, y = Q.labelled_features(docs, labels)
    assert len(y) == 5 and not y.any()
