import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from tessara.llm import kernels as K
from tessara.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = T.op8_toxicity(spark, SF).collect()
    assert len(got) == pq.read_metadata(f"{SF}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    y, s = np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held])
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print("AUC", auc, "recall", (s[y == 1] >= 0.5).mean(), "false", (s[y == 0] >= 0.5).mean())
    assert auc > 0.9 and (s[y == 1] >= 0.5).mean() > 0.8 and (s[y == 0] >= 0.5).mean() < 0.02


def sentences(seed):
    """Group mentions lean toxic in the labels; one group more than others."""
    r = random.Random(seed)
    plain = [f"plain{i}" for i in range(200)]
    texts, y = [], []
    for _ in range(3000):
        toxic = r.random() < 0.3
        w = [r.choice(plain) for _ in range(12)]
        if r.random() < (0.9 if toxic else 0.7):
            w.append("nasty" if toxic else "pleasant")
        if r.random() < (0.6 if toxic else 0.1):
            w.append("muslims" if r.random() < 0.8 else "christians")
        texts.append(" ".join(w))
        y.append(float(toxic))
    return texts, np.array(y)


def test_counterfactual_penalty_closes_the_gap_between_groups():
    texts, y = sentences(1)
    documents = [np.unique(T.features(T._rows([t]))[1]) for t in texts]
    gaps, errors = [], []
    for strength in (0.0, T.STRENGTH):
        model = T.fit(documents, y, strength=strength)
        a, b = model.scores(T._rows(["plain1 plain2 muslims", "plain1 plain2 hindus"]))
        gaps.append(abs(a - b))
        test, truth = sentences(2)
        errors.append(((model.scores(T._rows(test)) >= 0.5) != truth).mean())
    print(gaps, errors)
    assert gaps[1] < 0.25 * gaps[0] and errors[1] < 0.3


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "Idiot!"), (2, "Idiot!")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as held_out")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert T.train(docs, labels) is None
    assert [r.score for r in T.score(docs, None).collect()] == [0.0] * 4
    assert T.score(docs.limit(0), None).collect() == []


def plain_features(text):
    """Hashed words, beginnings and ends by plain Python."""
    import re

    def key(b, k):
        return int(K.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0] ^ T._SALT[k])

    out = set()
    low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    for w in re.findall(r"[a-z0-9'\u0080-\U0010ffff]+", low):
        b = w.encode()
        out.add(key(b, 0))
        out |= {key(b[:k], i + 1) for i, k in enumerate(T.HEADS) if len(b) > k}
        out |= {key(b[-k:], i + 1 + len(T.HEADS)) for i, k in enumerate(T.TAILS) if len(b) > k}
    return out


def test_scores_against_plain_python(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = T.train(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    texts = [None, "", "ÉTRANGERS Étrangers étrangers", "İ × ÷ ñ", "word " * 40000, *(r.text for r in docs.orderBy("doc_id").limit(60).collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.score, r.predicted) for r in T.score(df, model).collect()}
    for i, t in enumerate(texts):
        logit = model.bias + sum(weight.get(f, 0.0) for f in plain_features(t))
        want = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == (got[i][0] >= 0.5), t


def test_neutral_mentions_of_groups_are_not_toxic(spark):
    """Held-out clean documents with a neutral sentence about each group added stay clean, and swaps of the group hardly move scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = T.train(docs, labels)
    held = docs.join(labels.filter("toxic = 0"), "doc_id").filter(T.held_out(docs["doc_id"])).orderBy("doc_id").limit(200).collect()
    before = np.array([r.text for r in held])
    clean = model.scores(T._rows(list(before))) < 0.5
    wrong, moved = [], []
    for group in T.IDENTITY:
        each = []
        for term in group:
            scores = model.scores(T._rows([f"{t}\nYesterday some {term} visited the library and read a book." for t in before[clean]]))
            wrong.append((scores >= 0.5).mean())
            each.append(scores)
        moved.append(np.ptp(np.stack(each), axis=0).max())
    print("false positives", max(wrong), "largest move", max(moved))
    assert clean.sum() > 100 and max(wrong) <= 0.01 and max(moved) < 0.3


def test_sentences_and_accents():
    rows = T._rows(["One two. Three! four\nfive", "", "É. x? "])
    cut = T.sentences(rows)
    blob = rows.data.tobytes()
    assert [blob[a:b].decode() for a, b in zip(cut.offsets, cut.offsets[1:], strict=False)] == ["One two.", " Three!", " four\n", "five", "É.", " x?", " "]
    assert T.lower(rows.data).tobytes().decode() == "one two. three! four\nfiveé. x? "
