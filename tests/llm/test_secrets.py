import base64
import hashlib
import os
import random
import string

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessara.llm import secrets as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return S.train(S.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")))


def odd_texts():
    r = random.Random(5)
    parts = ["token=", "Token = '", 'API_KEY":"', "apikey :", "ſecret=", "secret=", "passwd", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6", "deadbeef", "0123456789abcdef", "é", "\U0001f600", "\n", " ", "=", "abc.def-1", "short", "token=secret: abcdefghij", "PassWord:"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, "", "token=" * 500, "a" * 31, "f" * 32, "F" * 40, "AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "x" * 30000 + "token=abcdefgh"]


def test_base_against_brute_force(spark, model):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).withColumn("base", F.lit(1)).withColumn("spans", F.lit(2))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k))
    got = {r[0]: tuple(r)[1:] for r in S.scan(df, model).select("doc_id", count(0), count(1), count(2), F.sha2(S.listing(F.col("base")), 256)).collect()}
    assert [got[i] for i in range(len(texts))] == [S.brute_force(t) for t in texts]
    assert S.scan(df.limit(0), model).count() == 0


def test_query_on_documents(spark):
    got = {r.doc_id: r for r in S.op4_secret_scan(spark, SF).collect()}
    for row in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        r = got[row["doc_id"]]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == S.brute_force(row["text"])
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 10


def rate(spark, model, tokens):
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    found = F.size(F.filter("spans", lambda s: s.kind == 3)) > 0
    return S.scan(df.withColumnRenamed("token", "text"), model).select(F.avg(found.cast("int"))).first()[0]


def test_markov_recall_by_length(spark, model):
    """Random strings that no base pattern covers, alone and joined to long ordinary words."""
    r = random.Random(1)
    b62, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    found = {(k, n): rate(spark, model, [make(a, n) for _ in range(300)]) for k, a in (("b62", b62), ("hex", hexa), ("url", b62 + "_-")) for n in (8, 12, 16, 19, 24, 31)}
    joined = {pre: rate(spark, model, [pre + make(b62, 20) for _ in range(300)]) for pre in ("application-configuration-session-credential=", "/usr/local/share/applications/internationalization/configuration/department/")}
    print(found, joined)
    assert all(p > 0.8 for (_, n), p in found.items() if n >= 12) and all(p > 0.9 for (_, n), p in found.items() if n >= 16)
    assert all(p > 0.5 for p in found.values()) and min(joined.values()) > 0.95


def test_markov_leaves_ordinary_names_alone(spark, model):
    """Words of documents joined to names, and identifiers of the standard library, none of which is a labelled sample as it stands."""
    import ast
    import functools
    import json as json_
    import unittest

    r = random.Random(2)
    vocab = [w for row in pq.read_table(f"{SF}/documents.parquet").slice(500).to_pylist() for w in (row["text"] or "").split() if w.isascii() and w.isalpha()]
    plain = ["_".join(r.choice(vocab) for _ in range(r.randint(4, 8))) for _ in range(500)]
    names = {n for m in (ast, functools, json_, os, random, hashlib, base64, string, unittest, unittest.TestCase, pytest, spark, spark.range(1), F) for n in dir(m) if len(n) >= 8}
    wrong = {"words": rate(spark, model, plain), "names": rate(spark, model, sorted(names))}
    print(len(names), wrong)
    wrong["numbers"] = rate(spark, model, ["".join(r.choice(string.digits) for _ in range(r.randint(8, 20))) for _ in range(500)])
    assert len(names) > 800 and wrong["words"] < 0.01 and wrong["names"] < 0.04 and wrong["numbers"] < 0.05


def test_spans_and_redaction(spark, model):
    key = base64.b64encode(hashlib.sha512(b"k").digest())[:40].decode().replace("=", "a")
    text = f"é token=abcdefgh1 then {key} and {'0a' * 20} end"
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = S.scan(df, model).select("doc_id", S.listing(F.col("spans")).alias("s"), S.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [x.split(":")[0] for x in got[0].s.split(",")] == ["assign", "markov", "hex"]
    assert got[0].t == "é [SECRET] then [SECRET] and [SECRET] end" and got[1].t == "nothing here" and got[2].t == ""


def test_hidden_and_neighbouring_secrets(spark, model):
    key = base64.b64encode(hashlib.sha512(b"z").digest())[:30].decode().replace("+", "a").replace("/", "b")
    texts = [f"path/of/ordinary/words/{key}/and/more/words", f"{'0a' * 20}_{key}", f"{key}\n{key}", f"token=abcdefgh1 {key}", "😀é " + key, key, key]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.s for r in S.scan(df, model).select("doc_id", S.listing(F.filter("spans", lambda s: s.kind == 3)).alias("s")).collect()}
    for i, t in enumerate(texts):
        spans = [tuple(map(int, x.split(":")[1:])) for x in got[i].split(",")]
        # A short neighbouring word may come along.
        assert len(spans) == t.count(key) and all(key in t[a:b] and b - a <= len(key) + 12 for a, b in spans), (t, spans)


def test_long_texts_and_many_secrets(spark, model):
    text = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)) + " ordinary words " * 20000
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    got = S.scan(df, model).select(F.size("base").alias("n"), S.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("t")).collect()
    assert [(r.n, r.t.count("[SECRET]"), len(r.t)) for r in got] == [(3000, 3000, len(text) - 3000 * 56)] * 2
