import random

import pytest
from pyspark.sql import functions as F

from tessara.llm import substring_dedup as S


def docs_of(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string")


def fixture_texts(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    passages = [words(r.choice([34, 35, 36, 60, 120])) for _ in range(6)]
    texts: list[str | None] = []
    for _ in range(n):
        w = words(r.randint(0, 150))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        texts.append(r.choice([" ", "\n", "\t ", " \x0b"]).join(w))
    texts += [None, "", "   ", texts[0], texts[0], "a " * 400, "a b " * 100, "x y " * 3, " ".join(words(9000))]
    return texts


@pytest.mark.parametrize("shard_rows", [3, 2000])
def test_against_brute_force(spark, shard_rows):
    texts = fixture_texts(shard_rows)
    got = S.remove_recurring(docs_of(spark, texts), shard_rows=shard_rows).withColumn("s", F.sha2("kept_text", 256))
    got = {r.doc_id: (r.n_words, r.n_removed, r.s) for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == S.brute_force(texts)


def test_edges(spark):
    text = " ".join(f"q{i}" for i in range(40))
    df = docs_of(spark, [text, text, None], [7, 7, None]).withColumn("spans", F.lit(1)).withColumn("anchor", F.lit("x"))
    got = sorted((r.n_words, r.n_removed) for r in S.remove_recurring(df).collect())
    assert got == [(0, 0), (40, 40), (40, 40)]
    assert S.remove_recurring(df.limit(0)).collect() == []


def morse(n, a="a", b="b"):
    """Two of these, with a and b swapped, have one value under every polynomial hash modulo 2**64."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("shard_rows", [1, 2000])
def test_words_that_a_polynomial_hash_confuses(spark, shard_rows):
    around = [f"q{i}" for i in range(34)]
    texts = [" ".join([*around[:17], morse(n, *ab), *around[17:]]) for n in (1024, 2048, 4096) for ab in ("ab", "ba")]
    texts.append(" ".join([*around[:17], morse(1024), *around[17:], "more"]))
    got = S.remove_recurring(docs_of(spark, texts), shard_rows=shard_rows).withColumn("s", F.sha2("kept_text", 256))
    got = {r.doc_id: (r.n_words, r.n_removed, r.s) for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == S.brute_force(texts)
    assert [got[i][1] for i in range(len(texts))] == [35, 0, 0, 0, 0, 0, 35]


def test_the_automata_do_the_locating(monkeypatch):
    """Without an automaton a shard locates nothing; passages kept once are found in every segment that holds them."""
    import pyarrow as pa

    w = [f"w{i}" for i in range(80)]
    segments = pa.table({"anchor": [1] * 3, "salts": pa.array([1] * 3, pa.int32()), "copies": [1] * 3, "start": pa.array([0, 100, 7], pa.int32()), "text_key": [b"a", b"b", b"c"], "segment": [" ".join(w[:60]), " ".join(w[5:50]), " ".join(w[20:])]})
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    passages = S._passages(35)(segments, none)
    assert sorted(passages["passage"].to_pylist()) == sorted([" ".join(w[5:50]), " ".join(w[20:60])])
    located = S._locate(35)(segments, passages)
    assert located.to_pylist() == [{"text_key": b"a", "spans": [5, 60]}, {"text_key": b"b", "spans": [100, 145]}, {"text_key": b"c", "spans": [7, 47]}]
    monkeypatch.setattr(S, "compiled", lambda passages, window: None)
    assert S._locate(35)(segments, passages).num_rows == 0
