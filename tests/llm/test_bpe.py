import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessara.llm import bpe

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def oracle(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(2)
    chars = "abcdefg  \n\t'.!?0123456789éßñ中文字🙂́‍\x00"
    return ["".join(r.choice(chars) for _ in range(r.randint(0, 80))) for _ in range(300)] + [None, "", " ", "a" * 5000, " " * 700 + "x", "<|endoftext|>", "it's we'll I'D", "".join(r.choice("abcdefghij") for _ in range(400)), "\r\n\r\n", "é" * 300]


def test_against_the_library_and_round_trip(spark, oracle):
    texts = odd_texts() + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).selectExpr("*", "1 as ids", "2 as n_tokens")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    for i, t in enumerate(texts):
        ids = np.array(oracle.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(df)).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_small_vocabularies(spark):
    """A merge table where a later merge has a smaller rank than its parts, against direct contraction."""
    r = random.Random(3)
    for _ in range(30):
        tokens = {bytes([i]): i for i in range(256)}
        names = list({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(25)})
        r.shuffle(names)
        for i, t in enumerate(names):
            tokens[t] = 256 + i
        codec = bpe.Codec(tokens, r"[a-z]+|\s+")
        texts = ["".join(r.choice("abc") for _ in range(r.choice([1, 5, 30, 100]))) for _ in range(20)]
        ids, at = codec.encode(texts)
        for k, t in enumerate(texts):
            want = [bytes([c]) for c in t.encode()]
            while True:
                found = [(tokens[a + b], i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if a + b in tokens]
                if not found:
                    break
                _, i = min(found)
                want[i : i + 2] = [want[i] + want[i + 1]]
            assert ids[at[k] : at[k + 1]].tolist() == [tokens[w] for w in want]
        with pytest.raises(ValueError):
            codec.decode(np.array([9999], np.uint32), np.array([0, 1]))


def test_cache_starts_over(ranks, oracle):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, cache_words=3)
    for t in ("one two three four", "five six", "one seven"):
        assert codec.encode([t])[0].tolist() == oracle.encode_ordinary(t)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(df).collect() == [] and bpe.encode(df).collect() == []
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert bpe.decode(bpe.encode(nulls).withColumn("ids", F.lit(None).cast("array<int>"))).first().decoded == b""


def contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One leftmost pair of minimum rank after another."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_long_words_of_odd_vocabularies():
    """Merge tables in any order of ranks, where a merge may be followed by one of a smaller rank."""
    r = random.Random(5)
    for trial in range(60):
        letters = "ab" if trial % 3 else "abcd"
        tokens = {"".join(r.choice(letters) for _ in range(r.randint(2, 5 + trial % 7))).encode() for _ in range(r.choice([3, 8, 30, 90]))}
        order = list(range(256, 256 + len(tokens)))
        r.shuffle(order)
        ranks = {bytes([i]): i for i in range(256)} | dict(zip(sorted(tokens), order, strict=True))
        codec = bpe.Codec(ranks, r"\S+")
        for _ in range(4):
            word = "".join(r.choice(letters) for _ in range(r.randint(65, 300)))
            if r.random() < 0.3:
                word = (word[: r.randint(1, 9)] * 300)[:300]
            assert codec.encode([word])[0].tolist() == contract(word.encode(), ranks), (trial, word)


def test_long_random_letters_are_fast(oracle, ranks):
    import time

    r = random.Random(7)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for n, limit in ((20_000, 10), (100_000, 50)):
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        start = time.time()
        assert codec.encode([text])[0].tolist() == oracle.encode_ordinary(text)
        assert time.time() - start < limit
