import hashlib
import os

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline as P
from tessara.llm import bpe, minhash_dedup, quality, secrets

SF = "/root/testdata/sf0.001"


def small(tmp_path):
    """200 documents with repeated rows, nulls and long texts, and their labels."""
    docs = pq.read_table(f"{SF}/documents.parquet")
    extra = docs.slice(0, 3).to_pylist() + [{"doc_id": 10**9, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 10**9 + 1, "text": "A good plain sentence, with token = abcdefgh12345 in it, that goes on for a while and then ends.", "lang": "en", "source": None, "n_chars": 3}]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(extra, docs.schema)]), tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), tmp_path / "labels.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    d = small(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before, after = [r.asDict() for r in docs.collect()], stage(spark, docs, d)
        out = os.path.join(d, f"out{k}")
        after.write.parquet(out)
        docs = spark.read.parquet(out)
        rows[name] = (before, [r.asDict() for r in docs.collect()])
        if k < 4:
            assert docs.columns == P.COLUMNS

    before, after = rows["quality rules"]
    passing = [r for r in before if not quality.brute_force(r["text"])[5]]
    assert all(r in passing for r in after) and len(after) > 0.8 * len(passing)

    before, after = rows["MinHash near-dedup"]
    want = minhash_dedup.brute_force([(r["doc_id"], r["text"]) for r in before], 5)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in want.items() if c == i)

    before, after = rows["secret scans"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    assert all(secrets.brute_force(r["text"])[:3] == (0, 0, 0) and r["n_chars"] == len(r["text"]) for r in after)
    assert any("[SECRET]" in r["text"] for r in after)
    same = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == same[r["doc_id"]] for r in after if "[SECRET]" not in r["text"])

    before, after = rows["mixing sources"]
    known = {r["doc_id"]: r for r in before}
    assert after and all(known[r["doc_id"]] == r for r in after)

    before, after = rows["byte-level BPE"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    count = {r["doc_id"]: len(enc.encode_ordinary(r["text"] or "")) for r in before}
    assert len(before) == len(after) and all(r["n_tokens"] == count[r["doc_id"]] for r in after)
    digest = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in before}
    assert all(r["decoded_sha256"] == digest[r["doc_id"]] for r in after)


def test_run(spark, tmp_path):
    got = P.run(spark, small(tmp_path))
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50


def test_near_duplicates_keep_texts_of_null_and_shared_ids(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = lambda k: text(k) + " more"
    rows = [(None, text(k), "en", "a", 1) for k in range(5)] + [(None, near(0), "en", "a", 1)]  # five groups without an id
    rows += [(7, text(10), "en", "a", 1), (7, text(11), "en", "a", 1)]  # two texts under one id
    rows += [(3, text(12), "en", "a", 1), (7, near(12), "en", "a", 1)]  # a near copy under that id
    rows += [(8, text(13), "en", "b", 1), (8, text(13), "en", "a", 1), (None, near(13), "en", "a", 1)]
    rows += [(None, None, None, "a", None), (None, None, None, "b", None), (None, None, None, "b", None), (None, "", None, "b", None), (9, None, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [tuple(r) for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()]
    left = [r for r in got if r[1] in (text(0), near(0))]
    assert len(left) == 1 and left[0][0] is None
    want = rows[1:5] + rows[6:9] + [rows[11]] + rows[13:15] + rows[16:]
    assert sorted([r for r in got if r not in left], key=repr) == sorted(want, key=repr)


def test_empty_tables_and_many_null_ids(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), tmp_path / "labels.parquet")
    pq.write_table(docs.slice(0, 0), tmp_path / "documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
    unnamed = docs.slice(0, 40).set_column(0, "doc_id", pa.nulls(40, pa.int64()))
    pq.write_table(pa.concat_tables([unnamed, docs.slice(40, 40)]), tmp_path / "documents.parquet")
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = P.near_duplicates(spark, whole, str(tmp_path)).collect()
    texts = {r["text"] for r in docs.slice(0, 80).to_pylist()}
    assert len({r.text for r in kept}) > 0.7 * len(texts) and sum(r.doc_id is None for r in kept) > 25
