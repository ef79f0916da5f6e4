import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessara.functions import text as T
from tessara.plans.catalog_queries import QUERIES
from tessara.retrieval import chunking, cli, dense, evaluate, fusion, harness, hnsw, lexical, rag, retrievers
from tessara.retrieval.lexical import Bm25
from tessara.retrieval.retrievers import build_index
from tessara.session import staged
from tessara.sources import jsonl

DOCS = [("d1", "The quick brown fox jumps over the lazy dog."), ("d2", "A lazy dog sleeps all day. Dogs like sun."), ("d3", "Quantum computing uses qubits and superposition."), ("d4", "Foxes hunt at night; the fox is quick."), ("d5", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


def tokens(t):
    return re.findall(r"[a-z0-9]+(?:[-_'][a-z0-9]+)*", t.lower())


def test_bm25(spark, docs):
    index = Bm25.fit(docs.withColumnRenamed("doc_id", "chunk_id"))
    queries = spark.createDataFrame([("q1", "quick fox fox"), ("q2", "nothing here matches zebra"), ("q3", "Lazy")], "query_id string, query string")
    n, lengths = len(DOCS), {i: len(tokens(t)) for i, t in DOCS}
    average = sum(lengths.values()) / n

    def score(q, text, i):
        out = 0.0
        for term in set(tokens(q)):
            df, tf = sum(term in tokens(t) for _, t in DOCS), tokens(text).count(term)
            if tf:
                out += max(0, math.log((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[i] / average)) * tokens(q).count(term)
        return out

    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in index.search(queries, 2).collect()}
    for q, text in (("q1", "quick fox fox"), ("q3", "Lazy")):
        want = sorted(((i, score(text, t, i)) for i, t in DOCS if score(text, t, i)), key=lambda x: (-x[1], x[0]))[:2]
        for k, (i, s) in enumerate(want, 1):
            assert got[q, k][0] == i and abs(got[q, k][1] - s) < 1e-9
    assert not any(q == "q2" for q, _ in got)
    parts = {r.term: r.score for r in index.explain("quick zebra fox", "d4").collect()}
    assert parts["zebra"] == 0 and abs(sum(parts.values()) - score("quick zebra fox", DOCS[3][1], "d4")) < 1e-9
    assert index.document_frequency("FOX") == 2 and index.vocabulary_size() == len({t for _, x in DOCS for t in tokens(x)})
    with pytest.raises(KeyError):
        index.explain("fox", "nope")
    for bad in ({"k1": -1}, {"b": 2}):
        with pytest.raises(ValueError):
            Bm25.fit(docs.withColumnRenamed("doc_id", "chunk_id"), **bad)
    with pytest.raises(ValueError):
        Bm25.fit(docs.union(docs).withColumnRenamed("doc_id", "chunk_id"))


def test_bm25_top_k_makes_no_pairs(spark, capsys, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 12))) for _ in range(200)]
    texts += texts[:100]  # copies tie, and go by id
    rows = [(f"c{i}", t) for i, t in enumerate(texts)]
    asked = [(i % 5 if i else None, " ".join(r.choices([*words, "none"], k=4))) for i in range(9)]  # rows of one id are one query
    for name, n in (("QUERY_BLOCK", 2), ("CHUNKS", 7), ("PAIRS", 50)):
        monkeypatch.setattr(lexical, name, n)
    index = Bm25.fit(spark.createDataFrame(rows, "chunk_id string, text string").repartition(5))
    found = index.search(spark.createDataFrame(asked, "query_id long, query string"), 6)
    df = {w: sum(w in tokens(t) for t in texts) for w in words}
    average, want, parts = sum(len(tokens(t)) for t in texts) / len(texts), {}, {}
    for q in {i for i, _ in asked}:
        named = tokens(" ".join(t for i, t in asked if i == q))
        for c, t in rows:
            tf = {w: tokens(t).count(w) for w in set(named) if w in tokens(t)}
            for w, n in tf.items():
                parts[q, c, w] = math.log((300 - df[w] + 0.5) / (df[w] + 0.5) + 1) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(tokens(t)) / average)) * named.count(w)
            if tf:
                want.setdefault(q, []).append((-round(sum(parts[q, c, w] for w in tf), 9), c))
    assert {(x.query_id, x.rank): (-round(x.score, 9), x.chunk_id) for x in found.collect()} == {(q, i): x for q, xs in want.items() for i, x in enumerate(sorted(xs)[:6], 1)}
    got = {(x.query_id, x.chunk_id, x.term): x.score for x in index.contributions(spark.createDataFrame(asked, "query_id long, query string")).collect()}
    assert got.keys() == parts.keys() and all(abs(got[k] - v) < 1e-12 for k, v in parts.items())
    assert index.search(spark.createDataFrame([], "query_id long, query string"), 6).count() == 0
    capsys.readouterr()
    found.explain()
    assert "Aggregate" not in capsys.readouterr().out


def test_text_kernels(spark):
    row = spark.createDataFrame([("Dr. No said: The cat's well-known. See [2] and [1], [2].\n\n\n\nA  b ",)], "t string").select(
        T.tokenize(F.col("t"), True).alias("tok"), T.citations(F.col("t")).alias("c"), T.sentences(F.col("t")).alias("s"), T.normalize_whitespace(F.col("t")).alias("w"), T.answer_words(F.lit("The Cat, an owl!")).alias("a"), T.char_ngrams(F.lit("Ab  c"), 3).alias("g"), T.char_ngrams(F.lit("ab"), 3).alias("none"),
    ).first()
    assert row.tok[:4] == ["dr", "no", "said", "cat's"] and row.c == [2, 1] and row.s[0] == "Dr." and row.w.endswith("[2].\n\nA b") and row.a == ["cat", "owl"] and row.g == ["ab ", "b c"] and row.none == []


def test_char_ngrams_of_odd_texts(spark, capsys):
    r = random.Random(2)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for letters in ("aB \n", "ab\u00e9\t ", "\u4e00\uffffx ", "\U0001f600a \U0010fffd") for _ in range(12)] + ["", "abc", "abcd", "\U0001f600" * 5, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {i: t if t is None else re.sub(r"[\t\n\x0b\f\r ]+", " ", t.lower()) for i, t in enumerate(texts)}
    for n in (1, 4, 5):
        grams = {i: t if t is None else [t[k : k + n] for k in range(len(t) - n + 1)] for i, t in clean.items()}
        assert {x.doc_id: x.g for x in df.select("doc_id", T.char_ngrams(F.col("text"), n).alias("g")).collect()} == grams
        assert {x.doc_id: (x.n, x.different) for x in T.char_ngram_counts(df, "doc_id", n).collect()} == {i: (len(g or []), None if g is None else len(set(g))) for i, g in grams.items()}
    capsys.readouterr()
    df.select(T.char_ngrams(F.col("text"), 4)).explain()
    assert "lambda" not in capsys.readouterr().out  # nothing is interpreted for each character


def fixed(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if text[start:end].strip():
            out.append((start, end))
        if end == len(text):
            break
        start += size - overlap
    return out


def test_chunking(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab cdé. \n\n,;") for _ in range(r.randint(0, 300))) for _ in range(60)] + ["", "   ", "x" * 130, None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for size, overlap in ((40, 10), (25, 0), (7, 6)):
        for strategy in ("fixed", "recursive"):
            chunks = chunking.chunk_documents(df, strategy, size, overlap).collect()
            for c in chunks:
                t = texts[int(c.doc_id)]
                assert t[c.start : c.end] == c.text and c.text.strip() == c.text != "" and c.chunk_id == f"{c.doc_id}::{c.ordinal}"
                assert strategy == "recursive" or len(c.text) <= size
        by = {}
        for c in chunking.fixed_windows(df, size, overlap).collect():
            by.setdefault(int(c.doc_id), []).append((c.ordinal, c.text))
        for i, t in enumerate(texts):
            want = [t[a:b].strip() for a, b in fixed(t or "", size, overlap)]
            assert [x for _, x in sorted(by.get(i, []))] == want
    spans = chunking.recursive_spans("One two. Three four. Five six seven eight.", 20, 5)
    assert all(b - a <= 25 for a, b in spans) and spans[0][0] == 0
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.fixed_windows(df, *bad)
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, "nope")


def test_nearest(spark, monkeypatch):
    rng = np.random.RandomState(0)
    x = rng.randn(300, 8)
    x[5] = 0
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", [float(v) for v in x[i]]) for i in range(7)], "query_id string, embedding array<float>")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    x = x.astype(np.float32).astype(float)
    for metric in dense.METRICS:
        got = {}
        for r in dense.nearest(queries, vectors, 4, metric).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for i in range(7):
            s = {"dot": x @ x[i], "l2": -np.linalg.norm(x - x[i], axis=1), "cosine": (x @ x[i]) / np.where((n := np.linalg.norm(x, axis=1) * np.linalg.norm(x[i])) == 0, 1, n)}[metric]
            mine = sorted(got[f"q{i}"])
            assert np.allclose([v for _, _, v in mine], np.sort(s)[::-1][:4], atol=1e-6) and np.allclose(s[[v for _, v, _ in mine]], [v for _, _, v in mine], atol=1e-6)
    exact = dense.nearest(queries, vectors, 5)
    near = dense.nearest_lsh(queries, vectors, 5, tables=24, bits=3)
    assert dense.recall(near, exact).agg(F.avg("recall")).first()[0] >= 0.9
    with pytest.raises(ValueError):
        dense.nearest(queries, vectors, 0)


def test_embedder(spark, docs):
    embedder = dense.HashingEmbedder(dim=32).fit_idf(docs.select("text"))
    got = {r.doc_id: np.array(r.embedding) for r in embedder.embed(docs, "doc_id").collect()}
    feats = {i: dense.features(t) for i, t in DOCS}
    for i, t in DOCS:
        v = np.zeros(32)
        for f in set(feats[i]):
            at, sign = dense.bucket(f, 32, 0)
            v[at] += sign * (1 + math.log(feats[i].count(f))) * math.log(1 + 5 / (1 + sum(f in x for x in feats.values())))
        n = np.linalg.norm(v)
        assert np.allclose(got[i], v / (n or 1), atol=1e-6), t


def test_fusion(spark):
    rows = [("q", "a", 1, "x", 9.0), ("q", "a", 2, "y", 5.0), ("q", "a", 3, "z", 1.0), ("q", "b", 1, "y", 0.5), ("q", "b", 2, "w", 0.5)]
    df = spark.createDataFrame(rows, "query_id string, source string, rank int, chunk_id string, score double")
    got = {r.chunk_id: (r.rank, r.score) for r in fusion.reciprocal_rank_fusion(df, 10).collect()}
    assert got["y"][0] == 1 and abs(got["y"][1] - (1 / 62 + 1 / 61)) < 1e-12
    assert {r.chunk_id for r in fusion.reciprocal_rank_fusion(df, 10, weights={"b": 0.0}).collect()} == {"x", "y", "z"}
    got = {r.chunk_id: r.score for r in fusion.weighted_fusion(df, 10, {"a": 2.0}).collect()}
    assert got == {"x": 2.0, "y": 2.0, "z": 0.0, "w": 1.0}
    z = {(r.source, r.chunk_id): r.score for r in fusion.normalized(df, "zscore").collect()}
    assert z["b", "y"] == 0 and abs(z["a", "x"] - 4 / np.std([9, 5, 1])) < 1e-9
    assert fusion.overlap(df).first().overlap == 0.25
    for call in (lambda: fusion.reciprocal_rank_fusion(df, rrf_k=-1), lambda: fusion.normalized(df, "no"), lambda: fusion.weighted_fusion(df, weights={"a": -1})):
        with pytest.raises(ValueError):
            call()


def test_metrics(spark):
    ranking = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "c"), ("q3", 1, "a"), ("q4", 1, "a")], "query_id string, rank int, doc_id string")
    labels = spark.createDataFrame([("q1", "b", 2.0), ("q1", "c", 1.0), ("q1", "z", 1.0), ("q2", "a", 1.0), ("q3", "a", 1.0)], "query_id string, doc_id string, gain double")
    got = {r.query_id: r for r in evaluate.outcomes(ranking, labels, (1, 3)).collect()}
    assert set(got) == {"q1", "q2", "q3"}
    q = got["q1"]
    assert (q["recall@1"], q["precision@3"], q["hit@3"], q["rr"]) == (0.0, 2 / 3, 1.0, 0.5) and abs(q["recall@3"] - 2 / 3) < 1e-12
    assert abs(q["ap"] - (1 / 2 + 2 / 3) / 3) < 1e-12
    assert abs(q["ndcg@3"] - (2 / math.log2(3) + 1 / 2) / (2 + 1 / math.log2(3) + 1 / 2)) < 1e-12
    assert got["q2"]["rr"] == 0 and got["q3"]["ap"] == 1
    assert evaluate.means(evaluate.outcomes(ranking, labels)).first().queries == 3
    assert {r.query_id for r in evaluate.failures(evaluate.outcomes(ranking, labels, (1,)), "recall@1").collect()} == {"q1", "q2"}
    with pytest.raises(ValueError):
        evaluate.failures(evaluate.outcomes(ranking, labels, (1,)), "recall@7")
    p = evaluate.percentiles(spark.range(1, 5).withColumn("v", F.col("id").cast("double")), "v").first()
    assert (p.p50, p.p95, p["mean"], p["max"]) == (2, 4, 2.5, 4)
    f = spark.range(1).select(evaluate.token_f1(F.lit("the cat cat sat"), F.lit("a cat sat down")).alias("f"), evaluate.exact_match(F.lit("The cat!"), F.lit("cat")).alias("m"), evaluate.token_f1(F.lit(""), F.lit("the")).alias("e"), evaluate.groundedness(F.lit("This sentence is taken from the text. Not this one at all, which is new."), F.lit("Indeed this sentence is taken from the text, yes.")).alias("g")).first()
    assert abs(f.f - 2 * 2 / 6) < 1e-12 and f.m == 1 and f.e == 1 and f.g == 0.5
    configs = evaluate.outcomes(ranking, labels).withColumn("config", F.lit("a")).unionByName(evaluate.outcomes(ranking.filter("rank > 1"), labels).withColumn("config", F.lit("b")))
    rows = {r.config: r for r in evaluate.compare(configs, "rr").collect()}
    assert rows["a"].best and not rows["b"].best and rows["a"].spread > 0


def test_rag(spark):
    ranked = spark.createDataFrame([("q", 1, "c1", "Cats purr when happy. Dogs bark."), ("q", 2, "c2", "Fish swim. Cats like fish."), ("q", 3, "c3", "x" * 50), ("q", 4, "c4", "late")], "query_id string, rank int, chunk_id string, text string")
    questions = spark.createDataFrame([("q", "Do cats like fish?"), ("none", "What?")], "query_id string, question string")
    assert [r.chunk_id for r in rag.packed(ranked, 80).orderBy("rank").collect()] == ["c1", "c2"]
    got = {r.query_id: r for r in rag.answers(questions, ranked, most=2, budget=80).collect()}
    assert got["q"].answer == "Fish swim. Cats like fish." or got["q"].answer == "Cats purr when happy. Cats like fish."
    assert got["q"].citations == ["c1", "c2"] and got["none"].answer == rag.REFUSAL and got["none"].citations == []


def test_hybrid_and_jsonl(spark, docs, tmp_path):
    index = build_index(docs, size=60, overlap=10, dim=64)
    queries = spark.createDataFrame([("q1", "quantum qubits"), ("q2", "lazy dog")], "query_id string, query string")
    for method in ("rrf", "minmax", "zscore"):
        top = {r.query_id: r.chunk_id for r in index.hybrid(queries, 3, method).filter("rank = 1").collect()}
        assert top["q1"].startswith("d3") and top["q2"][:2] in ("d1", "d2")
    assert index.status().first().documents == 4
    jsonl.write_jsonl(docs.filter("text <> ''").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v"))), f"{tmp_path}/d")
    jsonl.write_jsonl(spark.createDataFrame([("q", "fox?", ["d1"], {"d4": 2.0})], "query_id string, query string, relevant_doc_ids array<string>, gains map<string,double>"), f"{tmp_path}/q")
    read = jsonl.read_documents(spark, f"{tmp_path}/d")
    labels = jsonl.labels_of(jsonl.read_queries(spark, f"{tmp_path}/q", read))
    assert {(r.doc_id, r.gain) for r in labels.collect()} == {("d1", 1.0), ("d4", 2.0)}
    with pytest.raises(Exception, match="no document"):
        jsonl.read_queries(spark, f"{tmp_path}/q", read.filter("doc_id = 'd1'"))


def test_bm25_reads_texts_once(spark, docs, tmp_path, capsys):
    def noted(batches):
        for b in batches:
            with open(tmp_path / "read", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    index = Bm25.fit(docs.withColumnRenamed("doc_id", "chunk_id").mapInArrow(noted, "chunk_id string, text string"))
    assert (tmp_path / "read").read_text() == "x" * len(DOCS)
    want = {(w, i, len(tokens(t)), tokens(t).count(w)) for i, t in DOCS for w in tokens(t)}
    assert sorted(map(tuple, index.postings.select("term", "chunk_id", "dl", "tf").collect())) == sorted(want)
    parts = index.contributions(spark.createDataFrame([("q", "fox")], "query_id string, query string"))
    assert {(x.chunk_id, x.term) for x in parts.collect()} == {("d1", "fox"), ("d4", "fox")}
    assert (tmp_path / "read").read_text() == "x" * len(DOCS)
    capsys.readouterr()
    parts.explain()
    assert not re.search("Join|Exchange", capsys.readouterr().out)  # postings are not dealt out by term


def test_hybrid_search_keeps_no_index(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    words = [f"word{i}" for i in range(40)]
    spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(0, 90)))) for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(r.choices(words, k=5))) for i in range(9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    monkeypatch.setattr(retrievers, "staged", lambda df, name: kept.append(name) or staged(df, name))
    found = QUERIES["search_hybrid"](spark, str(tmp_path))
    once = sorted(map(tuple, found.collect()))
    assert kept == ["chunks"] and len(once) == 90
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, QUERIES["search_hybrid"](spark, str(tmp_path)).collect())) == once and "vectors" in kept


def test_sweep_and_command_line(spark, docs, tmp_path):
    rows = [("q1", "quantum qubits", ["d3"], None), ("q2", "lazy dog", ["d1", "d2"], {"d2": 3.0}), ("q3", "unlabelled", [], None)]
    queries = spark.createDataFrame(rows, "query_id string, query string, relevant_doc_ids array<string>, gains map<string,double>")
    jsonl.write_jsonl(docs.filter("text <> ''"), f"{tmp_path}/d")
    jsonl.write_jsonl(queries, f"{tmp_path}/q")
    outcomes = harness.sweep(docs, queries, jsonl.labels_of(queries), 2, 32, chunkings=((60, 10),), weights=((1.0, 1.0),))
    assert {(r.config, r.queries) for r in harness.summary(outcomes).collect()} == {(c, 2) for c in ("vectors/60", "terms/60", "both/60/1:1")}
    options = ["--corpus", f"{tmp_path}/d", "--dim", "32"]
    assert "recall@2" in cli.run(spark, ["eval", *options, "--queries", f"{tmp_path}/q", "-k", "2", "--retriever", "lexical"])
    assert "d3::0" in cli.run(spark, ["search", *options, "qubits"])
    assert "[1] " in cli.run(spark, ["ask", *options, "--show-prompt", "What do qubits do in quantum computing?"])
    with pytest.raises(ValueError):
        harness.retriever(None, "nope")


def test_layered_graphs(spark):
    rng = np.random.RandomState(7)
    centres = rng.randn(12, 16) * 3
    x = np.stack([centres[i % 12] + 0.5 * rng.randn(16) for i in range(600)])
    frame = lambda lo, hi: spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(lo, hi)] + [(9999 + lo, None)], "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i % 10, [float(v) for v in x[i * 17]]) for i in range(20)] + [(None, [0.1] * 16), (3, None)], "query_id long, embedding array<float>")
    for metric in hnsw.METRICS:
        index = hnsw.build(frame(0, 600), metric, shard_rows=250)
        found = hnsw.search(queries, index, 10, metric=metric)
        exact = dense.nearest(queries, frame(0, 600), 10, metric)
        got, want = ({(r.query_id, r.vec_id, r.score) for r in f.collect()} for f in (found, exact))
        assert found.count() == 210 and len(got & want) >= 0.9 * len(want)
    shards = {r.shard: r for r in hnsw.statistics(index).collect()}
    assert len(shards) == 3 and sum(r.nodes for r in shards.values()) == 600 and all(r.layers >= 2 and r.links >= 8 for r in shards.values())
    assert found.agg(F.max("compared")).first()[0] < 3 * 600
    part = hnsw.build(frame(0, 400))
    both = hnsw.add(part, frame(400, 600), "later")
    near = dense.recall(hnsw.search(queries.limit(8).withColumn("query_id", F.monotonically_increasing_id()), both, 5), dense.nearest(queries.limit(8).withColumn("query_id", F.monotonically_increasing_id()), frame(0, 600), 5))
    assert near.agg(F.avg("recall")).first()[0] >= 0.9
    empty = hnsw.build(frame(0, 0))
    assert empty.count() == 0 and hnsw.search(queries, empty, 5).count() == 0
    for bad in ({"metric": "taxi"}, {"m": 1}):
        with pytest.raises(ValueError):
            hnsw.build(frame(0, 3), **bad)


def test_repeated_and_null_query_ids_are_all_answered(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    x = np.random.RandomState(1).randn(30, 4)
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(v) for v in x[k]]) for k, i in enumerate([None] * 5 + [1, 1, 1, 1, 1, 2])], "query_id long, embedding array<float>")
    got = dense.nearest(queries, vectors, 2).collect()
    assert len(got) == 22 and sorted(r.vec_id for r in got if r.rank == 1) == list(range(11))


def test_hyperplanes_find_nine_in_ten(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense.recall(dense.nearest_lsh(queries, vectors, 10), dense.nearest(queries, vectors, 10))
    assert found.agg(F.avg("recall")).first()[0] >= 0.9


def test_generators_and_data_set_sink(spark, tmp_path):
    ranked = spark.createDataFrame([("q", 1, "c1", "Rivers flow to the sea."), ("q", 2, "c2", "Mountains are high.")], "query_id string, rank int, chunk_id string, text string")
    questions = spark.createDataFrame([("q", "Where do rivers flow?")], "query_id string, question string")
    assert rag.answers(questions, ranked, generate=rag.Echo("same")).first().answer == "same"
    assert rag.answers(questions, ranked).first().answer == rag.answers(questions, ranked, generate=rag.Extractive(3)).first().answer
    docs = spark.createDataFrame([("b", "text b", {"title": "B"}), ("a", "text a", None)], jsonl.DOCUMENTS)
    queries = spark.createDataFrame([("q1", "what", ["b", "a"], None, None), ("q2", "who", ["a"], {"a": 2.0}, "x")], jsonl.QUERIES)
    jsonl.write_dataset(docs, queries, f"{tmp_path}/set")
    back = jsonl.read_documents(spark, f"{tmp_path}/set/corpus.jsonl")
    assert sorted(r.doc_id for r in back.collect()) == ["a", "b"]
    asked = {r.query_id: r for r in jsonl.read_queries(spark, f"{tmp_path}/set/queries.jsonl", back).collect()}
    assert asked["q1"].relevant_doc_ids == ["a", "b"] and asked["q2"].gains == {"a": 2.0}


def test_a_part_keeps_the_digit_of_its_place(spark):
    said = "".join(f"{i % 10} is {i % 10}. " for i in range(25)) + " End. "
    row = spark.createDataFrame([(said,)], "t string").select(T.sentences(F.col("t")).alias("s"), evaluate.groundedness(F.col("t"), F.col("t")).alias("g")).first()
    assert row.s == [f"{i % 10} is {i % 10}." for i in range(25)] + ["End."] and row.g == 1


def test_configurations_are_averaged_once(spark, capsys):
    """A mean that is taken twice may differ from itself in its last bits, and no configuration is best then."""
    scored = spark.range(100).select((F.col("id") % 3).alias("config"), (F.col("id") / 7).alias("score"))
    evaluate.compare(scored, "score").explain()
    assert capsys.readouterr().out.count("Range (") == 1
    rows = {r.config: r for r in evaluate.compare(scored, "score").collect()}
    assert [c for c, r in rows.items() if r.best] == [2] and abs(rows[0].spread - 1 / 7) < 1e-12


def test_neighbour_searches_make_no_pairs(spark, capsys):
    x = np.random.RandomState(2).randint(0, 3, (400, 6)).astype(float)  # many ties
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    queries = vectors.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    near = dense.nearest_lsh(queries, vectors, 5, tables=40, bits=1)
    near.explain()
    assert "Join" not in capsys.readouterr().out
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in dense.nearest(queries, vectors, 5).collect()}
    s, v = np.round(x[:20] @ x.T), np.broadcast_to(np.arange(400), (20, 400))
    got = dense._best(s, v, 7)
    assert all(got[1][i].tolist() == sorted(range(400), key=lambda j: (-s[i, j], j))[:7] for i in range(20))


def test_rare_features_find_their_idf(spark, docs, monkeypatch):
    """Whether a feature's idf is known to every task or comes from the table, the vectors are the same."""
    want = {r.doc_id: r.embedding for r in dense.HashingEmbedder(dim=16).fit_idf(docs).embed(docs, "doc_id").collect()}
    for frequent, held in ((0, 1), (5, 3)):
        monkeypatch.setattr(dense, "FREQUENT", frequent)
        monkeypatch.setattr(dense, "HELD", held)
        got = {r.doc_id: r.embedding for r in dense.HashingEmbedder(dim=16).fit_idf(docs).embed(docs, "doc_id").collect()}
        assert all(np.allclose(got[i], v, atol=1e-6) for i, v in want.items())


def test_contributions_leave_python_once_for_all_queries(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"cat cat w{i} dog" if i % 2 else f"w{i} dog") for i in range(8)], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, "cat cat w3" if i % 3 else "cat none") for i in range(30)], "query_id long, query string")
    index = Bm25.fit(chunks)
    (block,) = index._blocks(queries)
    # Of cat, named once or twice, two uses in four chunks; of w3 one use in one.
    assert sum(b.num_rows for b in block.shared(index.index.toArrow().to_batches())) == 9
    got = {(r.query_id, r.chunk_id, r.term): r.score for r in index.contributions(queries).collect()}
    once = {r.term: r.score for r in index.explain("cat w3", "c3").collect()}
    want = {(i, f"c{k}", "cat") for i in range(30) for k in (1, 3, 5, 7)} | {(i, "c3", "w3") for i in range(30) if i % 3}
    assert got.keys() == want
    assert got[0, "c3", "cat"] == once["cat"] and got[1, "c3", "cat"] == 2 * once["cat"] and got[1, "c3", "w3"] == once["w3"]
    assert {r.score for r in index.contributions(queries, 3).collect()} == {round(x, 3) for x in got.values()}
    assert index.contributions(queries.filter("query = ''")).count() == 0
    assert index.contributions(spark.createDataFrame([(1, "none")], queries.schema)).count() == 0
