import random

from pyspark.sql import functions as F

from tessara.llm import minhash_dedup as M
from tessara.session import staged


def near_texts(seed):
    r = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(500)] + [f"Up{i}" for i in range(50)]
    texts: list[str | None] = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([6, 20, 60, 200]))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(r.choice([" ", "\n"]).join(w))
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join(chain[k : k + 50]) for k in range(10)]  # each near its neighbours only
    texts += [None, "", " \n", "one", "ONE", "one two", "One two", "one two three", texts[0], texts[0].upper(), " ".join(r.choice(vocab) for _ in range(20000))]
    return texts


def test_against_brute_force(spark):
    for n in (4, 5):
        texts = near_texts(n)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("root", F.lit("x"))
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, n=n).collect()}
        want = M.brute_force(list(enumerate(texts)), n)
        assert got == {i: (a, b, i == b) for i, (a, b) in want.items()}


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "SHARD_ROWS", 16)
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"x{r.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, n=4).collect()}
    want = M.brute_force(list(enumerate(texts)), 4)
    assert got == want and 3 < len({c for _, c in want.values()}) < 140


def test_edges(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (9, None)], "doc_id long, text string")
    got = sorted(M.near_duplicates(df, n=4).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(None, 5, 5, False), (5, 5, 5, True), (5, 5, 5, True), (9, 0, 9, True)], key=lambda r: str(M_row(r)))
    assert M.near_duplicates(df.limit(0)).collect() == []


def M_row(r):
    from pyspark.sql import Row

    return Row(doc_id=r[0], n_shingles=r[1], component_id=r[2], kept=r[3])


def test_floors():
    floors = M.posterior_floors(0.8, 1e-6)
    assert len(floors) == 4 and floors == sorted(floors) and floors[-1] < 0.8 * 128


def morse(n, a="a", b="b"):
    """Two of these, with a and b swapped, have one value under every polynomial hash modulo 2**64."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    texts = [t for n in (1024, 2048, 4096) for t in (morse(n), morse(n, "b", "a"), f"x {morse(n)} y z q", f"x {morse(n, 'b', 'a')} y z q")]
    pair = lambda a, b: " ".join((a, b)[bin(i).count("1") % 2] for i in range(2048))
    texts += [pair("alpha", "beta"), pair("beta", "alpha"), pair("alpha", "gamma")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, n=4).collect()}
    assert got == M.brute_force(list(enumerate(texts)), 4)


def test_small_tables_are_not_spread_over_all_shuffle_partitions(spark, monkeypatch):
    files = {}

    def counted(df, name, *rows):
        out = staged(df, name, *rows)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(M, "staged", counted)
    texts = near_texts(3)
    # As on the check tool's check_h: many shuffle partitions, none of them merged.
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == M.brute_force(list(enumerate(texts)), 5)
    assert {files[k] for k in ("nodes", "members", "texts", "edges", "large", "rooted", "blocks")} == {1}
