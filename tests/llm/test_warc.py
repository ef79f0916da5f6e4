import gzip
import hashlib

from tessara.llm import warc


def test_round_trip(spark, tmp_path):
    big, crlf = "<p>é" * 60, "a\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(3, "http://x", big), (1, "http://y\nz", big), (2, None, big), (4, "u", crlf), (5, "u", crlf), (6, "u", "x"), (7, "u", "x"), (8, "u", None), (9, "u", ""), (None, "u", crlf), (None, "u", "only " * 50), (1, "again", big), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url").selectExpr("*", "1 as digest", "2 as payload", "3 as key")
    warc.write_archives(df, f"file://{tmp_path}/w", per_file=3)
    parts = sorted((tmp_path / "w").glob("part-*.gz"))
    assert len(parts) > 1 and all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n") for p in parts)
    got = sorted((tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()), key=str)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        o = first.get(b)
        revisit = o is not None and o != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", o if revisit else None))
    assert got == sorted(want, key=str)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").collect() == []


def record(kind, page, block, **fields):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{page}>", f"Page-Id: {page}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_members_orphans_and_torn_archives(spark, tmp_path):
    body = lambda x: b"HTTP/1.1 200 OK\r\n\r\n" + x
    sha = lambda x: hashlib.sha256(x).hexdigest()
    one, two = record("response", 1, body(b"one")), record("response", 2, body(b""))
    info = record("warcinfo", 90, b"software: x")
    known = record("revisit", 3, body(b""), WARC_Refers_To="<1>", Refers_To_Page_Id=1)
    orphan = record("revisit", 4, body(b""), WARC_Refers_To="<77>", Refers_To_Page_Id=77, WARC_Payload_Digest="sha256:abc")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (info, one, two))))  # one member for each record
    (tmp_path / "b.warc").write_bytes(known + orphan)
    (tmp_path / "c.warc").write_bytes(record("response", 5, body(b"five")) + one[:-6])
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(record("response", 6, body(b"six"))) + gzip.compress(two)[:9])
    (tmp_path / "e.warc").write_bytes(b"no archive at all")
    (tmp_path / "f.warc").write_bytes(b"")
    got = sorted((tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()), key=str)
    want = [(i, len(x), sha(x), "response", None) for i, x in ((1, b"one"), (2, b""), (5, b"five"), (6, b"six"))]
    want += [(3, 3, sha(b"one"), "revisit", 1), (4, None, "abc", "revisit", 77)] + [(None, None, None, "torn", None)] * 3
    assert got == sorted(want, key=str)


def test_long_pages_and_payloads_stay_where_they_are(spark, tmp_path):
    long = "<p>" + "long page " * 400_000
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", long + "x")], "page_id long, url string, html string")
    plan = warc.with_originals(df)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    warc.write_archives(df, f"file://{tmp_path}/w")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {1: (len(long), "response", None), 2: (len(long), "revisit", 1), 3: (len(long) + 1, "response", None)}
