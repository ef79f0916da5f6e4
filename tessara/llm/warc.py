"""WARC archives with revisit resolution.

Headers (page_id, digest) are shuffled by payload digest to elect each payload's
original, the smallest page_id; records with that payload join it and become
revisit records without a payload.  The headers of revisits are written as a
table, so that its true size decides how pages learn of them: below the
broadcast threshold payloads are not shuffled at all, above it once.

Archives are written by Spark's text writer: the record separator of WARC is its
line separator, so the files are plain WARC, and they live in any store that
Spark reaches.  Reading parses record by record by Content-Length, from plain
files and from gzip files of one or many members, and joins revisits back to
their originals.

Defined cases: null html is an empty payload; payloads under `least` bytes are
always responses; rows that share the smallest page_id of a payload are all
responses; a null page_id is a revisit if some other row has an id, else a
response; a null url becomes urn:unknown; line breaks in urls are escaped; an
empty table gives empty archives; other columns are ignored.  In reading, a
revisit whose original is in none of the archives stays, with a null size and
the digest that its own header states; a torn or foreign record ends its
archive and becomes one row of record_type "torn", whose other columns are null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage_path, staged, table

CRLF = "\r\n"
LEAST = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id, digest):
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with payload, size, digest, record_type and original (the page_id that a revisit refers to)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    headers = p.filter(F.col("size") >= least).select("page_id", "digest")
    originals = headers.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").drop("n")
    revisits = headers.distinct().join(originals, "digest").filter(~F.col("page_id").eqNullSafe(F.col("original")))
    revisits = staged(revisits.toDF("same_digest", "same_id", "original"), "revisits")
    same = (F.col("digest") == F.col("same_digest")) & F.col("page_id").eqNullSafe(F.col("same_id"))
    record_type = F.when(F.col("original").isNotNull(), "revisit").otherwise("response")
    return p.join(revisits, same, "left").drop("same_digest", "same_id").withColumn("record_type", record_type)


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """value: one WARC record per row, without its closing separator."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    url = F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit("urn:unknown"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.coalesce(line("Page-Id", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("original"), F.col("digest"))), line("Refers-To-Page-Id", F.col("original").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return resolved.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, per_file: int = 4000) -> None:
    """Write deduplicated archives of pages(page_id, url, html) under path, gzip-compressed."""
    records(with_originals(pages, least)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _unzipped(content: bytes) -> tuple[bytes, bool]:
    """What all members of a gzip file hold, and whether one of them is torn."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content) + member.flush())
        except zlib.error:
            return b"".join(out), True
        if not member.eof:
            return b"".join(out), True
        content = member.unused_data.lstrip(b"\0")  # zeros may pad a file
    return b"".join(out), False


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload (after the HTTP header) of every record of a gzip or plain archive; ValueError where one is torn."""
    content, torn = _unzipped(content) if content[:2] == b"\x1f\x8b" else (content, False)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode(errors="replace").split(CRLF)
        fields = dict(x.split(":", 1) for x in lines[1:] if ":" in x)
        size = fields.get("Content-Length", "").strip()
        if end < 0 or not lines[0].startswith("WARC/") or not size.isdigit():
            raise ValueError(f"no WARC record at byte {at}")
        start, stop = end + 4, end + 4 + int(size)
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"torn WARC record at byte {at}")
        block = content[start:stop]
        head = block.find(b"\r\n\r\n")
        yield {k: v.strip() for k, v in fields.items()}, block[head + 4 :] if head >= 0 else b""
        at = stop + 4
    if torn:
        raise ValueError("torn gzip member")


_PARSED = "page_id string, record_id string, record_type string, payload_bytes long, payload_digest string, target string, refers_to string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            try:
                for f, payload in parse_archive(content.as_py()):
                    if f.get("WARC-Type") not in ("response", "revisit"):
                        continue
                    original = f["WARC-Type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if original else f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
                    rows.append((f.get("Page-Id"), f.get("WARC-Record-ID"), f["WARC-Type"], len(payload) if original else None, digest, f.get("WARC-Refers-To"), f.get("Refers-To-Page-Id")))
            except ValueError:
                rows.append((None, None, "torn", None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; revisits take their original's payload."""
    parsed = staged(small_batches(spark.read.format("binaryFile").load(path).select("content")).mapInArrow(_parse, _PARSED), "warc-records")
    revisit = F.col("record_type") == "revisit"
    response = parsed.filter("record_type = 'response'")
    found = response.groupBy(F.col("record_id").alias("target")).agg(F.min("payload_bytes").alias("b"), F.min("payload_digest").alias("d"))
    resolved = parsed.filter(revisit).join(found, "target", "left").withColumn("payload_bytes", F.col("b")).withColumn("payload_digest", F.coalesce("d", "payload_digest"))
    out = [F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type)]
    return parsed.filter(~revisit).select(*out).union(resolved.select(*out))


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """One row per page, as read back from the archives."""
    pages = table(spark, sf_dir, "pages")
    path = stage_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, dict(pages.dtypes)["page_id"])


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m.first IS NULL OR p.page_id IS NOT DISTINCT FROM m.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.first IS NULL OR p.page_id IS NOT DISTINCT FROM m.first THEN NULL ELSE m.first END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 100
"""
