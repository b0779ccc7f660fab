"""WARC archives with revisit resolution.

Headers (id, digest, size; never the payload) are grouped by payload digest; within a
digest the smallest id is the response and every other record a revisit that refers
to it.  Archives are written by Spark's own writers, so any store that Spark writes
will do, and read back by parsing records by their declared length.

Files are plain WARC 1.1: the text writer's line separator is the blank line pair that
ends a record, and a payload's bytes pass through unchanged.

Defined results
    a null payload is empty; payloads smaller than ``least_bytes`` are always
    responses; a null id is a response and refers to nothing; rows that repeat an id
    and payload are responses each; line breaks in a url are dropped; an empty table
    gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.runtime import new_path, small_batches, spread_join, stash, table

#: Bytes of payload after which a new archive file begins, on average, and payloads from
#: which on pages are written apart, so that no file outgrows what can be read as one.
FILE_BYTES, LARGE_BYTES, MOST_BYTES = 32 << 20, 1 << 20, 1 << 30
#: Revisits broadcast to the writers; beyond it the same join is shuffled.
BROADCAST_REVISITS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are eight groups of 20 bits."""
    digest = F.sha1(payload)
    groups = (F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8))
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, payload_digest, refers_to, original_url)`` of the revisits among
    rows ``(page_id, url, payload_digest, payload_bytes)``."""
    heads = pages.where(f"payload_bytes >= {least_bytes} AND page_id IS NOT NULL")
    firsts = heads.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = stash(firsts.where("copies > 1"), "firsts")
    met = spread_join(heads.select("page_id", "payload_digest", "payload_bytes"), firsts, ["payload_digest", "payload_bytes"], "copies").where("page_id <> first.page_id")
    return met.select("page_id", "payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("original_url")).distinct()


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    parts = (F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, revisits: DataFrame, date: str) -> DataFrame:
    """One string column: the whole record of each page, without its closing lines."""
    rows = pages.join(revisits, ["page_id", "payload_digest"], "left")
    again = F.col("refers_to").isNotNull()

    def clean(c):
        return F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]+", "")

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    refers = F.concat(
        line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))), line("WARC-Refers-To-Target-URI", clean(F.col("original_url"))),
        line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(PROFILE)), line("Refers-To-Page", F.col("refers_to").cast("string")),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean(F.col("url"))),
        F.when(F.col("page_id").isNotNull(), line("Page", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.when(again, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit(CRLF),
    )
    return rows.select(F.concat(head, http, body).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", date: str | None = None) -> None:
    """Write a record per row of ``pages`` to WARC files in the folder ``path``."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).cast("string")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    heads = stash(rows.select("page_id", "url", "payload_digest", "payload_bytes"), "headers")
    revisits = stash(resolve(heads, least_bytes), "revisits")
    revisits = F.broadcast(revisits) if revisits.count() <= BROADCAST_REVISITS else revisits
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    large = F.col("payload_bytes") > LARGE_BYTES
    sizes = {r.large: r for r in heads.groupBy(large.alias("large")).agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("size"), F.max("payload_bytes").alias("most")).collect()}
    for apart in (False, True):
        if apart and apart not in sizes:
            continue
        n, size, most = (sizes[apart][c] for c in ("n", "size", "most")) if apart in sizes else (1, 0, 0)
        per_file = max(1, min(FILE_BYTES * n // (size + 600 * n), MOST_BYTES // (most + 4096)))
        part = rows.where(large if apart else ~large)
        records(part, revisits, date).write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", int(per_file)).text(path)


def parse(data: bytes):
    """``(headers, block)`` of each record of an archive, by declared length."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
        begin = end + 4
        at = begin + int(headers["content-length"])
        yield headers, data[begin:at]
        at += 4


def _read(batches):
    for batch in batches:
        columns = [[] for _ in range(7)]
        for data in batch.column(0).to_pylist():
            for h, block in parse(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                declared = h.get("warc-payload-digest", "").removeprefix("sha1:")
                if h["warc-type"] == "revisit":
                    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = declared
                else:
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                page, refers = h.get("page"), h.get("refers-to-page")
                row = (page and int(page), h.get("warc-target-uri"), h["warc-type"], size, digest, refers and int(refers), digest == declared)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def read_archives(spark, path: str) -> DataFrame:
    """A row per record of the archives in ``path`` (``SCHEMA``)."""
    small_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_read, SCHEMA)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
