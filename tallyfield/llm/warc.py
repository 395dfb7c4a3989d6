"""A content-addressed archive of web records.

Two tables hold an archive. ``payloads`` has the bytes of each payload once, under its SHA-256; a second
hash and the length are compared for all rows of one digest, and the write fails if they differ. ``headers``
has the exact header block of each record (the WARC header and the HTTP header) with the digest of its payload.
Joining the two gives back each record byte for byte.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is a response and the
others revisit it; smaller payloads are all responses. Payloads are reduced within each task before they move,
so a payload that a third of the records share moves once per task. The records of a digest that holds over a thousandth of all are dealt out
by a salt, to so many copies of the payload, in all at most a thousand, that none meets more than a thousandth of the records.

Cases: a null page is an empty payload. Rows repeated under the largest id are all responses. A null id counts
as the smallest; records whose ids are all null are responses. A null url leaves its header line out. Line
ends in a url are percent-encoded. Other columns aren't archived. An empty table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import join_hot, land, table


SALT_ROWS = 1000


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame
    headers: DataFrame


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _record_id(page: Column) -> Column:
    h = F.md5(F.coalesce(page.cast("string"), F.lit("")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in (F.lit("-" if i else ""), F.substring(h, a, n))), F.lit(">"))


def write_archive(pages: DataFrame, least: int = 1000) -> Archive:
    """Archive ``pages`` (page_id, url, html) in the shared folder."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("payload")).select("*", F.sha2("payload", 256).alias("sha256"))
    one = rows.select("page_id", "sha256", "payload", F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("second"))
    one = one.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("page_id").alias("last_id"), F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("size", "second") for k, f in (("min", F.min), ("max", F.max))))
    same = (F.col("min_size") == F.col("max_size")) & (F.col("min_second") == F.col("max_second"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("sha256"))).cast("binary"))
    payloads = land(one.select("sha256", checked.alias("payload"), "last_id", "n", F.col("max_size").cast("long").alias("size")), "payloads")
    total = payloads.agg(F.sum("n")).first()[0] or 0
    salts = F.ceil(F.col("n") / max(SALT_ROWS, total / 1000)).cast("long")
    payloads = payloads.withColumn("salts", salts)

    known = payloads.select("sha256", "last_id", "size", "n", "salts")
    small = rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"))
    r = join_hot(small, known, "sha256")
    revisit = (F.col("size") >= least) & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("last_id")))),
        _line("WARC-Refers-To-Page", F.when(revisit, F.col("last_id").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    return Archive(payloads, land(r.select("page_id", "sha256", F.pmod(F.xxhash64("page_id", "url"), "salts").alias("salt"), header.alias("header")), "headers"))


def read_records(archive: Archive) -> DataFrame:
    """Each record: page_id, header, its payload (of a revisit, that of the record it refers to) and ``record``, its exact bytes."""
    salted = archive.payloads.select("sha256", "payload", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    joined = archive.headers.join(salted, ["sha256", "salt"])
    kind = F.regexp_extract("header", r"\r\nWARC-Type: (\w+)\r\n", 1)
    to = F.regexp_extract("header", r"\r\nWARC-Refers-To-Page: (-?\d+)\r\n", 1)
    empty = F.lit("").cast("binary")
    record = F.concat(F.encode("header", "UTF-8"), F.when(kind == "response", F.col("payload")).otherwise(empty), F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return joined.select("page_id", "header", kind.alias("record_type"), F.when(to != "", to.cast("long")).alias("refers_to"), "payload", record.alias("record"))


def op4_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(write_archive(table(spark, sf_dir, "pages")))
    digest = F.sha1("payload")
    told = F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n", 1)
    checked = F.when(digest == told, digest).otherwise(F.raise_error(F.lit("a payload doesn't have the digest of its record")))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op4_content_addressed_warc": op4_content_addressed_warc}
ORACLE = {
    "op4_content_addressed_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""
}
