"""WARC revisit resolution: payload headers meet by digest, repeats become revisit records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, join_checked, remove_path, scratch_path, text_or_empty

CRLF = "\r\n"
#: Ends a record; also the line separator with which Spark's text writer puts records together.
RECORD_END = CRLF * 2
#: Fixed values of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is read as a whole, so its records are few enough to fit into this even if all are as long as the longest.
ARCHIVE_BYTES = 256 << 20
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page):
    """urn:uuid made from the page's id."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(name: str, value):
    """A header line, or nothing where the value is null. Line ends inside a value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def resolve_revisits(pages: DataFrame, min_bytes: int = 100, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type, refers_to, refers_uri.

    Only (page_id, url, digest, length) is shuffled, by digest with map-side minima, so a payload that a third
    of all pages carry costs a row per task. The originals (digests met more than once) join back to the pages:
    broadcast if few enough by count, else by a shuffle whose hot keys adaptive execution splits.

    A null html is an empty payload. A null page_id never becomes an original while another id exists. Rows that
    repeat the original's page_id and payload are responses too. Payloads under min_bytes are always responses.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    heads = own.where(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first)
    n = first.count()
    uris = join_checked(heads, first, "payload_digest", "inner", n, broadcast_rows).where("page_id <=> first_id").groupBy("payload_digest", "first_id").agg(F.min("url").alias("first_url"))
    first = cut(uris)
    met = join_checked(own, first, "payload_digest", "left", n, broadcast_rows)
    again = F.col("payload_digest").isNotNull() & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_uri"),
    )


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def records(resolved: DataFrame, date: str):
    """The text of each WARC/1.1 record with fresh headers, without the record end that the writer adds."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(REVISIT_PROFILE)), _header("WARC-Refers-To", _record_id(F.col("refers_to"))), _header("WARC-Refers-To-Target-URI", F.col("refers_uri")))).otherwise(F.lit("")),
        _header("X-Page-ID", F.col("page_id")), _header("X-Refers-To-Page-ID", F.col("refers_to")), _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Type", F.lit("application/http;msgtype=response")), _header("Content-Length", F.octet_length(body)), F.lit(CRLF),
    )
    return resolved.select(F.concat(head, body).alias("value"))


def write_archives(resolved: DataFrame, path: str, per_file: int = 2000, date: str | None = None) -> None:
    """Deduplicated archives under path, at most per_file records each; date: of the records, by default that of writing."""
    records(resolved, date or now()).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", per_file).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content block) of each record of an archive, found by Content-Length alone."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split(CRLF)
        head = dict(x.split(": ", 1) for x in lines[1:])
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        size = int(head["Content-Length"])
        yield head, content[end + 4 : end + 4 + size]
        at = end + 8 + size


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in parse(bytes(content)):
                said = head["WARC-Payload-Digest"].removeprefix("sha256:")
                page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                size = int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response":
                    payload = block[len(HTTP_HEAD) :]
                    size, found = len(payload), hashlib.sha256(payload).hexdigest()
                    if found != said:
                        raise ValueError(f"payload of page {page} does not match its digest")
                rows.append((None if page is None else int(page), size, said, head["WARC-Type"], None if refers is None else int(refers)))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the digest of every response is computed anew from what was read."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInPandas(_read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Writes the archives, reads them back, and returns what was read. The archives are deleted afterwards."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    write_archives(resolve_revisits(pages, min_bytes), path, max(1, min(2000, ARCHIVE_BYTES // (longest + 4096))))
    out = cut(read_archives(spark, path))
    remove_path(spark, path)
    return out
