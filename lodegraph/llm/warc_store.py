"""A content-addressed WARC archive.

Three steps: `write_archive` stores every payload once, under its SHA-256 digest, and the exact header block of every
record in a table of its own; `read_archive` rebuilds the original records by joining headers with payloads, and
verifies payload bytes against both digests in the headers; `export_warc` writes the rebuilt records as .warc files
and `read_warc` parses such files by their Content-Length.

A record is a response or, if its payload has at least `min_bytes` bytes and equals that of a record with a larger
page_id, a revisit of the one with the largest. Equal means equal digests on writing; reading verifies the bytes. Null
html is an empty payload, a null url leaves out the target header, CR and LF in it become spaces. Rows that repeat the
response's page_id and payload are responses, too. An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import checkpoint, is_small, shared_path, table

#: Fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEWLINE = "\r\n"
RECORD_END = "\r\n\r\n"
#: keys of repeated payloads that may be broadcast (16 bytes each)
BROADCAST_DIGESTS = 1_000_000


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE))


def records(pages: DataFrame, min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, sha256, header) of each record."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b"))
    p = p.select("page_id", "url", F.sha2("b", 256).alias("sha256"), F.sha1("b").alias("sha1"), F.octet_length("b").alias("n"))
    first = p.filter(F.col("n") >= min_bytes).groupBy("sha256").agg(F.max("page_id").alias("response"))
    p = p.join(first, "sha256", "left")
    revisit = F.coalesce(F.col("response") != F.coalesce("page_id", F.lit(-(2**63))), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit(VERSION + NEWLINE),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        F.coalesce(_field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Block-Digest", F.concat(F.lit("sha256:"), "sha256")),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", urn(F.col("response"))))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(NEWLINE),
    )
    return p.select("page_id", "sha256", header.alias("header"))


def distinct_payloads(pages: DataFrame, few: int = BROADCAST_DIGESTS) -> DataFrame:
    """(sha256, payload) of each different payload. Only payloads that come again are exchanged, all of them if over `few` do."""
    b = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.sha2(b, 256).alias("sha256"), b.alias("payload"))
    once = lambda df: df.groupBy("sha256").agg(F.first("payload").alias("payload"))
    # equal payloads have equal keys; a key that different payloads share only sends them to the exchange, too
    key = F.xxhash64("sha256").alias("k")
    again = checkpoint(rows.select(key).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"))
    if not is_small(again, few):
        return once(rows)
    keyed, again = rows.withColumn("k", key), F.broadcast(again)
    alone = keyed.join(again, "k", "left_anti").select("sha256", "payload")
    return alone.union(once(keyed.join(again, "k", "left_semi")))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    records(pages, min_bytes).write.mode("error").parquet(f"{path}/headers")
    distinct_payloads(pages).write.mode("error").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, stored) of each record; stored is false where the record itself (a revisit) has no payload."""
    headers = spark.read.schema("page_id long, sha256 string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    return headers.join(payloads, "sha256").select("header", "payload", (~F.col("header").startswith(f"{VERSION}{NEWLINE}WARC-Type: revisit")).alias("stored"))


def fields(header: str) -> dict[str, str]:
    lines = header.split(NEWLINE)
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def verified(archive: DataFrame) -> DataFrame:
    """One row a record, from the record's own header and its payload's bytes; wrong bytes raise ValueError."""

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches):
        for b in batches:
            rows = []
            for header, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f, sha1 = fields(header), hashlib.sha1(payload).hexdigest()
                if f["WARC-Payload-Digest"] != f"sha1:{sha1}" or f["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
                    raise ValueError(f"the payload of {f['WARC-Record-ID']} is not the one that was stored")
                if f["WARC-Type"] == "response" and int(f["Content-Length"]) != len(payload):
                    raise ValueError(f"{f['WARC-Record-ID']} has another length")
                rows.append((number(f["WARC-Record-ID"]), len(payload), sha1, f["WARC-Type"], number(f.get("WARC-Refers-To"))))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archive.select("header", "payload").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_warc(spark: SparkSession, archive: str, path: str, records_per_file: int = 10_000) -> None:
    """The rebuilt records as .warc files."""
    rows = read_archive(spark, archive)
    whole = F.concat("header", F.when(F.col("stored"), F.decode("payload", "UTF-8")).otherwise(""))
    rows.select(whole.alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).mode("error").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of the records in .warc files; a file is read by one task."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                at, headers, payloads = 0, [], []
                while at < len(data):
                    end = data.index(RECORD_END.encode(), at) + len(RECORD_END)
                    header = data[at:end].decode()
                    size = int(fields(header)["Content-Length"])
                    headers.append(header)
                    payloads.append(data[end : end + size])
                    at = end + size + len(RECORD_END)
                yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(payloads, pa.binary())], names=["header", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content").mapInArrow(run, "header string, payload binary")


def op9_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return verified(read_archive(spark, path))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
