"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart, records put together by a join.

An archive is a folder with two tables. `payloads` holds every distinct payload once under its SHA-256; the digest is
verified, since all rows that share it must agree in SHA-1 and length too, or the write fails. `headers` holds one row
per record with the bytes that stand before its payload: the WARC header and the HTTP header. Records with a payload
that an earlier one (by id) already has are revisits of that one. Reading joins the tables on the digest, computes both
digests anew from the stored bytes, and fails where they differ.

Copies are reduced to one row in each task before the shuffle, so a payload that a third of all pages share moves once
per task; the headers' side of the join has small rows and is split by the adaptive planner where a digest is hot.

Defined cases. A null payload is empty bytes, and an empty payload is a payload like others. Rows that share id and
payload are the same record twice and of the same type. A null id comes after all others; a payload that only such
rows have makes responses. A null URL has no header line; line ends in URLs are percent-encoded. An empty table makes
an empty archive. Only id, URL and payload are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.session import broadcast_if_small, job_dir

# Fixed values of the record format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: every 20 bits of the digest are four letters."""
    hexed = F.sha1(payload)
    letters = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*letters), CONV32, BASE32)


def _sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _records(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("digest", _sha256(F.col("payload")))


def write_archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html",
                  least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write the archive of `pages` and return its folder. Payloads under `least_bytes` are never revisited."""
    spark = pages.sparkSession
    folder = folder or f"{job_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = _records(pages, key, url, payload)

    size, sha1 = F.length("payload").cast("long"), sha1_base32(F.col("payload"))
    stored = rows.select("page_id", "payload", "digest", size.alias("size"), sha1.alias("sha1")).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.first("payload").alias("payload"),
        F.min("size").alias("size"), F.max("size").alias("most"), F.min("sha1").alias("sha1"), F.max("sha1").alias("sha1_max"))
    clash = (F.col("size") != F.col("most")) | (F.col("sha1") != F.col("sha1_max"))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("two payloads with the digest "), F.hex("digest")))).otherwise(F.col("sha1"))
    stored.select("digest", "first_id", "size", checked.alias("sha1"), "payload").write.parquet(f"{folder}/payloads")

    known = spark.read.parquet(f"{folder}/payloads").select("digest", "first_id", "size", "sha1")
    heads = rows.select("page_id", "url", "digest").join(broadcast_if_small(known), "digest")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    again = F.coalesce((F.col("size") >= least_bytes) & F.col("first_id").isNotNull() & later, F.lit(False))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        _line("Content-Length", F.col("size").cast("string")), F.lit(CRLF))
    block = F.length(http) + F.when(again, F.lit(0)).otherwise(F.col("size"))
    target = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.when(F.col("page_id").isNotNull(), _line("WARC-Record-ID", _urn(F.col("page_id")))).otherwise(""),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(again, F.concat(_line("WARC-Refers-To", _urn(F.col("first_id"))), F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", block.cast("string")),
        F.coalesce(_line("WARC-Target-URI", target), F.lit("")),
        F.lit(CRLF), http)
    heads.select("page_id", "digest", head.cast("binary").alias("head")).write.parquet(f"{folder}/headers")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records (page_id, head, payload, payload_bytes, payload_digest, record_type, refers_to, record) of an archive.

    `payload` is the full one for revisits too; `record` is the record as it stands in a WARC file.
    """
    fresh = sha1_base32(F.col("payload"))
    sound = (F.col("digest") == _sha256(F.col("payload"))) & (F.col("sha1") == fresh)
    digest = F.when(sound, fresh).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest"))))
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "digest", "payload", F.length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"))
    rows = spark.read.parquet(f"{folder}/headers").join(payloads, "digest")
    # the header lines before the first empty one
    lines = F.split(F.substring_index(F.col("head").cast("string"), CRLF + CRLF, 1), CRLF)

    def field(name: str) -> Column:
        start = f"{name}: "
        return F.get(F.transform(F.filter(lines, lambda x: x.startswith(start)), lambda x: F.substring(x, F.lit(len(start) + 1), F.length(x))), F.lit(0))

    kind = field("WARC-Type")
    stated = F.substring(field("WARC-Payload-Digest"), 6, 32)
    agreed = F.when(stated == F.col("payload_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("a header states another digest than "), F.col("payload_digest"))))
    body = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return rows.select(
        "page_id", "head", "payload", "payload_bytes", agreed.alias("payload_digest"), kind.alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).cast("long").alias("refers_to"),
        F.concat("head", body, F.lit(CRLF + CRLF).cast("binary")).alias("record"))


def write_warc_files(spark: SparkSession, folder: str, target: str) -> None:
    """The records of an archive as WARC files, one per task."""
    bare = F.col("record").substr(F.lit(1), F.length("record") - 4)
    read_archive(spark, folder).select(bare.cast("string").alias("value")).write.option("lineSep", CRLF + CRLF).text(target)
