"""Content-addressed WARC archive.

Two tables make an archive. `payloads` holds the bytes of each distinct payload once, under its SHA-256,
with the SHA-1 that the headers cite and the page that brought it first. `records` holds the exact header
block of every record (WARC header, and for responses the HTTP header) and the digest of its payload.
Joining the two gives back every original record, byte for byte. Reading verifies both digests and the
length of each payload against its bytes, once per payload.

Record types: of records with equal payloads of at least `min_revisit` bytes, the one with the smallest
page_id is a response and the others revisit it; smaller payloads are always responses.

Payload bytes are shuffled once, one copy of a payload per map task at most, because equal payloads are
combined before the shuffle; everything else that moves is digests and ids.

Nulls: null html is an empty payload; a null url is written as an empty target; a null page_id orders after
all others and its record has an empty record number. Rows that agree in everything get a record each, of
which one is the response. Empty tables give empty archives. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_out, new_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648 base32
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_sha1(hex40: Column) -> Column:
    """20 bytes as hex: 8 groups of 5 hex digits are 4 base32 digits each."""
    parts = []
    for at in range(0, 40, 5):
        group = F.conv(F.substring(hex40, at + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _header(kind: Column, page_id: Column, url: Column, length: Column, sha1: Column, refers_to: Column) -> Column:
    """The exact text before the payload. A revisit's block is its HTTP header alone."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(kind == "response", length).otherwise(F.lit(0))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit(f"\r\nWARC-Date: {WARC_DATE}\r\nWARC-Payload-Digest: sha1:"), sha1,
        F.when(kind == "revisit", F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.coalesce(refers_to.cast("string"), F.lit("")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"),
        F.lit("\r\n\r\n"), http,
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Write `path`/payloads and `path`/records."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    order = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "url")
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(order).alias("first"))
    stored = stored.withColumn("length", F.octet_length("payload").cast("long")).withColumn("sha1", base32_of_sha1(F.sha1("payload")))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = spark.read.schema(stored.schema).parquet(f"{path}/payloads").select("digest", "length", "sha1", "first")

    # equal rows are counted, then numbered again: the first of them may be the response
    each = rows.groupBy("page_id", "url", "digest").agg(F.count(F.lit(1)).alias("copies"))
    each.write.option("compression", "zstd").parquet(f"{path}/rows")
    each = spark.read.schema(each.schema).parquet(f"{path}/rows")
    joined = counted_out(each.join(known, "digest").withColumn("one", F.lit(1).cast("long")), "one", "copies", "copy")
    leads = F.expr("copy = 1 and page_id <=> first.page_id and url <=> first.url")
    kind = F.when((F.col("length") < min_revisit) | leads, F.lit("response")).otherwise(F.lit("revisit"))
    records = joined.withColumn("kind", kind).select(
        "page_id", "copy", "digest", _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("length"), F.col("sha1"), F.col("first.page_id")).alias("header")
    )
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, copy, digest, header, record_type, payload_digest, refers_to), fields parsed from the stored headers."""
    field = lambda name, value: F.regexp_extract("header", rf"\r\n{name}: {value}\r\n", 1)
    refers = field("WARC-Refers-To", "<urn:page:([^>]*)>")
    return spark.read.parquet(f"{path}/records").select(
        "page_id", "copy", "digest", "header",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        F.when(refers == "", F.lit(None)).otherwise(refers).cast("long").alias("refers_to"),
    )


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, length, sha1): recomputed from the bytes. A payload that is not what its key says raises an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    sound = F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("digest"))))
    return stored.select("digest", sound.alias("payload"), F.octet_length("payload").cast("long").alias("length"), base32_of_sha1(F.sha1("payload")).alias("sha1"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, copy, record): the original records, header and payload, with the closing blank lines."""
    heads = read_headers(spark, path)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(b"\r\n\r\n")
    return heads.join(verified_payloads(spark, path), "digest").select("page_id", "copy", F.concat(F.col("header").cast("binary"), body, end).alias("record"))


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """The records as gzipped WARC files, one per partition."""
    text = reconstruct(spark, path).select(F.decode("record", "UTF-8").alias("value"))
    text = text.select(F.expr("left(value, char_length(value) - 4)").alias("value"))  # the separator writes the blank lines
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(to)


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the archive as stored."""
    heads = read_headers(spark, path)
    facts = verified_payloads(spark, path).select("digest", "length", "sha1", F.octet_length("payload").alias("checked"))
    agree = F.when(F.col("payload_digest") == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("a header cites another payload")))
    return heads.join(facts, "digest").select("page_id", F.col("checked").cast("long").alias("payload_bytes"), agree.alias("payload_digest"), "record_type", "refers_to")


def op5_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return archive_report(spark, path)


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(p.h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
