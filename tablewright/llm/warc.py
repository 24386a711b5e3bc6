"""A content-addressed WARC archive (DataFrame functions only).

Payload bytes are stored once, under their SHA-256; the exact header of every record is stored
apart, with the digest of its payload. Joining the two gives back each record, byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Equal payloads below this size each stay a response record.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, left out when the value is null; line breaks in a value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record_id(row: Column, place: Column) -> Column:
    """A URN from the row id and the record's place in the table, so that repeated rows have two."""
    h = F.md5(F.concat_ws(":", F.coalesce(row.cast("string"), F.lit("null")), place.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(
    pages: DataFrame, folder: str, *, row: str = "page_id", url: str = "url", payload: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> str:
    """Write a WARC record for every row of ``pages`` below ``folder``; returns ``folder``.

    ``folder/headers``: the header bytes of every record and its payload's digest.
    ``folder/payloads``: the bytes of every different payload, once, under their SHA-256.

    Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the largest row id is the
    response; the others, repeated rows with the same id as well, are revisits of it. A null payload is empty. A null row id counts as the
    smallest and its line is left out of the header, as is that of a null URL. Other columns are not read.

    A narrow table of digests, one row for each record, is written once and numbers the records; headers come from it. The
    largest row of each payload comes from an aggregation whose partial results merge before the shuffle; the join back has one
    row for each different payload on one side, so a payload that a third of the rows share can be split on the other (adaptive
    skew join). Payloads are grouped by digest and need no number: equal ones merge in each task before they are shuffled.
    """
    base = pages.select(
        F.col(row).cast("bigint").alias("row"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha256", F.sha2("payload", 256))
    digests = cut_lineage(
        base.select(
            F.monotonically_increasing_id().alias("place"), "row", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")
        ),
        "warc_digests",
    )
    owners = digests.groupBy("sha256").agg(F.max(F.struct("row", "place")).alias("owner"))
    revisit = (F.col("n") >= revisit_bytes) & (F.col("place") != F.col("owner.place"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("row"), F.col("place"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("owner.row"), F.col("owner.place")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("X-Row", F.col("row")),
        _line("X-Refers-To-Row", F.when(revisit, F.col("owner.row"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
        F.lit("\r\n"),
    )
    digests.join(owners, "sha256").select(F.encode(header, "UTF-8").alias("header"), "sha256").write.parquet(f"{folder}/headers")
    base.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    return folder


def _field(name: str) -> Column:
    value = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The payload store, each payload checked against the digest it is stored under."""
    stored = spark.read.parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), "sha256"))
    return stored.withColumn("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(wrong))


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The record headers with their fields."""
    return spark.read.parquet(f"{folder}/headers").select(
        "header",
        "sha256",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Payload-Digest").alias("payload_digest"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Refers-To").alias("refers_to_id"),
        _field("X-Row").cast("bigint").alias("row"),
        _field("X-Refers-To-Row").cast("bigint").alias("refers_to"),
        _field("Content-Length").cast("bigint").alias("content_length"),
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record again: its header fields, exact ``record`` bytes, and full ``payload`` (for revisits that of the response)."""
    found = read_headers(spark, folder).join(read_payloads(spark, folder), "sha256")
    block = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return found.withColumn("record", F.concat("header", block, F.encode(F.lit("\r\n\r\n"), "UTF-8")))


def record_facts(spark: SparkSession, folder: str) -> DataFrame:
    """``(row, payload_bytes, payload_digest, record_type, refers_to)`` of every record, from the archive.

    Size and digest are taken anew from the stored bytes, once for each payload, and joined to the
    headers; a header that names another digest or size stops the run.
    """
    facts = read_payloads(spark, folder).select(
        "sha256", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("sha1")
    )
    found = read_headers(spark, folder).join(facts, "sha256")
    same = (F.col("payload_digest") == F.concat(F.lit("sha1:"), "sha1")) & (
        F.col("content_length") == F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    )
    wrong = F.raise_error(F.concat(F.lit("header and payload differ in "), "record_id"))
    return found.select(
        "row", "payload_bytes", F.when(same, F.col("sha1")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to"
    )
