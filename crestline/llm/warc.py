"""Content-addressed WARC archive.

``write_archive`` stores every distinct payload once, keyed by its SHA-256, as a table, and the exact
header block of every record as text files whose records end with an empty line. ``read_archive``
parses the headers, recomputes each stored payload's digest and length (a difference is an error) and
joins both; ``records`` rebuilds the bytes of whole records. All of it is JVM-side.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page id is
the response, all others are revisits of it; smaller payloads are always responses (their bytes are
still stored once).

Defined results: a null html is an empty payload; a null url gives no target line; line breaks in an
url are percent-encoded in the header; records without page id are revisits if some record with an id
has the payload, else responses; rows that repeat the response's id and payload are responses too.

Shuffles: payloads move once, after each task has merged its own copies; headers move narrow, and a
payload with a third of all rows is the split left side of a join with one row per payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import query, table, written
from crestline.session import scratch_path

REVISIT_BYTES = 100
CRLF = "\r\n"
#: Written instead of the time of capture, which the table doesn't have.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 500_000


def _payload(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"), F.sha2(body, 256).alias("digest"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def header(kind: Column) -> Column:
    """Header block of a record, without the empty line behind it."""
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(_line("WARC-Target-URI", uri)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line(
            "WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))))
        ).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")))


def write_archive(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> tuple[str, DataFrame]:
    """Write the archive to the shared folder; (folder of headers, table of payloads)."""
    facts = _payload(pages)
    store = written(facts.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.any_value("payload").alias("payload")),
                    "payloads")
    owners = store.select("digest", "first_id")
    rows = facts.select("page_id", "url", "digest", F.octet_length("payload").alias("size")).join(owners, "digest", "left")
    own = (F.col("size") < min_bytes) | F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(own, F.lit("response")).otherwise(F.lit("revisit"))
    path = scratch_path(pages.sparkSession, "headers")
    rows.select(header(kind).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path, store


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract("value", rf"(?s)\r\n{name}: {pattern}(?:\r\n|$)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, headers: str, store: DataFrame) -> DataFrame:
    """Every record of an archive: header fields, the header block and its verified payload."""
    parsed = spark.read.option("lineSep", CRLF * 2).text(headers).filter(F.length("value") > 0).select(
        F.col("value").alias("header"),
        _field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
        _field("WARC-Type", r"([a-z]+)").alias("record_type"),
        _field("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        _field("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})").alias("digest"),
        _field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        _field("Content-Length", r"(\d+)").cast("long").alias("content_length"))
    actual = F.sha2("payload", 256)
    good = F.when(actual == F.col("digest"), actual).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))))
    verified = store.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                            good.alias("payload_digest"))
    return parsed.join(verified, "digest", "left").withColumn("payload_bytes", F.when(
        F.col("payload_bytes").isNull() | ((F.col("record_type") == "response") & (F.col("content_length") != F.col("payload_bytes"))),
        F.raise_error(F.concat(F.lit("no payload of this length: "), F.col("header")))).otherwise(F.col("payload_bytes")))


def records(archive: DataFrame) -> DataFrame:
    """(page_id, record): the exact bytes of each record, rebuilt from header and payload."""
    end = F.lit(CRLF * 2).cast("binary")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.select("page_id", F.concat(F.col("header").cast("binary"), end, body, end).alias("record"))


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY sha256(h)) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM d
"""


@query("op3_warc", _SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, store = write_archive(table(spark, sf_dir, "pages"))
    return read_archive(spark, headers, store).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
