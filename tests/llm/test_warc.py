import hashlib

import pytest
from llm_tables import pages, rows_of

from crestline.llm import warc

LONG = "<p>" + "payload é " * 20
ROWS = [(4, "http://a/4", LONG), (2, "http://a/2", LONG), (9, None, LONG), (1, "http://a/\r\n1", "short"), (3, "u", "short"),
        (5, "u", None), (6, "u", ""), (7, "u", "x\r\n\r\nWARC/1.1\r\n" + LONG), (None, "n", LONG), (2, "http://a/2", LONG),
        (8, "u", "long " * 100_000), (None, "n", "only without id " * 20)]


def archive(spark, rows):
    return warc.read_archive(spark, *warc.write_archive(pages(spark, rows)))


def test_records(spark):
    got = rows_of(archive(spark, ROWS), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "").encode() == data and j is not None]
        own = len(data) < 100 or not same or i == min(same)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if own else "revisit", None if own else min(same)))
    assert got == sorted(want, key=lambda t: tuple((v is not None, v) for v in t))


def test_payload_once_and_exact_bytes(spark):
    headers, store = warc.write_archive(pages(spark, ROWS))
    assert store.count() == len({r[2] or "" for r in ROWS})
    read = warc.read_archive(spark, headers, store)
    for r in warc.records(read).filter("page_id = 7").collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        data = ROWS[7][2].encode()
        assert body == data + b"\r\n\r\n" and b"Content-Length: %d" % len(data) in head and b"WARC-Target-URI: u\r\n" in head
    assert b"Content-Length: 0" in bytes(warc.records(read).filter("page_id = 4").first()["record"])


def test_damage_is_an_error(spark):
    headers, store = warc.write_archive(pages(spark, ROWS[:3]))
    from pyspark.sql import functions as F
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, headers, store.withColumn("payload", F.lit(b"else"))).collect()
    with pytest.raises(Exception, match="no payload of this length"):
        warc.read_archive(spark, headers, store.limit(0)).collect()


def test_empty(spark):
    assert archive(spark, []).count() == 0
