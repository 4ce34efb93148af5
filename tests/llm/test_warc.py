import base64
import hashlib

from pyspark.sql import functions as F

from pricebridge.llm import warc
from pricebridge.llm.common import new_path
from tests.llm.fixtures import SMALL, clashing, rows_of

ROWS = [(5, "http://a.example/x", "same"), (3, "http://b.example/y?q=1", "same"), (9, None, "same"), (4, "http://c.example", None), (6, "", ""), (7, "u\r\nv: w", "a\r\n\r\nb\r\n\r\n\r\n"), (8, "http://d.example/", "x\r\n"), (10, "http://e", "WARC/1.1\r\nWARC-Type: response\r\n\r\nfoo"),
        (11, "http://f", "é中\U0001f600" * 4000), (3, "http://b.example/y?q=1", "same"), (None, "http://n", "no id"), (12, "http://g", "\r\n"), (13, "http://g", "no id")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def brute(rows):
    b = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, h in b:
        if p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, h in b:
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        again = sum(x == h for _, x in b) > 1 and p != first.get(h)
        out.append([p, len(h), digest, "revisit" if again else "response", first[h] if again else None])
    return sorted(out, key=repr)


def round_trip(spark, pages, **how):
    path = new_path(spark, "warc")
    warc.write_warc(pages, path, **how)
    return path


def test_awkward_rows(spark):
    path = round_trip(spark, clashing(frame(spark, ROWS)))
    got = warc.captures(warc.read_warc(spark, path))
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute(ROWS)
    assert got.filter("NOT has_request OR NOT has_metadata").count() == 0


def test_generated_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    path = round_trip(spark, pages)
    got = warc.captures(warc.read_warc(spark, path, payload=False))
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_payloads_come_back(spark):
    path = round_trip(spark, frame(spark, ROWS))
    records = warc.read_warc(spark, path)
    got = [bytes(r["payload"]) for r in records.filter("type = 'response'").collect()]
    assert set(got) == {(h or "").encode() for _, _, h in ROWS}
    nested = warc.transactions(records)
    assert nested.filter("request.type = 'request' AND metadata.type = 'metadata'").count() == nested.count() == len(ROWS)


def test_small_payloads_may_all_be_responses(spark):
    path = round_trip(spark, frame(spark, ROWS), least_bytes=5)
    got = warc.captures(warc.read_warc(spark, path))
    assert got.filter("record_type = 'revisit' AND payload_bytes < 5").count() == 0 and got.filter("record_type = 'revisit'").count() == 1


def test_empty_table(spark):
    path = round_trip(spark, frame(spark, []))
    assert warc.captures(warc.read_warc(spark, path)).collect() == []


def test_requests_without_a_capture_are_left_out(spark):
    path = round_trip(spark, frame(spark, ROWS[:2]))
    records = warc.read_warc(spark, path)
    assert warc.transactions(records.filter(F.col("type") == "request")).count() == 0
    assert warc.transactions(records.filter(F.col("type") != "metadata")).filter("metadata IS NULL").count() == 2
