import base64
import hashlib

from pyspark.sql import functions as F

from plumbline.llm import warc

SCHEMA = "page_id long, url string, html string, d string, first long"


def test_round_trip(spark):
    rows = [(5, "http://a.example.org/x?y=1", "<p>é</p>"), (3, "http://b.example.org/", "<p>é</p>"), (9, None, None), (8, "http://c.example.org/ü\r\nX: y", ""), (1, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "x" * 700_000), (None, "u", "<p>é</p>"), (None, "v", "own"), (4, "u", "twin"), (4, "u", "twin")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(3)
    got = warc.captures(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    for page, url, html in rows:
        if page is not None:
            data = (html or "").encode()
            assert by[page]["payload_bytes"] == len(data) and by[page]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert by[page]["response"]["target_uri"] == url and by[page]["request"]["record_type"] == "request"
    assert (by[3]["record_type"], by[5]["record_type"], by[5]["refers_to"]) == ("response", "revisit", 3)
    assert (by[8]["record_type"], by[9]["record_type"], by[9]["refers_to"]) == ("response", "revisit", 8)
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == [("response", None), ("revisit", 3)]
    assert all(r["metadata"]["record_type"] == "metadata" for r in got)


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab", "z", 1), (2, "u", "ab", "z", 1), (3, "u", "abcdef", "z", 1), (4, "u", "abcdef", "z", 1)], SCHEMA)
    got = {r["page_id"]: r["record_type"] for r in warc.captures(df, least=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    assert warc.captures(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_of_a_foreign_order_are_joined(spark):
    rows = [("p", "m", "metadata", "r", None, None, None, None, None, {"k": "v"}), ("q", "r", "response", None, "u", 3, "D", None, None, {}), ("p", "x", "request", "r", "u", None, None, None, None, {}), ("q", "i", "warcinfo", None, None, None, None, None, None, {})]
    got = warc.transactions(spark.createDataFrame(rows, warc.RECORD)).select("capture_id", F.col("request.record_id").alias("a"), F.col("response.payload_bytes").alias("b"), F.col("metadata.fields")["k"].alias("c")).collect()
    assert [tuple(r) for r in got] == [("r", "x", 3, "v")]
