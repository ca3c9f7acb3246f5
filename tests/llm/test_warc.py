"""WARC: exact round trips, with the magic inside payloads and splits of a few bytes."""

import base64
import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sievekit.llm import warc

EVIL = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nfoo\r\n\r\nWARC/1.0\r\nbad WARC/1.0\r\nContent-Length: 5\r\n\r\n"


def brute(rows, least=0):
    groups = defaultdict(list)
    for k, page in rows:
        groups[(page or "").encode()].append(k)
    out = {}
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k in ids:
            revisit = len(payload) >= least and k != max(ids)
            out[k] = (len(payload), digest, "revisit" if revisit else "response", max(ids) if revisit else None)
    return out


def got(df, least=0):
    rows = warc.round_trip(df, least).collect()
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}


def pages():
    kinds = ["", None, "a", EVIL, "é\r\n\r\n" + EVIL, "WARC/1.0\r\n", "WARC/1.0", "\n", "\r"]
    return [(k, f"http://a/{k}\r\nX: y" if k % 5 else None, (kinds[k % 9] or "") * (1 + k % 4) if k % 9 != 1 else None) for k in range(90)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 4000)
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string").repartition(2)
    assert got(df) == brute([(k, h) for k, _, h in rows])
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    assert got(df, 5) == brute([(k, h) for k, _, h in rows], 5)


def test_texts_come_back(spark):
    rows = pages()
    path = warc.new_path(spark, "test")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    read = warc.parse(warc.read(spark, path)).where("record_type = 'response'")
    assert all((dict((k, h or "") for k, _, h in rows))[r.page_id] == r.payload for r in read.collect())


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, None, "q"), (5, None, "q"), (5, "u", "q"), (None, "x", "z")], "page_id bigint, url string, html string")
    rows = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    assert rows == sorted([(5, "response", None), (5, "response", None), (None, "revisit", 5), (None, "response", None)], key=str)
    df.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op8_warc(spark, str(tmp_path)).count() == 0


def test_digest(spark):
    row = spark.createDataFrame([("é",)], "t string").select(warc.base32_sha1(F.col("t").cast("binary")).alias("d")).first()
    assert row.d == base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()


def test_headers_are_whole(spark):
    row = warc.records(warc.with_types(spark.createDataFrame([(None, "u", "a"), (7, "u", "b")], "page_id bigint, url string, html string"))).collect()
    for r in row:
        fields, _, _ = warc.header(r.value.removeprefix(warc.MAGIC) + warc.END)
        assert {"warc-record-id", "warc-date", "warc-type", "content-length"} <= set(fields)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])


def test_ids_that_repeat_with_other_payloads(spark, monkeypatch):
    rows = [(5, "u", "first"), (5, "u", "second"), (1, "u", "first"), (2, "u", "second!"), (3, "u", "second")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (warc.MAX_BROADCAST, 0):
        monkeypatch.setattr(warc, "MAX_BROADCAST", most)
        found = {(r.page_id, r.payload_bytes): r.refers_to for r in warc.round_trip(df).collect()}
        assert found == {(5, 5): None, (5, 6): None, (1, 5): 5, (2, 7): None, (3, 6): 5}


def test_number_of_splits_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 100)
    monkeypatch.setattr(warc, "MAX_SPLITS", 4)
    path = warc.new_path(spark, "test")
    warc.write(spark.createDataFrame(pages(), "page_id bigint, url string, html string").coalesce(1), path)
    assert warc.split_bytes(spark, path) > 100 and warc._chunks(spark, path).getNumPartitions() <= 5
    assert warc.read(spark, path).count() == 90
