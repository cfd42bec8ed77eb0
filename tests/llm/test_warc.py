"""The WARC archive: exact round trips, record types, and damage."""

import hashlib
import re

import pytest

from voxloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"
BIG = "ñ<p>" * 60


def rows():
    return [
        (5, "http://a/x", BIG, "clash", 1),
        (3, "http://a/y\r\nX-Evil: 1", BIG, "clash", 1),
        (9, None, BIG, None, None),
        (None, "http://b/", BIG, None, None),
        (1, "http://c/", "short", None, None),
        (2, "http://d/", "short", None, None),
        (4, "http://e/", None, None, None),
        (6, "http://f/", "", None, None),
        (7, "http://g/", "z" * 100, None, None),
        (8, "http://h/", "z" * 100, None, None),
        (3, "http://a/y", BIG, None, None),
        (10, "http://long/", "long text " * 50000, None, None),
    ]


def test_round_trip(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    first = {}
    for page, _, html, *_ in data:
        b = (html or "").encode()
        if page is not None:
            first[b] = min(page, first.get(b, page))
    want = []
    for page, _, html, *_ in data:
        b = (html or "").encode()
        revisit = len(b) >= 100 and page != first[b]
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    assert sorted(map(str, map(tuple, warc.round_trip(df).collect()))) == sorted(map(str, want))

    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    stored = spark.read.parquet(path + "/payloads")
    assert stored.count() == len({(h or "").encode() for _, _, h, *_ in data})
    for page, record in warc.records(spark, path).collect():
        head, block = bytes(record).split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and b"X-Evil" not in fields
        block = block[:-4]
        assert int(fields[b"Content-Length"]) == len(block)
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(block).hexdigest().encode()
        else:
            assert block == b"" and re.fullmatch(rb"<urn:x-page:=\d+>", fields[b"WARC-Refers-To"])


def test_damage_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows(), SCHEMA), path)
    bad = spark.read.parquet(path + "/payloads").withColumn("payload", F.expr("concat(payload, X'00')"))
    other = str(tmp_path / "other")
    bad.write.parquet(other + "/payloads")
    spark.read.parquet(path + "/headers").write.parquet(other + "/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, other).collect()


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_of_text(spark):
    rows = [("a>b%3E", BIG), ("z\r\n", BIG), (None, "x"), ("", "y")]
    df = spark.createDataFrame(rows, "page_id string, html string").selectExpr("page_id", "cast(null as string) url", "html")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {"a>b%3E": ("response", None), "z\r\n": ("revisit", "a>b%3E"), None: ("response", None), "": ("response", None)}


def test_payloads_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("voxloom.llm.common.BROADCAST_BYTES", -1)
    df = spark.createDataFrame(rows(), SCHEMA)
    by_shuffle = sorted(map(str, map(tuple, warc.round_trip(df).collect())))
    monkeypatch.undo()
    assert by_shuffle == sorted(map(str, map(tuple, warc.round_trip(df).collect())))
