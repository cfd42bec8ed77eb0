"""Extendible hashing against a plain bucket-splitting reference."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from voxloom.llm import queries, sharding


def bits(i, t):
    return "".join(f"{int(hashlib.md5(x.encode()).hexdigest()[:15], 16):060b}" for x in (str(i) if i is not None else "null", t or ""))


def brute(rows, limit):
    """Split one bucket at a time, on the next bit of its rows' hashes."""
    done, open_ = {}, [("", list(range(len(rows))))]
    while open_:
        prefix, own = open_.pop()
        size = sum(len((rows[i][1] or "").encode()) for i in own)
        if size <= limit or len(own) == 1:
            for i in own:
                done[i] = (prefix, size, len(own))
            continue
        parts = defaultdict(list)
        for i in own:
            parts[bits(*rows[i][:2])[: len(prefix) + 1]].append(i)
        open_ += parts.items()
    return done


@pytest.mark.parametrize("limit", [10**9, 3000, 300, 30])
def test_against_splitting(spark, limit):
    rng = random.Random(2)
    rows = [(i, "ñx " * rng.randrange(0, 40)) for i in range(150)] + [(None, "a" * 50), (None, "b" * 50), (None, None), (7, "other text of seven" * 3), (900, "long " * 5000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string")
    want = brute(rows, limit)
    got = sharding.assign(df, limit).collect()
    expected = [(str(rows[i][0]), len((rows[i][1] or "").encode()), *want[i]) for i in range(len(rows))]
    assert Counter((str(r.doc_id), r.bytes, r.shard, r.shard_bytes, r.shard_docs) for r in got) == Counter(expected)
    assert all(r.depth == len(r.shard) and (r.shard_bytes <= limit or r.shard_docs == 1) for r in got)


def test_equal_rows_go_to_pages(spark):
    rows = [(5, "x" * 10)] * 25 + [(i, "y" * 10) for i in range(20)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40).collect()
    assert len(got) == 45 and all(r.shard_bytes <= 40 for r in got)
    assert Counter(r.shard for r in got) == {r.shard: r.shard_docs for r in got}
    assert sum("+" in r.shard for r in got) == 25


def test_empty_write_and_sql(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(empty).count() == 0
    rows = [(i, "word " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write(df, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == rows
    assert {r[0]: r[1] for r in back.groupBy("__shard").sum().select("__shard", "sum(doc_id)").collect()}
    documents = __import__("pandas").DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    sql = queries.ORACLE_SQL["op1_sharding"].replace(str(queries.OP1_SHARD_BYTES), "2000")
    want = sorted(duckdb.sql(f"SELECT doc_id, bytes, shard, depth, shard_bytes, shard_docs FROM ({sql})").fetchall())
    assert sorted(map(tuple, sharding.assign(df, 2000).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs").collect())) == want


def test_any_column_names(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * i, "a", "b") for i in range(40)], "doc_id long, text string, __id string, key string")
    sharding.write(df, str(tmp_path / "out"), limit=100)
    back = spark.read.parquet(str(tmp_path / "out")).drop("__shard")
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        sharding.write(df.withColumn("__shard", df.key), str(tmp_path / "no"))
