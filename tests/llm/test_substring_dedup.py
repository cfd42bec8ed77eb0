"""Substring dedup against brute force, and the FM-index against a naive search."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import substring_dedup as sd
from voxloom.llm.fm_index import Shard

SCHEMA = "doc_id long, text string, row string, __spans_ string"


def brute(rows, window):
    first = {}
    for d, text, *_ in rows:
        words = (text or "").encode().split()
        if d is not None:
            for i in range(len(words) - window + 1):
                w = tuple(words[i : i + window])
                first[w] = min(d, first.get(w, d))
    out = []
    for d, text, *_ in rows:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), dtype=bool)
        if d is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < d:
                    gone[i : i + window] = True
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((str(d), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), text))
    return out


def data(window, n=60):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(3000)] + ["ñandú", "a\x1cb", "\x85", "x y"]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [say(window + rng.randrange(-2, 40)) for _ in range(6)] + [["same"] * (window + 5)]
    rows = []
    for i in range(n):
        parts = say(rng.randrange(0, 120))
        for _ in range(rng.choice([0, 1, 1, 3])):
            p = rng.choice(passages)
            lo = rng.choice([0, 0, rng.randrange(5)])
            parts += p[lo:] + say(rng.randrange(0, 30))
        rows.append((i * 3 % 100, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (200, rows[0][1]), (None, rows[0][1]), (300, None), (301, ""), (302, " ".join(say(20000) + passages[0])), (303, " ".join(["same"] * 400))]
    rng.shuffle(rows)
    return [(*r, "clash", "clash") for r in rows]


@pytest.mark.parametrize("window,options", [(50, {}), (50, {"hot_limit": 0, "filter_bits": 3}), (50, {"shard_words": 200}), (5, {}), (12, {"hot_limit": 2})])
def test_against_brute_force(spark, window, options):
    rows = data(window)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, window)
    got = sd.digests(df, window=window, **options).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(w[:4] for w in want)
    assert sum(w[2] for w in want) > 1000


ADAPTIVE = {
    "spark.sql.shuffle.partitions": "7",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_one_shard_per_anchor_under_adaptive_joins(spark, broadcast):
    """Joins re-planned at run time (local reads, split partitions) leave an anchor's segments together."""
    rows = data(12, n=400)
    conf = {**ADAPTIVE, "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, SCHEMA).repartition(6)
        got = sd.digests(df, window=12, hot_limit=12).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(w[:4] for w in brute(rows, 12))


def test_deduplicate(spark):
    rows = data(50)
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(d, text if not gone else kept) for d, n, gone, _, kept, text in brute(rows, 50) if not (gone and gone == n)]
    out = sd.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((d, str(t)) for d, t in want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.digests(empty).count() == 0 and sd.deduplicate(empty).count() == 0


@pytest.mark.parametrize("threshold", [1, 3, 6, 50])
def test_matching_statistics(threshold):
    rng = random.Random(threshold)
    for letters in (2, 4, 30):
        say = lambda k: [b"%d" % rng.randrange(letters) for _ in range(k)]
        index = [say(rng.randrange(1, 60)) for _ in range(12)]
        owners = [rng.randrange(100) for _ in index]
        stream = index[:3] + [say(rng.randrange(0, 80)) for _ in range(8)] + [[b"unknown"] + index[0] + [b"?"], []]
        shard = Shard(index, owners, threshold)
        match, owner = shard.statistics(stream)
        for s, m, o in zip(stream, match, owner):
            for i in range(len(s)):
                best, who = 0, -1
                for seq, own in zip(index, owners):
                    for j in range(len(seq)):
                        k = 0
                        while k < threshold and i + k < len(s) and j + k < len(seq) and s[i + k] == seq[j + k]:
                            k += 1
                        best = max(best, k)
                        if k == threshold:
                            who = own if who < 0 else min(who, own)
                assert (m[i], o[i]) == (best, who)


def test_any_column_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a", "b", "c", 7), (2, "x " + text, "d", "e", "f", 8)], "doc_id long, text string, __row string, __spans string, __kept string, row int").withColumn("spans", F.lit("s"))
    out = {r.doc_id: tuple(r) for r in sd.deduplicate(df).collect()}
    assert out == {1: (1, text, "a", "b", "c", 7, "s"), 2: (2, "x", "d", "e", "f", 8, "s")}


def test_limits_change_no_row(spark):
    """Near copies that differ in a word, so that their segments share anchors: every limit gives the same rows."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(160)]
    rows = []
    for i in range(300):
        copy = list(base[rng.randrange(40) :])
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = f"only{rng.randrange(200)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, sd.digests(df, hot_limit=limit).collect())) for limit in (1, 40, 4096)]
    assert found[0] == found[1] == found[2] == sorted((int(w[0]), *w[1:4]) for w in brute(rows, 50))


def test_kept_words_are_found_once(spark):
    words = [f"w{i}" for i in range(90)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[10:80]))], "doc_id long, text string")
    found = sd.deduplicate(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [kept(") == 1
    assert dict(found.collect()) == {1: " ".join(words), 2: "x"}
