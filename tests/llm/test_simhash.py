"""SimHash near-duplicates against brute force."""

import random

from pyspark.sql import functions as F

from voxloom.llm import simhash


def brute(rows):
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted((str(d), f"{fps[i]:016x}", str(low.get(top(i)))) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 200, 400]))]
        for c in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t "), (903, "One"), (904, "oNE"), (None, "One"), (905, "x y"), (903, "One"), (None, "alone here now then"), (906, "long " * 30000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("fp", F.lit(1))
    assert got(simhash.near_duplicates(df)) == brute(rows)
    # every bucket is too large: the recursion down to 8-bit segments gives the same rows
    assert got(simhash.near_duplicates(df, bucket_limit=1)) == brute(rows)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(20):
            x = base
            for _ in range(rng.choice([0, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = sorted((a, b) for i, a in enumerate(signed) for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (64, 4, 1):
        assert sorted(map(tuple, simhash.neighbour_links(df, bucket_limit=limit).collect())) == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (3, "other words of it", "z"), (None, "no id at all", "n"), (None, "no id at all", "m"), (1, "a b c d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df).collect())
    assert kept == [("1", "a b c d"), ("3", "other words of it"), ("None", "no id at all")]


def jaccard_brute(texts, at_least):
    shingles = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if len(shingles[i] & shingles[j]) >= at_least * len(shingles[i] | shingles[j])}


def test_stage_catches_similar_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STAR_ROUNDS", 2)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.choice([4, 100, 300, 600]))]
        texts.append(" ".join(base))
        for k in (1, 2, 5):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    near = jaccard_brute(texts, 0.8)
    fps = [simhash.fingerprint(t) for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() > 2 for i, j in near) > len(near) / 4
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (64, 3):  # with 3, buckets go through the rounds
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, jaccard=0.8, bucket_limit=limit).collect()}
        assert all(found[i] == found[j] for i, j in near)
        root = list(range(len(texts)))
        for i, j in sorted(near | {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        assert found == dict(enumerate(root))


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "y"), (None, "no id", "z")], "doc_id long, text string, __keep string").withColumn("keep", F.lit(1)).withColumn("row", F.lit(2)).withColumn("fingerprint", F.lit(3))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "None"]


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)] + [(5, 5), (7000, 7000)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = sorted(map(tuple, simhash.components(df).collect()))
    assert len({r for _, r in one}) > 10 and simhash.components(df.limit(0)).count() == 0
    monkeypatch.setattr(simhash, "EDGES_AT_ONCE", 0)
    assert sorted(map(tuple, simhash.components(df).collect())) == one


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randrange(1, 11)):
            copy[rng.randrange(len(copy))] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(copy[: rng.choice([150, 150, 130])]))
    near, pairs, verified = jaccard_brute(texts, 0.8), [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda found, *more: pairs.append(found.count()) or verified(found, *more))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, jaccard=0.8).collect()}
    root = list(range(len(texts)))
    fps = [simhash.fingerprint(t) for t in texts]
    for i, j in sorted(near | {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert found == dict(enumerate(root)) and 50 < len(set(root)) < 390
    assert sum(pairs) < len(texts) ** 2 / 10  # 4 rounds and all pairs that were apart before


def test_prefixes_of_a_large_group_meet_their_plainest(spark, monkeypatch):
    rng = random.Random(17)
    texts = []
    for size in (146, 300):  # two groups; the second with other shared passages, some of which are edited as one
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for i in range(200):
            copy = list(base)
            for _ in range(rng.randrange(size // 15)):
                copy[rng.randrange(len(copy))] = f"own{rng.randrange(10**9)}"
            if i % 3 == 0:
                copy[20:50] = [f"new{i % 4}_{j}" for j in range(30)]
            texts.append(" ".join(copy[: rng.choice([size, size, size - 15])]))
    texts = list(dict.fromkeys(texts))
    near, pairs, verified = jaccard_brute(texts, 0.8), [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda found, *more: pairs.append(found.count()) or verified(found, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    apart = docs.select(F.lit(1).cast("long").alias("key"), F.xxhash64("text").alias("t"), F.col("doc_id").alias("fp"), F.lit(1).alias("weight"), F.col("doc_id").alias("root"))
    links = simhash._prefix_links(apart, docs, 0.8, "text")
    assert {(min(r), max(r)) for r in links.collect()} <= near
    root = list(range(len(texts)))
    for i, j in sorted(near):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    found = dict(map(tuple, simhash.components(links).collect()))
    assert [found.get(i, i) for i in range(len(texts))] == root and 20 < len(set(root)) < 300
    assert sum(pairs) < 10 * len(texts)  # 39,538 before the plainest was met first


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    rng = random.Random(19)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(40)]
    rows = list(enumerate([t + more for t in texts for more in ("", " of", " ")]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans, cut = [], simhash.cut

    def seen(x):
        x.collect()
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        return cut(x)

    monkeypatch.setattr(simhash, "cut", seen)
    for edges in (simhash.EDGES_AT_ONCE, 0):  # components in one task and in rounds
        monkeypatch.setattr(simhash, "EDGES_AT_ONCE", edges)
        found = simhash.near_duplicates(df)
        assert got(found) == brute(rows)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not any("Broadcast" in p for p in plans)
