"""Each stage of the pipeline on its own input, against a plain version of it."""

import hashlib
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontamination import brute as contaminated_brute
from test_simhash import brute as fingerprint_groups
from test_substring_dedup import brute as substring_brute
from voxloom.llm import toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def first_of_each_group(texts):
    """Ids that are the smallest of their group: fingerprints within 2 bits, or five-word shingles of Jaccard 0.8."""
    ids = [d for d, _ in texts]
    root = {int(d): int(c) for d, _, c in fingerprint_groups(texts)}
    words = [(t or "").encode().lower().split() for _, t in texts]
    shingles = [{hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = []
    for j, b in enumerate(shingles):
        for i, a in enumerate(shingles[:j]):
            if a and b and min(len(a), len(b)) >= corpus_pipeline.SIMILAR * max(len(a), len(b)):
                both = len(a & b)
                if both >= corpus_pipeline.SIMILAR * (len(a) + len(b) - both):
                    near.append((i, j))

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, j in near:
        a, b = sorted((top(ids[i]), top(ids[j])))
        root[b] = a
    return {d for d in ids if top(d) == d}


def rows(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # a near copy of a text that stays, so that the second stage has something to do whatever the table holds
    docs = docs.unionByName(docs.orderBy("doc_id").limit(3).withColumn("doc_id", F.col("doc_id") + 100000))
    before = rows(docs)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(step))
        stage(spark, docs, DATA).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "toxicity":
            chain = toxicity.train(docs, labels)
            want = [r for r in before if chain.predict(r[1])[-1] < chain.thresholds[-1]]
            assert 0 < len(want) < len(before)
        elif name == "simhash near-dedup":
            want = [r for r in before if r[0] in first_of_each_group([x[:2] for x in before])]
            assert len(want) < len(before)
        elif name == "substring dedup":
            cut = {int(d): (n, gone, kept) for d, n, gone, _, kept, _ in substring_brute([x[:2] for x in before], 50)}
            want = [r if not cut[r[0]][1] else (r[0], cut[r[0]][2], *r[2:4], len(cut[r[0]][2])) for r in before if not cut[r[0]][1] or cut[r[0]][1] < cut[r[0]][0]]
        elif name == "benchmark decontamination":
            bad = {int(d) for d, *_ in contaminated_brute([x[:2] for x in before], bench)}
            want = [r for r in before if r[0] not in bad]
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids for r in before}
            want = sorted((r[0], len(ids[r[0]]), sha(",".join(map(str, ids[r[0]]))), sha(r[1] or ""), ids[r[0]]) for r in before)
            assert sorted(map(tuple, out.collect())) == want
            break
        assert out.columns == corpus_pipeline.COLUMNS and rows(out) == want
        docs, before = out, want


def test_stages_on_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(step)))
        docs = spark.read.parquet(str(tmp_path / str(step)))
    assert docs.count() == 0


def test_run_is_the_stages_in_turn(spark):
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) for _ in range(2))
    assert first == second and first


def test_stages_on_odd_rows(spark, tmp_path):
    words = " ".join(f"odd{i}" for i in range(80))
    rows = [(1, None, "en", "web", 0), (2, None, None, None, None), (None, words, "en", "web", 5), (None, None, "en", "web", 0), (3, "", "en", "web", 0), (4, words + " and more of it", "en", "web", 9), (4, words + " and more of it", "en", "web", 9), (5, "plain text here", "en", "web", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("text_was", F.lit("clash"))
    for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(step)))
        docs = spark.read.parquet(str(tmp_path / str(step)))
    got = {r.doc_id: r.n_tokens for r in docs.collect()}
    # nulls and the empty text are copies of each other; of the repeated row one stays
    assert set(got) <= {1, None, 4, 5} and {1, 4, 5} <= set(got) and got[1] == 0 and got[4] > 0
