"""The classifier chain: held-out accuracy, and every kind of odd row."""

import random
from collections import Counter

import numpy as np

from voxloom.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(10, 300))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        for bad, mine in ((["vile", "scum"], toxic), (["buy", "cheap"], junk)):
            if mine:
                for _ in range(rng.randrange(1, 4)):
                    words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", "!!", "."]))
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string")
    lab = spark.createDataFrame(labels[:600] + [(5000, 1, 1), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.classify(df, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [got[i].toxic == bool(truth[i]) for i in range(600, 900)]
    assert len(got) == 900 and np.mean(held) > 0.97
    assert {c for c in got[0].__fields__} == {"doc_id", "p_quality", "p_toxic", "toxic"}
    kept = tx.reject(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(800):
        a = rng.random() < 0.5
        rows.append(np.unique(np.concatenate([rng.integers(0, 5000, 40), [7 if a and rng.random() < 0.95 else 9]])).astype(np.int32))
        labels.append((int(a), int(a and rng.random() < 0.9)))
    chain = tx.train_rows(rows, np.array(labels), ("first", "second"))
    assert len(chain.models[0].dense) == 0 and chain.models[1].dense[0] > 0


def test_odd_rows(spark):
    docs, labels = corpus(120, 2)
    odd = docs + [(None, "vile scum", "x"), (500, None, "x"), (501, "", "x"), (502, "VILE " * 40000, "x"), docs[0], docs[0]]
    df = spark.createDataFrame(odd, "doc_id long, text string, x string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert tx.classify(df, lab).count() == len(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    others = spark.createDataFrame([(i + 100000, 0, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    alike = spark.createDataFrame([(i, 1, 1) for i in range(50)], "doc_id long, quality int, toxic int")
    for untold in (none, others, alike):
        assert [r.toxic for r in tx.classify(df, untold).collect()].count(True) == 0 and tx.reject(df, untold).count() == len(odd)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tx.classify(empty, lab).count() == 0 and tx.reject(empty, lab).count() == 0


def test_the_sample_is_of_ids_that_occur(spark):
    docs, labels = corpus(120, 3)
    df = spark.createDataFrame(docs * 3, "doc_id long, text string, x string")
    foreign = [(i + 100000, 0, 1) for i in range(4000)]
    lab = spark.createDataFrame(labels + foreign, "doc_id long, quality int, toxic int")
    some, all_ = tx.train(df, lab, sample=120), tx.train(spark.createDataFrame(docs, df.schema), spark.createDataFrame(labels, lab.schema))
    assert some.thresholds == all_.thresholds and all((a.weights == b.weights).all() for a, b in zip(some.models, all_.models))


def plain_fit(rows, dense, y):
    """Proximal gradient over a dense matrix, without acceleration, run until it stands still."""
    n = len(rows)
    seen = Counter(x for r in rows for x in r.tolist())
    kept = sorted(x for x, k in seen.items() if tx.MIN_ROWS <= k < n)
    X = np.array([[float(k in set(r.tolist())) for k in kept] for r in rows])
    X, D = (X - X.mean(0)) / X.std(0), (dense - dense.mean(0)) / np.where(dense.std(0) == 0, 1, dense.std(0))
    A = np.hstack([X, D, np.ones((n, 1))])
    step = 4 * n / np.linalg.norm(A, 2) ** 2
    w = np.zeros(A.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (n + 0.5 - y.sum()))
    for _ in range(40000):
        new = w - step * A.T @ (1 / (1 + np.exp(-A @ w)) - y) / n
        new[: len(kept)] = np.sign(new[: len(kept)]) * np.maximum(np.abs(new[: len(kept)]) - step * tx.PENALTY, 0)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return lambda: 1 / (1 + np.exp(-A @ w))


def test_models_against_a_plain_solver():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 25, rng.integers(2, 12))).astype(np.int32) for _ in range(150)]
    y = np.array([float(len(set(r.tolist()) & {3, 7}) > 0) if rng.random() < 0.9 else 1.0 for r in rows])
    dense = rng.standard_normal((150, 1)) + y[:, None]
    for d in (np.zeros((150, 0)), dense):
        got = tx._predict(tx.fit(rows, d, y, rounds=4000), rows, d)
        assert np.abs(got - plain_fit(rows, d, y)()).max() < 1e-3


def test_the_chain_against_a_plain_one():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 25, rng.integers(2, 12))).astype(np.int32) for _ in range(120)]
    first = np.array([int(3 in r) for r in rows])
    labels = np.column_stack([first, [int(a and 7 not in r) for a, r in zip(first, rows)]])
    chain = tx.train_rows(rows, labels, ("first", "second"))
    odds = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))[:, None]
    out, none = np.zeros(120), np.zeros((120, 0))
    for f in range(tx.FOLDS):
        a, b = [i for i in range(120) if i % tx.FOLDS != f], [i for i in range(120) if i % tx.FOLDS == f]
        m = tx.fit([rows[i] for i in a], none[a], labels[a, 0].astype(float))
        out[b] = [1 / (1 + np.exp(-m.margin(rows[i]))) for i in b]
    second = tx.fit(rows, odds(out), labels[:, 1].astype(float))
    assert np.allclose(second.dense, chain.models[1].dense) and np.allclose(second.weights, chain.models[1].weights)
    scores = []
    for t in sorted(set(out)):
        hit = out >= t
        true = (hit & (labels[:, 0] == 1)).sum()
        scores.append(5 * true / (hit.sum() + 4 * labels[:, 0].sum()))
    hit = out >= chain.thresholds[0]
    assert np.isclose(5 * (hit & (labels[:, 0] == 1)).sum() / (hit.sum() + 4 * labels[:, 0].sum()), max(scores))
