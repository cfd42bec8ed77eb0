"""Toxicity by a classifier chain.

The categories are predicted one after the other, each by a sparse logistic model over hashed words; a later model also
sees the probabilities of the earlier categories.  In training those are out-of-fold predictions, so a later model
learns from what earlier ones say about texts that they have not seen.

Features are the words of a text and the beginnings of its words, so that a word that no labelled text holds still
speaks by its stem.

The models are fitted on a bounded sample of labelled rows (``SAMPLE``): its features are made on the executors, gathered
and broadcast, and the fits of a category (each fold left out, and none) are dealt to tasks.  Every row of the table is scored,
over its whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LETTERS, give_back, let_go, mix, small_batches, tidy, word_hashes

#: Chain of label columns, in order; the last one is what ``reject`` acts on.
CATEGORIES = ("quality", "toxic")
#: Labelled rows that models are fitted on, at most: those with the lowest hashes of their ids.
SAMPLE = 8000
#: Hash buckets of the features are 2**FEATURE_BITS.
FEATURE_BITS = 18
FOLDS = 4
#: Tasks that the fits of a category are dealt to: a fit takes some 250 MB.
FIT_TASKS = 3
ROUNDS = 120
#: Characters of a word's beginning.
STEM = 4
#: The threshold of a category is the one of the best F-score with this beta on out-of-fold predictions: a missed toxic
#: text weighs more than a clean one that goes.  It is never below LEAST.
BETA = 2.0
LEAST = 0.1
#: Entries of the feature table that a fit works on at a time.
PART = 1 << 20
#: L1 penalty, and rows of the sample that must hold a word before it is a feature.
PENALTY = 0.002
MIN_ROWS = 3


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of the words (runs of letters, lower case) of a text, and of their first ``STEM`` characters."""
    data = (text or "").lower().encode()
    h = np.concatenate([word_hashes(data, LETTERS), mix(word_hashes(data, LETTERS, STEM) + np.uint64(1))])
    return np.unique((h >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """p = sigmoid(bias + sum of the buckets' weights + dense @ more)."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def margin(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum()) + self.bias


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def predict(self, text: str | None) -> list[float]:
        buckets, found = features(text), []
        for m in self.models:
            z = m.margin(buckets) + float(np.dot(m.dense, _dense(np.array([found]))[0])) if found else m.margin(buckets)
            found.append(float(_sigmoid(np.array(z))))
        return found


def _dense(p: np.ndarray) -> np.ndarray:
    """Probabilities as bounded log-odds."""
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> Linear:
    """L1-regularised logistic regression by accelerated proximal gradient over standardised columns.

    Without rows, or with one class only, the model is the (smoothed) share of positives.
    """
    n, k = len(rows), dense.shape[1]
    prior = (y.sum() + 0.5) / (n + 1)
    flat = np.concatenate(rows).astype(np.int32) if n else np.zeros(0, dtype=np.int32)
    weights, more = np.zeros(1 << FEATURE_BITS), np.zeros(k)
    base = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Linear(weights, more, base)
    seen = np.bincount(flat, minlength=1 << FEATURE_BITS)
    kept = np.flatnonzero((seen >= MIN_ROWS) & (seen < n))
    place = np.full(1 << FEATURE_BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    col = place[flat]
    lengths = np.array([len(r) for r in rows])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.concatenate([[0], np.cumsum(col >= 0)])[ends]  # of the kept entries
    lengths, col = np.diff(ends), col[col >= 0]
    del flat
    # rows are taken in parts, so that what is made on the way stays small
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PART)), [0, n]))
    parts = [(a, b, ends[a], ends[b]) for a, b in zip(cuts[:-1], cuts[1:])]
    share = seen[kept] / n
    scale = 1 / np.sqrt(share * (1 - share))
    spread = dense.std(axis=0)
    spread[spread == 0] = 1
    d = (dense - dense.mean(axis=0)) / spread
    centre = share * scale

    def forward(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        own, out = w * scale, np.empty(n)
        for a, b, low, high in parts:
            sums = np.concatenate([[0.0], np.cumsum(own[col[low:high]])])
            out[a:b] = np.diff(sums[ends[a : b + 1] - low])
        return out - centre @ w + d @ v

    def backward(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.zeros(len(kept))
        for a, b, low, high in parts:
            g += np.bincount(col[low:high], weights=np.repeat(r[a:b], lengths[a:b]), minlength=len(kept))
        return g * scale - centre * r.sum(), d.T @ r

    w, v = np.random.default_rng(0).standard_normal(len(kept)), np.ones(k)
    top = 1.0
    for _ in range(8):  # the largest eigenvalue bounds the step
        g, gv = backward(forward(w, v))
        top = float(np.sqrt(g @ g + gv @ gv)) or 1.0
        w, v = g / top, gv / top
    step = n / (0.25 * top * 1.2)
    w, v, b = np.zeros(len(kept)), np.zeros(k), base
    pw, pv, pb, t = w, v, b, 1.0
    for _ in range(rounds):
        r = (_sigmoid(forward(pw, pv) + pb) - y) / n
        g, gv = backward(r)
        nw = pw - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nv, nb = pv - step * gv, pb - min(step, 4.0) * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pv, pb = nw + (t - 1) / nt * (nw - w), nv + (t - 1) / nt * (nv - v), nb + (t - 1) / nt * (nb - b)
        w, v, b, t = nw, nv, nb, nt
    weights[kept] = w * scale
    return Linear(weights, v / spread, float(b - centre @ w - (dense.mean(axis=0) / spread) @ v))


def _predict(m: Linear, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    return _sigmoid(np.array([m.margin(r) for r in rows]) + dense @ m.dense)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F-score on out-of-fold predictions, the largest of several, at least ``LEAST``.

    Labels of one class only, or none, tell nothing apart: no probability reaches the threshold, which is infinite.
    """
    if not len(y) or y.min() == y.max():
        return float("inf")
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    score = (1 + BETA**2) * hits / (np.arange(1, len(y) + 1) + BETA**2 * y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    best = int(np.argmax(np.where(last, score, -1)))
    following = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float(max(LEAST, (p[order][best] + following) / 2))


#: One fit: the rows to fit on (all for None), the dense columns and the labels.
Job = tuple[np.ndarray | None, np.ndarray, np.ndarray]


def fit_job(rows: list[np.ndarray], job: Job) -> Linear:
    own, dense, y = job
    return fit(rows, dense, y) if own is None else fit([rows[i] for i in own], dense[own], y[own])


def train_rows(
    rows: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...] = CATEGORIES, folds: int = FOLDS, fits: Callable[[list[Job]], list[Linear]] | None = None
) -> Chain:
    """Fit the chain on feature rows and their labels (one column per category); ``fits`` runs the jobs of a category."""
    fits = fits or (lambda jobs: [fit_job(rows, job) for job in jobs])
    chain = Chain(categories)
    n = len(rows)
    earlier = np.zeros((n, 0))
    fold = np.arange(n) % folds
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        dense = _dense(earlier)
        parts = range(folds) if n >= 2 * folds else ()
        *left_out, whole = fits([(np.flatnonzero(fold != f), dense, y) for f in parts] + [(None, dense, y)])
        out = np.zeros(n) if len(left_out) else _predict(whole, rows, dense)
        for f, m in zip(parts, left_out):
            own = np.flatnonzero(fold == f)
            out[own] = _predict(m, [rows[i] for i in own], dense[own])
        chain.models.append(whole)
        chain.thresholds.append(_threshold(out, y))
        earlier = np.column_stack([earlier, out])
    return chain


def _as_tasks(spark: SparkSession, shared: Broadcast) -> Callable[[list[Job]], list[Linear]]:
    """Runs fits in tasks over ``shared`` rows (all buckets, buckets of each); a model's weights come back
    without their zeros."""

    def fits(jobs: list[Job]) -> list[Linear]:
        todo = spark.sparkContext.broadcast(jobs)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for i in p["id"]:
                    flat, lengths = shared.value
                    m = fit_job(np.split(flat, np.cumsum(lengths)[:-1]), todo.value[i])
                    at = np.flatnonzero(m.weights)
                    yield pd.DataFrame([(i, at.tolist(), m.weights[at].tolist(), m.dense.tolist(), m.bias)], columns=["id", "place", "weight", "dense", "bias"])
            give_back()

        found = spark.range(0, len(jobs), 1, min(len(jobs), FIT_TASKS)).mapInPandas(run, "id long, place array<int>, weight array<double>, dense array<double>, bias double").collect()
        out = []
        for r in sorted(found, key=lambda r: r["id"]):
            weights = np.zeros(1 << FEATURE_BITS)
            weights[r["place"]] = r["weight"]
            out.append(Linear(weights, np.array(r["dense"], dtype=float), r["bias"]))
        todo.destroy()
        return out

    return fits


def train(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> Chain:
    """Fit the chain on up to ``sample`` labelled ids of ``labels`` that occur in ``docs``: those of the lowest hashes.

    Labels that are null, and null ids, are left out; an id labelled several times has its largest labels.  Of rows of
    ``docs`` that share an id the first by text is taken, before anything goes to the driver.
    """
    small_batches(docs.sparkSession)
    names = [f"y{i}" for i in range(len(categories))]
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").cast("int").alias(n) for c, n in zip(categories, names)]).dropna()
    usable = usable.groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    chosen = usable.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` rows of a few integers
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", *names).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f.tolist() for f in found], pa.list_(pa.int32()))], ["id", *names, "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = texts.mapInArrow(tidy(run), f"id {kind}, {', '.join(f'{n} int' for n in names)}, f array<int>").toArrow().sort_by("id")
    found = made.column("f").combine_chunks() if made.num_rows else pa.array([], pa.list_(pa.int32()))
    y = np.array([made.column(n).to_numpy() for n in names], dtype=np.int64).reshape(len(names), made.num_rows).T
    flat, lengths = found.flatten().to_numpy(), found.value_lengths().to_numpy()
    # a bucket of fewer than MIN_ROWS rows is no feature of any fit
    known = np.bincount(flat, minlength=1 << FEATURE_BITS)[flat] >= MIN_ROWS
    lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[known], minlength=len(lengths))
    flat = flat[known]
    del made, found, known
    if not len(lengths):
        return train_rows([], y, categories)
    shared = docs.sparkSession.sparkContext.broadcast((flat, lengths))
    chain = train_rows(np.split(flat, np.cumsum(lengths)[:-1]), y, categories, fits=_as_tasks(docs.sparkSession, shared))
    shared.destroy()
    del flat, lengths
    let_go()
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, p_<category>..., <last category> boolean), one for each row of ``docs``; null texts are empty."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for b in batches:
            p = np.array([c.predict(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(names))
            flag = p[:, -1] >= c.thresholds[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, i]) for i in range(len(names))], pa.array(flag)], ["id", *names, "flag"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {', '.join(f'{n} double' for n in names)}, `{chain.categories[-1]}` boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def flag(chain: Chain, spark, text_col: str = "text") -> Column:
    """A boolean column: the last category's probability reaches its threshold."""
    model = spark.sparkContext.broadcast(chain)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        c = model.value
        return pd.Series([c.predict(t)[-1] >= c.thresholds[-1] for t in texts], dtype=bool)

    return toxic(F.col(text_col).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows, score all rows: (doc_id, p_quality, p_toxic, toxic).

    Null texts are empty; repeated rows and null ids are scored like others; other columns are not read; an empty table
    gives an empty one.  Where no labelled id occurs in ``docs``, or all have one label, no row is toxic.
    """
    return score(docs, train(docs, labels, **options))


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the chain finds toxic; all columns are kept.

    Rows are judged by their texts, null ids and repeated rows like others; where ``classify`` finds nothing toxic, all stay.
    """
    return docs.where(~flag(train(docs, labels, text_col=text_col, **options), docs.sparkSession, text_col))
