"""Code vocabularies and vector quantization; codebooks are small and fixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

N_CODES = 8192
FIRST_ID = 128256
END_TOKEN = "<|speech_end|>"


def vocabulary(spark: SparkSession, n: int = N_CODES, first: int = FIRST_ID) -> DataFrame:
    """Rows (code, token, token_id): ids follow the lexicographic order of ``<|s_N|>``, not that of the numbers."""
    tokens = spark.range(n).select(F.col("id").alias("code"), F.concat(F.lit("<|s_"), F.col("id").cast("string"), F.lit("|>")).alias("token"))
    return tokens.withColumn("token_id", (F.lit(first - 1) + F.row_number().over(Window.orderBy("token"))).cast("long"))


def check_vocabulary(vocab: DataFrame, n: int = N_CODES, end: DataFrame | None = None) -> None:
    """Raise unless ``n`` codes stand on one block of ids without gaps or repeats, and the end token is among ``end``'s (token)."""
    r = vocab.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token_id").alias("d"), F.min("token_id").alias("lo"), F.max("token_id").alias("hi")).first()
    if r["n"] != n or r["d"] != n:
        raise ValueError(f"expected {n} audio tokens, found {r['d']}")
    if r["hi"] - r["lo"] + 1 != n:
        raise ValueError("audio token ids have gaps")
    if end is not None and end.where(F.col("token") == END_TOKEN).isEmpty():
        raise ValueError(f"the vocabulary has no {END_TOKEN}")


def audio_vocabulary(tokens: DataFrame) -> DataFrame:
    """Rows (code, token, token_id) of the audio tokens among rows (token, token_id) of a tokenizer."""
    code = F.regexp_extract("token", r"^<\|s_([0-9]+)\|>$", 1)
    return tokens.where(code != "").select(code.cast("long").alias("code"), "token", F.col("token_id").cast("long").alias("token_id"))


def codes_to_ids(codes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows (.., code) with their token_id; unknown codes get null.  The vocabulary has N_CODES rows: broadcast."""
    return codes.join(F.broadcast(vocab.select("code", "token_id")), "code", "left")


def ids_to_codes(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows (.., token_id) with their code; ids that are no audio token are dropped."""
    return ids.join(F.broadcast(vocab.select("code", "token_id")), "token_id")


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def nearest(vectors: DataFrame, codebook: list[tuple[int, list[float]]], vec: str = "embedding") -> DataFrame:
    """``vectors`` with ``code`` and ``similarity`` of the codebook's nearest entry by cosine; ties: the lowest code.

    The codebook stands in the plan as a literal: no join, one pass over each vector.
    """
    entries = []
    for code, v in codebook:
        size = sum(x * x for x in v) ** 0.5 or 1.0
        entries.append((code, [x / size for x in v]))
    unit = _unit(F.transform(F.col(vec), lambda x: x.cast("double")))
    scored = F.array(
        *[
            F.struct((-F.round(F.aggregate(F.zip_with("__unit", F.array(*map(F.lit, v)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 9)).alias("d"), F.lit(code).cast("long").alias("c"))
            for code, v in entries
        ]
    )
    best = F.array_min(scored)
    return vectors.withColumn("__unit", unit).withColumn("__best", best).select(*vectors.columns, F.col("__best.c").alias("code"), (-F.col("__best.d")).alias("similarity"))


#: Values of a codebook, over all layers, that may be broadcast: 64 MiB of 32-bit numbers.
MOST_VALUES = 1 << 24


def quantize(vectors: DataFrame, codebooks: list[np.ndarray], key: str, vec: str = "embedding") -> DataFrame:
    """Rows (key, layer, code, similarity): residual quantization, the nearest entry by cosine in each layer's codebook.

    Each layer quantizes what the layers before it left; of equal similarities (to 6 places) the lowest code is taken.
    Codebooks are fixed and broadcast, so their size is checked; vectors meet them as matrix products, batch by batch.
    """
    if sum(b.size for b in codebooks) > MOST_VALUES:
        raise ValueError(f"codebooks of more than {MOST_VALUES} values are not broadcast")
    books = [np.asarray(b, dtype=np.float64) for b in codebooks]
    shared = vectors.sparkSession.sparkContext.broadcast([(b, b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)) for b in books])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 1024):
                own = p.iloc[at : at + 1024]
                rest = np.array([np.asarray(v, dtype=np.float64) for v in own["vec"]]) if len(own) else np.zeros((0, books[0].shape[1]))
                for layer, (book, unit) in enumerate(shared.value):
                    near = np.round(rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12) @ unit.T, 6)
                    code = near.argmax(axis=1)
                    yield pd.DataFrame({key: own["key"].values, "layer": layer, "code": code, "similarity": near[np.arange(len(code)), code]})
                    rest = rest - book[code]

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")).mapInPandas(run, f"`{key}` {kind}, layer int, code long, similarity double")


def dequantize(codes: DataFrame, book: DataFrame, key: str) -> DataFrame:
    """Rows (key, vector): the sum over layers of the entries that (key, layer, code) look up in (layer, code, entry)."""
    found = codes.join(book, ["layer", "code"]).select(key, F.posexplode("entry").alias("i", "x"))
    sums = found.groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
