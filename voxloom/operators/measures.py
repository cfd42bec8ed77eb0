"""Sentences of labelled tokens, accuracy, and delivery measures of sessions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types


@F.pandas_udf(types.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Texts in Unicode's composed normal form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def sentences(tokens: DataFrame, key: str, order: str, kind: str, word: str, end: str) -> DataFrame:
    """Rows (key, sentence, text, kinds): the words before each token of kind ``end``; an unended rest is left out.

    Words are in Unicode's composed form.  A sentence of no words has an empty text and no kinds.  Equal values of ``order`` within a key are not expected.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    is_end = F.col(kind) == end
    marked = tokens.withColumn("sentence", F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0)).cast("int"))
    words = F.collect_list(F.when(~is_end, F.struct(F.col(order), F.col(word).alias("w"))))
    return (
        marked.groupBy(key, "sentence")
        .agg(F.sort_array(words).alias("__w"), F.sort_array(F.collect_set(F.when(~is_end, F.col(kind)))).alias("kinds"), F.max(is_end.cast("int")).alias("__ended"))
        .where("__ended = 1")
        .select(key, "sentence", composed(F.array_join(F.transform("__w", lambda x: x["w"]), " ")).alias("text"), "kinds")
    )


def accuracy(predicted: Column, wanted: Column) -> Column:
    """Share of rows whose texts agree but for case and outer white space."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.avg((clean(predicted) == clean(wanted)).cast("double"))


def delivery(chunks: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Per session, from rows (session, *order, arrival, seconds): first and last arrival, audio seconds, speed against
    real time, and the least audio in hand before any later chunk (null for a single chunk)."""
    w = Window.partitionBy(session).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.first("arrival").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = chunks.withColumn("__first", start).withColumn("__hand", F.sum("seconds").over(before) - (F.col("arrival") - F.col("__first")))
    out = rows.groupBy(session).agg(F.min("__first").alias("first"), F.max("arrival").alias("closed"), F.sum("seconds").alias("audio"), F.min("__hand").alias("buffer_floor"))
    return out.withColumn("realtime", F.when(F.col("closed") > F.col("first"), F.col("audio") / (F.col("closed") - F.col("first"))))
