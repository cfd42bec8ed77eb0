"""Token counts from an exact length histogram.

Texts are encoded, and only their lengths are kept: documents are counted by encoded length.  Suffix sums over the
histogram answer, for every context limit at once: how many documents reach it, how many tokens a cut at the limit
leaves (``sum(min(length, limit))``), and all quantiles of the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import Codec, default_vocabulary
from .common import cut, small_batches, tidy

#: Lengths of one block of the two-level prefix sums.
BLOCK = 128


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (n_tokens long) per row of ``docs``; a null text has no tokens."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            n = [len(codec.encode(t or "")) // codec.dtype.itemsize for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(n, dtype=np.int64))], ["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "n_tokens long")


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Rows (length, n_docs): one for each encoded length that occurs."""
    return lengths(docs, text_col, vocabulary).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """One row per length L of the histogram, taken as a context limit.

    length, n_docs; docs_reaching: documents of L tokens or more; tokens_reaching: their tokens; truncated_total:
    ``sum(min(length, L))`` over all documents; docs_upto: documents of L tokens or fewer (quantile q is the smallest L
    with docs_upto >= q * total_docs); total_docs, total_tokens.  An empty histogram gives an empty table.

    Suffix sums are made in two levels, so no task sees all lengths: within blocks of ``BLOCK`` lengths, then over blocks.
    """
    hist = hist.select("length", "n_docs", F.expr("length * n_docs").alias("tokens"), F.expr(f"length div {BLOCK}").alias("block"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hist.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum("tokens").over(within)).join(blocks, "block")
    docs, tokens = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return out.select(
        "length",
        "n_docs",
        docs.alias("docs_reaching"),
        tokens.alias("tokens_reaching"),
        (F.col("total_tokens") - tokens + docs * F.col("length")).alias("truncated_total"),
        (F.col("total_docs") - docs + F.col("n_docs")).alias("docs_upto"),
        "total_docs",
        "total_tokens",
    )


def quantile(table: DataFrame, q: float) -> int | None:
    """The smallest length that a share ``q`` of the documents does not exceed; None without documents."""
    return table.where(F.col("docs_upto") >= F.lit(q) * F.col("total_docs")).agg(F.min("length")).first()[0]


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, for any limit."""
    row = table.where(F.col("length") > limit).agg(F.max("docs_reaching").alias("d"), F.max("tokens_reaching").alias("t")).first()
    total = table.agg(F.max("total_tokens")).first()[0] or 0
    return total - (row["t"] or 0) + limit * (row["d"] or 0)


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The context table of all rows of ``docs``.

    A null text has no tokens and counts as length 0, like an empty one; repeated rows count each; other columns are not
    read; an empty table gives an empty one.
    """
    return context_table(cut(histogram(docs, text_col, vocabulary)))
