"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``; all but the last return the columns of ``documents``.  What a stage has written goes when the next one
has written its own.

Null texts count as empty and stay, all but one of them (they are copies of each other); null ids are judged by their
texts; rows that repeat an id and a text are copies; equal similarities and ties go to the smallest id.  Columns beyond
those of ``documents`` are left out.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm import bpe, decontamination, simhash, substring_dedup, toxicity
from voxloom.llm.common import read_table, remove_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Jaccard similarity of five-word shingles from which two documents are near duplicates.
SIMILAR = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays: near fingerprints, or similar five-word shingles."""
    return simhash.keep_one(docs, jaccard=SIMILAR).select(COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; ``n_chars`` is counted again where the text has changed."""
    before = docs.select(*COLUMNS, F.xxhash64("text").alias("text_was"))
    after = substring_dedup.deduplicate(before)
    n_chars = F.when(F.xxhash64("text").eqNullSafe(F.col("text_was")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return after.withColumn("n_chars", n_chars).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), whole_span=False).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and the digests that show the exact round trip."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: A trained classifier and BPE merges are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
