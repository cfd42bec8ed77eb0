"""One query per operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, gif, sharding, simhash, substring_dedup, token_counts, toxicity, url_filter, warc
from .common import read_table


#: Bytes of a shard in op1_sharding: a small one, so that small tables are split as well.
OP1_SHARD_BYTES = 1 << 18


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"), OP1_SHARD_BYTES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), whole_span=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.round_trip(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_gif": op9_gif,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    # 30 levels: ample for the tables that DuckDB can hold
    "op1_sharding": f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, ('0x' || md5(coalesce(doc_id::varchar, 'null'))[1:15])::bigint AS h FROM documents),
lv AS (SELECT d, h >> (60 - d)::int AS p, sum(bytes)::bigint AS shard_bytes, count(*) AS shard_docs FROM r, range(0, 31) t(d) GROUP BY ALL),
fits AS (SELECT * FROM lv WHERE shard_bytes <= {OP1_SHARD_BYTES} OR shard_docs = 1)
SELECT doc_id, bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d::int, '0') END AS shard, d::int AS depth, shard_bytes, shard_docs
FROM r JOIN fits ON fits.p = h >> (60 - d)::int
QUALIFY row_number() OVER (PARTITION BY doc_id, h ORDER BY d) = 1""",
    "op10_url_filter": url_filter.oracle(),
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, i, list_aggregate(words[i : i + 49], 'string_agg', ' ') AS s FROM d, range(1, len(words) - 48) t(i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM f GROUP BY doc_id),
c AS (SELECT doc_id, words, coalesce((SELECT list_distinct(flatten(list_transform(gone, lambda i: range(i, i + 50)))) FROM g WHERE g.doc_id = d.doc_id), []) AS cut FROM d)
SELECT doc_id, len(words) AS n_words, len(cut) AS n_removed,
       sha256(coalesce(list_aggregate(list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(cut, i)), lambda i: words[i]), 'string_agg', ' '), '')) AS kept_sha256
FROM c""",
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q""",
}
