"""Sharding by extendible hashing.

A directory maps hash prefixes to shards.  All rows begin in one bucket; a bucket that exceeds the byte limit is split
on the next bit of the hash, and only that one, until every shard fits.  The bits are those of the id's MD5 and then, for
rows that share an id, those of the text's.

The directory is built from sums, not rows: bytes are pre-aggregated by the 12 next bits of the hash, and the 12 levels
of splits are read off the sums of all prefixes.  Only buckets that are still too large go on to the next 12 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, if_small, unused

#: Bytes of text of one shard.
SHARD_BYTES = 64 << 20
_STEP = 12  # bits of one round; 2**12 directory entries are the proven bound of what is broadcast
_BITS = 60  # bits taken from each of the two hashes


def _bits(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, _BITS // 4), 16, 10).cast("long")


def _round(rows: DataFrame, low: int, limit: int) -> DataFrame:
    """Directory entries for the bits ``low`` to ``low + 12`` of the rows (group, h, bytes), which all lie in too large buckets.

    (group, fine: the 12 bits, depth: of the leaf or null if still too large, shard_bytes, shard_docs)
    """
    fine = F.expr(f"shiftright(h, {_BITS - low - _STEP}) & {(1 << _STEP) - 1}L")
    sums = rows.groupBy("group", fine.alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    levels = sums.select("*", F.explode(F.expr(f"sequence(0, {_STEP})")).alias("d")).withColumn("prefix", F.expr(f"shiftright(fine, {_STEP} - d)"))
    totals = levels.groupBy("group", "d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = totals.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    leaf = levels.join(fits, ["group", "d", "prefix"]).groupBy("group", "fine").agg(F.min_by(F.struct("d", "shard_bytes", "shard_docs"), "d").alias("leaf"))
    return sums.select("group", "fine").join(leaf, ["group", "fine"], "left").select(
        "group", "fine", F.col("leaf.d").alias("d"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_docs").alias("shard_docs")
    )


def assign(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, bytes, shard, depth, shard_bytes, shard_docs), one for each row of ``docs``.

    ``shard`` is the hash prefix in binary ('' where one shard holds everything), ``depth`` its length.  A null text has
    0 bytes; null ids share one hash; rows with equal ids are told apart by their texts.  A single text above the limit
    has a shard of its own.  Rows equal in id and text that exceed the limit together cannot be split by a hash: they
    are dealt to numbered pages ``<prefix>+<page>`` in turn.  Other columns are not read; an empty table gives no shards.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), _bits(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("h"), _bits(text).alias("h2"), F.octet_length(text).cast("long").alias("bytes")
    )
    rows = cut(rows).withColumn("group", F.lit(""))
    done: list[DataFrame] = []
    for low in (*range(0, _BITS, _STEP), *range(_BITS, 2 * _BITS, _STEP)):
        if low == _BITS:
            rows = rows.withColumn("h", F.col("h2"))
        directory = cut(_round(rows, low % _BITS, limit))
        fine = F.expr(f"shiftright(h, {_BITS - low % _BITS - _STEP}) & {(1 << _STEP) - 1}L")
        # the first directory has 2**12 entries at most; later ones grow with the data, and large ones are joined by shuffle
        looked_up = rows.withColumn("fine", fine).join(F.broadcast(directory) if low == 0 else if_small(directory, 160), ["group", "fine"])
        looked_up = looked_up.withColumn("prefix", F.concat("group", F.expr(f"substring(lpad(bin(fine), {_STEP}, '0'), 1, coalesce(d, {_STEP}))")))
        done.append(
            looked_up.where("d is not null").select("id", "bytes", F.col("prefix").alias("shard"), F.length("prefix").alias("depth"), "shard_bytes", "shard_docs")
        )
        if directory.where("d is null").isEmpty():
            break
        rows = cut(looked_up.where("d is null").select("id", "h", "h2", "bytes", F.col("prefix").alias("group")))
    else:
        done.append(_pages(rows, limit))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Deal equal rows to pages in turn: numbered within each partition, then offset by the partitions before it."""
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("group", "part").orderBy("bytes")
    each = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(bytes, 1)"))
    numbered = rows.withColumn("nr", F.row_number().over(within)).join(parts, ["group", "part"]).withColumn("page", F.floor((F.col("before") + F.col("nr") - 1) / each))
    sums = numbered.groupBy("group", "page").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    shard = F.concat("group", F.lit("+"), F.col("page").cast("string"))
    return numbered.join(sums, ["group", "page"]).select("id", "bytes", shard.alias("shard"), F.length("group").alias("depth"), "shard_bytes", "shard_docs")


def write(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` below ``path``, one folder ``__shard=<prefix>`` for each shard; all columns are kept.

    Needs distinct, non-null ids: the shard is joined to the row by its id.  A column ``__shard`` of ``docs`` would be
    lost in the folders' names, so it is an error; all other names may be used.
    """
    if "__shard" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column __shard")
    key = unused(docs, "key")
    shards = assign(docs, limit, id_col, text_col).select(F.col(f"`{id_col}`").alias(key), F.concat(F.lit("s"), "shard").alias("__shard"))
    docs.join(shards, F.col(f"`{id_col}`") == F.col(key)).drop(key).repartition("__shard").write.partitionBy("__shard").parquet(path)
