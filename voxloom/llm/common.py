"""Helpers shared by the corpus operators: lineage cuts, Arrow batching, word tables and repeated-key filters."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Upper bound of one Arrow batch sent to a Python worker; long texts make batches of few rows.
ARROW_BATCH_BYTES = "4m"
#: Bytes up to which a table may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bits of a repeated-key filter, at most: 2**27 bits are 16 MiB, whatever the size of the corpus.
FILTER_BITS = 27
#: Bits of each of the filters that order keys by their counts: 2 MiB.
LEVEL_BITS = 24
#: Share of a filter's bits up to which it is halved.
FILTER_SHARE = 1 / 64
_BUCKET = 32768  # bits in one bitmap of Spark's bitmap_construct_agg


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that a batch of very long texts cannot exhaust a worker; the setting stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="voxloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with checkpoint() in the shared folder that the session names.

    ``spark.checkpoint.dir`` is read from the session; only on a local master, where neither it nor the context has a
    folder, is a temporary one set; on a cluster that is an error.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the session's checkpoint folder, which the driver and all executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_small(df: DataFrame, row_bytes: int = 40) -> bool:
    """Are the rows of a checkpointed ``df``, counted at ``row_bytes`` each, below the bound of what is broadcast?"""
    return df.count() * row_bytes <= BROADCAST_BYTES


def if_small(df: DataFrame, row_bytes: int = 40) -> DataFrame:
    """A checkpointed ``df``, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df, row_bytes) else df


def sorted_side(df: DataFrame) -> DataFrame:
    """``df``, which grows with the input, marked to be joined by sorting: else Spark broadcasts what was shuffled in up to
    10 MB, which as a hash table on the driver takes many times that."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as shuffles have: a small table that was gathered in few and will grow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any spelling of its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, giving free memory back to the system when its task ends: workers are reused by later stages."""

    def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return with_end


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let_go() -> None:
    """On the driver: plans and tables that nothing refers to any more, and free memory of Python and the JVM back to the system."""
    gc.collect()
    give_back()
    if (sc := SparkContext._active_spark_context) is not None:
        sc._jvm.System.gc()


# ---------------------------------------------------------------- words of a text as arrays


class Powers:
    """B**i and B**-i modulo 2**64, grown to the longest text seen by a worker."""

    base = 0x9E3779B97F4A7C15 | 1
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            inverse = pow(cls.base, -1, 1 << 64)
            up, down = np.full(size, cls.base, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads polynomial hashes over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of words as contracts define them: all but 0x20 and 0x09-0x0D.
BLACK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Bytes of letters: ASCII letters and all bytes of other characters.
LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def word_hashes(data: bytes, of: np.ndarray = BLACK, most: int | None = None) -> np.ndarray:
    """A 64-bit hash of every maximal run of bytes for which the table ``of`` is true, in order; of its first ``most`` characters."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(of[b].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if most is not None:
        first = np.append(np.flatnonzero((b & 0xC0) != 0x80), [len(b)] * (most + 1))
        end = np.minimum(end, first[np.searchsorted(first[: len(first) - most], start) + most])
    up, down = Powers.to(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries; ``n`` is a power of two."""
    step = 1
    while step < n and len(h):
        h = mix(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum, logical_and) over every window of ``width`` entries, by doubling."""
    if len(a) < width:
        return a[:0]
    size = 1
    while size * 2 <= width:
        a, size = op(a[:-size], a[size:]), size * 2
    rest = width - size
    return op(a[:-rest], a[rest:]) if rest else a


# ---------------------------------------------------------------- keys that occur more than once


class KeyFilter:
    """A bitmap of bounded size over hashed keys, without false negatives.

    It only decides what has to travel: a key it wrongly reports as repeated costs a shuffled row and changes no
    result.  Its size is ``2**bits`` bits at most however large the corpus is, so it may be broadcast; one that is
    nearly empty is halved, its halves laid over each other.
    """

    def __init__(self, bitmap: np.ndarray, bits: int):
        held = int(np.bitwise_count(bitmap).sum())
        while bits > 10 and held <= FILTER_SHARE * (1 << (bits - 1)):
            half = len(bitmap) // 2
            bitmap, bits = bitmap[:half] | bitmap[half:], bits - 1
        self.bitmap, self.mask = bitmap, np.uint64((1 << bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def repeated_keys(keys: DataFrame, bits: int = FILTER_BITS):
    """Broadcast KeyFilter of the values of column ``k`` (long) that occur in two or more rows of ``keys``, or, where it
    has a column ``times``, more than once by that.

    Counting and building the bitmap run in Spark; the driver gets 2**bits bits at most.
    """
    n = F.sum("times") if "times" in keys.columns else F.count(F.lit(1))
    return key_filter(keys.groupBy("k").agg(n.alias("n")).where("n > 1"), bits)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS):
    """Broadcast KeyFilter of the distinct values of column ``k`` (long) of ``keys``."""
    at = F.col("k").bitwiseAND(F.lit((1 << bits) - 1))
    blocks = (
        keys.select(at.alias("at"))
        .groupBy(F.expr(f"at div {_BUCKET}").alias("block"))
        .agg(F.bitmap_construct_agg(F.expr(f"at % {_BUCKET}")).alias("bitmap"))
    )
    bitmap = np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8)
    for row in blocks.toLocalIterator():
        part = np.frombuffer(row["bitmap"], dtype=np.uint8)
        bitmap[row["block"] * (_BUCKET // 8) :][: len(part)] = part[: len(bitmap)]
    found = keys.sparkSession.sparkContext.broadcast(KeyFilter(bitmap, bits))
    del bitmap
    let_go()
    return found


class KeyLevels:
    """How many of ``filters`` report a key: a rough logarithm of its count, the same wherever it is asked for."""

    def __init__(self, filters: list[KeyFilter]):
        self.filters = filters

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return sum(f(keys).astype(np.int8) for f in self.filters)


def key_levels(counts: DataFrame, limits: tuple[int, ...], bits: int = LEVEL_BITS):
    """Broadcast KeyLevels of ``counts`` (k, n): for each of ``limits`` the keys of that ``n`` at least; for orders, where an error only costs time."""
    blocks = (
        counts.where(F.col("n") >= min(limits))
        .select(F.expr(f"k & {(1 << bits) - 1}L").alias("at"), "n")
        .groupBy(F.expr(f"at div {_BUCKET}").alias("block"))
        .agg(*[F.bitmap_construct_agg(F.expr(f"if(n >= {x}, at % {_BUCKET}, null)")).alias(f"b{x}") for x in limits])
    )
    maps = np.zeros((len(limits), (1 << bits) // 8), dtype=np.uint8)
    for row in blocks.collect():
        for own, x in zip(maps, limits):
            part = np.frombuffer(row[f"b{x}"], dtype=np.uint8)
            own[row["block"] * (_BUCKET // 8) :][: len(part)] = part
    found = counts.sparkSession.sparkContext.broadcast(KeyLevels([KeyFilter(m, bits) for m in maps]))
    del maps
    let_go()
    return found
