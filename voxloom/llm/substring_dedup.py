"""Removal of long repeated passages by FM-indexes of shards.

A window is ``WINDOW`` consecutive words of one document.  Every word covered by a window whose words also occur in a
document of a smaller id is removed.

1. Anchors: every half window has an anchor, the smallest hash of its 8-word runs.  Anchors that two rows share are
   counted in Spark and kept in a filter of fixed size.
2. A window all of whose halves have shared anchors may be repeated; only texts with such windows go on.  Their windows
   are grouped to segments: runs of windows with the same smallest anchor.  Equal windows have equal anchors, so equal
   windows meet in the shard of their anchor.
3. Equal segments are collapsed to one with the smallest id before anything else (a passage that a third of all
   documents share is one segment); only then their words are fetched, and they are dealt to shards by anchor.
4. An anchor with more than ``HOT`` different segments (near copies that differ in a word each) is split.  Windows with
   a run that only one text holds leave its segments; what is left is grouped to segments again, by the smallest hash
   of a run, by the 4 and then the 16 smallest, and at last by all words.  Equal windows have equal runs, so they meet
   at every level.  The limit decides where windows meet, not whether.
5. Per shard an FM-index over the segments is built; the segments stream through it backwards, and the matching
   statistics tell, for every window, the smallest id that holds it.
6. Intervals are joined back to the occurrences of the segments; the words that they cover are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import FILTER_BITS, cut, grams, if_small, mix, repeated_keys, sliding, small_batches, tidy, unused, word_hashes
from .fm_index import Shard

WINDOW = 50
#: Words of one FM-index.
SHARD_WORDS = 1 << 18
#: Different segments of one key that are indexed together; the levels of keys by which more are split.
HOT = 256
LEVELS = (1, 4, 16, None)


def _geometry(window: int) -> tuple[int, int]:
    """Words of an anchor's run (a power of two), and of a half window."""
    run = 1 << (min(8, max(1, window // 2)).bit_length() - 1)
    return run, max(run, window // 2)


def half_anchors(data: bytes, window: int) -> np.ndarray:
    """The anchor of every half window of a text of at least one window; else none."""
    h = word_hashes(data)
    if len(h) < window:
        return h[:0]
    run, half = _geometry(window)
    return sliding(grams(h, run), half - run + 1, np.minimum)


def _candidates(data: bytes, window: int, repeated) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that may be repeated, and their anchors."""
    m = half_anchors(data, window)
    if not len(m):
        return np.zeros(0, dtype=np.int64), m
    _, half = _geometry(window)
    fit = sliding(repeated(m), window - half + 1, np.logical_and)
    at = np.flatnonzero(fit)
    return at, (sliding(m, window - half + 1, np.minimum)[at] if len(at) else m[:0])


def _plan(docs: DataFrame, id_col: str, text_col: str, window: int, filter_bits: int):
    """The broadcast filter of shared anchors."""
    small_batches(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(half_anchors(t.encode(), window)) for t in b.column(0).to_pylist() if t]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)).view(np.int64))], ["k"])

    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return repeated_keys(usable.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(keys), "k long"), filter_bits)


def _may_repeat(repeated, window: int):
    @F.pandas_udf("boolean")
    def may_repeat(texts: pd.Series) -> pd.Series:
        return pd.Series([t is not None and len(_candidates(t.encode(), window, repeated.value)[0]) > 0 for t in texts], dtype=bool)

    return may_repeat


def _digest(segment: bytes) -> bytes:
    return hashlib.blake2b(segment, digest_size=16).digest()


def _runs(keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, last) of the maximal runs of consecutive places ``at`` with one key."""
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (keys[1:] != keys[:-1])]))
        last = np.append(first[1:], len(at)) - 1
        yield from zip(keys[first].view(np.int64).tolist(), at[first].tolist(), at[last].tolist())


def _finer(segment: bytes, window: int, level: int | None) -> np.ndarray:
    """A key for every window of a segment: of its ``level`` smallest runs, or of all its words."""
    h = word_hashes(segment)
    run, _ = _geometry(window)
    if level is None:
        key = np.zeros(len(h) - window + 1, dtype=np.uint64)
        for j in range(window):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(key)])
        return key
    h = np.lib.stride_tricks.sliding_window_view(grams(h, run), window - run + 1)
    k = min(level, h.shape[1])
    out = []
    for i in range(0, len(h), 4096):
        low = np.sort(np.partition(h[i : i + 4096], k - 1, axis=1)[:, :k], axis=1)
        key = np.zeros(len(low), dtype=np.uint64)
        for j in range(k):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + low[:, j])
        out.append(key)
    return np.concatenate(out)


_OCCURRENCE = "key long, sh binary, row long, doc long, start int, n int"


def _occurrences(held: DataFrame, repeated, window: int) -> DataFrame:
    """One row per segment of every text: key, digest of the words, row, doc, first word, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out: list[list] = [[] for _ in range(6)]
                for row, doc, text in zip(*(c.to_pylist() for c in b.slice(i, 64).columns)):
                    data = text.encode()
                    at, anchor = _candidates(data, window, repeated.value)
                    words = data.split() if len(at) else []
                    for key, lo, hi in _runs(anchor, at):
                        for column, value in zip(out, (key, _digest(b" ".join(words[lo : hi + window])), row, doc, lo, hi - lo + window)):
                            column.append(value)
                yield _batch(out, [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["key", "sh", "row", "doc", "start", "n"])

    return held.mapInArrow(tidy(run), _OCCURRENCE)


def _batch(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _repeated_runs(segments: DataFrame, window: int, filter_bits: int):
    """Broadcast filter of the runs of segments (key, sh, doc, times, seg) that more than one row holds.

    Neighbouring segments of a text share words, so ids are compared, not occurrences counted; a task puts out a run once.
    """
    run, _ = _geometry(window)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            k, low, high, times = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.maximum.reduceat(times[order], first)

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], ["k", "low", "high", "times"])

        for b in batches:
            for doc, times, seg in zip(*(c.to_pylist() for c in b.columns)):
                k = np.unique(grams(word_hashes(seg), run)).view(np.int64)
                held.append((k, np.full(len(k), doc), np.full(len(k), doc), np.full(len(k), times)))
                if len(held) == 4096:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 18:
                        yield emit()
                        held = []
        if held:
            yield emit()

    found = segments.select("doc", "times", "seg").mapInArrow(tidy(keys), "k long, low long, high long, times long")
    several = F.when((F.min("low") < F.max("high")) | (F.max("times") > 1), 2).otherwise(1)
    return repeated_keys(found.groupBy("k").agg(several.alias("times")), filter_bits)


def _sub_occurrences(segments: DataFrame, window: int, level: int | None, repeated) -> DataFrame:
    """One row per finer segment of every segment (key, sh, doc, times, seg), whose own key and digest become ``up``.

    Windows with a run that is not ``repeated`` are left out.
    """
    run_words, _ = _geometry(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out: list[list] = [[] for _ in range(8)]
                for up, up_sh, doc, times, seg in zip(*(c.to_pylist() for c in b.slice(i, 64).columns)):
                    at = np.flatnonzero(sliding(repeated.value(grams(word_hashes(seg), run_words)), window - run_words + 1, np.logical_and))
                    words, keys = seg.split(b" "), _finer(seg, window, level)[at]
                    for key, lo, hi in _runs(keys, at):
                        for column, value in zip(out, (key, _digest(b" ".join(words[lo : hi + window])), up, up_sh, doc, times, lo, hi - lo + window)):
                            column.append(value)
                types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield _batch(out, types, ["key", "sh", "up", "up_sh", "doc", "times", "start", "n"])

    return segments.select("key", "sh", "doc", "times", "seg").mapInArrow(tidy(run), "key long, sh binary, up long, up_sh binary, doc long, times long, start int, n int")


def _fetch(distinct: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """Rows (key, sh, doc, times, hot, seg): the words of segments, cut out of one text (columns ``on``, text) that holds each.

    The segments of one text travel as one array, which is no longer than the text.
    """
    wanted = distinct.select(*[F.col(f"at.{c}").alias(c) for c in on], F.struct("key", "sh", "doc", "times", "hot", "at.start", "at.n").alias("s"))
    wanted = wanted.groupBy(*on).agg(F.collect_list("s").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out: list[list] = [[] for _ in range(6)]
                for text, segments in zip(*(c.to_pylist() for c in b.slice(i, 64).columns)):
                    words = text.split()
                    for s in segments:
                        for column, value in zip(out, (s["key"], s["sh"], s["doc"], s["times"], s["hot"], b" ".join(words[s["start"] : s["start"] + s["n"]]))):
                            column.append(value)
                yield _batch(out, [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()], ["key", "sh", "doc", "times", "hot", "seg"])

    return texts.join(wanted, on).select(F.col("text").cast("binary").alias("text"), "s").mapInArrow(tidy(run), "key long, sh binary, doc long, times long, hot boolean, seg binary")


def _found(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Rows (key, sh, intervals) of segments by FM-indexes: all segments of a key share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one key follow each other; a shard takes whole keys.  It is one of several of a task, one at a time."""
        pending: list[tuple] = []
        words = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if words >= shard_words and row[0] != pending[-1][0]:
                    yield from _search_shard(pending, window)
                    pending, words = [], 0
                pending.append(row)
                words += row[4].count(b" ") + 1
        yield from _search_shard(pending, window)

    # The key is dealt by its hash: a join that is itself partitioned by the key would make Spark drop
    # repartition("key"), and its run-time re-planning (local reads, split partitions) then scatters a key over tasks.
    dealt = segments.repartition(F.xxhash64("key")).sortWithinPartitions("key").select("key", "sh", "doc", "times", "seg")
    return dealt.mapInArrow(tidy(run), f"key long, sh binary, intervals {_INTERVALS}")


def _different(occurrences: DataFrame, on: list[str], limit: int | None) -> tuple[DataFrame, bool]:
    """Different segments (key, sh, doc, times, at, hot) that may meet others, and whether any is hot: of a key of more
    than ``limit`` of them."""
    times = F.sum("times") if "times" in occurrences.columns else F.count(F.lit(1))
    distinct = cut(occurrences.groupBy("key", "sh").agg(F.min("doc").alias("doc"), times.alias("times"), F.min(F.struct(*on, "start", "n")).alias("at")))
    sizes = cut(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("times").alias("all")).where("all > 1"))
    cold = F.lit(True) if limit is None else F.col("size") <= limit
    hot = cut(sizes.where(~cold).select("key"))
    any_hot = not hot.isEmpty()
    # the rows of hot keys are picked before anything is dealt by key, so that no task gets all of one
    hot = if_small(hot) if any_hot else None
    few = (distinct.join(hot, "key", "left_anti") if any_hot else distinct).join(sizes.select("key"), "key", "left_semi").withColumn("hot", F.lit(False))
    return few.unionByName(distinct.join(hot, "key", "left_semi").withColumn("hot", F.lit(True))) if any_hot else few, any_hot


_INTERVALS = "array<struct<first_window:int,last_window:int,owner:bigint>>"
_INTERVAL_TYPE = pa.list_(pa.struct([("first_window", pa.int32()), ("last_window", pa.int32()), ("owner", pa.int64())]))


def _attached(occurrences: DataFrame, found: DataFrame) -> DataFrame:
    """``occurrences`` with the ``intervals`` of their segments, one row each; those without are left out.

    A passage that many rows hold is a group of small rows without a text; the join is left to be split at run time.
    """
    return occurrences.join(found.groupBy("key", "sh").agg(F.flatten(F.collect_list("intervals")).alias("intervals")), ["key", "sh"])


def _intervals(held: DataFrame, repeated, window: int, filter_bits: int, shard_words: int, hot_limit: int) -> DataFrame:
    """Rows (row, spans): intervals (low, high) of words to remove, from rows (row, doc, text); several for a row."""
    occurrences = cut(_occurrences(held, repeated, window))
    distinct, hot = _different(occurrences, ["row"], hot_limit)
    segments = _fetch(distinct, held, ["row"])
    above, found = [occurrences], []
    for level in LEVELS:
        if not hot:
            break
        segments = cut(segments)
        found.append(_found(segments.where("not hot"), window, shard_words))
        many = segments.where("hot")
        if level == LEVELS[0]:
            several = _repeated_runs(many, window, filter_bits)
        finer = cut(_sub_occurrences(many, window, level, several))
        distinct, hot = _different(finer, ["up", "up_sh"], None if level is None else hot_limit)
        above.append(finer)
        segments = _fetch(distinct, many.select(F.col("key").alias("up"), F.col("sh").alias("up_sh"), F.col("seg").alias("text")), ["up", "up_sh"])
    found.append(_found(segments, window, shard_words))
    # what finer segments found, in windows of the segments that they are parts of
    moved = "transform({i}, x -> named_struct('first_window', x.first_window + start, 'last_window', x.last_window + start, 'owner', x.owner))"
    while len(above) > 1:
        back = _attached(above.pop(), found.pop())
        # a segment that is held once takes only from smaller ids than its own
        own = "filter(intervals, x -> times > 1 or x.owner < doc)"
        back = back.select(F.col("up").alias("key"), F.col("up_sh").alias("sh"), F.expr(moved.format(i=own)).alias("intervals")).where("size(intervals) > 0")
        found[-1] = found[-1].unionByName(back)
    taken = _attached(occurrences, found[0])
    spans = f"transform(filter(intervals, x -> x.owner < doc), x -> named_struct('low', x.first_window + start, 'high', x.last_window + start + {window}))"
    return taken.select("row", F.expr(spans).alias("spans")).where("size(spans) > 0")


def _search_shard(rows: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """Build the index of a shard's segments and stream them through it."""
    if not rows:
        return
    shard = Shard((r[4].split(b" ") for r in rows), [r[2] for r in rows], window, foreign=False)
    match, owner = shard.statistics()
    keys, digests, found = [], [], []
    for (key, sh, *_), m, o in zip(rows, match, owner):
        at = np.flatnonzero(m >= window)
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(o[at]) != 0)]))
        end = np.append(new[1:], len(at)) - 1
        keys.append(key)
        digests.append(sh)
        found.append([{"first_window": a, "last_window": b, "owner": c} for a, b, c in zip(at[new].tolist(), at[end].tolist(), o[at[new]].tolist())])
    yield _batch([keys, digests, found], [pa.int64(), pa.binary(), _INTERVAL_TYPE], ["key", "sh", "intervals"])


def _spans(held: DataFrame, repeated, window: int, filter_bits: int, shard_words: int, hot_limit: int) -> DataFrame:
    """Rows (row, spans) of rows (row, doc, text); the intervals of one row are no more than its words."""
    return _intervals(held, repeated, window, filter_bits, shard_words, hot_limit).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def _kept_words(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    words = (text or "").encode().split()
    if spans is None or not len(spans):
        return words, len(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        gone[s["low"]] += 1
        gone[s["high"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k], len(words)


def digests(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    filter_bits: int = FILTER_BITS,
    shard_words: int = SHARD_WORDS,
    hot_limit: int = HOT,
) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each row of ``docs``.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  A null text has none.  Ids are integers; a row without an id
    loses nothing and takes nothing from others; rows that share an id take nothing from each other.  Other columns are
    not read; an empty table gives an empty one.
    """
    repeated = _plan(docs, id_col, text_col, window, filter_bits)
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that cannot lose words are done; the others go on."""
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out: list[list] = [[], [], []]
                for doc, text in zip(*(c.to_pylist() for c in part.columns)):
                    data = (text or "").encode()
                    goes_on = doc is not None and len(_candidates(data, window, repeated.value)[0]) > 0
                    words = [] if goes_on else data.split()
                    for column, value in zip(out, (text if goes_on else None, len(words), None if goes_on else hashlib.sha256(b" ".join(words)).hexdigest())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "text", "n_words", "kept_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(first), f"id {kind}, text string, n_words long, kept_sha256 string")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    held = rows.where("kept_sha256 is null").select("row", "id", F.col("id").cast("long").alias("doc"), "text")
    spans = _spans(held.select("row", "doc", "text"), repeated, window, filter_bits, shard_words, hot_limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, sha = [], [], []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, total = _kept_words(text, own)
                n.append(total)
                removed.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    done = rows.where("kept_sha256 is not null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    cut_up = held.join(spans, "row", "left").select("id", "text", "spans").mapInArrow(tidy(run), f"id {kind}, n_words long, n_removed long, kept_sha256 string")
    return done.unionByName(cut_up).withColumnRenamed("id", id_col)


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    filter_bits: int = FILTER_BITS,
    shard_words: int = SHARD_WORDS,
    hot_limit: int = HOT,
) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text_col``; all other columns are unchanged.

    Texts that lose nothing stay as they are, byte by byte; of the others the kept words are joined by one space.  A
    text that loses all its words leaves the table.  Nulls and repeated rows are treated as in ``digests``.
    """
    repeated = _plan(docs, id_col, text_col, window, filter_bits)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    may_repeat = _may_repeat(repeated, window)(F.when(id_.isNotNull(), text))
    row, own = unused(docs, "row"), unused(docs, "spans")
    held = cut(docs.where(may_repeat).withColumn(row, F.monotonically_increasing_id()))
    spans = _spans(held.select(F.col(row).alias("row"), id_.cast("long").alias("doc"), text.alias("text")), repeated, window, filter_bits, shard_words, hot_limit)
    held = held.join(spans.select(F.col("row").alias(row), F.col("spans").alias(own)), row, "left")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            words, total = _kept_words(text, cuts)
            out.append(text if len(words) == total else b" ".join(words).decode() if words else None)
        return pd.Series(out, dtype=object)

    # marked, else Spark asks it for the filter and again for the column, in a second Python worker of the task
    changed = held.withColumn(row, kept.asNondeterministic()(text, F.col(own))).where(F.col(row).isNotNull())
    names = [F.col(row).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return docs.where(~may_repeat).unionByName(changed.select(*names))
