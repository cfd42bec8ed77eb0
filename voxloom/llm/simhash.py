"""SimHash near-duplicates by multi-index hashing.

Fingerprints: one 64-bit SimHash per text over its word shingles.  Links: fingerprints at ``radius`` or fewer differing
bits.  Multi-index hashing finds them without comparing all pairs: every fingerprint is stored in one table per 32-bit
segment; by the pigeonhole principle two fingerprints within 2 bits agree in one of the two segments up to 1 bit, so
each fingerprint probes, for each segment, the Hamming ball of radius 1 around its own segment (33 values), and the
complete distance of what the tables return is verified.

A segment value held by more than ``bucket_limit`` fingerprints is not scanned: its rows are indexed again on the two
halves of the bits that are left, down to 8-bit segments, where a bucket holds 256 fingerprints at most.  That is exact:
the remaining distance is itself split by the pigeonhole principle.

Copies share a fingerprint and are collapsed to it first; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLACK, cut, grams, if_small, key_levels, let_go, mix, small_batches, sorted_side, spread, tidy, unused, word_hashes

SEED = 42
RADIUS = 2
BUCKET_LIMIT = 64
#: Bands of minima over five-word shingles: a pair of Jaccard 0.8 agrees in a band with probability 0.8**4, in one of 16 with 0.9998.
SHINGLE = 5
BANDS = 16
ROWS = 4
#: Texts of a band bucket up to which all its pairs are compared at once; those of a larger one meet one of them first.
BAND_LIMIT = 8
#: Rounds, at most, in which the members of a large band bucket meet one of them, before those that are still apart meet
#: by their rare shingles; a round that links less than half of what it compares is the last.
STAR_ROUNDS = 4
#: Of a shingle's number of texts the steps by which prefixes are ordered, and the bits of a set's signature.
LEVELS = (2, 16, 128, 1024)
SIGN = 512
#: Edges up to which their components are found in one task; with more, star rounds over all tasks find them.
EDGES_AT_ONCE = 1 << 19


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) word shingles of ``text``; 0 for a text without words or null.

    A text of fewer than ``words`` words has one shingle, all its words.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(found) < words:
        shingles = [b" ".join(found)]
    elif words == 3:
        shingles = [a + b" " + b + b" " + c for a, b, c in zip(found, found[1:], found[2:])]
    else:
        shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), 65536):
        h = np.array([hashed(s, SEED) for s in shingles[i : i + 65536]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bands: bool = False) -> DataFrame:
    """One row (id, fp long) per row of ``docs``; null texts count as empty.

    With ``bands`` also (t long, keys array<long>): the hash of the text and the band keys of its five-word shingles.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [b.column(0), pa.array(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))]
            if bands:
                keys = [band_keys(x).view(np.int64) if len(x := shingle_set(t)) else [] for t in texts]
                out += [b.column(2), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["id", "fp", "t", "keys"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    more = [F.xxhash64(text).alias("t")] if bands else []
    schema = f"id {kind}, fp long" + (", t long, keys array<long>" if bands else "")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), *more).mapInArrow(tidy(run), schema)


# ---------------------------------------------------------------- multi-index hashing


def _level(rows: DataFrame, width: int, one_sided: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of the index over segments of ``width`` bits.

    ``rows``: (fp, side, up, low): the fingerprint, 't' (stored) or 'p' (probing), the bucket of the level above and
    the bit from which ``2 * width`` bits are left.  Returns the table, the probes and the sizes of the table's buckets.
    ``one_sided`` probes clear bits only: of two rows whose segments differ in one bit, one finds the other.
    """
    mask = (1 << width) - 1
    split = (
        rows.select("fp", "side", "up", "low", F.explode(F.array(F.lit(0), F.lit(width))).alias("half"))
        .withColumn("seg", F.expr(f"shiftrightunsigned(fp, low + half) & {mask}L"))
        .withColumn("rest", F.expr(f"low + {width} - half"))
    )
    flips = F.expr(f"transform(sequence(0, {width}), i -> if(i = 0, 0L, shiftleft(1L, i - 1)))")
    if one_sided:
        flips = F.expr(f"filter(transform(sequence(0, {width}), i -> if(i = 0, 0L, shiftleft(1L, i - 1))), f -> (seg & f) = f)")
    stored = split.where("side = 't'").select(F.xxhash64("up", "half", "seg").alias("key"), "fp", "rest")
    probes = split.where("side = 'p'").select("fp", "rest", "up", "half", "seg", F.explode(flips).alias("flip"))
    probes = probes.select(F.xxhash64("up", "half", F.col("seg").bitwiseXOR(F.col("flip"))).alias("key"), "fp", "rest")
    return stored, probes, stored.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def neighbour_links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs in column ``fp`` that differ in 1 to ``radius`` (at most 2) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 cover a distance of 3 at most")
    start = spread(cut(fps.select("fp").where("fp is not null").distinct()))  # each row becomes 35
    rows = start.select("fp", F.explode(F.array(F.lit("t"), F.lit("p"))).alias("side"), F.lit(0).cast("long").alias("up"), F.lit(0).alias("low"))
    found: DataFrame | None = None
    width = 32
    while True:
        stored, probes, sizes = _level(rows, width, one_sided=width == 32)
        large = cut(sizes.where(F.col("n") > bucket_limit).select("key")) if width > 8 else None
        hot = large is not None and not large.isEmpty()
        few_stored = stored.join(large, "key", "left_anti") if hot else stored
        few_probes = probes.join(large, "key", "left_anti") if hot else probes
        pairs = (
            few_probes.select("key", F.col("fp").alias("u"))
            .join(sorted_side(few_stored.select("key", F.col("fp").alias("v"))), "key")
            .where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
            .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        )
        found = pairs if found is None else found.unionByName(pairs)
        if not hot:
            return found.distinct()
        large_t, large_p = stored.join(large, "key", "left_semi"), probes.join(large, "key", "left_semi")
        rows = cut(
            large_t.select("fp", F.lit("t").alias("side"), F.col("key").alias("up"), F.col("rest").alias("low")).unionByName(
                large_p.select("fp", F.lit("p").alias("side"), F.col("key").alias("up"), F.col("rest").alias("low"))
            )
        )
        width //= 2


# ---------------------------------------------------------------- links by shingle Jaccard


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased (A-Z) five-word shingles; a shorter text has one, of all its words."""
    h = word_hashes((text or "").encode().lower(), BLACK)
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], dtype=np.uint64) if len(h) else h
    return np.unique(mix(grams(h, 4)[:-1] * np.uint64(0x9FB21C651E98DF25) + h[4:]))


_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One hash per band of the minima of ``ROWS`` orders of ``shingles``."""
    low = np.full(len(_SALTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 8192):
        low = np.minimum(low, mix(shingles[i : i + 8192] ^ _SALTS[:, None]).min(axis=1))
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return key


def _texts(docs: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """One row (t, text) for each text of ``docs`` whose hash is in ``needed`` (t)."""
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    return cut(texts.join(if_small(cut(needed.distinct())), "t", "left_semi").dropDuplicates(["t"]))


def _verified(pairs: DataFrame, texts: DataFrame, jaccard: float) -> DataFrame:
    """Those of ``pairs`` (ta, tb, a, b) whose ``texts`` have a shingle Jaccard of ``jaccard`` at least, as (a, b)."""
    both = pairs.join(texts.select(F.col("t").alias("ta"), F.col("text").alias("xa")), "ta").join(texts.select(F.col("t").alias("tb"), F.col("text").alias("xb")), "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for xa, xb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                sa, sb = shingle_set(xa), shingle_set(xb)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(common >= jaccard * (len(sa) + len(sb) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("a", "b", "xa", "xb").mapInArrow(tidy(run), "a long, b long").distinct())


def similar_links(
    fps: DataFrame, docs: DataFrame, jaccard: float, text_col: str = "text", bucket_limit: int = BAND_LIMIT, known: DataFrame | None = None
) -> DataFrame:
    """Pairs (a, b) of fingerprints with texts of a five-word shingle Jaccard of ``jaccard`` at least, enough to connect them.

    Texts that share the minima of a band are candidates, and each candidate is verified on its whole text.  In a bucket
    of more than ``bucket_limit`` texts all meet the one that shares most large buckets, in further rounds others, as
    long as half of what is compared is linked.  Texts of buckets that are still apart then meet by their rare shingles
    (``_prefix_links``), so no link is lost.  ``fps`` are the fingerprints of ``docs`` with their bands; ``known`` are
    links (a, b) that are there already.
    """
    bands = cut(fps.select("t", "fp", F.explode("keys").alias("key")).distinct())
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    sizes = cut(sizes.select("key", "n"))
    few = bands.join(sizes.where(F.col("n") <= bucket_limit).select("key"), "key", "left_semi")
    u, v = few.select("key", F.col("t").alias("ta"), F.col("fp").alias("a")), few.select("key", F.col("t").alias("tb"), F.col("fp").alias("b"))
    pairs = u.join(v, "key").where("ta < tb and a <> b").select("ta", "tb", "a", "b")
    many = bands.join(sizes.where(F.col("n") > bucket_limit), "key")
    many = cut(many.join(many.groupBy("t").agg(F.sum("n").alias("weight")), "t").select("key", "t", "fp", "weight"))
    hot, links = not many.isEmpty(), None
    for step in range(max(1, STAR_ROUNDS)):
        if hot:
            apart = _apart(many, known, links)
            if links is not None and apart.isEmpty():
                return links
            rank = F.struct("weight", "t") if step == 0 else F.struct(F.xxhash64("t", F.lit(step)))
            first = apart.groupBy("key").agg(F.max_by(F.struct("t", "fp", "root"), rank).alias("m"))
            star = first.join(apart, "key").where("m.root <> root").select(F.col("m.t").alias("ta"), F.col("t").alias("tb"), F.col("m.fp").alias("a"), F.col("fp").alias("b"))
            pairs = star if links is not None else pairs.unionByName(star)
        pairs = cut(pairs.distinct())
        new = _verified(pairs, _texts(docs, pairs.select(F.col("ta").alias("t")).union(pairs.select("tb")), text_col), jaccard)
        links = new if links is None else cut(links.unionByName(new).distinct())
        if not hot:
            return links
        if 2 * new.count() < pairs.count():
            break
    apart = _apart(many, known, links)
    return links if apart.isEmpty() else cut(links.unionByName(_prefix_links(apart, docs, jaccard, text_col)).distinct())


def _apart(many: DataFrame, *links: DataFrame | None) -> DataFrame:
    """The rows of ``many`` (key, t, fp, weight) in buckets that ``links`` do not connect, with the root of each."""
    links = [x for x in links if x is not None]
    if not links:
        return many.withColumn("root", F.col("fp"))
    roots = components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "fp")
    rooted = cut(many.join(roots, "fp", "left").select("key", "t", "fp", "weight", F.coalesce("root", "fp").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return cut(rooted.join(mixed, "key", "left_semi"))


def _levels(texts: DataFrame):
    """Broadcast KeyLevels of the shingles of ``texts`` (t, text): in how many of these each occurs, roughly."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            k, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(times)], ["k", "times"])

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(shingle_set(x))
                n += len(held[-1])
                if n >= 1 << 20:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    counts = texts.select("text").mapInArrow(tidy(counted), "k long, times long").groupBy("k").agg(F.sum("times").alias("n"))
    return key_levels(counts, LEVELS)


def _prefix_links(apart: DataFrame, docs: DataFrame, jaccard: float, text_col: str) -> DataFrame:
    """Links (a, b) between texts of ``apart`` (key, t, fp, weight, root) of different roots, enough to connect all that are linked.

    Prefix filtering: with the shingles of all texts in one order, two sets of n and m shingles and a Jaccard of j share
    one of the first n - ceil(j n) + 1 of the one and m - ceil(j m) + 1 of the other, and behind the first that they
    share each has enough left to reach the j (n + m) / (1 + j) that they have in common.  Rare shingles come first in the
    order: what a text shares with its whole group says little.  Sets that differ in d shingles have signatures (the
    parities of ``SIGN`` parts of each set) that differ in d bits at most.

    The texts that share a shingle meet the one with the fewest rarer ones before it, the plainest of its group.  What is
    still apart meets all that share a shingle with it, but for those of one root, the one of most texts, among themselves.
    """
    rows = cut(apart.select("t", "fp", "root").distinct())
    texts = _texts(docs, rows.select("t"), text_col)
    levels, signs = _levels(texts), [f"s{x}" for x in range(SIGN // 64)]

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, fp, root, x in zip(*(c.to_pylist() for c in b.columns)):
                found = shingle_set(x)
                n = len(found)
                odd = np.bincount((found % np.uint64(SIGN)).astype(np.int64), minlength=SIGN) & 1
                sign = np.packbits(odd.astype(np.uint8)).view(np.int64)
                found = found[np.argsort(levels.value(found), kind="stable")][: n - int(np.ceil(jaccard * n - 1e-9)) + 1]
                own = [np.full(len(found), y, dtype=np.int64) for y in (t, fp, root, n, *sign)]
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (*own, np.arange(len(found)), found.view(np.int64))], names)

    names = ["t", "fp", "root", "n", *signs, "i", "k"]
    firsts = rows.join(texts, "t").select("t", "fp", "root", "text").mapInArrow(tidy(prefix), ", ".join(f"{c} long" for c in names))
    differ = " + ".join(f"bit_count({s}a ^ {s}b)" for s in signs)
    near = F.expr(
        f"roota <> rootb and least(na - ia, nb - ib) * {1 + jaccard}D >= {jaccard}D * (na + nb) - 1e-6D"
        f" and (na + nb - ({differ})) * {1 + jaccard}D >= {2 * jaccard}D * (na + nb) - 1e-6D"
    )
    side = lambda df, x, *more: df.select("k", *more, *[F.col(c).alias(c + x) for c in names[:-1]])

    def mixed(firsts: DataFrame) -> DataFrame:
        """``firsts`` of shingles of several roots, with enough left to be near the smallest set there; ``main``: the root of most."""
        of = firsts.groupBy("k", "root").agg(F.count(F.lit(1)).alias("of"), F.min("n").alias("least"))
        of = of.groupBy("k").agg(F.max_by("root", F.struct("of", "root")).alias("main"), F.min("least").alias("least"), F.count(F.lit(1)).alias("roots"))
        enough = F.expr(f"(n - i) * {1 + jaccard}D >= {jaccard}D * (n + least) - 1e-6D")
        return cut(firsts.join(of.where("roots > 1").drop("roots"), "k").where(enough).select(*names, "main"))

    def verified(pairs: DataFrame) -> DataFrame:
        turn = [F.when(F.col("ta") < F.col("tb"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("ta", "tb"), ("tb", "ta"), ("fpa", "fpb"), ("fpb", "fpa"))]
        return _verified(cut(pairs.select(turn).distinct()).withColumnsRenamed({"fpa": "a", "fpb": "b"}), texts, jaccard)

    firsts = mixed(cut(firsts))
    plain = firsts.groupBy("k").agg(F.min_by(F.struct(*names[:-1]), F.struct("i", "n", "t")).alias("plain")).select("k", "plain.*")
    links = verified(side(plain, "a").join(side(firsts, "b"), "k").where(near))
    if not links.isEmpty():
        roots = components(links.unionByName(rows.select(F.col("fp").alias("a"), F.col("root").alias("b"))))
        roots = roots.select(F.col("node").alias("fp"), F.col("root").alias("now"))
        firsts = mixed(firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("now", "root")).select(names))
    pairs = side(firsts.where("root <> main"), "a", "main").join(side(firsts, "b"), "k")
    return cut(links.unionByName(verified(pairs.where(near & F.expr("ta < tb or rootb = main")))).distinct())


# ---------------------------------------------------------------- connected components


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges: the larger root of an edge hangs on the smaller one, then paths are shortened."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not sum(len(u) for u, _ in parts):
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at, root = at.reshape(2, -1), np.arange(len(nodes))
    while True:
        a, b = root[at]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    for i in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65536]), pa.array(nodes[root[i : i + 65536]])], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b long): root is the smallest node that it reaches.

    Up to ``EDGES_AT_ONCE`` edges, a few MB, are joined in one task, which spares the driver some hundred stages.  With
    more: alternating large-star and small-star steps; every round is checkpointed, and only a count reaches the driver.
    The rounds grow with the logarithm of the longest path; ``max_rounds`` is a guard that raises, it drops nothing.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    let_go()
    if e.count() <= EDGES_AT_ONCE:
        return cut(e.coalesce(1).mapInArrow(tidy(_joined), "node long, root long"))
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(sorted_side(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(sorted_side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(e)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    let_go()
    roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = RADIUS,
    bucket_limit: int = BUCKET_LIMIT,
    jaccard: float | None = None,
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    With ``jaccard`` texts of that five-word shingle Jaccard are linked as well, however far their fingerprints are.
    Nulls: a null text counts as empty (fingerprint zero); a null id is kept, belongs to its fingerprint's component,
    and is no candidate for component_id, which is null only where every id of the component is null.
    Repeated rows and repeated ids give a row each.  Other columns of ``docs``, whatever their names, are not read.
    An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words, bands=jaccard is not None))
    groups = fps.groupBy("fp").agg(F.min("id").alias("first"))
    groups = cut(groups)
    links = neighbour_links(groups.select("fp"), radius, bucket_limit)
    if jaccard is not None:
        links = cut(links)
        links = links.unionByName(similar_links(fps, docs, jaccard, text_col, min(bucket_limit, BAND_LIMIT), links)).distinct()
    comp = components(links)
    labelled = groups.join(sorted_side(comp.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = cut(labelled.join(sorted_side(lowest), "root").select("fp", "component_id"))
    return fps.join(sorted_side(of_fp), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id.

    Rows that repeat that id, or that have no id in a component without ids, are reduced to the one that comes first by
    text; all columns of the kept rows, whatever their names, are unchanged.  An empty table stays empty.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key, row = unused(docs, "keep"), unused(docs, "row")
    found = near_duplicates(docs.select(id_.alias("id"), text.cast("string").alias("text")), "id", "text", **options)
    one = found.groupBy("component_id").agg(F.count(F.expr("case when id = component_id then 1 end")).alias("own"), F.min("fingerprint").alias("fp"))
    one = cut(one)
    keep = one.where("component_id is not null").select(F.col("component_id").alias(key))
    kept = docs.join(if_small(keep), id_ == F.col(key), "left_semi")
    if one.where("own > 1 or component_id is null").isEmpty():
        return kept
    lone = found.where("component_id is null").select(F.col("fingerprint").alias(key)).distinct()
    nulls = docs.where(id_.isNull()).join(lone, _fingerprint_udf(text_col) == F.col(key), "left_semi")
    everything = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = lambda rows, by: rows.groupBy(by.alias(key)).agg(F.min_by(everything, F.struct(text.isNull(), text)).alias(row)).select(f"{row}.*")
    return first(kept, id_).unionByName(first(nulls, _fingerprint_udf(text_col)))


def _fingerprint_udf(text_col: str) -> Column:
    @F.pandas_udf("string")
    def hexed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fingerprint(t):016x}")

    return hexed(F.col(f"`{text_col}`").cast("string"))
