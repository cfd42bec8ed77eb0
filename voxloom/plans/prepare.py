"""A folder of recordings to a training corpus: discover, segment, transcribe, filter, encode, merge, split, report.

The codec and the recogniser are functions that the caller brings; each is called where the clips are.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import corpus, report, signal
from ..operators.settings import Segmenting
from ..sources import corpus_files as files

FRAME_SECONDS, HOP_SECONDS, NOISE = 0.025, 0.010, 1e-4
_CLIP = "rel string, segment int, wav array<float>, rate int, seconds double, split boolean, text string, reason string, detail string"


# ---------------------------------------------------------------- one recording


def loud_frames(wav: np.ndarray, rate: int, top_db: float) -> tuple[np.ndarray, int, int]:
    """Which whole frames are within ``top_db`` of the loudest, and a frame and a hop in samples."""
    frame, hop = max(1, round(FRAME_SECONDS * rate)), max(1, round(HOP_SECONDS * rate))
    if len(wav) < frame:
        power = np.array([np.mean(np.asarray(wav, dtype=float) ** 2) if len(wav) else 0.0])
    else:
        sums = np.concatenate([[0.0], np.cumsum(np.asarray(wav, dtype=float) ** 2)])
        starts = np.arange(0, len(wav) - frame + 1, hop)
        power = np.maximum(sums[starts + frame] - sums[starts], 0) / frame
    rms = np.sqrt(power)
    top = rms.max()
    return (20 * np.log10(np.maximum(rms, 1e-10) / top) > -top_db if top > 1e-10 else np.zeros(len(rms), dtype=bool)), frame, hop


def cuts_in_silence(wav: np.ndarray, rate: int, s: Segmenting) -> list[int]:
    """The middles of the inner silences that are long enough."""
    loud, frame, hop = loud_frames(wav, rate, s.top_db)
    if not loud.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~loud).astype(np.int8), [0]])))
    spans = [(a * hop, min((b - 1) * hop + frame, len(wav))) for a, b in zip(edge[::2], edge[1::2]) if a and b < len(loud)]
    return [(a + b) // 2 for a, b in spans if b - a >= round(s.min_silence * rate)]


def pieces(wav: np.ndarray, rate: int, s: Segmenting) -> list[np.ndarray]:
    """Cut at the last silence within the limit, else at the next one; what has none stays whole."""
    limit, start, out = round(s.max_seconds * rate), 0, []
    cuts = cuts_in_silence(wav, rate, s) if len(wav) > limit else []
    while len(wav) - start > limit:
        within = [c for c in cuts if start < c <= start + limit]
        at = within[-1] if within else next((c for c in cuts if c > start + limit), None)
        if at is None:
            break
        out.append(wav[start:at])
        start = at
    return [p for p in [*out, wav[start:]] if len(p)]


def trimmed(wav: np.ndarray, rate: int, s: Segmenting) -> np.ndarray:
    """Without the silence at both ends, but for the pad; silence leaves nothing, speech to the end keeps its tail."""
    loud, frame, hop = loud_frames(wav, rate, s.top_db)
    at = np.flatnonzero(loud)
    if not len(at) or not len(wav):
        return wav[:0]
    pad = round(s.pad_seconds * rate)
    return wav[max(0, at[0] * hop - pad) : len(wav) if at[-1] == len(loud) - 1 else min(len(wav), at[-1] * hop + frame + pad)]


# The reasons and details that a report shows.
def clips_of(rel: str, content: bytes, text: str | None, s: Segmenting, splittable: bool) -> Iterator[tuple]:
    """Rows of _CLIP: usable clips, or why there are none."""
    skip = lambda segment, reason, detail: (rel, segment, None, None, None, False, None, reason, detail)
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2:
                raise wave.Error("not 16 bits")
            own = w.getframerate()
            wav = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
    except (wave.Error, EOFError, ValueError) as e:
        yield skip(None, "unreadable", (" ".join(str(e).split()) or type(e).__name__)[:90])
        return
    rate = 16000 if own <= 16000 else 32000
    wav = files.resample(wav, own, rate)
    if not len(wav) or np.abs(wav).max() < NOISE:
        yield skip(None, "silent", "no signal above the noise floor")
        return
    found = pieces(wav, rate, s) if splittable else [wav]
    for i, piece in enumerate(found):
        clip = trimmed(piece, rate, s)
        seconds = len(clip) / rate
        if not len(clip):
            yield skip(i, "silent", "silent after trimming")
        elif seconds < s.min_seconds:
            yield skip(i, "too short", f"{seconds:.2f} s under the {s.min_seconds:g} s minimum")
        elif seconds > s.max_seconds:
            why = "with no silence to split on" if splittable else "and has a transcript, so it cannot be split; cut it yourself or re-run with --transcribe"
            yield skip(i, "too long", f"{seconds:.1f} s {why}")
        else:
            yield (rel, i, signal.level_out(clip, rate), rate, seconds, len(found) > 1, None if splittable else text, None, None)


# ---------------------------------------------------------------- the run


def discover(spark: SparkSession, source: str, metadata: str | None = None, recursive: bool = True) -> tuple[DataFrame, dict]:
    """Rows (path, rel, text) of the recordings, and what the report says of their transcripts.

    A manifest goes before what is beside a recording; of several rows for one the last with a text counts.
    """
    found = files.find_audio(spark, source, recursive, ordered=False)
    n = found.count()
    if not n:
        raise FileNotFoundError(f"{source} holds no recordings ({', '.join(files.AUDIO_SUFFIXES)})")
    at, fs = files._fs(spark, source)
    root = source if fs.getFileStatus(at).isDirectory() else str(at.getParent())
    metadata = metadata or files.find_metadata(spark, root)
    told = {"audio_files": n, "unmatched_rows": 0, "ambiguous_names": 0, "transcript_source": "none found"}
    listed = found.select("path", F.col("rel").alias("file"))
    texts = None
    if metadata:
        rows, told["transcript_source"] = files.read_metadata(spark, metadata)
        paired = rows.join(corpus.pair(listed.select("file", F.regexp_replace("path", "^file:/*", "/").alias("path")), rows.select("row", "name")), "row")
        counts = {r["status"]: r["count"] for r in paired.groupBy("status").count().collect()}  # three rows
        told |= {"unmatched_rows": counts.get("unmatched", 0), "ambiguous_names": counts.get("ambiguous", 0)}
        texts = paired.where("status = 'matched' and text <> ''").groupBy("file").agg(F.max_by("text", "row").alias("text"))
    beside = files.read_sidecars(spark, root, found).select(F.col("rel").alias("file"), F.col("text").alias("beside"))
    out = listed.join(beside, "file", "left")
    out = out.join(texts, "file", "left") if texts is not None else out.withColumn("text", F.lit(None).cast("string"))
    sidecars = out.where("text is null and beside is not null").count()
    if sidecars:
        note = f"{sidecars} from {'/'.join(files.SIDECAR_SUFFIXES)} sidecars"
        told["transcript_source"] = f"{told['transcript_source']}, {note}" if metadata else note
    return out.select("path", F.col("file").alias("rel"), F.coalesce("text", "beside").alias("text")), told


def _kept(df: DataFrame) -> DataFrame:
    """``df`` kept on disk for this run.  A cached plan is matched by its shape, and a later run over files that have
    changed has the same one, so each is marked."""
    return df.where(F.lit(uuid.uuid4().hex) != "").persist(StorageLevel.DISK_ONLY)


def _corpus_lines(spark: SparkSession, path: str) -> DataFrame | None:
    at, fs = files._fs(spark, path)
    if not fs.exists(at):
        return None
    field = lambda name, kind: F.get_json_object("raw", f"$.{name}").cast(kind).alias(name)
    rows = files.read_corpus(spark, path).select("raw", "id", field("audio", "string"), field("seconds", "double"), field("tokens", "long"))
    return rows.withColumn("seq", F.monotonically_increasing_id())


def prepare(
    spark: SparkSession, source: str, output: str, *, encoder: Callable | None = None, transcriber: Callable | None = None, metadata: str | None = None, recursive: bool = True,
    settings: Segmenting | None = None, val_split: float = 0.0, val_output: str | None = None, seed: int = 42, max_tokens: int = 4096, transcribe: bool | None = None,
    overwrite: bool = False, dry_run: bool = False,
) -> tuple[dict, DataFrame]:
    """Write the corpus of the recordings below ``source`` to ``output``; returns the report's totals and the skips.

    ``encoder(wav, rate)`` gives codes, ``transcriber(wav, rate)`` a text.  Files that the corpus already has are left
    out; rows merge by id, the new one wins.  ``transcribe`` None transcribes what has no text, True everything (and long
    recordings may be split), False nothing.  A dry run encodes and writes nothing.
    """
    settings = settings or Segmenting()
    settings.validate()
    if not 0 <= val_split < 1:
        raise ValueError(f"val_split = {val_split} is no share of the corpus")
    found, totals = discover(spark, source, metadata, recursive)
    sibling = val_output or files.default_val_path(output)
    val_path = sibling if val_split > 0 else None
    totals |= {"source": source, "output": output, "val_output": val_path, "max_tokens": max_tokens, "dry_run": dry_run}
    old = [] if overwrite or dry_run else [c for c in (_corpus_lines(spark, output), _corpus_lines(spark, sibling)) if c is not None]
    if old and val_path is None and files._fs(spark, sibling)[1].exists(files._fs(spark, sibling)[0]):
        totals["stale_val"] = sibling.rsplit("/", 1)[-1]
    carried = None
    for part in old:
        carried = part if carried is None else carried.unionByName(part)
    if carried is not None:
        carried = _kept(carried)
        totals["reused"] = carried.count()
        found = found.join(carried.where("audio is not null").select(F.col("audio").alias("rel")), "rel", "left_anti")

    may_listen = transcribe is not False
    listen = transcriber if may_listen else None
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "content")
    todo = found if may_listen else found.where("text is not null")
    every = transcribe is True

    def cut_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _CLIP.split(", ")]
        for p in parts:
            for rel, data, text in zip(p["rel"], p["content"], p["text"]):  # one recording at a time in memory
                yield pd.DataFrame(list(clips_of(rel, data, text, settings, every or text is None)), columns=names)

    clips = todo.join(content, "path").select("rel", "content", "text").mapInPandas(cut_up, _CLIP)

    def spoken(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            heard = []
            for i, (reason, text) in enumerate(zip(p["reason"], p["text"])):
                heard.append(None)
                if reason is not None or text:
                    continue
                if listen is None:
                    p.loc[p.index[i], ["reason", "detail"]] = ["no transcript", "no recogniser is given"]
                    continue
                said = " ".join(str(listen(np.asarray(p["wav"].iloc[i], dtype=np.float32), int(p["rate"].iloc[i])) or "").split())
                heard[-1] = bool(said)
                p.loc[p.index[i], "text"] = said
                if not said:
                    p.loc[p.index[i], ["reason", "detail"]] = ["empty transcript", "ASR heard no speech"]
            yield p.assign(transcribed=pd.Series(heard, index=p.index, dtype=object))

    heard = clips.mapInPandas(spoken, _CLIP + ", transcribed boolean") if may_listen else clips.withColumn("transcribed", F.lit(None).cast("boolean"))
    estimate = T.estimate_tokens(F.coalesce("text", F.lit("")), T.code_count(F.size("wav"), F.col("rate"))).cast("long")
    heard = heard.withColumn("tokens", F.when(F.col("reason").isNull(), estimate))
    over = F.col("reason").isNull() & (F.col("tokens") > max_tokens)
    heard = heard.withColumn("detail", F.when(over, F.concat(F.lit("~"), F.col("tokens").cast("string"), F.lit(f" tokens over the {max_tokens}-token row limit"))).otherwise(F.col("detail")))
    heard = heard.withColumn("reason", F.when(over, "too long").otherwise(F.col("reason")))
    heard = _kept(heard)

    skips = heard.where("reason is not null").select("rel", F.coalesce("segment", F.lit(0)).alias("segment"), "reason", "detail")
    if not may_listen:
        untold = found.where("text is null").select("rel", F.lit(0).alias("segment"), F.lit("no transcript").alias("reason"), F.lit("no sidecar and no metadata row; drop --no-transcribe to transcribe it").alias("detail"))
        skips = skips.unionByName(untold)
    skips = skips.select(F.struct("rel", "segment").alias("seq"), F.regexp_extract("rel", "([^/]*)$", 1).alias("name"), "segment", "detail", "reason")

    good = heard.where("reason is null").select(F.concat("rel", F.lit("#"), F.col("segment").cast("string")).alias("id"), F.col("rel").alias("audio"), "segment", F.round("seconds", 3).alias("seconds"), "tokens", "text", "wav", "rate")
    if not dry_run:
        if encoder is None:
            raise ValueError("an encoder is needed to write a corpus")

        def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                codes = [np.asarray(encoder(np.asarray(w, dtype=np.float32), int(r)), dtype=np.int64)[: -(-len(w) // (int(r) // 80))].tolist() for w, r in zip(p["wav"], p["rate"])]
                yield p.drop(columns=["wav", "rate"]).assign(codes=pd.Series(codes, index=p.index, dtype=object))

        good = good.mapInPandas(encoded, "id string, audio string, segment int, seconds double, tokens long, text string, codes array<long>")
        good = good.withColumn("tokens", T.estimate_tokens(F.col("text"), F.size("codes")).cast("long")).withColumn("text", T.training_example(F.col("text"), F.col("codes"))).drop("codes")
        good = _kept(good)
    else:
        good = good.drop("wav", "rate", "text")
    fresh = good.select(F.to_json(F.struct(*good.columns)).alias("raw"), "id", "audio", "seconds", "tokens", F.lit(0).cast("long").alias("seq"))
    rows = fresh if carried is None else corpus.merge(carried, fresh, order="seq")
    counted = heard.agg(F.count_if(F.col("reason").isNull()).alias("emitted"), F.count_if(F.col("transcribed")).alias("transcribed"), F.count_distinct(F.when(F.col("split"), F.col("rel"))).alias("split")).first()
    totals |= {k: counted[k] for k in ("emitted", "transcribed", "split")}
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total"), F.coalesce(F.max("seconds"), F.lit(0.0)).alias("long"), F.coalesce(F.max("tokens"), F.lit(0)).alias("most")).first()
    totals |= {"total_seconds": sums["total"], "longest_seconds": sums["long"], "longest_tokens": sums["most"], "train_rows": sums["n"], "val_rows": 0}
    if dry_run:
        return totals, skips
    # rows without an id are told apart by their place
    keyed = rows.withColumn("key", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("#"), F.xxhash64("raw").cast("string"), F.lit("#"), F.col("seq").cast("string"))))
    if val_path:
        marked = _kept(corpus.holdout(keyed, "key", val_split, str(seed)))
        totals["val_rows"] = marked.where("held_out").count()
        totals["train_rows"] -= totals["val_rows"]
        files.write_corpus(corpus.in_order(marked.where("held_out"), "id", "seq").select("raw"), val_path, lines=True)
        keyed = marked.where("not held_out")
    files.write_corpus(corpus.in_order(keyed, "id", "seq").select("raw"), output, lines=True)
    return totals, skips


def summary(totals: dict, skips: DataFrame) -> str:
    return report.summary(totals, skips)
