"""Sources and sinks: manifests, corpora as JSON lines, recordings, PCM WAV."""

from __future__ import annotations

import csv
import io
import json
import struct
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types

from ..functions.text import clean_text
from ..operators.checks import AUDIO_SUFFIXES

# Columns that hold a recording's name and its transcript, the names of metadata files and the suffixes of
# transcripts beside a recording, each in the order of preference.
NAME_COLUMNS = ("file_name", "filename", "file", "audio_file", "audio_filepath", "audio_path", "audio", "wav_path", "wav", "path", "clip", "utterance_id", "id", "name")
TEXT_COLUMNS = ("text", "transcript", "transcription", "sentence", "normalized_text", "text_normalized", "raw_text", "utterance", "caption")
METADATA_NAMES = ("metadata.csv", "metadata.tsv", "metadata.jsonl", "metadata.json", "transcripts.csv", "transcripts.tsv", "transcripts.jsonl", "transcripts.json")
SIDECAR_SUFFIXES = (".txt", ".lab")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def find_audio(spark: SparkSession, source: str, recursive: bool = True, ordered: bool = True) -> DataFrame:
    """Rows (path, rel, length) of audio files; parts of a name that begin with a dot leave it out; only names are read.

    ``source`` is a folder or one file; a missing one raises.  Rows are sorted by ``rel`` unless ``ordered`` is false.
    """
    at, fs = _fs(spark, source)
    if not fs.exists(at):
        raise FileNotFoundError(f"there is no folder or file {source}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(source).select("path", "length")
    if fs.getFileStatus(at).isFile():
        return found.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("rel"), "length")
    root = F.lit(fs.getFileStatus(at).getPath().toUri().getPath().rstrip("/") + "/")
    rel = F.expr("substring(path, instr(path, root) + length(root))")
    out = (
        found.withColumn("root", root).withColumn("rel", rel)
        .where(F.lower(F.regexp_extract("rel", r"(\.[^./]*)$", 1)).isin(*AUDIO_SUFFIXES) & ~F.col("rel").rlike(r"(^|/)\."))
        .select("path", "rel", "length")
    )
    return out.orderBy("rel") if ordered else out


def find_metadata(spark: SparkSession, root: str) -> str | None:
    """The first of the known metadata files right below ``root``."""
    return next((f"{root.rstrip('/')}/{n}" for n in METADATA_NAMES if _fs(spark, root)[1].exists(_fs(spark, f"{root.rstrip('/')}/{n}")[0])), None)


def read_sidecars(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Rows (rel, text) for ``files`` (rel): the transcript beside each, of the first suffix that holds text; null without."""
    at, fs = _fs(spark, root)
    base = F.lit(fs.getFileStatus(at).getPath().toUri().getPath().rstrip("/") + "/")
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,lab}").text(root)
    texts = texts.select(F.col("_metadata.file_path").alias("path"), clean_text(F.col("value")).alias("text")).withColumn("base", base)
    texts = texts.select(F.expr("substring(path, instr(path, base) + length(base))").alias("side"), "text").where("text <> ''")
    suffix = F.regexp_extract("side", r"(\.[^./]*)$", 1)
    rank = F.array_position(F.array(*map(F.lit, SIDECAR_SUFFIXES)), suffix)
    best = texts.where(rank > 0).groupBy(F.regexp_replace("side", r"\.[^./]*$", "").alias("stem")).agg(F.min_by("text", rank).alias("text"))
    return files.withColumn("stem", F.regexp_replace("rel", r"\.[^./]*$", "")).join(best, "stem", "left").select("rel", "text")


def sniff_delimiter(line: str, suffix: str = "") -> str:
    """Tab for .tsv; else the most frequent of comma, tab, bar and semicolon, the earlier on ties; comma if none."""
    if suffix == ".tsv":
        return "\t"
    counts = [(line.count(d), -i, d) for i, d in enumerate(",\t|;")]
    return max(counts)[2] if max(counts)[0] else ","


def pick_column(header: list[str], candidates: tuple[str, ...]) -> int | None:
    """Index of the first candidate that the header has."""
    keys = [h.strip().lstrip("﻿").lower().replace(" ", "_").replace("-", "_") for h in header]
    return next((keys.index(c) for c in candidates if c in keys), None)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row, name, text) of a CSV-like table or of JSON; rows without a name are dropped."""
    return read_metadata(spark, path)[0]


def read_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Rows (row, name, text) and how they were read; a file without rows raises.

    A table has a header only if both columns are recognised; else columns 0 and 1 are taken, first line included.
    JSON is one object per line, an array of objects, or (.json) one object: of names to texts, or of anything to
    objects; the columns are those of the first object.  A line that is no JSON raises with its number.
    """
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    rows, shape = _read_json(spark, path, suffix) if suffix in (".jsonl", ".json") else _read_table(spark, path, suffix)
    rows = rows.select("row", F.trim("name").alias("name"), clean_text(F.col("text")).alias("text")).where("name <> '' and text is not null")
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows, shape


def _columns(path: str, keys: list[str]) -> tuple[str, str]:
    n, t = pick_column(keys, NAME_COLUMNS), pick_column(keys, TEXT_COLUMNS)
    if n is None or t is None:
        raise ValueError(f"{path}: no fields for name and text among {', '.join(keys) or 'none'}")
    return keys[n], keys[t]


def _read_json(spark: SparkSession, path: str, suffix: str) -> tuple[DataFrame, str]:
    head = next((r[0].lstrip("\ufeff").lstrip() for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect()), "")
    if head.startswith("[") or head.startswith("{") and suffix == ".json":
        # one JSON value: a file of metadata, read as a whole
        whole = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
        if head.startswith("["):
            items, shape = F.expr("from_json(v, 'array<string>')"), "JSON array"
            rows = whole.select(F.posexplode(items).alias("row", "object"))
        else:
            rows, shape = whole.select(F.posexplode(F.expr("from_json(v, 'map<string,string>')")).alias("row", "key", "object")), "JSON object"
            if rows.where("not startswith(trim(object), '{')").limit(1).count() or not rows.limit(1).count():
                return rows.select("row", F.col("key").alias("name"), F.col("object").alias("text")), "filename -> text mapping"
    else:
        rows, shape = numbered(spark, path).where("trim(value) <> ''").select(F.col("line").alias("row"), F.col("value").alias("object")), "JSONL"
        bad = rows.where(F.try_parse_json("object").isNull()).agg(F.min("row")).first()[0]
        if bad is not None:
            raise ValueError(f"{path}: line {bad} is no JSON")
    rows = rows.where("startswith(trim(object), '{')")
    first = rows.agg(F.min_by("object", "row")).first()[0]
    if first is None:
        raise ValueError(f"{path} holds no JSON objects")
    n, t = _columns(path, list(json.loads(first)))
    value = lambda key: F.try_variant_get(F.try_parse_json("object"), f"$['{key}']", "string")
    return rows.select("row", value(n).alias("name"), F.coalesce(value(t), F.lit("")).alias("text")), f"{shape}, {n!r} -> {t!r}"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line, value) of a text file, lines from 1: counted within each partition, then offset by those before it."""
    rows = spark.read.text(path).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # one number per partition
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    known = spark.createDataFrame(offsets or [(0, 0)], "part int, before long")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(known), "part").select((F.col("before") + within + 1).alias("line"), F.regexp_replace("value", "^\ufeff", "").alias("value"))


def _read_table(spark: SparkSession, path: str, suffix: str) -> tuple[DataFrame, str]:
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} has no rows")
    sep = sniff_delimiter(first[0], suffix)
    header = next(csv.reader([first[0].lstrip("\ufeff")], delimiter=sep), [])
    n, t = pick_column(header, NAME_COLUMNS), pick_column(header, TEXT_COLUMNS)
    known = n is not None and t is not None and n != t
    df = spark.read.option("sep", sep).option("header", "false").option("quote", '"').option("multiLine", "true").csv(path)
    if len(df.columns) < 2:
        raise ValueError(f"{path} has one column")
    n, t = (n, t) if known else (0, 1)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.regexp_replace(df.columns[n], "^\ufeff", "").alias("name"), F.col(df.columns[t]).alias("text"))
    shape = f"header, {header[n]!r} -> {header[t]!r}" if known else "no header, columns 1 and 2"
    return rows.where("row > 0") if known else rows, shape


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Rows (raw, id, text) of JSON lines; blank lines, bad JSON, non-objects and rows without a string text are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = lines.select(F.col("value").alias("raw"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.text", "variant"))
    return v.where(kind == "STRING").select("raw", F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.text", "string").alias("text"))


def write_corpus(rows: DataFrame, path: str, lines: bool = False) -> None:
    """JSON lines, written beside ``path`` and renamed, so a corpus may be rewritten from itself.

    With ``lines`` the rows are one text column of finished lines.  The old corpus is renamed aside first and deleted
    last: after a crash either it or the new one is there in whole.
    """
    spark = rows.sparkSession
    staged, aside = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.text(staged) if lines else rows.write.json(staged)
    at, fs = _fs(spark, path)
    new, old = _fs(spark, staged)[0], _fs(spark, aside)[0]
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot move {staged} to {path}")
    if had:
        fs.delete(old, True)


def default_val_path(path: str) -> str:
    if path.endswith("train.jsonl"):
        return path[: -len("train.jsonl")] + "val.jsonl"
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}.val{dot}{suffix}" if dot else f"{path}.val"


def wav_bytes(samples: list[int], rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, dtype="<i2").tobytes())
    return out.getvalue()


def streaming_wav_header(rate: int) -> bytes:
    """A header whose sizes are placeholders, for a stream of unknown length."""
    return b"RIFF\xff\xff\xff\xffWAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data\xff\xff\xff\xff"


_WAV = types.StructType([types.StructField("rate", types.IntegerType()), types.StructField("wav", types.ArrayType(types.FloatType()))])


@F.pandas_udf(_WAV)
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """Mono samples in [-1, 1] of 16-bit PCM WAV files; several channels are averaged; other files give nulls."""
    rates, waves = [], []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as w:
                if w.getsampwidth() != 2:
                    raise wave.Error("not 16 bits")
                raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
                rates.append(w.getframerate())
                waves.append((raw.mean(axis=1) / 32768).astype(np.float32))
        except (wave.Error, EOFError, TypeError):
            rates.append(None)
            waves.append(None)
    return pd.DataFrame({"rate": pd.array(rates, dtype="Int32"), "wav": pd.Series(waves, dtype=object)})


def resample(wav: np.ndarray, old: int, new: int, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc resampling to ceil(new * n / old) samples."""
    wav = np.asarray(wav, dtype=np.float64)
    if old == new or not len(wav):
        return wav.astype(np.float32)
    n = -(-new * len(wav) // old)
    scale = min(1.0, new / old)
    half = int(np.ceil(zeros / scale))
    at = np.arange(n) * old / new
    near = np.floor(at).astype(int)[:, None] + np.arange(-half, half + 1)[None, :]
    x = (near - at[:, None]) * scale
    kernel = np.sinc(x) * np.cos(np.clip(x / zeros, -1, 1) * np.pi / 2) ** 2 * scale
    inside = (near >= 0) & (near < len(wav))
    return (np.where(inside, wav[np.clip(near, 0, len(wav) - 1)], 0) * kernel).sum(axis=1).astype(np.float32)
