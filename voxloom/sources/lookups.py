"""Lookup files: presets, adapters, label tables, labelled token files, training corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.checks import looks_like_audio
from .corpus_files import _fs


def presets(spark: SparkSession, folder: str, manifest: str = "metadata.csv") -> DataFrame:
    """Rows (preset, audio, text, gender, tags array, rating int) of a folder's manifest, best rated first, then by name.

    A row needs a text and an existing audio file; of repeated names the last row counts; no folder or manifest, no rows.
    """
    schema = "preset string, audio string, text string, gender string, tags array<string>, rating int"
    if not _fs(spark, folder)[1].exists(_fs(spark, f"{folder}/{manifest}")[0]):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{manifest}")
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), cell("file_name").alias("audio"), cell("text").alias("text"), cell("gender").alias("gender"),
        F.filter(F.transform(F.split(cell("tags"), ";"), lambda t: F.trim(t)), lambda t: t != "").alias("tags"), F.nullif(cell("rating"), F.lit("")).try_cast("double").cast("int").alias("rating"),
    )
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("audio")).distinct()
    good = rows.where((F.col("text") != "") & looks_like_audio(F.col("audio"))).join(there, "audio", "left_semi")
    good = good.withColumn("preset", F.regexp_replace("audio", r"\.[^.]*$", ""))
    last = good.groupBy("preset").agg(F.max_by(F.struct("audio", "text", "gender", "tags", "rating"), "row").alias("r"))
    return last.select("preset", "r.*").orderBy(F.coalesce("rating", F.lit(-1)).desc(), "preset")


def adapters(spark: SparkSession, folder: str, marker: str = "adapter_config.json") -> DataFrame:
    """Rows (name), sorted: the folders right below ``folder`` that hold the marker file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", marker).load(folder)
    root = _fs(spark, folder)[1].getFileStatus(_fs(spark, folder)[0]).getPath().toUri().getPath().rstrip("/") + "/"
    rel = found.select(F.expr(f"substring(path, instr(path, '{root}') + {len(root)})").alias("rel"))
    return rel.where(F.size(F.split("rel", "/")) == 2).select(F.split("rel", "/")[0].alias("name")).distinct().orderBy("name")


def base_model_of(config: Column, exists: Column, fallback: str) -> Column:
    """The base model that an adapter's configuration records, or the fallback where that is a local path that is gone."""
    recorded = F.get_json_object(config, "$.base_model_name_or_path")
    local = recorded.rlike(r"^[./~]|^[A-Za-z]:")
    return F.when(recorded.isNull() | (local & ~F.coalesce(exists, F.lit(False))), F.lit(fallback)).otherwise(recorded)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (written, spoken) of a two-column table of tabs; a line of one column maps to itself."""
    rows = spark.read.option("sep", "\t").schema("written string, spoken string").csv(path)
    return rows.where("written is not null").select("written", F.coalesce("spoken", "written").alias("spoken"))


def labelled_tokens(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """Rows (line, kind, written, spoken) of a token file: kind, word and spoken form in three columns of tabs.

    PLAIN words are spoken as written, PUNCT lines are left out, ``<eos>`` lines have the kind EOS and empty words.
    """
    from .corpus_files import numbered

    parts = F.split(F.trim("value"), "\t")
    rows = numbered(spark, path).where("trim(value) <> ''").select("line", parts[0].alias("kind"), F.get(parts, F.lit(1)).alias("w"), F.get(parts, F.lit(2)).alias("s"))
    form = (lambda c: F.lower(c)) if lower else (lambda c: c)
    end = F.col("kind") == "<eos>"
    return rows.where("kind <> 'PUNCT'").select(
        "line", F.when(end, "EOS").otherwise(F.col("kind")).alias("kind"), F.when(end, "").otherwise(form(F.col("w"))).alias("written"),
        F.when(end, "").when(F.col("kind") == "PLAIN", form(F.col("w"))).otherwise(form(F.col("s"))).alias("spoken"),
    )


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text, fate) of a corpus of JSON lines: fate is null, ``unparseable`` or ``no_text``; blank lines are left out."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("v", F.try_parse_json("value"))
    text = F.try_variant_get("v", "$.text", "string")
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")) == "STRING", F.lit(False)) & (text != "")
    return lines.select(F.when(is_text, text).alias("text"), F.when(F.col("v").isNull(), "unparseable").when(~is_text, "no_text").alias("fate"))


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def artifact_report(resolvers: dict) -> list[tuple[str, str, str]]:
    """(name, status, value) of each resolver, a function of nothing: errors are told, not raised."""
    out = []
    for name, resolve in resolvers.items():
        try:
            value = resolve()
            out.append((name, "ok", str(value)) if value is not None else (name, "not configured", ""))
        except FileNotFoundError as e:
            out.append((name, "error", str(e)))
        except Exception as e:  # noqa: BLE001 - a report of what fails
            out.append((name, "unavailable", str(e)))
    return out
