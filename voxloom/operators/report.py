"""Reports of preparation runs: skipped clips, warnings, the summary, labelled tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .checks import CROWDED

EXAMPLES = 3


def describe(name: Column, segment: Column, detail: Column) -> Column:
    """``name#segment (detail)``; segment 0 and an empty detail are not shown."""
    shown = F.when(segment > 0, F.concat(name, F.lit("#"), segment.cast("string"))).otherwise(name)
    return F.when(F.coalesce(detail, F.lit("")) != "", F.concat(shown, F.lit(" ("), detail, F.lit(")"))).otherwise(shown)


def skip_lines(skips: DataFrame, order: str) -> DataFrame:
    """Rows (reason, n, first, line) of skips (reason, name, segment, detail, order): the report's line of each reason.

    Most common first, ties by first seen.  Only the first EXAMPLES of a reason are gathered.
    """
    rows = skips.withColumn("__d", describe(F.col("name"), F.col("segment"), F.col("detail")))
    top = rows.withColumn("__r", F.row_number().over(Window.partitionBy("reason").orderBy(order))).where(F.col("__r") <= EXAMPLES)
    shown = top.groupBy("reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", "__d"))), lambda x: x["__d"]), ", ").alias("__shown"))
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    more = F.when(F.col("n") > EXAMPLES, F.concat(F.lit(", +"), (F.col("n") - EXAMPLES).cast("string"), F.lit(" more"))).otherwise("")
    line = F.concat(F.lit(" " * 13), F.lpad(F.col("n").cast("string"), 5, " "), F.lit("  "), F.rpad("reason", 16, " "), F.lit(" "), "__shown", more)
    return counts.join(shown, "reason").select("reason", "n", "first", line.alias("line"))


# The texts of warnings and of the summary's lines.
def warnings(totals: dict) -> list[str]:
    """What costs rows or quality if it is ignored; ``totals`` is a finished report's one row."""
    t, notes = totals, []
    if t["longest_tokens"] > t["max_tokens"] * CROWDED:
        notes.append(f"longest row is {t['longest_tokens']} tokens, {t['longest_tokens'] / t['max_tokens']:.0%} of the {t['max_tokens']}-token limit; lower --max-seconds to leave headroom")
    if t.get("unmatched_rows"):
        notes.append(f"{t['unmatched_rows']} metadata rows name a file that is not in the source directory")
    if t.get("ambiguous_names"):
        notes.append(f"{t['ambiguous_names']} metadata names match more than one recording and were ignored; use paths relative to the source directory to disambiguate")
    if t.get("train_rows", 0) + t.get("val_rows", 0) and not t.get("val_rows") and t.get("val_output"):
        notes.append("val split rounded to zero rows; the corpus is too small to hold any out")
    if t.get("stale_val"):
        notes.append(f"{t['stale_val']} is left over from a run with --val-split; its rows are now in the training file too, so delete it or pass --val-split again")
    return notes


def _duration(seconds: float) -> str:
    minutes, rest = divmod(round(seconds), 60)
    return f"{minutes // 60}:{minutes % 60:02d}:{rest:02d}" if minutes >= 60 else f"{minutes}:{rest:02d}"


def summary(totals: dict, skips: DataFrame | None = None, order: str = "seq") -> str:
    """The block that a finished run prints; the lines of skips come from Spark, one per reason."""
    t = totals
    made = f"{t['emitted']} encoded" + (f", {t['reused']} reused from the existing corpus" if t.get("reused") else "") + (f", from {t['split']} recordings that were split" if t.get("split") else "")
    rows = [("source", f"{t['source']} ({t['audio_files']} audio files)"), ("transcripts", t.get("transcript_source", "none found"))]
    rows += [("transcribed", f"{t['transcribed']} clips by ASR")] if t.get("transcribed") else []
    rows += [("clips", made)]
    if t.get("train_rows", 0) + t.get("val_rows", 0):
        rows.append(("duration", f"{_duration(t['total_seconds'])} total, longest {t['longest_seconds']:.1f} s / {t['longest_tokens']} tokens"))
    written = f"{t['output']} ({t.get('train_rows', 0)} rows)" + (f", {t['val_output']} ({t.get('val_rows', 0)} rows)" if t.get("val_output") else "")
    rows.append(("written", "nothing (--dry-run)" if t.get("dry_run") else written))
    lines = [f"{label:<13}{value}" for label, value in rows]
    found = [] if skips is None else sorted(skip_lines(skips, order).collect(), key=lambda r: (-r["n"], r["first"]))  # one row per reason
    if found:
        lines += [f"{'skipped':<13}{sum(r['n'] for r in found)} clips", *(r["line"] for r in found)]
    return "\n".join(lines + [f"{'warning':<13}{note}" for note in warnings(t)])


def tokens_by_kind(tokens: DataFrame, key: str, order: str, kind: str, written: str, spoken: str, end: str, only: str | None = None) -> DataFrame:
    """Rows (key, kind, written array, spoken array): the tokens of each kind in order, without sentence ends."""
    rows = tokens.where(F.col(kind) != end)
    rows = rows if only is None else rows.where(F.col(kind) == only)
    found = rows.groupBy(key, kind).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(written).alias("w"), F.col(spoken).alias("s")))).alias("__t"))
    return found.select(key, kind, F.transform("__t", lambda x: x["w"]).alias("written"), F.transform("__t", lambda x: x["s"]).alias("spoken"))


def carry(words: Column, codes: Column, complete: Column, rate: int = 80, seconds: float = 5.0) -> Column:
    """(text, codes) that a finished chunk hands on: its words that end in the last seconds, and the codes from the first
    of them on; all codes where that is every word of a fully timed chunk.  Null without words or codes.

    ``words`` is an array of (spoken, start_ms, end_ms).
    """
    end = F.size(codes) * 1000.0 / rate
    late = F.greatest(F.lit(0.0), end - seconds * 1000)
    first = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w["end_ms"] >= late, i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(F.lit(0), F.get(words, first)["start_ms"])
    whole = complete & (first == 0) & (F.get(words, F.lit(0))["end_ms"] >= late) & (start < end)
    at = F.least(F.floor(F.when(whole, 0).otherwise(start) * rate / 1000).cast("int"), F.size(codes))
    kept = F.filter(F.transform(F.slice(words, first + 1, F.size(words)), lambda w: F.trim(w["spoken"])), lambda w: w != "")
    return F.when((F.size(words) > 0) & (F.size(codes) > 0), F.struct(F.array_join(kept, " ").alias("text"), F.slice(codes, at + 1, F.size(codes)).alias("codes")))


def word_times(words: Column, offset_codes: Column, rate: int = 80) -> Column:
    """Words (spoken, start_ms, end_ms) of a chunk as seconds from the start of the audio."""
    at = offset_codes / F.lit(float(rate))
    return F.transform(words, lambda w: F.struct(w["spoken"].alias("word"), (at + w["start_ms"] / 1000.0).alias("start"), (at + w["end_ms"] / 1000.0).alias("end")))


def worst_join(samples: DataFrame, session: str, order: str, value: str, joins: DataFrame) -> DataFrame:
    """Largest step of ``value`` at the joins (session, order: the first sample behind a join); null where there is none."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(session).orderBy(order)))
    rows = samples.withColumn("__step", step).join(joins.select(session, order).distinct(), [session, order], "left_semi")
    return samples.select(session).distinct().join(rows.groupBy(session).agg(F.max("__step").alias("worst_join")), session, "left")

