"""Checks of requests, references, presets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The suffixes of audio files that voices and presets may have.
AUDIO_SUFFIXES = [".wav", ".flac", ".ogg", ".opus", ".mp3", ".m4a"]
MAX_TEXT = 5000
LOWEST_RATE, HIGHEST_RATE = 8000, 48000
SHORTEST_REFERENCE, LONGEST_REFERENCE = 1.0, 20.0
#: Share of the token limit from which the longest row is reported.
CROWDED = 0.8


def suffix(name: Column) -> Column:
    """The lower-case suffix of a path's last part; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def looks_like_audio(name: Column) -> Column:
    return suffix(name).isin(AUDIO_SUFFIXES)


def request_problem(text: Column, rate: Column, speed: Column, voice: Column, reference: Column) -> Column:
    """The first reason to refuse a synthesis request, null for a good one; null texts are blank."""
    return (
        F.when(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", " ")) == "", "blank text")
        .when(F.length(text) > MAX_TEXT, "text too long")
        .when(~rate.between(LOWEST_RATE, HIGHEST_RATE), "sample rate")
        .when(F.abs(speed - 1.0) > 1e-6, "speed")
        .when(voice.isNotNull() & reference.isNotNull(), "voice and reference")
    )


def reference_problem(audio: Column, codes: Column, transcript: Column) -> Column:
    """Why a cloning reference is refused: it is audio or codes, not both, and has a transcript."""
    return (
        F.when(audio.isNotNull() & codes.isNotNull(), "both audio and codes").when(audio.isNull() & codes.isNull(), "neither audio nor codes")
        .when(F.trim(F.regexp_replace(F.coalesce(transcript, F.lit("")), r"\s", " ")) == "", "no transcript")
    )


def voice_problem(name: Column, adapter: Column, codes: Column, transcript: Column, n_codes: int = 8192) -> Column:
    """Why a voice is refused: it has a name, an adapter or reference codes, a transcript with codes, codes of the codebook."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    some = F.coalesce(F.size(codes) > 0, F.lit(False))
    return (
        F.when(blank(name), "no name").when(adapter.isNull() & ~some, "neither adapter nor reference").when(some & blank(transcript), "reference without transcript")
        .when(some & F.exists(codes, lambda c: ~c.between(0, n_codes - 1)), "code outside the codebook")
    )


def sampling_problem(temperature: Column, top_p: Column, top_k: Column, penalty: Column, max_tokens: Column) -> Column:
    return (
        F.when(temperature <= 0, "temperature").when(~((top_p > 0) & (top_p <= 1)), "top_p").when(top_k < 0, "top_k").when(penalty <= 0, "repetition_penalty").when(max_tokens <= 0, "max_tokens")
    )


def one_message(errors: Column) -> Column:
    """Field errors, an array of (loc array<string>, msg), as one text; the first part of a place only says where it was sent."""
    path = lambda e: F.array_join(F.slice(e["loc"], 2, F.greatest(F.size(e["loc"]) - 1, F.lit(0))), ".")
    parts = F.transform(errors, lambda e: F.when(path(e) == "", F.coalesce(e["msg"], F.lit("invalid value"))).otherwise(F.concat(path(e), F.lit(": "), F.coalesce(e["msg"], F.lit("invalid value")))))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("the request body could not be parsed")


#: Containers that can be written, the one for a request that names none, and the one if that is not there.
FORMATS = ["mp3", "opus", "flac", "wav", "pcm"]
DEFAULT_FORMAT, FALLBACK_FORMAT = "mp3", "wav"


def response_format(name: Column, available: list[str] = FORMATS) -> Column:
    """(format, problem) of a request: none named is the default; aac and unknown names are refused."""
    key = F.lower(F.trim(name))
    default = DEFAULT_FORMAT if DEFAULT_FORMAT in available else FALLBACK_FORMAT
    problem = F.when(key == "aac", "needs an external encoder").when(~key.isin(FORMATS), "unknown format").when(~key.isin(available), "not available here")
    return F.struct(F.when(name.isNull(), default).when(problem.isNull(), key).alias("format"), problem.alias("problem"))


def response_headers(fmt: Column, rate: Column, voice: Column, streaming: Column) -> Column:
    """Header names and values; the base voice has a label of its own, streams tell proxies not to hold them back."""
    rows = [("X-Sample-Rate", rate.cast("string")), ("X-Voice", F.coalesce(F.nullif(voice, F.lit("")), F.lit("base"))), ("Content-Disposition", F.concat(F.lit('inline; filename="speech.'), fmt, F.lit('"')))]
    given = F.create_map(*[x for n, v in rows for x in (F.lit(n), v)])
    return F.when(streaming, F.map_concat(given, F.create_map(F.lit("X-Accel-Buffering"), F.lit("no")))).otherwise(given)


def reference_fate(seconds: Column, session: Column) -> Column:
    """What becomes of a cloning reference: sessions refuse long ones, single requests cut them."""
    return (
        F.when(seconds < SHORTEST_REFERENCE, "too short").when((seconds > LONGEST_REFERENCE) & session, "too long").when(seconds > LONGEST_REFERENCE, "cut").otherwise("whole")
    )


def presets(manifest: DataFrame, files: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """Rows of ``manifest`` with text and an audio suffix whose file is among ``files`` (same column); a left semi join."""
    good = manifest.where((F.trim(text) != "") & looks_like_audio(F.col(name)))
    return good.join(files.select(name), name, "left_semi")


def report_notes(longest: Column, limit: int, unmatched: Column, ambiguous: Column, rows: Column, held_out: Column, wants_held_out: bool, stale: bool) -> Column:
    """Keys of the remarks that a finished report deserves, in order."""
    notes = [
        F.when(longest > limit * CROWDED, "longest row is close to the limit"),
        F.when(unmatched > 0, "names without a recording"),
        F.when(ambiguous > 0, "names of several recordings"),
        F.when((rows > 0) & (held_out == 0) & F.lit(wants_held_out), "nothing held out"),
        F.when(F.lit(stale), "left-over validation file"),
    ]
    return F.filter(F.array(*notes), lambda n: n.isNotNull())
