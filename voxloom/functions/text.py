"""Column functions over text: cleaning, estimates, token and prompt layouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space in the Unicode sense; Java and RE2 read it alike.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
CODES_PER_SECOND = 80
PROMPT_TAGS = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once: inside a lambda over an array it would be for every element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def clean_text(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalise_key(c: Column) -> Column:
    return F.lower(F.translate(F.trim(F.regexp_replace(c, "^﻿", "")), " -", "__"))


def estimate_tokens(text: Column, codes: Column) -> Column:
    """Codes, the text's UTF-8 bytes (1 at least) and the prompt's tags."""
    return codes + F.greatest(F.lit(1), F.octet_length(F.trim(text))) + F.lit(PROMPT_TAGS)


def code_count(samples: Column, rate: Column) -> Column:
    return F.ceil(samples / F.floor(rate / CODES_PER_SECOND)).cast("long")


def encoder_input_rate(rate: Column) -> Column:
    return F.when(rate <= 16000, 16000).otherwise(32000)


def codes_to_seconds(codes: Column) -> Column:
    return codes / F.lit(float(CODES_PER_SECOND))


def seconds_to_codes(seconds: Column) -> Column:
    return (seconds * CODES_PER_SECOND).cast("int")


def format_duration(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from one hour; halves go to the even second."""
    s = F.bround(seconds, 0).cast("long")
    rest = F.lpad((s % 60).cast("string"), 2, "0")
    minutes = F.floor(s / 60)
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad((minutes % 60).cast("string"), 2, "0"), rest)).otherwise(F.concat_ws(":", minutes.cast("string"), rest))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024.0**2))
        .otherwise(F.format_string("%.1f GB", n / 1024.0**3))
    )


def tags_closed(c: Column) -> Column:
    """The last ``[`` does not stand after the last ``]``."""
    back = F.reverse(c)
    opened, closed = F.instr(back, "["), F.instr(back, "]")
    return (opened == 0) | ((closed > 0) & (closed < opened))


def tokens(c: Column) -> Column:
    """Bracketed tags and runs of non-space; an empty text is one empty token."""
    found = F.regexp_extract_all(c, F.lit(r"\[[^\[\]]*\]|\S+"), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def letters(word: Column) -> Column:
    """Lower-case letters and apostrophes of a word; a tag is ``@``."""
    plain = F.replace(F.lower(word), F.lit("’"), F.lit("'"))
    return F.when(word.rlike(r"^\[[^\[\]]*\]$"), F.array(F.lit("@"))).otherwise(F.regexp_extract_all(plain, F.lit("[a-z'@]"), F.lit(0)))


def stretch_limit_ms(word: Column) -> Column:
    return F.lit(200) + F.lit(150) * F.greatest(F.lit(1), F.size(letters(word)))


def format_audio_tokens(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<|s_"), c.cast("string"), F.lit("|>"))), "")


def parse_audio_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"<\|s_([0-9]+)\|>"), F.lit(1)), lambda x: x.cast("int"))


def tts_prompt(text: Column) -> Column:
    return F.concat(F.lit("<|text_start|>"), F.trim(text), F.lit("<|text_end|><|speech_start|>"))


def clone_prompt(reference: Column, codes: Column, text: Column) -> Column:
    return F.concat(F.lit("<|bos|><|text_start|>"), F.trim(reference), F.lit(" "), F.trim(text), F.lit("<|text_end|><|speech_start|>"), format_audio_tokens(codes))


def training_example(text: Column, codes: Column) -> Column:
    return F.concat(F.lit("<|bos|>"), tts_prompt(text), format_audio_tokens(codes), F.lit("<|speech_end|>"))


def squeeze_brackets(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"([\[\]])", " $1 "), " {2,}", " "))


def no_space_before_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+([!,.:;?])", "$1")


def pluralise(c: Column) -> Column:
    """Suppletive forms, then consonant + y, then sibilants, then -s."""
    known = F.create_map(*[F.lit(x) for pair in {"foot": "feet", "inch": "inches", "man": "men", "child": "children"}.items() for x in pair])
    return (
        F.when(known[c].isNotNull(), known[c])
        .when(c.rlike("[^aeiou]y$"), F.regexp_replace(c, "y$", "ies"))
        .when(c.rlike("(s|sh|ch|x|z)$"), F.concat(c, F.lit("es")))
        .otherwise(F.concat(c, F.lit("s")))
    )
