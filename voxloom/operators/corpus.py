"""Corpus preparation: a reason for every dropped row, reports, merging, splits, pairing and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that a row breaks, else null; a rule on null counts as kept."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def prepared(docs: DataFrame, least: int = 100, most: int = 8000, max_tokens: int = 8192) -> DataFrame:
    """Documents with cleaned text, their token estimate and the reason to drop them (null: kept)."""
    df = docs.withColumn("clean", T.clean_text(F.col("text"))).withColumn("tokens", T.estimate_tokens(F.col("clean"), F.col("n_chars")).cast("long"))
    return df.withColumn(
        "reason",
        first_failure(
            ("empty", F.col("clean").isNull() | (F.col("clean") == "")),
            ("too short", F.col("n_chars") < least),
            ("too long", F.col("n_chars") > most),
            ("over budget", F.col("tokens") > max_tokens),
        ),
    )


def reasons(rows: DataFrame, order: str) -> DataFrame:
    """Rows dropped per reason, with the first of each: most common first, ties by first seen."""
    found = rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return found.orderBy(F.desc("n"), "first_seen")


def examples(rows: DataFrame, order: str, k: int = 3) -> DataFrame:
    """The first ``k`` rows of each reason and how many more there are.

    The k first are kept per partition by the window's group limit before anything is shuffled.
    """
    dropped = rows.where("reason is not null").select("reason", F.col(order).alias("seq"))
    top = dropped.withColumn("rn", F.row_number().over(Window.partitionBy("reason").orderBy("seq"))).where(F.col("rn") <= k)
    lists = top.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ", ").alias("examples"))
    return lists.join(dropped.groupBy("reason").agg((F.count(F.lit(1)) - k).alias("more")), "reason").withColumn("more", F.greatest("more", F.lit(0)))


def merge(carried: DataFrame, fresh: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Union by name; of rows that share a key the last one stays; rows without a key (null or empty) all stay.

    Fresh rows come after carried ones, within a side later ones by ``order``; without ``order``, and on ties, the row
    that is last by its content.  ``in_order`` sorts the result as a corpus is written.
    """
    both = carried.withColumn("__src", F.lit(0)).unionByName(fresh.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "__src"]
    row = F.struct(*names)
    rank = F.struct("__src", *([order] if order else []), F.to_json(row).alias("__json"))
    keyed = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    last = both.where(keyed).groupBy(key).agg(F.max_by(row, rank).alias("r")).select("r.*")
    return last.unionByName(both.where(~keyed | F.col(key).isNull()).select(names))


def in_order(rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows by key; those without one at the end, by ``order``."""
    anonymous = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return rows.orderBy(anonymous, F.when(~anonymous, F.col(key)), *([order] if order else []))


def split_size(n: int, fraction: float) -> int:
    return 0 if fraction <= 0 or n < 2 else min(max(1, int(n * fraction)), n - 1)


def holdout(rows: DataFrame, key: str, fraction: float, seed: str = "7") -> DataFrame:
    """``rows`` with ``held_out``: exactly ``split_size`` rows, those with the lowest hashes of seed and key.

    Exact without a global sort: a histogram over 4 hex digits of the hash finds the bucket of the k-th row, and only
    that bucket is ranked.  Keys are distinct.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("__b", F.substring("__h", 1, 4))
    counts = sorted((r["__b"], r["count"]) for r in hashed.groupBy("__b").count().collect())  # 65,536 numbers at most
    k = split_size(sum(n for _, n in counts), fraction)
    before, edge = 0, ""
    for b, n in counts:
        if before + n >= k > 0:
            edge = b
            break
        before += n
    ranked = hashed.where(F.col("__b") == edge).select(key, F.row_number().over(Window.orderBy("__h", key)).alias("__r"))
    inside = ranked.where(F.col("__r") <= k - before).select(F.col(key).alias("__k"))
    marked = hashed.join(inside, F.col(key) == F.col("__k"), "left")
    return marked.withColumn("held_out", (F.col("__b") < edge) | F.col("__k").isNotNull() if k else F.lit(False)).drop("__h", "__b", "__k")


def _answers(path: Column, full: Column | None = None) -> Column:
    """Names that a file answers to: its path, without suffix, base name, stem and full path, each also lower-cased."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    names = F.array(path, F.regexp_replace(path, r"\.[^.]*$", ""), base, F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), *([full] if full is not None else []))
    return F.array_distinct(F.concat(names, F.transform(names, F.lower)))


def _tries(name: Column) -> Column:
    """Names that a manifest row tries, in order: each as it is, then at once in lower case.

    As written, without leading dots and slashes, as a plain path (no empty or ``.`` parts), base name, stem.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "/+", "/"), r"(^|(?<=/))(\./)+", ""), r"(?<=.)/\.?$", "")
    base = F.regexp_extract(plain, "([^/]*)$", 1)
    names = F.array(name, F.regexp_replace(name, "^[./]+", ""), plain, base, F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))
    return F.flatten(F.transform(names, lambda n: F.array(n, F.lower(n))))


def pair(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (row, file, status) for manifest rows (row, name) and files (file[, path]): matched, ambiguous or unmatched.

    The first name that exactly one file answers to wins; a name of several files is poisoned.  ``path`` is a file's
    full path.
    """
    full = F.col("path") if "path" in files.columns else None
    keys = files.select("file", F.explode(_answers(F.col("file"), full)).alias("key")).distinct()
    keys = keys.groupBy("key").agg(F.count(F.lit(1)).alias("owners"), F.min("file").alias("file"))
    tried = manifest.select("row", F.posexplode(_tries(F.col("name"))).alias("priority", "key")).join(keys, "key", "left")
    best = tried.groupBy("row").agg(
        F.min_by("file", F.when(F.col("owners") == 1, F.col("priority"))).alias("hit"),
        F.max(F.coalesce(F.col("owners") == 1, F.lit(False))).alias("any"),
        F.max(F.coalesce(F.col("owners") > 1, F.lit(False))).alias("poisoned"),
    )
    status = F.when(F.col("any"), "matched").when(F.col("poisoned"), "ambiguous").otherwise("unmatched")
    return best.select("row", F.when(F.col("any"), F.col("hit")).alias("file"), status.alias("status"))


def precedence(files: DataFrame, manifest_texts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Text of each file: the manifest's, else the sidecar's if not empty, else null."""
    side = sidecars.select("file", F.nullif(T.clean_text(F.col("text")), F.lit("")).alias("side"))
    man = manifest_texts.groupBy("file").agg(F.max_by("text", F.when(T.clean_text(F.col("text")) != "", F.col("row"))).alias("man"))
    return files.join(man, "file", "left").join(side, "file", "left").select("file", F.coalesce("man", "side").alias("text"))


def cascade(requests: DataFrame, installed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve names (request, name): installed, else the part after ``:``, else an alias (case-blind), else base."""
    inst = installed.select("voice")
    out = requests.join(inst.select(F.col("voice").alias("exact")), F.col("name") == F.col("exact"), "left")
    out = out.withColumn("suffix", F.regexp_extract("name", "^[^:]+:(.+)$", 1)).join(inst.select(F.col("voice").alias("by_suffix")), F.col("suffix") == F.col("by_suffix"), "left")
    out = out.join(aliases.select(F.lower("alias").alias("alias"), "target"), F.lower("name") == F.col("alias"), "left")
    how = F.when(F.col("exact").isNotNull(), "installed").when(F.col("by_suffix").isNotNull(), "suffix").when(F.col("target").isNotNull(), "alias").otherwise("base")
    return out.select("request", F.coalesce("exact", "by_suffix", "target", F.lit("base")).alias("voice"), how.alias("how"))


# Names that stock clients send, and those of the base voice.
STOCK_VOICES = ["alloy", "ash", "ballad", "cedar", "coral", "echo", "fable", "marin", "nova", "onyx", "sage", "shimmer", "verse"]
BASE_NAMES = ["base", "default"]


def is_generic(name: Column, aliases: DataFrame | None = None) -> Column:
    """Is the name a stock one or one of the base voice?  (An alias is one as well; those are a table.)"""
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(["", *STOCK_VOICES, *BASE_NAMES])


def resolve_voice(requests: DataFrame, installed: DataFrame, aliases: DataFrame, model_id: str) -> DataFrame:
    """(request, voice, how) of requests (request, name, model): the most deliberate choice first.

    An installed voice; a name that is neither generic nor an alias is ``unknown``; the voice of a ``<model_id>:<voice>``
    model; an alias whose target is installed (``missing`` if it is not); the base voice, null.
    """
    inst = F.broadcast(installed.select(F.col("voice").alias("__v")).distinct())  # the voices of one machine
    given = requests.withColumn("__n", F.trim(F.coalesce("name", F.lit(""))))
    tail = F.when(F.trim(F.element_at(F.split("model", ":", 2), 1)) == model_id, F.trim(F.get(F.split("model", ":", 2), F.lit(1))))
    out = given.join(inst.select(F.col("__v").alias("exact")), F.col("__n") == F.col("exact"), "left")
    out = out.withColumn("__t", tail).join(inst.select(F.col("__v").alias("by_model")), F.col("__t") == F.col("by_model"), "left")
    out = out.join(F.broadcast(aliases.select(F.lower("alias").alias("__a"), "target")), F.lower("__n") == F.col("__a"), "left")
    out = out.join(inst.select(F.col("__v").alias("by_alias")), F.col("target") == F.col("by_alias"), "left")
    known = is_generic(F.col("__n")) | F.col("__a").isNotNull()
    how = (
        F.when(F.col("exact").isNotNull(), "installed").when(~known, "unknown").when(F.col("by_model").isNotNull(), "model")
        .when(F.col("by_alias").isNotNull(), "alias").when(F.col("__a").isNotNull(), "missing").otherwise("base")
    )
    voice = F.when(how == "installed", F.col("exact")).when(how == "model", F.col("by_model")).when(how == "alias", F.col("by_alias"))
    return out.select("request", voice.alias("voice"), how.alias("how"))


def dangling_aliases(aliases: DataFrame, installed: DataFrame) -> DataFrame:
    """Aliases whose target is not installed; an anti join."""
    return aliases.join(installed.select(F.col("voice").alias("target")), "target", "left_anti").select("alias", "target")


def aliases_of(entries: Column) -> Column:
    """Map of lower-cased names to voices from ``a=b,c=d`` texts (an array); the last of a name wins, a bad entry raises."""
    items = F.filter(F.transform(F.flatten(F.transform(entries, lambda e: F.split(e, ","))), lambda t: F.trim(t)), lambda t: t != "")
    parts = F.transform(
        items,
        lambda t: F.when(
            F.instr(t, "=") > 0, F.struct(F.lower(F.trim(F.substring_index(t, "=", 1))).alias("key"), F.trim(F.regexp_replace(t, "^[^=]*=", "")).alias("value"))
        ),
    )
    checked = F.transform(F.arrays_zip(items.alias("t"), parts.alias("p")), lambda x: F.when(x["p"].isNull() | (x["p"]["key"] == "") | (x["p"]["value"] == ""), F.raise_error(F.concat(F.lit("bad voice alias "), x["t"]))).otherwise(x["p"]))
    # of repeated names only the last is left before the map is made
    last = F.filter(checked, lambda e, i: ~F.exists(F.slice(checked, i + 2, F.size(checked)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def snap_up(values: Column, allowed: list[int]) -> Column:
    """The next allowed value, or the largest."""
    steps = F.array(*[F.lit(a) for a in sorted(allowed)])
    return F.coalesce(F.array_min(F.filter(steps, lambda a: a >= values)), F.lit(max(allowed)))


def funnel(rows: DataFrame, text: Column, tokens: Column, start: Column, end: Column, max_length: int) -> DataFrame:
    """Loader validation: the first failure of each row in ``fate``; a missing end is counted but kept."""
    fate = first_failure(("no_text", text.isNull() | (F.trim(text) == "")), ("too_long", tokens > max_length), ("no_speech_start", ~start))
    return rows.select(fate.alias("fate"), end.alias("ended"), tokens.alias("tokens")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("fate") == "no_text").alias("no_text"),
        F.count_if(F.col("fate") == "too_long").alias("too_long"),
        F.count_if(F.col("fate") == "no_speech_start").alias("no_speech_start"),
        F.count_if(F.col("fate").isNull() & ~F.col("ended")).alias("no_speech_end"),
        F.count_if(F.col("fate").isNull()).alias("kept"),
        F.coalesce(F.max("tokens"), F.lit(0)).cast("long").alias("longest"),
    )


def changed(local: DataFrame, target: DataFrame) -> DataFrame:
    """Names whose content is missing or different at the target, by SHA-256; unowned targets are left alone."""
    mine = local.select("name", F.sha2("content", 256).alias("sha"))
    theirs = target.select("name", F.sha2("content", 256).alias("other"))
    state = F.when(F.col("other").isNull(), "missing").when(F.col("sha") != F.col("other"), "changed")
    return mine.join(theirs, "name", "left").select("name", state.alias("state")).where("state is not null")


def build_split(rows: DataFrame, key: str, fraction: float, seed: str = "42") -> DataFrame:
    """``holdout`` for a training run: at least one row is held out; a fraction that leaves nothing to train on raises."""
    n = rows.count()
    size = max(1, int(n * fraction)) if fraction > 0 else 0
    if size and size >= n:
        raise ValueError(f"a share of {fraction} held out leaves no training examples of {n} rows")
    ranked = holdout(rows, key, fraction, seed)
    return ranked.withColumn("turn", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))


def same_tables(declared: DataFrame, expected: DataFrame, key: str, content: str) -> DataFrame:
    """Differences of two tables as (key, problem): missing, unexpected, repeated or different content."""
    have = declared.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(content).alias("__c"))
    want = expected.select(key, F.col(content).alias("__e"), F.lit(True).alias("__x"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__x").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(~F.col("__c").eqNullSafe(F.col("__e")), "different")
    return have.join(want, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def choices(groups: list[tuple[str, DataFrame]], only: str | None = None) -> DataFrame:
    """Ordered union of labelled groups (label, value, pos): (kind, label, value) by group, then place."""
    out = None
    for n, (kind, rows) in enumerate(groups):
        if only in (None, kind):
            part = rows.select(F.lit(n).alias("group"), F.lit(kind).alias("kind"), "label", "value", "pos")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no group named {only}")
    return out.orderBy("group", "pos").select("kind", "label", "value")


def kind_of(names: DataFrame, name: str, cloned: DataFrame, prefix: str = "preset:") -> DataFrame:
    """``names`` with ``kind``: base for none, preset by prefix, clone by membership, else installed."""
    seen = cloned.select(F.col("name").alias("__c")).distinct()
    kind = F.when(F.coalesce(F.col(name), F.lit("")) == "", "base").when(F.col(name).startswith(prefix), "preset").when(F.col("__c").isNotNull(), "clone").otherwise("installed")
    return names.join(seen, F.col(name) == F.col("__c"), "left").withColumn("kind", kind).drop("__c")


def preset_label(preset: Column, gender: Column, tags: Column, text: Column) -> Column:
    """Number, gender and tags of a tagged preset; of others the name and the beginning of the text."""
    parts = F.array(F.element_at(F.split(preset, "_"), -1), F.concat(F.upper(F.substring(gender, 1, 1)), F.lower(F.substr(gender, F.lit(2)))), F.array_join(tags, ", "))
    tagged = F.array_join(F.filter(parts, lambda p: F.length(p) > 0), " · ")
    head = F.substring(text, 1, 47)
    short = F.when(F.length(text) <= 48, text).otherwise(F.concat(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head), F.lit("…")))
    return F.when((F.coalesce(gender, F.lit("")) == "") & (F.size(tags) <= 0), F.concat(preset, F.lit(" · “"), short, F.lit("”"))).otherwise(tagged)


def evaluation_due(log: DataFrame, run: str, step: str = "step", order: str = "seq", loss: str = "eval_loss", back: int = 5) -> DataFrame:
    """Log rows with ``due``: none of the run's last ``back`` rows, this one included, is an evaluation of the same step."""
    recent = Window.partitionBy(run).orderBy(order).rowsBetween(-(back - 1), 0)
    steps = F.collect_list(F.when(F.col(loss).isNotNull(), F.col(step))).over(recent)
    return log.withColumn("due", ~F.array_contains(steps, F.col(step)))


def override(preset: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``preset`` with the fields that ``overrides`` sets (not null) replaced."""
    own = overrides.select(key, *[F.col(f).alias("__" + f) for f in fields])
    return preset.join(own, key, "left").select(*[F.coalesce("__" + c, c).alias(c) if c in fields else F.col(c) for c in preset.columns])
