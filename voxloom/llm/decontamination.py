"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts and benchmark items are turned into templates: numbers become ``#``, names ``@`` and units ``%``; everything else
is a lower-case word.  Windows of ``WINDOW`` template words are hashed and joined.  Matches of one document and item that
lie on one diagonal (document position minus item position) are a passage; it counts if it has enough windows and its
slots are consistent: over the whole passage each value of the item stands for one value of the document and the other
way round.  So a question whose numbers, names or units were exchanged is found, and a chance template match is not.

Windows of the raw, case-folded words are joined next to the templates.  So are found, word for word, items that are
mostly numbers, names and units, whose templates say too little to be searched for, and copies in another case.  In
scripts that are written without spaces every character is a word.

Equal texts and equal items are searched once.  The window table of the benchmark is broadcast while its size is below a
bound; a larger one is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, if_small, unused

WINDOW = 8
#: Windows on one diagonal that make a passage: 13 words in a row.  Shorter items need all their windows but one.
MIN_WINDOWS = 6
#: Words other than placeholders that a window needs to be searched for by its template.
MIN_PLAIN = 4
#: An item of fewer words is found only where it is the whole text, word for word.
MIN_ITEM = 3

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degrees celsius fahrenheit kmh mph watt watts kwh volt volts"
).split()
#: A capitalised word after a lower-case word or a comma and up to 16 characters of white space; words in capitals
#: throughout are no names.
NAME = r"\p{Lu}(?<=[\p{Ll},;][\s\p{Z}]{1,16}\p{Lu})\p{Ll}+"
#: Scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana and Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f"
TOKEN = f"\u0001?[^{UNSPACED}\\P{{L}}]+|[{UNSPACED}]|[0-9]+(?:[.,][0-9]+)*"


def raw_tokens(text: Column) -> Column:
    """Lower-case words and numbers in order; names are marked by U+0001."""
    clean = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u0001"), F.lit(" "))
    return F.regexp_extract_all(F.lower(F.regexp_replace(clean, NAME, "\u0001$0")), F.lit(TOKEN), F.lit(0))


def _shape(w: Column) -> Column:
    return F.when((w < ":") & (w >= "0"), "#").when(w < "\u0002", "@").when(w.isin(NUMBER_WORDS), "#").when(w.isin(UNITS), "%").otherwise(w)


def template(tokens: Column) -> Column:
    """Placeholders for numbers, names and units; other tokens as they are."""
    return F.transform(tokens, _shape)


def _fold(w: Column) -> Column:
    """A token without the mark of names."""
    return F.ltrim(w, F.lit("\u0001"))


def _coded(tokens: Column) -> tuple[Column, str, str]:
    """Codes of the templates, and SQL of the codes of the words and of the places of placeholders, given the columns
    ``shapes`` and ``tokens``: a word that is no placeholder is its own template."""
    held = " or ".join(f"s = xxhash64('{c}')" for c in "#@%")
    words = f"zip_with(shapes, tokens, (s, w) -> if({held}, xxhash64(ltrim('\u0001', w)), s))"
    return F.transform(tokens, lambda w: F.xxhash64(_shape(w))), words, f"filter(transform(shapes, (s, i) -> if({held}, i, -1)), i -> i >= 0)"


def _hash(column: str, n: int, salt: int) -> str:
    """SQL of the hash of ``n`` codes from index ``i`` on; naming them one by one is faster than a slice."""
    return f"xxhash64({', '.join(f'{column}[i + {j}]' for j in range(n))}, {salt})"


def _windows(n: int) -> str:
    """SQL of (pos, hash) of all windows of ``n`` words, and of the templates of those with placeholders.

    Each of the latter belongs to its first placeholder: the j-th stands in those that begin behind the one before it.
    """
    none = "cast(array() as array<struct<pos:int,hash:bigint>>)"
    each = "transform(sequence({low}, {high}), i -> named_struct('pos', i, 'hash', {h}))"
    if n < MIN_ITEM:
        return f"if(size(words) = {n}, {each.format(low=0, high=0, h=_hash('words', n, -n))}, {none})"
    low, high = f"greatest(0, j - {n - 1}, if(x = 0, 0, at[x - 1] + 1))", f"least(j, size(words) - {n})"
    of_shapes = f"flatten(transform(at, (j, x) -> if({low} <= {high}, {each.format(low=low, high=high, h=_hash('shapes', n, n))}, {none})))"
    return f"if(size(words) >= {n}, concat({each.format(low=0, high=f'size(words) - {n}', h=_hash('words', n, -n))}, {of_shapes}), {none})"


def _sequences(bench: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The items (item, item_key), and the different sequences of words among them.

    ``plain`` tells for every window of a sequence whether it has words enough to be searched for by its template, and
    ``open`` whether it has a placeholder: a template without is the words themselves.
    """
    items = bench.select(F.col(item_col).alias("item"), raw_tokens(F.col(text_col)).alias("item_raw")).where(F.size("item_raw") > 0)
    items = cut(items.withColumn("item_key", F.xxhash64(F.array_join("item_raw", " "))).distinct())
    texts = items.select("item_key", "item_raw").dropDuplicates(["item_key"]).withColumn("item_template", template(F.col("item_raw")))
    texts = texts.withColumn("n", F.least(F.size("item_raw"), F.lit(window))).withColumn("n_windows", F.size("item_raw") - F.col("n") + 1)
    plain = f"transform(sequence(0, n_windows - 1), i -> n >= {MIN_ITEM} and size(filter(slice(item_template, i + 1, n), w -> w not in ('#', '@', '%'))) >= least({MIN_PLAIN}, n))"
    opened = "transform(plain, (p, i) -> p and exists(slice(item_template, i + 1, n), w -> w in ('#', '@', '%')))"
    texts = texts.withColumn("plain", F.expr(plain)).withColumn("open", F.expr(opened)).withColumn("n_dense", F.expr("size(filter(plain, p -> not p))"))
    return items.select("item", "item_key"), cut(texts)


def _alike(texts: DataFrame) -> DataFrame:
    """Of sequences of one template, and of the same slots repeated in it, the first: any of them finds a changed copy."""
    first = F.transform("item_raw", lambda w: F.array_position("item_raw", w))
    pattern = F.zip_with(first, F.col("item_template"), lambda at, t: F.when(t.isin("#", "@", "%"), at))
    return texts.groupBy("item_template", pattern.alias("pattern")).agg(F.min("item_key").alias("item_key")).select("item_key", F.lit(True).alias("stands"))


def _candidates(docs: DataFrame, texts: DataFrame, collapse: bool, min_windows: int) -> DataFrame:
    """Rows (k1, k2, item_key, diagonal): different texts and item sequences that share enough windows on a diagonal."""
    sizes = sorted(r[0] for r in texts.select("n").distinct().collect())  # at most WINDOW numbers
    of_items = None
    texts = texts.join(_alike(texts), "item_key", "left").withColumn("searched", F.col("stands").isNotNull() | F.lit(not collapse))
    shapes, words, at = _coded(F.col("tokens"))
    coded = texts.select("item_key", "n", "n_windows", "n_dense", "open", "searched", F.col("item_raw").alias("tokens")).withColumn("shapes", shapes).withColumn("words", F.expr(words))
    for n in sizes:
        rows = coded.where(F.col("n") == n).select("*", F.posexplode("open").alias("i", "by_shape"))
        for part, h in ((rows.where("by_shape and searched"), _hash("shapes", n, n)), (rows, _hash("words", n, -n))):
            part = part.select(F.expr(h).alias("hash"), "item_key", "n_windows", "n_dense", F.col("i").alias("ipos"))
            of_items = part if of_items is None else of_items.unionByName(part)
    if of_items is None:
        return docs.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("item_key"), F.lit(0).alias("diagonal"), F.lit(0).alias("hit")).limit(0)
    of_items = cut(of_items)
    coded = docs.select("k1", "k2", raw_tokens(F.col("text")).alias("tokens")).withColumn("shapes", shapes).withColumn("words", F.expr(words)).drop("tokens").withColumn("at", F.expr(at))
    if len(sizes) > 1:
        coded = coded.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("n"))
        windows = F.expr(f"case n {' '.join(f'when {n} then {_windows(n)}' for n in sizes)} end")
    else:
        windows = F.expr(_windows(sizes[0]))
    found = coded.select("k1", "k2", F.inline(windows)).join(if_small(of_items), "hash")
    found = found.select("k1", "k2", "item_key", "n_windows", "n_dense", F.col("pos").alias("dpos"), "ipos").distinct()
    hits = found.groupBy("k1", "k2", "item_key", "n_windows", "n_dense", (F.col("dpos") - F.col("ipos")).alias("diagonal")).agg(F.count(F.lit(1)).alias("hit"))
    # windows that only their words find may match by their templates: they are counted when the passage is judged
    return hits.where(F.col("hit") >= F.greatest(F.lit(1), _needed(F.col("n_windows"), min_windows) - F.col("n_dense"))).select("k1", "k2", "item_key", "diagonal", "hit")


def _needed(n_windows: Column, min_windows: int) -> Column:
    return F.least(F.lit(min_windows), F.greatest(F.lit(1), n_windows - 1))


_RUN = ["k1", "k2", "item_key", "diagonal"]


def _aligned(runs: DataFrame, keyed: DataFrame, texts: DataFrame, min_windows: int) -> DataFrame:
    """One row per word on a diagonal: place i, the document's word b, the item's a and its template u, and whether the
    window that ends there is plain."""
    held = keyed.join(if_small(cut(runs.select("k1", "k2").distinct())), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    held = held.select("k1", "k2", raw_tokens(F.col("text")).alias("raw"))
    both = runs.join(held, ["k1", "k2"]).join(texts, "item_key")
    low = F.greatest(F.lit(0), F.col("diagonal"))
    both = both.withColumn("low", low).withColumn("off", low - F.col("diagonal") + 1).withColumn("len", F.least(F.size("raw"), F.col("diagonal") + F.size("item_raw")) - low)
    ends = F.concat(F.array_repeat(F.lit(False), F.col("n") - 1), F.slice("plain", F.col("off"), F.greatest(F.lit(0), F.col("len") - F.col("n") + 1)))
    words = F.arrays_zip(
        F.slice("raw", F.col("low") + 1, F.col("len")).alias("b"), F.slice("item_raw", F.col("off"), F.col("len")).alias("a"), F.slice("item_template", F.col("off"), F.col("len")).alias("u"),
        F.slice(ends, F.lit(1), F.col("len")).alias("plain"),
    )
    rows = both.select(*_RUN, "low", "n", "n_windows", _needed(F.col("n_windows"), min_windows).alias("need"), F.posexplode(words).alias("i", "w"))
    return rows.select(*_RUN, "low", "n", "n_windows", "need", "i", "w.*")


def passages(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_windows: int = MIN_WINDOWS,
    whole_span: bool = True, collapse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Checked passages (k1, k2, item_key, diagonal, windows, n_windows, kind, n_slots, start) and the items (item, item_key).

    ``k1`` and ``k2`` are two hashes of the text: ``text_keys``.  ``whole_span`` lets one inconsistent slot clear the whole
    span from the first to the last matched window.  Without it a span is split at such slots and its longest consistent
    part judged, two values of an item may become one (names may not), a word may match by its template or as it is, and
    enough windows equal word for word always count.  With ``collapse`` one of the items that are alike but for the
    values of their slots is searched by its template for all of them; word for word each is searched.
    """
    items, texts = _sequences(bench, item_col, item_text_col, window)
    keyed = docs.select(*text_keys(F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    rows = _aligned(cut(_candidates(keyed, texts, collapse, min_windows)), keyed, texts, min_windows)
    rows = rows.withColumn("t", _shape(F.col("b"))).withColumn("same", _fold(F.col("a")) == _fold(F.col("b")))
    rows = rows.withColumn("eq", (F.col("t") == F.col("u")) if whole_span else (F.col("t") == F.col("u")) | F.col("same"))
    run = Window.partitionBy(*_RUN)
    upto = run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # a window is named by the place of its last word
    last = lambda c: F.coalesce(F.max(F.when(~c, F.col("i"))).over(upto), F.lit(-1))
    rows = rows.withColumn("s", F.col("i") - last(F.col("eq")) >= F.col("n")).withColumn("r", F.col("i") - last(F.col("same")) >= F.col("n"))
    rows = rows.withColumn("some", F.max(F.col("s") & F.col("plain")).over(run))
    rows = rows.withColumn("sh", F.col("s") & (F.col("plain") | F.col("r") | F.col("some")))
    low, high = F.min(F.when(F.col("sh"), F.col("i") - F.col("n") + 1)).over(run), F.max(F.when(F.col("sh"), F.col("i"))).over(run)
    slot = F.col("t").isin("#", "@", "%") & (F.col("t") == F.col("u"))
    rows = rows.withColumn("slot", slot).withColumn("inside", F.coalesce(slot & F.col("i").between(low, high), F.lit(False)))

    # the last slot before a slot that has the same value on one side and another on the other
    for key, value in (("a", "b"), ("b", "a")):
        before = Window.partitionBy(*_RUN, "inside", "t", key).orderBy("i")
        rows = rows.withColumn("at", F.lag("i").over(before)).withColumn("was", F.lag(value).over(before))
        rows = rows.withColumn("c_" + key, F.max(F.when(F.col("was") != F.col(value), F.col("at"))).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    other_way = F.lit(True) if whole_span else F.col("t") == "@"
    rows = rows.withColumn("c", F.when(F.col("inside"), F.greatest("c_a", F.when(other_way, F.col("c_b")))))
    rows = rows.withColumn("m", F.coalesce(F.max("c").over(upto), F.lit(-1))).withColumn("k", F.count(F.when(F.col("sh"), 1)).over(upto))
    value = F.when(F.col("slot"), F.struct("t", "a", "b"))
    judged = rows.groupBy(*_RUN, "low", "n", "n_windows", "need").agg(
        F.sort_array(F.collect_list(F.struct("i", "k", "m", "sh", "r", value.alias("v")))).alias("ws"), F.count("c").alias("clashes"),
    )
    if whole_span:
        judged = judged.where("clashes = 0")
    # windows between the last clash and this one
    best = "array_min(transform(filter(ws, e -> e.sh), e -> named_struct('few', if(e.m < 0, 0, ws[least(e.m + n - 1, e.i)].k) - e.k, 'i', e.i, 'm', e.m)))"
    judged = judged.withColumn("best", F.expr(best)).withColumn("by_words", F.expr("transform(filter(ws, e -> e.r), e -> e.i)"))
    shaped = F.coalesce(-F.col("best.few") >= F.col("need"), F.lit(False))
    judged = judged.withColumn("shaped", shaped).where(F.col("shaped") | (F.size("by_words") >= F.col("need")))
    start = F.expr("if(shaped, array_min(transform(filter(ws, e -> e.sh and e.i - n + 1 > best.m), e -> e.i)), array_min(by_words)) - n + 1")
    judged = judged.withColumn("first", start).withColumn("end", F.expr("if(shaped, best.i, array_max(by_words))"))
    judged = judged.withColumn("held", F.expr("transform(filter(ws, e -> e.v is not null and e.i >= first and e.i <= end), e -> e.v)"))
    return judged.select(
        *_RUN, F.expr("cast(if(shaped, -best.few, size(by_words)) as bigint)").alias("windows"), "n_windows",
        F.expr("if(not shaped or forall(held, v -> v.a = v.b), 'verbatim', 're-parameterised')").alias("kind"),
        F.size(F.array_distinct("held")).alias("n_slots"), (F.col("low") + F.col("first")).alias("start"),
    ), items


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that tell texts apart; null for a null text."""
    text = text.cast("string")
    return [F.when(text.isNotNull(), F.xxhash64(text)).alias("k1"), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("k2")]


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """Rows (doc_id, item_id, kind, windows, n_windows, n_slots, start): one per contaminated document and item.

    The passage of most windows is told, the first of several; ``n_windows`` are the item's, ``start`` is the passage's
    first token in the document.  Null and empty texts and items hold nothing; null ids are kept; rows that repeat an id
    count once, with the best passage of their texts, and items that repeat an id likewise.  Other columns are not read;
    empty tables give an empty result.  An item of fewer than ``MIN_ITEM`` words is found where it is the whole text.
    Items and windows with fewer than ``MIN_PLAIN`` words other than placeholders are found word for word only.
    """
    found, items = passages(docs, bench, text_col, item_col, **options)
    order = F.struct((-F.col("windows")).alias("w"), "start", "diagonal", "kind", "n_windows", "n_slots", "windows")
    found = cut(found.groupBy("k1", "k2", "item_key").agg(F.min(order).alias("b")))
    ids = docs.select(F.col(id_col).alias("id"), *text_keys(F.col(text_col)))
    ids = ids.join(if_small(found.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").distinct()
    best = ids.join(found, ["k1", "k2"]).join(items, "item_key").groupBy("id", "item").agg(F.min("b").alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.kind").alias("kind"), F.col("b.windows").alias("windows"),
        F.col("b.n_windows").alias("n_windows"), F.col("b.n_slots").alias("n_slots"), F.col("b.start").alias("start"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a passage of a benchmark item; all columns are kept, whatever their names.

    Rows are judged by their texts: null and empty texts, null and repeated ids stay or go like others.  Empty tables
    lose nothing.
    """
    k1, k2 = unused(docs, "k1"), unused(docs, "k2")
    found = passages(docs, bench, text_col, **({"collapse": True} | options))[0]
    keys = cut(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
    own = text_keys(F.col(f"`{text_col}`"))
    return docs.join(if_small(keys), (own[0] == F.col(k1)) & (own[1] == F.col(k2)), "left_anti")
