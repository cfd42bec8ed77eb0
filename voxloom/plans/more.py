"""More registered queries: resolution, checks, reports, spoken forms, signal, training, sampling and quantization."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from ..functions import spoken, structure, text as T
from ..operators import alignment, checks, corpus, report, sampling, signal, vocab
from ..streaming import chunks, wire
from .registry import _LOGITS, _SOFTMAX, _VOCAB, _logits, _table, query


def _values(rows: list[tuple]) -> str:
    """SQL rows of Python texts, numbers and Nones."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


# ---------------------------------------------------------------- texts with their expected forms

#: (written, spoken): what the spoken forms must give.
SPOKEN = [
    ("I have 3 cats", "I have three cats"), ("1,234 and 12345", "one thousand two hundred thirty four and one two three four five"), ("007", "zero zero seven"),
    ("the 21st and 100th", "the twenty first and one hundredth"), ("12.50", "twelve point five zero"), ("3/4 of it", "three quarters of it"), ("23 4/5", "twenty three and four fifths"),
    ("1½ cups", "one and a half cups"), ("€2.5 million", "two point five million euros"), ("$150-$200", "one hundred fifty dollars to two hundred dollars"), ("20$", "twenty dollars"),
    ("It costs $12.50. Call me at 3pm.", "It costs twelve dollars fifty cents. Call me at three PM."),
    ("Dr. Smith paid -$40 on 3/14/2024 [laughs] for 2.5kg of U.S. beef.", "doctor Smith paid minus forty dollars on march fourteenth twenty twenty four [laughs] for two point five kilograms of U S beef."),
    ("The temperature dropped to −5 degrees; that's 23°F at 10:30 a.m.", "The temperature dropped to minus five degrees; that's twenty three degrees Fahrenheit at ten thirty AM"),
    ("the 1990s", "the nineteen nineties"), ("the '70s", "the seventies"), ("mid-1990s", "mid nineteen nineties"), ("1990-1995", "nineteen ninety to nineteen ninety five"), ("500 BC", "five hundred B C"),
    ("2:30:15", "two hours thirty minutes and fifteen seconds"), ("9:00-10:30", "nine o'clock to ten thirty"), ("60 km/h", "sixty kilometers per hour"), ("2-3 km", "two to three kilometers"), ("2x3", "two by three"),
    ("v1.2.3", "version one point two point three"), ("c325b", "c three two five b"), ("x^2", "x squared"), ("~5", "approximately five"), ("3+4", "three plus four"), ("10-20", "ten to twenty"),
    ("call 555-1234", "call five five five, one two three four"), ("555-123-4567 ext. 12", "five five five, one two three, four five six seven, extension one two"), ("192.168.0.1", "one nine two dot one six eight dot zero dot one"),
    ("a@b.com", "a at b dot com"), ("Boston, MA", "Boston, Massachusetts"), ("1e-3", "one e negative three"), ("3,000,000,000,000,000,000,000,000", "three" + " zero" * 24), ("5%", "five percent"),
]


@query(f"SELECT * FROM (VALUES {_values(SPOKEN)}) t(written, spoken)")
def spoken_forms(spark, sf_dir):
    rows = spark.createDataFrame(SPOKEN, "written string, expected string")
    return rows.select("written", spoken.spoken(F.col("written")).alias("spoken"))


#: (text, first stable end, last end, word end within 12).
ENDS = [
    ("Is it ready?", 12, 12, 6), ("It costs 3.", 0, 11, 9), ("It costs 3. More", 12, 12, 12), ("One! Two! Three", 5, 10, 10), ("Oh [wow! and", 0, 9, 3), ("One. Two. Three", 5, 10, 10), ("no stop at all", 0, 0, 11),
    ("Dr. Smith went", 0, 0, 10), ("Hi. ", 0, 4, 4), ("It is 3.5 now", 0, 0, 10), ("", 0, 0, 0),
]


@query(f"SELECT text, stable::int AS stable, last::int AS last, word::int AS word FROM (VALUES {_values(ENDS)}) t(text, stable, last, word)")
def sentence_ends(spark, sf_dir):
    rows = spark.createDataFrame([(r[0],) for r in ENDS], "text string")
    return rows.select("text", F.explode(F.array(structure.ends(F.col("text"), F.lit(12)))).alias("e")).select("text", "e.*")


#: (written, place, word, spoken form).
WORD_PAIRS = [
    ("I have 55 apples and $20.", [("I", "I"), ("have", "have"), ("55", "fifty five"), ("apples", "apples"), ("and", "and"), ("$20.", "twenty dollars.")]),
    ("Well [long pause] then", [("Well", "Well"), ("[long pause]", "[long pause]"), ("then", "then")]), ("", [("", "")]),
]


@query(f"SELECT text, pos::int AS pos, written, spoken FROM (VALUES {_values([(t, i, *p) for t, ps in WORD_PAIRS for i, p in enumerate(ps)])}) t(text, pos, written, spoken)")
def word_pairs(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t, _ in WORD_PAIRS], "text string")
    return rows.select("text", F.posexplode(structure.word_pairs(F.col("text"))).alias("pos", "p")).select("text", "pos", "p.written", "p.spoken")


@query()
def word_map(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(structure.word_pairs(F.col("text"))).alias("pos", "p"))
    return rows.select("conv_id", "turn", "pos", "p.written", "p.spoken")


@query("SELECT doc_id, text AS joined, CASE WHEN text IS NOT NULL THEN true END AS fits FROM documents")
def chunks_join_to_the_text(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", structure.chunk_array(F.col("text"), F.lit(300)).alias("c"))
    return rows.select("doc_id", F.array_join("c", "").alias("joined"), F.forall("c", lambda p: F.length(p) <= 300).alias("fits"))


@query("SELECT conv_id, turn, regexp_replace(text, '\\s', '', 'g') AS letters, CASE WHEN text IS NOT NULL THEN true END AS fits FROM conversations")
def aligned_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", structure.aligned_chunk_array(F.col("text")).alias("c"))
    return rows.select("conv_id", "turn", F.regexp_replace(F.array_join("c", ""), r"\s", "").alias("letters"), (F.length(F.col("c")[0]) <= structure.HARD).alias("fits"))


# ---------------------------------------------------------------- resolution and lookups

_ASKED = "SELECT n_nationkey AS request, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'alloy' WHEN 2 THEN lower(n_name) WHEN 3 THEN 'typo' ELSE NULL END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'tts-1' ELSE 'engine:' || n_name END AS model FROM nation"
_ALIAS = "SELECT lower(n_name) AS alias, CASE WHEN n_nationkey % 3 = 0 THEN 'GONE' ELSE n_name END AS target FROM nation WHERE n_nationkey % 5 = 2"


@query(f"""WITH i AS (SELECT n_name AS voice FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 5 = 0), a AS ({_ALIAS}), q AS ({_ASKED}),
j AS (SELECT q.request, coalesce(q.name, '') AS name, x.voice AS exact, y.voice AS by_model, a.alias, z.voice AS by_alias FROM q LEFT JOIN i x ON q.name = x.voice
  LEFT JOIN i y ON q.model = 'engine:' || y.voice LEFT JOIN a ON lower(coalesce(q.name, '')) = a.alias LEFT JOIN i z ON a.target = z.voice),
h AS (SELECT *, CASE WHEN exact IS NOT NULL THEN 'installed' WHEN lower(name) NOT IN ('', 'alloy', 'base', 'default') AND alias IS NULL THEN 'unknown' WHEN by_model IS NOT NULL THEN 'model'
  WHEN by_alias IS NOT NULL THEN 'alias' WHEN alias IS NOT NULL THEN 'missing' ELSE 'base' END AS how FROM j)
SELECT request, CASE how WHEN 'installed' THEN exact WHEN 'model' THEN by_model WHEN 'alias' THEN by_alias END AS voice, how FROM h""")
def resolve_voice(spark, sf_dir):
    nation, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = F.when(k % 5 == 0, F.col("n_name")).when(k % 5 == 1, "alloy").when(k % 5 == 2, F.lower("n_name")).when(k % 5 == 3, "typo")
    asked = nation.select(k.alias("request"), name.alias("name"), F.when(k % 2 == 0, "tts-1").otherwise(F.concat(F.lit("engine:"), "n_name")).alias("model"))
    installed = nation.where((k % 2 == 1) | (k % 5 == 0)).select(F.col("n_name").alias("voice"))
    return corpus.resolve_voice(asked, installed, _aliases(nation), "engine")


def _aliases(nation):
    k = F.col("n_nationkey")
    return nation.where(k % 5 == 2).select(F.lower("n_name").alias("alias"), F.when(k % 3 == 0, "GONE").otherwise(F.col("n_name")).alias("target"))


@query(f"SELECT alias, target FROM ({_ALIAS}) WHERE target NOT IN (SELECT n_name FROM nation)")
def dangling_aliases(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    return corpus.dangling_aliases(_aliases(nation), nation.select(F.col("n_name").alias("voice")))


@query("SELECT n_nationkey, n_name AS name, lower(n_name) AS other FROM nation")
def alias_entries(spark, sf_dir):
    entries = F.array(F.concat(F.lit("A=x, "), F.lower("n_name"), F.lit(" = "), F.lower("n_name"), F.lit(",,")), F.concat(F.lit("a="), "n_name"))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", corpus.aliases_of(entries).alias("m"))
    return rows.select("n_nationkey", F.col("m")["a"].alias("name"), F.col("m")[F.lower("n_name")].alias("other"))


@query("""WITH b AS (SELECT 0 AS src, doc_id % 50 AS id, doc_id AS seq, lang AS tag FROM documents UNION ALL SELECT 1, doc_id % 70, doc_id, 'fresh' || toxic FROM labels WHERE doc_id % 2 = 0)
SELECT id, seq, tag FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY src DESC, seq DESC) = 1""")
def merge_last_wins(spark, sf_dir):
    carried = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("id"), F.col("doc_id").alias("seq"), F.col("lang").alias("tag"))
    fresh = _table(spark, sf_dir, "labels").where("doc_id % 2 = 0").select((F.col("doc_id") % 70).alias("id"), F.col("doc_id").alias("seq"), F.concat(F.lit("fresh"), "toxic").alias("tag"))
    return corpus.in_order(corpus.merge(carried, fresh, order="seq"))


@query("""WITH h AS (SELECT doc_id, lang AS c FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0),
g AS (SELECT doc_id, count(*) AS n, min(c) AS c FROM h GROUP BY doc_id), w AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'zz' ELSE lang END AS e FROM documents WHERE doc_id % 5 <> 0)
SELECT * FROM (SELECT coalesce(g.doc_id, w.doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN w.doc_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' WHEN c IS DISTINCT FROM e THEN 'different' END AS problem
FROM g FULL JOIN w USING (doc_id)) WHERE problem IS NOT NULL""")
def table_differences(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("c"))
    have = docs.where("doc_id % 7 <> 0")
    want = docs.where("doc_id % 5 <> 0").withColumn("c", F.when(F.col("doc_id") % 13 == 0, "zz").otherwise(F.col("c")))
    return corpus.same_tables(have.unionByName(have.where("doc_id % 11 = 0")), want, "doc_id", "c")


@query("""SELECT 'base' AS kind, 'Base voice' AS label, '' AS value UNION ALL SELECT 'preset', r_name, 'preset:' || r_name FROM region UNION ALL SELECT 'installed', n_name, n_name FROM nation""")
def voice_choices(spark, sf_dir):
    base = spark.createDataFrame([("Base voice", "", 0)], "label string, value string, pos long")
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    presets = region.select(F.col("r_name").alias("label"), F.concat(F.lit("preset:"), "r_name").alias("value"), F.col("r_regionkey").cast("long").alias("pos"))
    return corpus.choices([("base", base), ("preset", presets), ("installed", nation.select(F.col("n_name").alias("label"), F.col("n_name").alias("value"), F.col("n_nationkey").cast("long").alias("pos")))])


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'preset:' || n_name ELSE n_name END AS picked,
CASE WHEN n_nationkey % 4 = 0 THEN 'preset' WHEN n_nationkey % 4 = 1 THEN 'clone' ELSE 'installed' END AS kind FROM nation""")
def voice_kinds(spark, sf_dir):
    nation, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    names = nation.select(F.col("n_name").alias("name"), F.when(k % 4 == 0, F.concat(F.lit("preset:"), "n_name")).otherwise(F.col("n_name")).alias("picked"))
    return corpus.kind_of(names, "picked", nation.where(k % 4 == 1).select(F.col("n_name").alias("name")))


#: (preset, gender, tags, text, label)
LABELS = [
    ("voice_07", "female", "British;crisp", "x", "07 · Female · British, crisp"), ("voice_08", "", "calm", "x", "08 · calm"), ("voice_09", "", "", "short text", "voice_09 · “short text”"),
    ("v", "", "", "The train station smelled of rain and of old coats that day", "v · “The train station smelled of rain and of old…”"),
]


@query(f"SELECT preset, label FROM (VALUES {_values([(r[0], r[4]) for r in LABELS])}) t(preset, label)")
def preset_labels(spark, sf_dir):
    rows = spark.createDataFrame([r[:4] for r in LABELS], "preset string, gender string, tags string, text string")
    return rows.select("preset", corpus.preset_label(F.col("preset"), F.col("gender"), F.filter(F.split("tags", ";"), lambda t: t != ""), F.col("text")).alias("label"))


@query("""SELECT event_id FROM (SELECT event_id, event_id // 2 % 3 AS step, list(CASE WHEN event_type = 'purchase' THEN event_id // 2 % 3 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM events)
WHERE NOT coalesce(list_contains(list_filter(l, lambda x: x IS NOT NULL), step), false)""")
def evaluations_due(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("event_id div 2 % 3").alias("step"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"))
    return corpus.evaluation_due(log, "user_id", order="event_id").where("due").select("event_id")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey * 1.5 ELSE 0.9 END::double AS temperature, CASE WHEN n_nationkey % 3 = 0 THEN 5 ELSE 75 END AS top_k FROM nation")
def sampling_overrides(spark, sf_dir):
    nation, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    preset = nation.select("n_nationkey", F.lit(0.9).alias("temperature"), F.lit(75).alias("top_k"))
    own = nation.select("n_nationkey", F.when(k % 2 == 0, F.col("n_regionkey") * F.lit(1.5)).alias("temperature"), F.when(k % 3 == 0, 5).alias("top_k"))
    return corpus.override(preset, own, "n_nationkey", ["temperature", "top_k"])


# ---------------------------------------------------------------- checks and messages


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN 'both audio and codes' WHEN turn % 3 <> 0 AND conv_id % 2 <> 0 THEN 'neither audio nor codes' WHEN trim(text) = '' OR text IS NULL THEN 'no transcript' END AS problem FROM conversations""")
def reference_problems(spark, sf_dir):
    audio, codes = F.when(F.col("turn") % 3 == 0, F.lit("x")), F.when(F.col("conv_id") % 2 == 0, F.lit("1 2"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", checks.reference_problem(audio, codes, F.col("text")).alias("problem"))


@query("""SELECT event_id, CASE WHEN value - 20 <= 0 THEN 'temperature' WHEN NOT (user_id % 7 / 5.0 > 0 AND user_id % 7 / 5.0 <= 1) THEN 'top_p' WHEN event_id % 9 - 1 < 0 THEN 'top_k' WHEN event_id % 5 <= 0 THEN 'repetition_penalty' WHEN event_id % 4 <= 0 THEN 'max_tokens' END AS problem FROM events""")
def sampling_problems(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return _table(spark, sf_dir, "events").select("event_id", checks.sampling_problem(F.col("value") - 20, u % 7 / F.lit(5.0), e % 9 - 1, e % 5, e % 4).alias("problem"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'no name' WHEN event_id % 3 = 1 AND user_id % 2 = 0 THEN 'neither adapter nor reference' WHEN user_id % 2 = 1 AND event_id % 5 = 0 THEN 'reference without transcript'
WHEN user_id % 2 = 1 AND event_id % 10000 > 8191 THEN 'code outside the codebook' END AS problem FROM events""")
def voice_problems(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    codes = F.when(u % 2 == 1, F.array((e % 10000).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    problem = checks.voice_problem(F.when(e % 6 == 0, " ").otherwise("n"), F.when(e % 3 != 1, "a"), codes, F.when(e % 5 != 0, "t"))
    return _table(spark, sf_dir, "events").select("event_id", problem.alias("problem"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'sampling.top_p: ' || n_name || '; invalid value' WHEN 1 THEN n_name ELSE 'the request body could not be parsed' END AS message FROM nation")
def flattened_errors(spark, sf_dir):
    k, name = F.col("n_nationkey"), F.col("n_name")
    error = lambda loc, msg: F.struct(F.array(*map(F.lit, loc)).alias("loc"), msg.alias("msg"))
    two = F.array(error(["body", "sampling", "top_p"], name), error(["body"], F.lit(None).cast("string")))
    errors = F.when(k % 3 == 0, two).when(k % 3 == 1, F.array(error(["body"], name))).otherwise(F.slice(two, 1, 0))
    return _table(spark, sf_dir, "nation").select("n_nationkey", checks.one_message(errors).alias("message"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' WHEN 3 THEN 'flac' END AS format, CASE event_id % 6 WHEN 2 THEN 'needs an external encoder' WHEN 4 THEN 'unknown format' WHEN 5 THEN 'not available here' END AS problem FROM events""")
def response_formats(spark, sf_dir):
    k = F.col("event_id") % 6
    name = F.when(k == 1, " WAV").when(k == 2, "aac").when(k == 3, "flac").when(k == 4, "midi").when(k == 5, "opus")
    return _table(spark, sf_dir, "events").select("event_id", F.explode(F.array(checks.response_format(name, ["mp3", "flac", "wav", "pcm"]))).alias("r")).select("event_id", "r.*")


@query("""SELECT n_nationkey, 'inline; filename="speech.mp3"' AS disposition, CASE WHEN n_nationkey % 2 = 0 THEN 'base' ELSE n_name END AS voice, CASE WHEN n_regionkey = 0 THEN 'no' END AS buffering FROM nation""")
def speech_headers(spark, sf_dir):
    head = checks.response_headers(F.lit("mp3"), F.lit(48000), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")), F.col("n_regionkey") == 0)
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", head.alias("h"))
    return rows.select("n_nationkey", F.col("h")["Content-Disposition"].alias("disposition"), F.col("h")["X-Voice"].alias("voice"), F.col("h")["X-Accel-Buffering"].alias("buffering"))


# ---------------------------------------------------------------- reports


_SKIPS = "SELECT doc_id AS seq, lang || doc_id AS name, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END::int AS segment, CASE WHEN doc_id % 2 = 0 THEN '' ELSE n_chars || ' chars' END AS detail, CASE WHEN n_chars < 100 THEN 'too short' WHEN n_chars > 8000 THEN 'too long' WHEN n_chars % 5 = 0 THEN 'silent' END AS reason FROM documents"


@query(f"""WITH s AS (SELECT *, CASE WHEN segment > 0 THEN name || '#' || segment ELSE name END || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END AS d, row_number() OVER (PARTITION BY reason ORDER BY seq) AS r FROM ({_SKIPS}) WHERE reason IS NOT NULL)
SELECT reason, count(*) AS n, min(seq) AS first, repeat(' ', 13) || lpad(count(*)::varchar, 5, ' ') || '  ' || rpad(reason, 16, ' ') || ' ' || string_agg(d, ', ' ORDER BY r) FILTER (r <= 3) || CASE WHEN count(*) > 3 THEN ', +' || (count(*) - 3) || ' more' ELSE '' END AS line FROM s GROUP BY reason""")
def skip_lines(spark, sf_dir):
    k, n = F.col("doc_id"), F.col("n_chars")
    rows = _table(spark, sf_dir, "documents").select(
        k.alias("seq"), F.concat("lang", k.cast("string")).alias("name"), F.when(k % 3 > 0, k % 3).cast("int").alias("segment"), F.when(k % 2 == 0, "").otherwise(F.concat(n.cast("string"), F.lit(" chars"))).alias("detail"),
        F.when(n < 100, "too short").when(n > 8000, "too long").when(n % 5 == 0, "silent").alias("reason"),
    )
    return report.skip_lines(rows.where("reason is not null"), "seq")


@query("""SELECT user_id % 20 AS bucket, event_type AS kind, list(props ORDER BY event_id) AS written, list(lower(props) ORDER BY event_id) AS spoken FROM events WHERE event_type <> 'purchase' GROUP BY ALL""")
def tokens_by_kind(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("bucket"), "event_id", F.col("event_type").alias("kind"), F.col("props").alias("w"), F.lower("props").alias("s"))
    return report.tokens_by_kind(rows, "bucket", "event_id", "kind", "w", "s", "purchase")


@query("""WITH w AS (SELECT doc_id, least(n_chars, 2000)::int AS n, n_chars % 7 + 1 AS k FROM documents),
e AS (SELECT *, list_transform(range(0, k), lambda i: (i + 1) * 3000 + n % 500) AS ends, greatest(0, n * 1000.0 / 80 - 5000) AS late FROM w),
f AS (SELECT *, coalesce(list_position(list_transform(ends, lambda x: x >= late), true), 1) - 1 AS first FROM e)
SELECT doc_id, CASE WHEN n > 0 THEN list_aggregate(list_transform(range(first, k), lambda i: 'w' || i), 'string_agg', ' ') END AS text,
CASE WHEN n > 0 THEN least(floor(CASE WHEN doc_id % 2 = 0 AND first = 0 AND ends[1] >= late AND ends[1] - 2500 < n * 1000.0 / 80 THEN 0 ELSE ends[first + 1] - 2500 END * 80 / 1000)::int, n)::int END AS start FROM f""")
def carried_tails(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(least(n_chars, 2000) as int) n", "cast(n_chars % 7 as int) + 1 k")
    words = F.expr("transform(sequence(0, k - 1), i -> named_struct('spoken', concat('w', i), 'start_ms', (i + 1) * 3000 + n % 500 - 2500, 'end_ms', (i + 1) * 3000 + n % 500))")
    rows = rows.select("doc_id", "n", report.carry(words, F.expr("if(n > 0, sequence(0, n - 1), cast(array() as array<int>))"), F.col("doc_id") % 2 == 0).alias("c"))
    return rows.select("doc_id", "c.text", (F.col("n") - F.size("c.codes")).alias("start"))


@query("SELECT doc_id, round(n_chars / 80.0 + doc_id % 100 / 1000.0, 6) AS start, round(n_chars / 80.0 + (doc_id % 100 + 250) / 1000.0, 6) AS stop FROM documents")
def word_times(spark, sf_dir):
    at = F.col("doc_id") % 100
    times = report.word_times(F.array(F.struct(F.lit("w").alias("spoken"), at.alias("start_ms"), (at + 250).alias("end_ms"))), F.col("n_chars"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(times).alias("t")).select("doc_id", F.round("t.start", 6).alias("start"), F.round("t.end", 6).alias("stop"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS step FROM events)
SELECT user_id, round(max(step) FILTER (event_type = 'purchase'), 6) AS worst_join FROM s GROUP BY user_id""")
def worst_joins(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    out = report.worst_join(events, "user_id", "event_id", "value", events.where("event_type = 'purchase'"))
    return out.select("user_id", F.round("worst_join", 6).alias("worst_join"))


@query("""SELECT event_id, 'event: note' || chr(10) || 'data: {"id":' || event_id || CASE WHEN event_type = 'click' THEN '' ELSE ',"kind":"' || event_type || '"' END || '}' || chr(10) || chr(10) AS event,
'{"id":' || event_id || CASE WHEN event_type = 'click' THEN '' ELSE ',"kind":"' || event_type || '"' END || '}' AS frame FROM events""")
def wire_events(spark, sf_dir):
    payload = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return _table(spark, sf_dir, "events").select("event_id", wire.sse(F.lit("note"), payload).alias("event"), wire.to_wire(payload).alias("frame"))


@query()
def speech_stream(spark, sf_dir):
    chunks_ = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.encode(F.col("props"), "UTF-8")).alias("pcm"))
    return wire.speech_events(chunks_, "user_id", "event_id", "pcm", 48000)


# ---------------------------------------------------------------- signal and training


@query("""WITH f AS (SELECT vec_id, f, sqrt(list_sum(list_transform(embedding[f * 4 + 1 : f * 4 + 8], lambda x: x::double * x::double)) / 8) AS rms FROM embeddings, range(0, 15) t(f)),
d AS (SELECT vec_id, f, 20 * log10(greatest(rms, 1e-10) / max(rms) OVER (PARTITION BY vec_id)) > -3 AS loud FROM f),
e AS (SELECT vec_id, min(f) FILTER (loud) AS a, max(f) FILTER (loud) AS b FROM d GROUP BY vec_id)
SELECT vec_id, embedding[greatest(0, a * 4 - 2) + 1 : CASE WHEN b = 14 THEN 64 ELSE least(64, b * 4 + 8 + 2) END] AS kept FROM embeddings JOIN e USING (vec_id)""")
def trim_silence(spark, sf_dir):
    wav = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select("vec_id", signal.trim_silence(wav, signal.frame_db(wav, 8, 4), 3.0, 4, 8, 2).alias("kept"))


@query("""WITH p AS (SELECT event_id, (event_id % 90)::int AS p, (user_id % 120)::int AS a, event_type = 'click' AS done FROM events), q AS (SELECT *, p + 40 >= a AS last FROM p)
SELECT event_id, p AS start, CASE WHEN last THEN a + 6 ELSE least(p + 55, a + 6) END AS stop, CASE WHEN p = 0 THEN 0 ELSE 5400 END AS emit_start, CASE WHEN NOT last THEN 24000 END AS emit_stop, CASE WHEN NOT last THEN 31 END AS state_at, last AS is_last
FROM q WHERE p < a AND CASE WHEN last THEN done ELSE done OR p + 52 <= a END""")
def decoder_windows(spark, sf_dir):
    plan = signal.plan_window((F.col("event_id") % 90).cast("int"), (F.col("user_id") % 120).cast("int"), F.coalesce(F.col("event_type") == "click", F.lit(False)))
    return _table(spark, sf_dir, "events").select("event_id", plan.alias("w")).where("w is not null").select("event_id", "w.*")


@query("""WITH l AS (SELECT event_id, event_id % 6 AS m, event_id % 9 AS e FROM events)
SELECT event_id, list_transform(range(0, 8), lambda i: CASE WHEN e > 7 OR e <= greatest(e - 4, m) OR i < greatest(e - 4, m) OR i >= e THEN 0 WHEN e - greatest(e - 4, m) = 1 THEN 1
ELSE round(1 + (i - greatest(e - 4, m)) * 2.0 / (e - greatest(e - 4, m) - 1), 9) END::double) AS weights FROM l""")
def ramp_weights(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "transform(sequence(0, 7), i -> case when i = event_id % 9 and i >= event_id % 6 then 99 when i < event_id % 6 then -100 else int(i) end) labels")
    return rows.select("event_id", F.transform(signal.ramp_weights(F.col("labels"), 99, 4, 3.0), lambda x: F.round(x, 9)).alias("weights"))


@query("""WITH t AS (SELECT user_id, event_id, value AS nll, lead(CASE WHEN event_type = 'error' THEN -100 ELSE event_id % 5 END) OVER w AS label, lead(event_id % 3) OVER w AS weight FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT user_id, nll, CASE WHEN label = 4 THEN 2.5 WHEN weight > 0 THEN weight ELSE 1 END AS w FROM t WHERE label IS NOT NULL AND label <> -100)
SELECT user_id, round(sum(w * nll) / greatest(sum(w), 1), 6) AS loss FROM x GROUP BY user_id""")
def lm_loss(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", -100).otherwise(F.col("event_id") % 5).alias("label"), (F.col("event_id") % 3).alias("weight"), F.col("value").alias("nll"))
    return signal.lm_loss(rows, "user_id", "event_id", 4, 2.5).select("user_id", F.round("loss", 6).alias("loss"))


@query("""WITH s AS (SELECT event_id, user_id % 40 AS batch, range(0, event_id % 13) AS v FROM events), w AS (SELECT batch, (ceil(max(len(v)) / 8.0) * 8)::int AS width FROM s GROUP BY batch)
SELECT event_id, batch, list_concat(v, list_transform(range(len(v), width), lambda i: 0))::int[] AS padded FROM s JOIN w USING (batch)""")
def collated(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 40 batch", "filter(sequence(0, 12), i -> i < event_id % 13) padded")
    return signal.collate(rows, "batch", "padded", 0)


@query("SELECT vec_id, len(embedding) * 3 // 2 AS n FROM embeddings")
def resampled_lengths(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(signal.resampled(16000, 24000)(F.col("embedding"))).cast("long").alias("n"))


@query("SELECT vec_id, embedding AS wav FROM embeddings")
def loudness_of_short_clips(spark, sf_dir):
    """Clips shorter than one block cannot be measured and stay as they are."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", signal.normalize_loudness(16000)(F.col("embedding")).alias("wav"))


# ---------------------------------------------------------------- sampling, vocabulary, quantization


@query(f"SELECT row, token, round(logit / 0.7, 6) AS logit FROM ({_LOGITS})")
def temperature(spark, sf_dir):
    return sampling.temperature(_logits(spark, sf_dir), 0.7).withColumn("logit", F.round("logit", 6))


@query(f"""WITH p AS (SELECT row, token, CASE WHEN token % 3 <> 0 THEN logit WHEN logit > 0 THEN logit / 1.3 ELSE logit * 1.3 END / 8 AS logit FROM ({_LOGITS})),
k AS (SELECT * FROM p QUALIFY rank() OVER (PARTITION BY row ORDER BY logit DESC) <= 20), s AS (SELECT *, exp(logit - max(logit) OVER w) AS e FROM k WINDOW w AS (PARTITION BY row)),
n AS (SELECT *, coalesce(round(sum(e / t) OVER (PARTITION BY row ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 12), 0) AS before FROM (SELECT *, sum(e) OVER (PARTITION BY row) AS t FROM s)),
q AS (SELECT row, token, logit, e / sum(e) OVER (PARTITION BY row) AS p FROM n WHERE before < 0.9 OR before = 0),
c AS (SELECT *, sum(p) OVER (PARTITION BY row ORDER BY logit DESC, token) AS c FROM q)
SELECT row, arg_min(token, c) AS token FROM c WHERE c > row % 97 / 97.0 * 0.999 GROUP BY row""")
def sampled(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    draws = rows.select("row").distinct().withColumn("u", F.col("row") % 97 / F.lit(97.0) * F.lit(0.999))
    return sampling.sample(rows, draws, rows.where("token % 3 = 0").select("row", "token"), 1.3, 8.0, 20, 0.9)


@query("""WITH l AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), t AS (SELECT vec_id, v, list_reverse_sort(v)[5] AS least FROM l)
SELECT vec_id, list_transform(v, lambda x: CASE WHEN x >= least THEN round(x, 6) END) AS top, list_position(v, list_max(v)) - 1 AS best FROM t""")
def array_sampling(spark, sf_dir):
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    top = F.transform(sampling.top_k_array(F.col("v"), 5), lambda x: F.when(x > float("-inf"), F.round(x, 6)))
    return _table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", top.alias("top"), sampling.argmax_array(F.col("v")).cast("long").alias("best"))


@query("""WITH l AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM l)
SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 9)) AS p FROM e""")
def array_softmax(spark, sf_dir):
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.transform(sampling.softmax_array(v), lambda x: F.round(x, 9)).alias("p"))


@query(f"SELECT event_id, code FROM (SELECT event_id, 128200 + event_id * 37 % 9000 AS id FROM events) JOIN ({_VOCAB}) v ON v.token_id = id")
def ids_to_codes(spark, sf_dir):
    ids = _table(spark, sf_dir, "events").select("event_id", (F.lit(128200) + F.col("event_id") * 37 % 9000).alias("token_id"))
    return vocab.ids_to_codes(ids, vocab.vocabulary(spark)).select("event_id", "code")


def _books(spark, sf_dir, layers=2, n=1024):
    """Codebooks of up to ``n`` entries: the first vectors of the table for the first layer, their halves for the next."""
    rows = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n).select("vec_id", "embedding").collect()  # n entries: the codebook
    book = np.array([r[1] for r in sorted(rows)], dtype=np.float64)
    return [book / (layer + 1) for layer in range(layers)]


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS code, round(list_dot_product(a.v, b.v), 6) AS sim FROM u a, u b WHERE b.vec_id < 1024)
SELECT vec_id, sim AS similarity FROM (SELECT vec_id, max(sim) AS sim FROM s GROUP BY vec_id)""")
def quantized_first_layer(spark, sf_dir):
    return vocab.quantize(_table(spark, sf_dir, "embeddings"), _books(spark, sf_dir, 1), "vec_id").select("vec_id", "similarity")


@query()
def residual_quantized(spark, sf_dir):
    return vocab.quantize(_table(spark, sf_dir, "embeddings"), _books(spark, sf_dir), "vec_id")


# ---------------------------------------------------------------- alignment and sessions


@query("""WITH r AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, floor(value * 10)::int AS e FROM events), x AS (SELECT utt, i // 3 AS round, i % 3 AS word, e FROM r),
n AS (SELECT a.utt, a.round, a.word, a.e, coalesce(abs(a.e - b.e) <= 100, false) AS near FROM x a LEFT JOIN x b ON a.utt = b.utt AND a.word = b.word AND b.round = a.round - 1),
l AS (SELECT *, bool_and(near) OVER (PARTITION BY utt, round ORDER BY word) AS ok FROM n)
SELECT utt, word, min(round) AS round, arg_min(e, round) AS end_ms FROM l WHERE ok GROUP BY utt, word""")
def confirmed(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), i.cast("long").alias("i"), F.floor(F.col("value") * 10).cast("int").alias("end_ms"))
    return alignment.confirmed(rows.select("utt", F.expr("i div 3").alias("round"), (F.col("i") % 3).alias("word"), "end_ms"))


@query()
def timed_words(spark, sf_dir):
    """The words of every sentence placed in frames whose label scores are made from the sentence: the acoustic model is no part of this."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(structure.sentence_array(F.col("text"))).alias("pos", "text"))
    labels = len(alignment.LABEL) + 2
    # (t * 7 + k * 13 + length) % 11 for label k of frame t: eleven rows of scores, of which each frame takes one
    scores = [[-1.0 - ((r + k * 13) % 11) / 4.0 for k in range(labels)] for r in range(11)]
    kinds = "array(" + ", ".join("array(" + ", ".join(f"{x}F" for x in row) + ")" for row in scores) + ")"
    score = F.expr(f"transform(sequence(0, 2 * length(text) + 20), t -> {kinds}[(t * 7 + length(text)) % 11])")
    utt = ((F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("pos")).cast("long").alias("utt")
    # the work of a row is great and the table may be one file: it is dealt to as many tasks as shuffles have
    rows = rows.select(utt, "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "utt")
    return alignment.timed(rows.select("utt", score.alias("log_probs"), T.tokens(F.col("text")).alias("words")))


@query()
def session_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", "text")
    words = rows.select("session", (F.col("turn") * 3).cast("long").alias("seq"), F.lit("words").alias("kind"), F.col("text").alias("value"))
    made = rows.select("session", (F.col("turn") * 3 + 1).cast("long"), F.lit("codes"), (F.length("text") * 2).cast("string"))
    return chunks.batch(words.union(made).union(rows.select("session", (F.col("turn") * 3 + 2).cast("long"), F.lit("end"), F.lit(None).cast("string"))))


@query("SELECT p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'changed' END AS state FROM part WHERE p_partkey % 3 <> 1")
def publish_diff(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.encode(F.col("p_name"), "UTF-8").alias("content"))
    there = part.where("name % 3 <> 0").withColumn("content", F.when(F.col("name") % 3 == 2, F.encode(F.lit("old"), "UTF-8")).otherwise(F.col("content")))
    return corpus.changed(part, there.unionByName(there.limit(1).withColumn("name", F.lit(-1).cast(part.schema["name"].dataType))))
