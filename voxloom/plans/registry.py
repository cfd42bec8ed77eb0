"""Every query of the engine, with the SQL that DuckDB runs to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import spoken, structure, text as T
from ..operators import alignment, checks, corpus, measures, sampling, signal, vocab
from ..streaming import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- corpus preparation

_PREPARED = f"""
WITH c AS (SELECT *, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS clean FROM documents),
p AS (SELECT *, n_chars + greatest(1, strlen(clean)) + 5 AS tokens,
  CASE WHEN clean IS NULL OR clean = '' THEN 'empty' WHEN n_chars < 100 THEN 'too short' WHEN n_chars > 8000 THEN 'too long'
       WHEN n_chars + greatest(1, strlen(clean)) + 5 > 8192 THEN 'over budget' END AS reason FROM c)"""


@query(_PREPARED + " SELECT source, coalesce(reason, 'kept') AS fate, count(*) AS n, sum(tokens)::bigint AS tokens FROM p GROUP BY ALL")
def prep_budget_funnel(spark, sf_dir):
    rows = corpus.prepared(_table(spark, sf_dir, "documents"))
    return rows.groupBy("source", F.coalesce("reason", F.lit("kept")).alias("fate")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query(_PREPARED + " SELECT reason, count(*) AS n, min(doc_id) AS first_seen FROM p WHERE reason IS NOT NULL GROUP BY reason")
def report_reasons(spark, sf_dir):
    return corpus.reasons(corpus.prepared(_table(spark, sf_dir, "documents")), "doc_id")


@query(_PREPARED + """, r AS (SELECT reason, doc_id, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS rn FROM p WHERE reason IS NOT NULL)
SELECT reason, string_agg(doc_id::varchar, ', ' ORDER BY doc_id) FILTER (rn <= 3) AS examples, greatest(count(*) - 3, 0) AS more FROM r GROUP BY reason""")
def report_examples(spark, sf_dir):
    return corpus.examples(corpus.prepared(_table(spark, sf_dir, "documents")), "doc_id")


@query(_PREPARED + " SELECT count(*) AS n, sum(n_chars)::bigint AS chars, max(n_chars) AS longest, max(tokens) AS most_tokens FROM p WHERE reason IS NULL")
def report_totals(spark, sf_dir):
    kept = corpus.prepared(_table(spark, sf_dir, "documents")).where("reason is null")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.max("tokens").alias("most_tokens"))


@query("""SELECT doc_id AS id, lang AS tag, n_chars AS n, NULL::int AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, NULL, NULL, quality FROM labels""")
def merge_dedup(spark, sf_dir):
    carried = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tag"), F.col("n_chars").alias("n"))
    return corpus.merge(carried, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT doc_id, row_number() OVER (ORDER BY md5('7' || doc_id::varchar), doc_id)
<= least(greatest(1, floor(count(*) OVER () * 0.05)), count(*) OVER () - 1) AS held_out FROM documents""")
def holdout_split(spark, sf_dir):
    return corpus.holdout(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05)


_BASE, _STEM = "regexp_extract({0}, '([^/]*)$', 1)", "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"
_KEYS = f"[p, regexp_replace(p, '\\.[^.]*$', ''), {_BASE.format('p')}, {_STEM.format('p')}]"


@query(f"""
WITH u AS (SELECT DISTINCT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS p FROM pages),
f AS (SELECT p FROM u UNION SELECT 'Other/' || upper({_BASE.format('p')}) || '.WAV' FROM u WHERE page_id % 3 = 0),
k AS (SELECT key, count(*) AS owners, min(p) AS file FROM (SELECT DISTINCT p, unnest({_KEYS} || list_transform({_KEYS}, lambda x: lower(x))) AS key FROM f) GROUP BY key),
m AS (SELECT page_id AS row, CASE page_id % 4 WHEN 0 THEN './' || p WHEN 1 THEN upper(p) WHEN 2 THEN '/else/' || {_BASE.format('p')} ELSE 'none//' || page_id END AS n FROM u),
c AS (SELECT row, n, regexp_replace(regexp_replace(regexp_replace(n, '/+', '/', 'g'), '^(\\./)+', ''), '(.)/$', '\\1') AS q FROM m),
t AS (SELECT row, unnest(flatten(list_transform([n, ltrim(n, './'), q, {_BASE.format('q')}, {_STEM.format('q')}], lambda x: [x, lower(x)]))) AS key, unnest(range(0, 10)) AS pr FROM c),
j AS (SELECT row, min_by(file, pr) FILTER (owners = 1) AS file, bool_or(coalesce(owners > 1, false)) AS poisoned FROM t LEFT JOIN k USING (key) GROUP BY row)
SELECT row, file, CASE WHEN file IS NOT NULL THEN 'matched' WHEN poisoned THEN 'ambiguous' ELSE 'unmatched' END AS status FROM j""")
def pair_manifest(spark, sf_dir):
    rel, base = F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), F.regexp_extract("p", "([^/]*)$", 1)
    pages = _table(spark, sf_dir, "pages").select("page_id", rel.alias("p"))
    case = F.col("page_id") % 4
    name = (
        F.when(case == 0, F.concat(F.lit("./"), "p")).when(case == 1, F.upper("p"))
        .when(case == 2, F.concat(F.lit("/else/"), base)).otherwise(F.concat(F.lit("none//"), F.col("page_id").cast("string")))
    )
    shouted = pages.where("page_id % 3 = 0").select(F.concat(F.lit("Other/"), F.upper(base), F.lit(".WAV")).alias("file"))
    return corpus.pair(pages.select(F.col("p").alias("file")).union(shouted).distinct(), pages.select(F.col("page_id").alias("row"), name.alias("name")))


@query("""SELECT d.doc_id AS file, coalesce(CASE WHEN l.quality = 1 THEN 'q1' END, nullif(CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.lang END, '')) AS text
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def pair_precedence(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "lang")
    man = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), F.when(F.col("quality") == 1, "q1").otherwise("  ").alias("text"), F.lit(1).alias("row"))
    return corpus.precedence(docs.select("file"), man, docs.select("file", F.when(F.col("file") % 3 == 0, " ").otherwise(F.col("lang")).alias("text")))


@query("""
WITH q AS (SELECT n_nationkey AS request, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'model:' || n_name WHEN 2 THEN lower(n_name) ELSE 'unknown' END AS name FROM nation),
i AS (SELECT n_name AS voice FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 4 = 1),
a AS (SELECT lower(n_name) AS alias, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT request, coalesce(x.voice, y.voice, target, 'base') AS voice,
  CASE WHEN x.voice IS NOT NULL THEN 'installed' WHEN y.voice IS NOT NULL THEN 'suffix' WHEN target IS NOT NULL THEN 'alias' ELSE 'base' END AS how
FROM q LEFT JOIN i x ON name = x.voice LEFT JOIN i y ON regexp_extract(name, '^[^:]+:(.+)$', 1) = y.voice LEFT JOIN a ON lower(name) = alias""")
def voice_cascade(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lit("model:"), "n_name")).when(k % 4 == 2, F.lower("n_name")).otherwise("unknown")
    installed = nation.where((k % 2 == 0) | (k % 4 == 1)).select(F.col("n_name").alias("voice"))
    aliases = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("target"))
    return corpus.cascade(nation.select(k.alias("request"), name.alias("name")), installed, aliases)


@query("SELECT doc_id, coalesce((SELECT min(r) FROM (VALUES (8000), (12000), (16000), (24000), (48000)) t(r) WHERE r >= n_chars), 48000)::int AS rate FROM documents")
def container_rate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", corpus.snap_up(F.col("n_chars"), [8000, 12000, 16000, 24000, 48000]).cast("int").alias("rate"))


# ---------------------------------------------------------------- runs, frames, silence, cuts


@query("""
WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, run::bigint AS run, any_value(event_type) AS event_type, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM r GROUP BY user_id, run""")
def rle_runs(spark, sf_dir):
    return signal.runs(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""
WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 1800 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, s::bigint AS session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY ALL""")
def gap_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    new = F.when(at - F.lag(at).over(w) <= 1800, 0).otherwise(1)
    rows = _table(spark, sf_dir, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


_FRAMES = """SELECT vec_id, f, sqrt(list_sum(list_transform(embedding[f * 4 + 1 : f * 4 + 8], lambda x: x::double * x::double)) / 8) AS rms FROM embeddings, range(0, 15) t(f)"""


@query(f"SELECT vec_id, f::int AS frame, round(rms, 6) AS rms FROM ({_FRAMES})")
def frame_rms(spark, sf_dir):
    rms = signal.frame_rms(F.col("embedding"), 8, 4)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(rms).alias("frame", "r")).select("vec_id", "frame", F.round("r", 6).alias("rms"))


@query(f"""
WITH f AS ({_FRAMES}), d AS (SELECT vec_id, f, CASE WHEN max(rms) OVER w <= 0 THEN false ELSE 20 * log10(greatest(rms, 1e-10) / max(rms) OVER w) > -6 END AS loud FROM f WINDOW w AS (PARTITION BY vec_id)),
i AS (SELECT *, f - row_number() OVER (PARTITION BY vec_id, loud ORDER BY f) AS island FROM d)
SELECT vec_id, min(f)::int AS start, (max(f) + 1)::int AS stop FROM i WHERE NOT loud GROUP BY vec_id, island HAVING min(f) > 0 AND max(f) < 14 AND count(*) >= 2""")
def silence_spans(spark, sf_dir):
    spans = signal.silent_spans(signal.frame_db(F.col("embedding"), 8, 4), 6.0, 2)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.explode(spans).alias("s")).select("vec_id", "s.start", "s.stop")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, n_chars, list_append(list_transform(range(1, 1 + n_chars // 700), lambda i: i * 700 + (i * doc_id) % 97), n_chars) AS stops FROM documents),
r(doc_id, stops, i, base, last, out) AS (
  SELECT doc_id, stops, 1, 0::bigint, -1::bigint, []::bigint[] FROM d
  UNION ALL SELECT doc_id, stops, i + 1, CASE WHEN stops[i] - base > 2000 AND last > base THEN last ELSE base END, stops[i],
    CASE WHEN stops[i] - base > 2000 AND last > base THEN list_append(out, last) ELSE out END FROM r WHERE i <= len(stops))
SELECT doc_id, unnest(out) AS cut FROM r WHERE i = len(stops) + 1""")
def greedy_cuts(spark, sf_dir):
    cuts = F.expr("transform(filter(sequence(0, n_chars div 700), i -> i > 0), i -> i * 700 + (i * doc_id) % 97)")
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(signal.greedy_cuts(cuts, F.col("n_chars"), 2000)).alias("cut"))


# ---------------------------------------------------------------- sampling

_LOGITS = "SELECT user_id AS row, event_id AS token, round(value, 1) - 50 AS logit FROM events"


def _logits(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_id").alias("token"), (F.round("value", 1) - 50).alias("logit"))


@query(f"SELECT row, token, round(logit, 6) AS logit FROM ({_LOGITS}) QUALIFY rank() OVER (PARTITION BY row ORDER BY logit DESC) <= 5")
def topk_ties(spark, sf_dir):
    return sampling.top_k(_logits(spark, sf_dir), 5).withColumn("logit", F.round("logit", 6))


_SOFTMAX = f"SELECT row, token, logit, exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w AS p FROM (SELECT *, max(logit) OVER (PARTITION BY row) AS m FROM ({_LOGITS})) WINDOW w AS (PARTITION BY row)"


@query(f"SELECT row, token, round(p, 9) AS p FROM ({_SOFTMAX})")
def softmax(spark, sf_dir):
    return sampling.softmax(_logits(spark, sf_dir)).select("row", "token", F.round("p", 9).alias("p"))


@query(f"""SELECT row, token FROM (SELECT *, round(coalesce(sum(p) OVER (PARTITION BY row ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12) AS m FROM ({_SOFTMAX}))
WHERE m < 0.9 OR m = 0""")
def topp_nucleus(spark, sf_dir):
    return sampling.top_p(_logits(spark, sf_dir), 0.9).select("row", "token")


@query(f"SELECT row, token, round(CASE WHEN token % 3 <> 0 THEN logit WHEN logit > 0 THEN logit / 1.3 ELSE logit * 1.3 END, 6) AS logit FROM ({_LOGITS})")
def rep_penalty(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    seen = rows.where("token % 3 = 0").select("row", "token")
    return sampling.repetition_penalty(rows, seen.unionByName(seen), 1.3).select("row", "token", F.round("logit", 6).alias("logit"))


@query("""
WITH g AS (SELECT user_id AS utt, row_number() OVER w AS k, round(sum(least(exp(-value / 40), 0.8)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 0.35 * row_number() OVER w, 9) AS score
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT utt, CASE WHEN max(score) > 0 THEN (min(k) FILTER (score = m))::int ELSE 0 END AS k FROM (SELECT *, max(score) OVER (PARTITION BY utt) AS m FROM g) GROUP BY utt""")
def best_prefix(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), F.col("event_id").alias("pos"), F.lit(1.0).alias("weight"), (-F.col("value") / 40).alias("log_p"))
    return sampling.best_prefix(rows, 0.8, 0.35)


# ---------------------------------------------------------------- vocabulary and quantization

_VOCAB = "SELECT i AS code, '<|s_' || i || '|>' AS token, 128255 + row_number() OVER (ORDER BY '<|s_' || i || '|>') AS token_id FROM range(0, 8192) t(i)"


@query(_VOCAB)
def vocab_lex_rank(spark, sf_dir):
    return vocab.vocabulary(spark)


@query(f"SELECT event_id, token_id FROM events JOIN ({_VOCAB}) v ON v.code = event_id % 8192")
def codes_to_ids(spark, sf_dir):
    codes = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8192).alias("code"))
    return vocab.codes_to_ids(codes, vocab.vocabulary(spark)).select("event_id", "token_id")


def _codebook(spark, sf_dir, n=16):
    rows = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n).select("vec_id", "embedding").collect()  # n entries: the codebook
    return [(r[0], [float(x) for x in r[1]]) for r in sorted(rows)]


@query("""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS code, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a, u b WHERE b.vec_id < 16)
SELECT vec_id, code, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, code) = 1""")
def vq_nearest(spark, sf_dir):
    out = vocab.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _codebook(spark, sf_dir))
    return out.select("vec_id", "code", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- text structure and loader

_WORDS = r"CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '\[[^\[\]]*\]|\S+') END"


@query(f"SELECT conv_id, turn, len({_WORDS})::int AS n, ({_WORDS})[1] AS first FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, turn, '' FROM conversations WHERE conv_id = 0)")
def tokens(spark, sf_dir):
    found = T.tokens(F.col("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # the empty text, which is one empty token, is not in the table
    rows = rows.unionByName(rows.where("conv_id = 0").select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), "turn", F.lit("").alias("text")))
    return rows.select("conv_id", "turn", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("SELECT conv_id, turn, regexp_extract_all(replace(lower(split_part(text, ' ', 1)), '’', ''''), '[a-z''@]') AS letters FROM conversations WHERE text NOT LIKE '[%'")
def letters(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where("text not like '[%'")
    return rows.select("conv_id", "turn", T.letters(F.split_part("text", F.lit(" "), F.lit(1))).alias("letters"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\[[^\[\]]*\]|\S+') AS words FROM conversations WHERE text <> ''),
t AS (SELECT conv_id, turn, unnest(range(0, len(words)))::int AS pos, unnest(words) AS word FROM w)
SELECT conv_id, turn, pos, CASE WHEN regexp_full_match(word, '\[[^\[\]]*\]') THEN ['@'] ELSE regexp_extract_all(replace(lower(word), '’', ''''), '[a-z''@]') END AS letters FROM t""")
def letters_of_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    return rows.select("conv_id", "turn", "pos", T.letters(F.col("word")).alias("letters"))


@query("SELECT event_id, '<|s_' || (event_id % 8192) || '|><|s_' || (user_id % 8192) || '|>' AS packed, [event_id % 8192, user_id % 8192]::int[] AS codes FROM events")
def audio_token_roundtrip(spark, sf_dir):
    packed = T.format_audio_tokens(F.array((F.col("event_id") % 8192).cast("int"), (F.col("user_id") % 8192).cast("int")))
    return _table(spark, sf_dir, "events").select("event_id", packed.alias("packed"), T.parse_audio_tokens(packed).alias("codes"))


@query("SELECT conv_id, turn, '<|bos|><|text_start|>' || trim(text) || '<|text_end|><|speech_start|><|s_' || turn || '|><|speech_end|>' AS example FROM conversations")
def prompt_layout(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.training_example(F.col("text"), F.array(F.col("turn"))).alias("example"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (trim(text) = '' OR text IS NULL) AS no_text, count(*) FILTER (trim(text) <> '' AND strlen(text) > 900) AS too_long,
count(*) FILTER (trim(text) <> '' AND strlen(text) <= 900 AND role = 'system') AS no_speech_start,
count(*) FILTER (trim(text) <> '' AND strlen(text) <= 900 AND role <> 'system' AND turn % 2 <> 0) AS no_speech_end,
count(*) FILTER (trim(text) <> '' AND strlen(text) <= 900 AND role <> 'system') AS kept, max(strlen(text)) AS longest FROM conversations""")
def loader_funnel(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return corpus.funnel(rows, F.col("text"), F.octet_length("text"), F.col("role") != "system", F.col("turn") % 2 == 0, 900)


@query("SELECT event_id, list_transform(range(0, 8), lambda i: CASE WHEN i <= event_id % 8 THEN -100 ELSE i END)::int[] AS labels FROM events")
def label_mask(spark, sf_dir):
    seq = F.expr("sequence(0, 7)")
    return _table(spark, sf_dir, "events").select("event_id", signal.mask_labels(seq, (F.col("event_id") % 8).cast("int")).alias("labels"))


@query("SELECT event_id, list_concat(list_transform(range(0, event_id % 8), lambda i: i), list_transform(range(event_id % 8, 8), lambda i: -1))::int[] AS padded FROM events")
def pad_batch(spark, sf_dir):
    own = F.expr("filter(sequence(0, 7), i -> i < event_id % 8)")
    return _table(spark, sf_dir, "events").select("event_id", signal.pad_right(own, F.lit(8), -1).alias("padded"))


@query("""SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN 2.0 ELSE 1.0 END * value) / sum(CASE WHEN event_type = 'click' THEN 2.0 ELSE 1.0 END), 6) AS loss FROM events GROUP BY user_id""")
def weighted_loss(spark, sf_dir):
    w = F.when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(w * F.col("value")) / F.sum(w), 6).alias("loss"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round_even(CASE WHEN x < 0 THEN greatest(x::double, -1) * 32768 ELSE least(x::double, 1) * 32767 END, 0)::int) AS pcm FROM embeddings")
def pcm(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", signal.pcm16(F.col("embedding")).alias("pcm"))


# ---------------------------------------------------------------- checks and measures

_NAME = "lang || '/' || doc_id || CASE source WHEN 'web' THEN '.WAV' WHEN 'books' THEN '.txt' ELSE '.mp3' END"


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s', ' ', 'g')) = '' THEN 'blank text' WHEN length(text) > 5000 THEN 'text too long'
WHEN turn * 9000 NOT BETWEEN 8000 AND 48000 THEN 'sample rate' WHEN role = 'system' THEN 'speed' WHEN conv_id % 2 = 0 AND turn = 2 THEN 'voice and reference' END AS problem FROM conversations""")
def request_problems(spark, sf_dir):
    given = F.when(F.col("conv_id") % 2 == 0, F.lit("voice"))
    reference = F.when(F.col("turn") == 2, F.lit("clip"))
    speed = F.when(F.col("role") == "system", 1.5).otherwise(1.0)
    problem = checks.request_problem(F.col("text"), F.col("turn") * 9000, speed, given, reference)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", problem.alias("problem"))


@query("""SELECT doc_id, CASE WHEN n_chars / 15 < 1 THEN 'too short' WHEN n_chars / 15 > 20 AND source = 'web' THEN 'too long' WHEN n_chars / 15 > 20 THEN 'cut' ELSE 'whole' END AS fate FROM documents""")
def reference_fate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", checks.reference_fate(F.col("n_chars") / 15, F.coalesce(F.col("source") == "web", F.lit(False))).alias("fate"))


@query(f"""SELECT doc_id, file_name FROM (SELECT doc_id, text, {_NAME} AS file_name FROM documents)
WHERE trim(text) <> '' AND (file_name LIKE '%.WAV' OR file_name LIKE '%.mp3') AND doc_id IN (SELECT doc_id FROM labels)""")
def preset_manifest(spark, sf_dir):
    manifest = _table(spark, sf_dir, "documents").withColumn("file_name", F.expr(_NAME))
    files = manifest.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return checks.presets(manifest, files).select("doc_id", "file_name")


@query("""SELECT source, list_filter([CASE WHEN max(n_chars) > 6553.6 THEN 'longest row is close to the limit' END, CASE WHEN count(*) FILTER (lang = 'de') > 0 THEN 'names without a recording' END,
CASE WHEN count(*) FILTER (lang = 'xx') > 0 THEN 'names of several recordings' END, CASE WHEN count(*) FILTER (lang = 'fr') = 0 THEN 'nothing held out' END], lambda x: x IS NOT NULL) AS notes FROM documents GROUP BY source""")
def report_notes(spark, sf_dir):
    n = lambda lang: F.count(F.when(F.col("lang") == lang, 1)).alias(lang)
    rows = _table(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("longest"), n("de"), n("xx"), n("fr"), F.count(F.lit(1)).alias("rows"))
    notes = checks.report_notes(F.col("longest"), 8192, F.col("de"), F.col("xx"), F.col("rows"), F.col("fr"), True, False)
    return rows.select("source", notes.alias("notes"))


@query("""WITH m AS (SELECT *, coalesce(sum((event_type = 'purchase')::int) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS sentence FROM events)
SELECT user_id, sentence, coalesce(string_agg(props, ' ' ORDER BY event_id) FILTER (event_type <> 'purchase'), '') AS text,
coalesce(list_sort(list(DISTINCT event_type) FILTER (event_type <> 'purchase')), []) AS kinds FROM m GROUP BY ALL HAVING bool_or(event_type = 'purchase')""")
def labelled_sentences(spark, sf_dir):
    return measures.sentences(_table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "props", "purchase")


@query("SELECT role, round(avg((lower(trim(text)) = lower(trim(CASE WHEN turn % 3 = 0 THEN '  ' || lower(text) || '  ' ELSE text || '.' END)))::int), 6) AS accuracy FROM conversations GROUP BY role")
def spoken_accuracy(spark, sf_dir):
    wanted = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.lower("text"), F.lit("  "))).otherwise(F.concat("text", F.lit(".")))
    return _table(spark, sf_dir, "conversations").groupBy("role").agg(F.round(measures.accuracy(F.col("text"), wanted), 6).alias("accuracy"))


@query("""WITH c AS (SELECT user_id, event_id, value, event_id * 0.25 AS arrival FROM events),
h AS (SELECT *, min(arrival) OVER (PARTITION BY user_id) AS first, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM c)
SELECT user_id, min(first)::double AS first, max(arrival)::double AS closed, round(sum(value), 6) AS audio, round(min(had - (arrival - first)), 6) AS buffer_floor,
round(CASE WHEN max(arrival) > min(first) THEN sum(value) / (max(arrival) - min(first)) END, 6) AS realtime FROM h GROUP BY user_id""")
def delivery_measures(spark, sf_dir):
    chunks = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * F.lit(0.25)).alias("arrival"), F.col("value").alias("seconds"))
    out = measures.delivery(chunks, "user_id", ["event_id"])
    return out.select("user_id", "first", "closed", *[F.round(c, 6).alias(c) for c in ("audio", "buffer_floor", "realtime")])


@query("""SELECT vec_id, list_transform(range(1, 33), lambda i: round((embedding[i]::double + embedding[i + 32]::double) / 2, 9)) AS channels_first,
list_transform(range(0, 32), lambda i: round((embedding[2 * i + 1]::double + embedding[2 * i + 2]::double) / 2, 9)) AS samples_first FROM embeddings""")
def mono_mix(spark, sf_dir):
    wide = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    tall = F.transform(F.expr("sequence(0, 31)"), lambda i: F.slice("embedding", 2 * i + 1, F.lit(2)))
    show = lambda c: F.transform(signal.mono(c), lambda x: F.round(x, 9))
    return _table(spark, sf_dir, "embeddings").select("vec_id", show(wide).alias("channels_first"), show(tall).alias("samples_first"))


@query("SELECT vec_id, embedding[least(round_even(vec_id % 70 / 2, 0), 64)::int + 1:] AS rest FROM embeddings")
def trim_leading(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", signal.trim_leading(F.col("embedding"), F.col("vec_id") % 70 / 40, 20).alias("rest"))


@query("""WITH p AS (SELECT i, greatest(0, (i + 0.5::double) * 64 / 102 - 0.5) AS x FROM range(0, 102) t(i)),
v AS (SELECT vec_id, i, embedding[floor(x)::int + 1]::double AS a, embedding[least(floor(x)::int + 1, 63) + 1]::double AS b, x - floor(x) AS f FROM embeddings, p)
SELECT vec_id, list(round(a + f * (b - a), 9) ORDER BY i) AS stretched FROM v GROUP BY vec_id""")
def stretch_frames(spark, sf_dir):
    out = F.transform(signal.stretch(F.col("embedding"), F.lit(102)), lambda x: F.round(x, 9))
    return _table(spark, sf_dir, "embeddings").select("vec_id", out.alias("stretched"))


@query("""SELECT vec_id, round(list_aggregate(list_transform(range(1, 64), lambda i: abs(embedding[i + 1]::double - embedding[i]::double)), 'quantile_cont', 0.999), 9) AS step_p999,
list_max(list_transform(embedding, lambda x: abs(x))) < 0.3 AS silent FROM embeddings""")
def step_percentile(spark, sf_dir):
    wav = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.step_percentile(wav, 0.999), 9).alias("step_p999"), signal.is_silent(wav, 0.3).alias("silent"))


_PLACED = "SELECT user_id AS utt, event_id AS word, (event_id // 4 % 97)::int AS start, (event_id // 4 % 97 + event_id % 5)::int AS stop FROM events"


@query(f"""WITH w AS ({_PLACED}), r AS (SELECT *, greatest(5, coalesce(max(greatest(start, stop)) OVER (PARTITION BY utt ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5)) AS f FROM w)
SELECT utt, word, greatest(start, f) AS start, greatest(stop, start, f) AS stop FROM r""")
def clamp_words(spark, sf_dir):
    at = F.expr("event_id div 4 % 97").cast("int")
    words = _table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), F.col("event_id").alias("word"), at.alias("start"), (at + F.col("event_id") % 5).cast("int").alias("stop"))
    return alignment.clamp_forward(words, "utt", "word", 5)


@query("""WITH f AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, CASE WHEN event_type <> 'error' THEN (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2 END AS state, -value / 40 AS log_p FROM events),
w AS (SELECT utt, word, word * 3 AS first, word * 3 + 1 AS last FROM (SELECT DISTINCT user_id AS utt FROM events), range(0, 4) t(word))
SELECT utt, word, coalesce(min(frame), 0) AS start, coalesce(max(frame) + 1, 0) AS stop, round(avg(log_p), 9) AS score FROM w LEFT JOIN f USING (utt) WHERE state BETWEEN first AND last GROUP BY utt, word
UNION ALL SELECT utt, word, 0, 0, NULL FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.utt = w.utt AND state BETWEEN first AND last)""")
def word_frames(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    frames = events.withColumn("frame", frame).select(F.col("user_id").alias("utt"), "frame", F.when(F.col("event_type") != "error", F.expr("frame div 2")).alias("state"), (-F.col("value") / 40).alias("log_p"))
    words = events.select(F.col("user_id").alias("utt")).distinct().select("utt", F.explode(F.expr("sequence(0L, 3L)")).alias("word"))
    words = words.withColumn("first", F.col("word") * 3).withColumn("last", F.col("word") * 3 + 1)
    return alignment.word_frames(words, frames).withColumn("score", F.round("score", 9))


# ---------------------------------------------------------------- beyond SQL


@query()
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", spoken.spoken(F.col("text")).alias("spoken"))


@query()
def normalize_turns(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", spoken.spoken(F.col("text")).alias("spoken"))


@query()
def split_chunks(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", structure.chunk_array(F.col("text"), F.lit(300)).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))


@query()
def split_clauses(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(structure.split_clauses(F.col("text"))).alias("pos", "piece"))


@query()
def ctc_align(spark, sf_dir):
    probs = F.transform(F.expr("sequence(0, 15)"), lambda t: F.transform(F.slice("embedding", t * 4 + 1, F.lit(4)), lambda x: (-F.abs(x)).cast("float")))
    return alignment.align(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt"), probs.alias("log_probs"), F.expr("array(array(1, 2), array(3), array(1, 1))").alias("words")))


@query()
def session_frames(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    kind = F.when(F.col("turn") == 0, F.to_json(F.struct(F.lit("ctx").alias("start_context")))).otherwise(F.to_json(F.struct(F.col("text").alias("send_text"))))
    return session.batch(rows.select(F.col("conv_id").cast("string").alias("session"), seq.cast("long").alias("seq"), kind.alias("frame")))


from . import more  # noqa: E402,F401 - registers its queries here
