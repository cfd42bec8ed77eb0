"""Edge cases of the operators that mirror the reference's, by small fixtures and plain Python."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import spoken, structure, text as T
from voxloom.operators import alignment, corpus, sampling, signal, vocab
from voxloom.sources import corpus_files as files
from voxloom.streaming import session


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("written,said", [(" a  \t b\n", "a b"), ("", ""), (None, None)])
def test_clean_text(spark, written, said):
    assert one(spark, T.clean_text, written) == said


def test_text_functions(spark):
    assert [one(spark, T.format_duration, s, "double") for s in (0.5, 59.5, 3599.6, 3661.0)] == ["0:00", "1:00", "1:00:00", "1:01:01"]
    assert [one(spark, T.tags_closed, s) for s in ("a [b] c", "a [b", "", "] [x")] == [True, False, True, False]
    assert one(spark, T.tokens, "") == [""] and one(spark, T.tokens, "hi [a b] you") == ["hi", "[a b]", "you"]
    assert one(spark, T.letters, "Don’t!") == list("don't") and one(spark, T.letters, "[tag]") == ["@"]
    assert one(spark, lambda c: T.parse_audio_tokens(T.format_audio_tokens(c)), [5, 81], "array<int>") == [5, 81]
    assert [one(spark, T.pluralise, w) for w in ("foot", "berry", "day", "box", "mile")] == ["feet", "berries", "days", "boxes", "miles"]
    assert [one(spark, T.human_bytes, n, "long") for n in (10, 2048, 3 << 20)] == ["10 B", "2.0 KB", "3.0 MB"]


@pytest.mark.parametrize(
    "written,said",
    [
        ("I have 3 cats", "I have three cats"), ("1,234 and 12345", "one thousand two hundred thirty four and one two three four five"), ("007", "zero zero seven"),
        ("the 21st and 100th", "the twenty first and one hundredth"), ("12.50", "twelve point five zero"), ("3/4 of it", "three quarters of it"),
        ("$5.07", "five dollars seven cents"), ("$1", "one dollar"), ("€2.5 million", "two point five million euros"), ("-$5", "minus five dollars"),
        ("at 3:05 pm", "at three o five PM"), ("10:00", "ten o'clock"), ("5 km", "five kilometers"), ("1 kg", "one kilogram"), ("March 5, 1999", "March fifth nineteen ninety nine"),
        ("2005", "two thousand five"), ("192.168.0.1", "one nine two dot one six eight dot zero dot one"), ("[7 up] 7", "[7 up] seven"), ("5%", "five percent"), ("Dr. No", "doctor No"), ("1e-3", "one e negative three"),
    ],
)
def test_spoken_forms(written, said):
    assert spoken.normalize_text(written) == said


def test_cardinals_round_numbers():
    assert spoken.cardinal(0) == "zero" and spoken.cardinal(10**6) == "one million" and spoken.cardinal(-21) == "minus twenty one"
    assert [spoken.ordinal(n) for n in (1, 2, 12, 20, 30, 101)] == ["first", "second", "twelfth", "twentieth", "thirtieth", "one hundred first"]


def test_structure(spark):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab. !?,Dr[]\n\"'") for _ in range(rng.randrange(80)))
        assert "".join(structure.sentences(text)) == text and "".join(structure.split_and_merge(text, 12)) == text
        assert all(len(p) <= 12 for p in structure.split_and_merge(text, 12))
    assert structure.sentences("Dr. No came. He left.") == ["Dr. No came. ", "He left."]
    assert structure.stable_sentence_end("Hi! you") == 4 and structure.stable_sentence_end("Hi.") == 0 and structure.stable_sentence_end("[a! b") == 0
    owned = structure.word_map(["I", "have", "21", "cats"], ["I", "have", "twenty", "one", "cats"])
    assert list(itertools.chain(*owned)) == ["I", "have", "twenty", "one", "cats"] and owned[3] == ["cats"]
    pieces = one(spark, lambda c: structure.split_clauses(c, 20, 5), "One two three. Four five six! Ok. X")
    assert pieces == ["One two three.", "Four five six! Ok. X"]


def test_merge_pair_holdout(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "keep"), (None, "anon")], "id string, text string")
    b = spark.createDataFrame([("1", "new", 5), (None, "anon", 1)], "id string, text string, extra int")
    assert sorted(map(str, map(tuple, corpus.merge(a, b).collect()))) == sorted(map(str, [("1", "new", 5), ("2", "keep", None), (None, "anon", None), (None, "anon", 1)]))
    fs = spark.createDataFrame([("x/a.wav",), ("y/a.wav",), ("B.wav",)], "file string")
    m = spark.createDataFrame([(0, "x/a"), (1, "a"), (2, "./b.WAV"), (3, "zz"), (4, "/else/B.wav")], "row long, name string")
    got = {r.row: (r.status, r.file) for r in corpus.pair(fs, m).collect()}
    assert got == {0: ("matched", "x/a.wav"), 1: ("ambiguous", None), 2: ("matched", "B.wav"), 3: ("unmatched", None), 4: ("matched", "B.wav")}
    for n, fraction, k in ((1, 0.5, 0), (2, 0.9, 1), (10, 0.01, 1), (10, 0, 0), (100, 0.25, 25)):
        assert corpus.holdout(spark.range(n), "id", fraction).where("held_out").count() == k


def test_sampling(spark):
    rows = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (0, 2, 1.0), (0, 3, -1.0)], "row int, token int, logit double")
    tokens = lambda df: sorted(r.token for r in df.collect())
    assert tokens(sampling.top_k(rows, 1)) == [0, 1] and tokens(sampling.top_k(rows, 0)) == [0, 1, 2, 3]
    assert tokens(sampling.top_p(rows, 1e-9)) == [0] and tokens(sampling.temperature(rows, 0)) == [0]
    seen = spark.createDataFrame([(0, 0), (0, 0), (0, 3)], "row int, token int")
    assert {r.token: r.logit for r in sampling.repetition_penalty(rows, seen, 2.0).collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: -2.0}
    words = spark.createDataFrame([(0, 0, 1.0, -0.1), (0, 1, 1.0, float("nan")), (1, 0, 1.0, -9.0)], "utt int, pos int, weight double, log_p double")
    assert {r.utt: r.k for r in sampling.best_prefix(words, 0.9, 0.5).collect()} == {0: 1, 1: 0}


def test_signal(spark):
    wav = [0.0] * 4 + [1.0] * 4 + [0.0] * 8 + [1.0] * 4
    db = one(spark, lambda c: signal.frame_db(c, 4, 4), wav, "array<double>")
    assert [x > -20 for x in db] == [False, True, False, False, True]
    assert [tuple(s) for s in one(spark, lambda c: signal.silent_spans(c, 20.0, 1), db, "array<double>")] == [(2, 4)]
    assert one(spark, lambda c: signal.trim_silence(c, signal.frame_db(c, 4, 4), 20.0, 4, 4, 1), wav, "array<double>") == wav[3:]
    assert one(spark, lambda c: signal.frame_db(c, 4, 4), [0.0] * 3, "array<double>") == [float("-inf")]
    assert one(spark, lambda c: signal.pcm16(c), [-1.5, -1.0, 0.0, 1.0, 0.5 / 32767], "array<double>") == [-32768, -32768, 0, 32767, 0]
    assert one(spark, lambda c: signal.greedy_cuts(c, F.lit(100), 40), [10, 30, 35, 90], "array<int>") == [35, 90]
    assert one(spark, lambda c: signal.mask_labels(c, F.lit(9)), [1, 9, 2, 3], "array<int>") == [-100, -100, 2, 3]
    assert one(spark, lambda c: signal.ramp_weights(c, 7, 3, 3.0), [-100, 1, 2, 3, 7], "array<int>") == [0.0, 1.0, 2.0, 3.0, 0.0]
    spans = one(spark, signal.plan_windows, 70, "int")
    assert [tuple(s) for s in spans] == [(0, 40, 0, 31), (16, 70, 31, 62), (47, 70, 62, 70)]


def test_vocabulary(spark):
    v = vocab.vocabulary(spark)
    vocab.check_vocabulary(v)
    assert {r.code: r.token_id for r in v.where("code in (0, 1, 2)").collect()} == {0: 128256, 1: 129367, 2: 130478}
    with pytest.raises(ValueError, match="gaps"):
        vocab.check_vocabulary(v.withColumn("token_id", F.col("token_id") * 2))


def best_path(lp, targets):
    """Every labelling, brute force."""
    best = None
    for path in itertools.product(range(lp.shape[1]), repeat=len(lp)):
        squeezed = [k for k, _ in itertools.groupby(path) if k]
        if squeezed == targets:
            s = sum(lp[t, x] for t, x in enumerate(path))
            best = s if best is None else max(best, s)
    return best


def test_ctc(spark):
    rng = np.random.default_rng(0)
    for targets in ([1], [1, 2], [1, 1], [2, 1, 2], []):
        lp = np.log(rng.dirichlet(np.ones(3), size=6))
        path = alignment.forced_align(lp, targets)
        assert [k for k, _ in itertools.groupby(path.tolist()) if k] == targets
        assert np.isclose(sum(lp[t, x] for t, x in enumerate(path)), best_path(lp, targets))
    with pytest.raises(ValueError):
        alignment.forced_align(np.zeros((2, 3)), [1, 1])
    lp = [[-0.1, -3.0, -3.0], [-3.0, -0.1, -3.0], [-3.0, -3.0, -0.1]]
    df = spark.createDataFrame([(1, lp, [[1], [], [2]])], "utt long, log_probs array<array<float>>, words array<array<int>>")
    rows = alignment.align(df).orderBy("word").collect()
    assert [(r["first"], r["last"]) for r in rows] == [(1, 1), (0, 0), (2, 2)]
    rounds = spark.createDataFrame([(1, 0, 0, 100), (1, 0, 1, 300), (1, 1, 0, 150), (1, 1, 1, 900), (1, 2, 0, 150), (1, 2, 1, 910)], "utt int, round int, word int, end_ms int")
    assert sorted(map(tuple, alignment.confirmed(rounds).collect())) == [(1, 0, 1, 150), (1, 1, 2, 910)]


def test_files(spark, tmp_path):
    assert [files.sniff_delimiter(s) for s in ("a|b|c,d", "a;b", "ab", "a,b;c")] == ["|", ";", ",", ","] and files.sniff_delimiter("a,b", ".tsv") == "\t"
    (tmp_path / "m.csv").write_text('﻿Text,File Name\n"hello, you",a.wav\n ,b.wav\n')
    assert [(r.name, r.text) for r in files.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("a.wav", "hello, you"), ("b.wav", "")]
    (tmp_path / "m.psv").write_text("a.wav|one\nb.wav|two  words\n")
    assert [(r.name, r.text) for r in files.read_manifest(spark, str(tmp_path / "m.psv")).collect()] == [("a.wav", "one"), ("b.wav", "two words")]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "x"}\n\nnot json\n[1]\n{"text": 5}\n{"text": "y", "more": 1}\n')
    assert [(r.id, r.text) for r in files.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()] == [("1", "x"), (None, "y")]
    out = str(tmp_path / "o.jsonl")
    files.write_corpus(spark.createDataFrame([("1", "ñ")], "id string, text string"), out)
    files.write_corpus(files.read_corpus(spark, out).select("id", "text"), out)
    assert [r.text for r in files.read_corpus(spark, out).collect()] == ["ñ"]
    assert files.default_val_path("a/train.jsonl") == "a/val.jsonl" and files.default_val_path("a/x.jsonl") == "a/x.val.jsonl"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.wav").write_bytes(files.wav_bytes([0, 16384, -32768], 16000))
    (tmp_path / "w" / ".b.wav").write_bytes(b"x")
    found = files.find_audio(spark, str(tmp_path / "w"))
    assert [r.rel for r in found.collect()] == ["a.wav"]
    r = spark.read.format("binaryFile").load(found.first().path).select(files.decode_wav("content").alias("d")).first().d
    assert (r.rate, r.wav) == (16000, [0.0, 0.5, -1.0])
    tone = np.sin(np.arange(1600) * 0.05)
    up = files.resample(tone, 16000, 32000)
    assert len(up) == 3200 and np.abs(up[200:-200:2] - tone[100:-100]).max() < 1e-2 and len(files.resample(tone, 32000, 24000)) == 1200


def test_sessions_stream_equals_batch(spark, tmp_path):
    texts = ["word " * 3, "and more text that goes on for a while ", "x", "the end of it all here "]
    frames = []
    for s in range(4):
        own = [{"start_context": f"c{s}"}] + [{"send_text": t} for t in texts] + [{"flush": "1"}, {"bad": 1}, {"send_text": "late"}, {"close_context": "1"}, {"send_text": "after"}]
        frames += [(f"s{s}", i, json.dumps(f)) for i, f in enumerate(own)]
    random.Random(3).shuffle(frames)
    schema = "session string, seq long, frame string"
    want = sorted(map(tuple, session.batch(spark.createDataFrame(frames, schema)).collect()))
    assert {k for _, _, k, _ in want} == {"started", "speak", "flushed", "closed", "error"}
    said = "".join(p for s, _, k, p in want if s == "s0" and k == "speak")
    assert said == "".join(texts) + "late"
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(frames[part::3], schema).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    q = session.stream(stream).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("sessions").collect())) == want


def test_alignment_of_many_utterances_at_once():
    rng = np.random.default_rng(4)
    items = []
    for n in [0, 1, 2, 5, 5, 40] * 25:
        targets = rng.integers(1, 5, n).tolist()
        frames = n + sum(a == b for a, b in zip(targets, targets[1:])) + int(rng.integers(1 if n == 0 else 0, 30))
        items.append((-rng.integers(0, 4, (frames, 5)).astype(np.float32) / 4, targets))  # few values: many ties
    for cells in (alignment.CELLS_AT_ONCE, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(alignment, "CELLS_AT_ONCE", cells)
            for (lp, targets), path in zip(items, alignment.forced_align_all(items)):
                assert path.tolist() == alignment.forced_align(lp, targets).tolist()


def test_timed_words_of_odd_rows(spark, monkeypatch):
    lp = [[-1.0 - (t * 7 + k * 3) % 5 for k in range(30)] for t in range(60)]
    rows = [(1, lp, ["one", "two"]), (2, None, ["a"]), (3, lp, None), (4, [], ["a"]), (5, lp[:3], ["too", "few"]), (6, lp, []), (7, lp, ["?!", "a"])]
    df = spark.createDataFrame(rows, "utt long, log_probs array<array<float>>, words array<string>").coalesce(1)
    calls, single = [], alignment.forced_align
    monkeypatch.setattr(alignment, "forced_align", lambda *a: calls.append(1) or single(*a))
    want = [(u, *w) for u, x, words in rows if x and words for w in alignment.place_all(words, np.array(x, dtype=np.float32))]
    tidy = lambda rows: sorted((*r[:4], None if r[4] is None or r[4] != r[4] else r[4]) for r in rows)
    assert tidy(map(tuple, alignment.timed(df).collect())) == tidy(want)
