"""Operators of words in codes, sessions, files, settings and signals, by small cases and plain versions."""

import json
import math
import os
import random
from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F

from voxloom.functions import spoken, structure
from voxloom.operators import alignment as al, corpus, report, sampling, settings, signal, vocab
from voxloom.sources import corpus_files as files, lookups
from voxloom.streaming import chunks, session, wire


# ---------------------------------------------------------------- texts


@given(st.text(alphabet=st.sampled_from("0123456789$€-–/.:,%°xkmKMB ehsQ'½²³+~^@ACDPpt[]() \n٣"), max_size=30))
@hypothesis_settings(max_examples=300, deadline=None)
def test_no_text_breaks_the_spoken_forms(text):
    said = spoken.normalize_text(text)
    assert not any(c in "0123456789" for c in spoken.TAG.sub("", said)) and isinstance(spoken.match_punctuation(text, said), str)


def test_punctuation_follows_the_written_text():
    assert spoken.match_punctuation("12 test' example", "twelve test 'example") == "twelve test' example"
    assert spoken.match_punctuation("a , b", "a, b") == "a , b" and spoken.match_punctuation("a-b", "a b") == "a b"
    assert spoken.tidy_spaces("( a ) , ``b'' !") == '(a), "b"!'


def test_chunks_of_text():
    assert structure.split_and_merge("Dr. Smith went to the U.S. office. Then home.", 20) == ["Dr. Smith went to ", "the U.S. office. ", "Then home."]
    assert structure.split_and_merge("One. Two. Three.", 300, preserve_first=True) == ["One. ", "Two. Three."]
    long = "Word one and two. " * 30
    head, tail = structure.aligned_chunks(long)
    assert 200 <= len(head) <= 400 and head.endswith(".") and f"{head} {tail}" == long.strip()
    words = "word " * 100
    head, tail = structure.aligned_chunks(words)
    assert len(head) <= 400 and f"{head} {tail}" == words.strip()
    assert structure.aligned_chunks("short") == ["short"] and structure.word_end("a [b c", 6) == 2


def test_words_and_their_spoken_forms():
    speak = lambda w: {"55": "fifty five", "$20.": "twenty dollars."}.get(w, w)
    assert structure.map_words("Pay 55 now", "Pay fifty five now", speak) == [("Pay", "Pay"), ("55", "fifty five"), ("now", "now")]
    assert structure.map_words("a b", "a b c d", speak)[-1] == ("", "c d")
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice(["x", "yy", "abc", "abd"]) for _ in range(rng.randrange(5))] for _ in range(2))
        pairs = structure.aligned_pairs(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))


# ---------------------------------------------------------------- words in codes


def stepwise(lp, targets, blank=0):
    """The same path, state by state."""
    states = [blank]
    for t in targets:
        states += [t, blank]
    neg = np.float32(-np.inf)
    alpha = [neg] * len(states)
    alpha[0] = lp[0, blank]
    if targets:
        alpha[1] = lp[0, targets[0]]
    moves = []
    for t in range(1, len(lp)):
        new, move = [], []
        for s, label in enumerate(states):
            x0, x1 = alpha[s], alpha[s - 1] if s else neg
            x2 = alpha[s - 2] if s % 2 and s > 1 and states[s] != states[s - 2] else neg
            k = 2 if x2 > x1 and x2 > x0 else 1 if x1 > x0 and x1 > x2 else 0
            new.append(np.float32((x0, x1, x2)[k] + lp[t, label]))
            move.append(k)
        alpha = new
        moves.append(move)
    s = len(states) - 1
    if targets and not alpha[s] > alpha[s - 1]:
        s -= 1
    path = [states[s]]
    for move in reversed(moves):
        s -= move[s]
        path.append(states[s])
    return path[::-1]


def test_ties_of_paths():
    assert al.forced_align(np.zeros((4, 3)), [1, 2]).tolist() == stepwise(np.zeros((4, 3), np.float32), [1, 2]) == [1, 2, 2, 2]
    rng = np.random.default_rng(3)
    for targets in ([1], [1, 2], [1, 1], [2, 1, 2], []):
        for _ in range(30):
            lp = rng.integers(-3, 0, (7, 3)).astype(np.float32)  # many ties
            assert al.forced_align(lp, targets).tolist() == stepwise(lp, targets)


def frames_of(words, per_letter=6, gap=4, high=-0.05, low=-6.0):
    """Scores of a clean recording: a gap of stars before each word, then its letters."""
    rows = []
    for w in [*words, None]:
        rows += [al.STAR] * gap
        rows += [al.LABEL[c] for c in (al.letters_of(w) if w else []) for _ in range(per_letter)]
    lp = np.full((len(rows), len(al.LABEL) + 2), low, dtype=np.float32)
    lp[np.arange(len(rows)), rows] = high
    return lp


def test_words_are_placed():
    words = ["one", "two", "[tag]", "fix"]
    lp = frames_of(words)
    got = al.place_all(words, lp)
    at, want = 0, []
    for w in words:
        at += 4
        want.append((at, at + 6 * len(al.letters_of(w))))
        at = want[-1][1]
    assert [(int(a / al.STRIDE_MS + 0.5), int(b / al.STRIDE_MS + 0.5)) for _, a, b, _ in got] == want
    assert al.place_all(["a"], lp[:3]) == [(0, 0, 0, got[0][3])] or math.isnan(al.place_all(["a"], lp[:3])[0][3])
    assert [i for i, *_ in al.place_sure(words, lp, tail_ms=0)] == [0, 1, 2, 3] and al.place_sure(words, lp[:7]) == []
    # a word that ends in the last 600 ms waits
    assert len(al.place_sure(words, lp, tail_ms=600)) < 4
    clamped = al.place_all(words, lp, floor=20)
    assert all(a >= 20 * al.STRIDE_MS and b >= a for _, a, b, _ in clamped)


def test_words_are_told_once():
    words = ["hello", "there", "my", "friend", "of", "old"]
    lp, clock, told = frames_of(words), al.WordClock(), []
    told += clock.add(words, lp[:0])
    for i in range(0, len(lp), 12):
        told += clock.add([], lp[i : i + 12])
    early = len(told)
    told += clock.finish()
    assert [w for w, *_ in told] == words and early >= 1 and clock.dropped > 0
    assert all(a <= b for _, a, b in told) and all(x[1] <= y[1] for x, y in zip(told, told[1:]))


# ---------------------------------------------------------------- signals


def test_streams_of_samples_and_codes():
    rng = np.random.default_rng(5)
    wav = rng.standard_normal(3000)
    for old, new in ((16000, 24000), (48000, 16000), (16000, 16000), (44100, 16000)):
        r, parts, at = signal.Resampler(old, new), [], 0
        while at < len(wav):
            step = int(rng.integers(1, 700))
            parts.append(r.push(wav[at : at + step]))
            at += step
        parts += [r.flush(), r.flush()]
        whole = files.resample(wav, old, new)
        got = np.concatenate(parts)
        assert len(got) == len(whole) == -(-new * len(wav) // old) and np.abs(got - whole).max() < 1e-5
    # a codec whose samples are its codes, two for each
    codec = lambda codes, window: [c for c in codes[3:-3] for _ in range(2)]
    for n in (0, 1, 30, 40, 41, 71, 200):
        codes = list(range(1, n + 1))
        s, out = signal.CodeStream(codec, hop=2), []
        for i in range(0, n, 7):
            out += s.push(codes[i : i + 7])
        out += s.finish() + s.finish()
        assert out == [c for c in codes for _ in range(2)]
    s = signal.CodeStream(codec, hop=2)
    s.prime([9] * 50)
    assert s.push(list(range(60))) + s.finish() == [c for c in range(60) for _ in range(2)]


def test_loudness():
    rate = 16000
    tone = 0.1 * np.sin(2 * np.pi * 997 * np.arange(rate * 2) / rate)
    # a full-scale sine of 997 Hz has -3.01 LUFS; this one is 20 dB below it
    assert abs(signal.loudness(tone, rate) - (-23.01)) < 0.15
    out = signal.level_out(tone, rate)
    assert abs(signal.loudness(out, rate) - signal.TARGET_LUFS) < 0.05
    quiet = np.concatenate([tone, np.zeros(rate * 5)])
    assert abs(signal.loudness(quiet, rate) - signal.loudness(tone, rate)) < 1.5  # silence is gated
    for same in (np.zeros(rate), tone[:100], np.zeros(0)):
        assert np.array_equal(signal.level_out(same, rate), np.asarray(same, np.float32))
    loud = signal.level_out(np.concatenate([[1.0], tone * 0.01]), rate)
    assert np.abs(loud).max() <= signal.CEILING + 1e-6


def test_silence_leaves_nothing(spark):
    trim = lambda w: spark.createDataFrame([(w,)], "x array<double>").select(signal.trim_silence(F.col("x"), signal.frame_db(F.col("x"), 4, 4), 20.0, 4, 4, 1)).first()[0]
    assert trim([0.0] * 12) == [] and trim([1.0] * 11) == [1.0] * 11 and trim([0.0] * 8 + [1.0] * 4 + [0.0] * 8) == [0.0] + [1.0] * 4 + [0.0]


def test_quantization(spark):
    rng = np.random.default_rng(6)
    books, vecs = [rng.standard_normal((50, 8)) for _ in range(3)], rng.standard_normal((40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "k long, v array<double>")
    got = {(r.k, r.layer): r.code for r in vocab.quantize(df, books, "k", "v").collect()}
    for i, v in enumerate(vecs):
        total, rest = np.zeros(8), v
        for layer, book in enumerate(books):
            near = np.round(book @ rest / np.linalg.norm(book, axis=1) / np.linalg.norm(rest), 6)
            assert got[i, layer] == int(np.argmax(near))
            rest, total = rest - book[np.argmax(near)], total + book[np.argmax(near)]
    entries = spark.createDataFrame([(n, c, e.tolist()) for n, b in enumerate(books) for c, e in enumerate(b)], "layer int, code long, entry array<double>")
    back = {r.k: r.vector for r in vocab.dequantize(vocab.quantize(df, books, "k", "v"), entries, "k").collect()}
    assert np.allclose(back[0], sum(books[n][got[0, n]] for n in range(3)))
    with pytest.raises(ValueError):
        vocab.quantize(df, [np.zeros((1 << 22, 8))], "k", "v")
    tokens = spark.createDataFrame([("<|s_5|>", 7), ("the", 1), (vocab.END_TOKEN, 9)], "token string, token_id int")
    assert [tuple(r) for r in vocab.audio_vocabulary(tokens).collect()] == [(5, "<|s_5|>", 7)]
    vocab.check_vocabulary(vocab.audio_vocabulary(tokens), 1, tokens)
    with pytest.raises(ValueError, match="speech_end"):
        vocab.check_vocabulary(vocab.audio_vocabulary(tokens), 1, tokens.where("token = 'the'"))


def test_sampling_of_a_row(spark):
    rows = spark.createDataFrame([(0, t, float(x)) for t, x in enumerate([2.0, 1.0, 0.0, -1.0])], "row int, token int, logit double")
    p = np.exp([2, 1, 0, -1]) / np.exp([2, 1, 0, -1]).sum()
    for u in (0.0, p[0] + 0.01, p[:2].sum() + 0.01, 0.9999):
        draw = spark.createDataFrame([(0, float(u))], "row int, u double")
        assert sampling.sample(rows, draw).first().token == int(np.searchsorted(np.cumsum(p), u, side="right"))
    assert sampling.sample(rows, spark.createDataFrame([(0, 0.99)], "row int, u double"), t=0).first().token == 0
    one = spark.createDataFrame([([2.0, 1.0, 0.0, -1.0], [0])], "l array<double>, s array<int>").select(
        sampling.top_p_array(F.col("l"), 0.8).alias("p"), sampling.penalize_array(F.col("l"), F.col("s"), 2.0).alias("q"), sampling.argmax_array(F.col("l")).alias("m")
    ).first()
    assert one.p == [2.0, 1.0, -math.inf, -math.inf] and one.q == [1.0, 1.0, 0.0, -1.0] and one.m == 0


# ---------------------------------------------------------------- sessions


def test_sessions_that_normalise():
    said = lambda s, text: [p for _, k, p in s.add([(0, "start_context", "c"), (1, "send_text", text)]) if k == "speak"]
    long = "This one is complete! And here the next one goes on without an end"
    assert said(session.Session(normalize=True), long) == ["This one is complete! "]
    assert said(session.Session(normalize=True), "no end " * 8) == []
    assert said(session.Session(normalize=True), "x" * 200) == ["x" * 160] and said(session.Session(), "x" * 200) == []
    assert said(session.Session(), "some words [a tag that is still open and goes on for a while") == ["some words "]


def test_chunks_of_a_session(spark):
    words = " ".join(f"word{i}." for i in range(60))
    rows = [("s", 0, "words", words[:250]), ("s", 1, "codes", "100"), ("s", 2, "words", words[250:]), ("s", 3, "level", None), ("s", 4, "end", None), ("t", 0, "words", "x" * 300), ("t", 1, "codes", "5000"), ("t", 2, "end", None)]
    got = sorted(map(tuple, chunks.batch(spark.createDataFrame(rows, "session string, seq long, kind string, value string")).collect()))
    closed = [r[3] for r in got if r[0] == "s" and r[2] in ("chunk", "carried")]
    last = [r for r in got if r[0] == "s"][-1]
    assert " ".join([*closed, last[3]]).split() == (words[:250] + " " + words[250:]).split() and all(len(c) <= chunks.LONGEST for c in closed)
    assert all(r[5] >= 0 for r in got if r[2] == "room")
    assert [r[2] for r in got if r[0] == "t"] == ["room", "room", "chunk"]  # more speech than its text accounts for: no carry
    assert chunks.fits(100, 100, 10, 2048, 260) and not chunks.fits(100, 101, 10, 2048, 260)


def test_events_on_the_wire(spark):
    rows = [("a", 1, b"\0\0\1\0"), ("a", 2, b"\2\0"), ("b", 1, b"\0\0"), ("b", 2, None), ("b", 3, b"\0\0")]
    got = wire.speech_events(spark.createDataFrame(rows, "r string, n int, pcm binary"), "r", "n", "pcm", 2).orderBy("r", "seq").collect()
    kinds = [(r.r, r.event.split("\n")[0]) for r in got]
    assert kinds == [("a", "event: chunk"), ("a", "event: chunk"), ("a", "event: done"), ("b", "event: chunk"), ("b", "event: error")]
    assert json.loads(got[2].event.split("data: ")[1]) == {"chunks": 2, "samples": 3, "duration": 1.5}


# ---------------------------------------------------------------- files and settings


def test_json_manifests(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        rows, shape = files.read_metadata(spark, str(tmp_path / name))
        return [(r.name, r.text) for r in rows.orderBy("row").collect()], shape

    assert read("a.jsonl", '{"file": "a", "text": "x  y"}\n\n{"file": "", "text": "n"}\n{"text": "no name"}\n{"file": "b"}\n[1]\n') == ([("a", "x y"), ("b", "")], "JSONL, 'file' -> 'text'")
    assert read("b.json", '[{"id": 1, "sentence": "x"}, 5, {"id": 2, "sentence": "y"}]') == ([("1", "x"), ("2", "y")], "JSON array, 'id' -> 'sentence'")
    assert read("c.json", '{"a.wav": "one", "b.wav": "two"}')[0] == [("a.wav", "one"), ("b.wav", "two")]
    assert read("d.json", '{"k": {"path": "p", "caption": "c"}}') == ([("p", "c")], "JSON object, 'path' -> 'caption'")
    for name, text, what in (("e.jsonl", '{"file": "a", "text": "b"}\n{bad\n', "line 2"), ("f.json", "[1, 2]", "no JSON objects"), ("g.jsonl", '{"x": 1}\n', "fields")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=what):
            files.read_metadata(spark, str(tmp_path / name))
    assert files.find_metadata(spark, str(tmp_path)) is None
    (tmp_path / "transcripts.csv").write_text("x")
    (tmp_path / "metadata.json").write_text("x")
    assert files.find_metadata(spark, str(tmp_path)).endswith("metadata.json")


def test_recordings_and_what_is_beside_them(spark, tmp_path):
    root = tmp_path / "rec"
    (root / "sub" / ".hidden").mkdir(parents=True)
    for name in ("b.WAV", "sub/a.flac", "sub/.hidden/x.wav", ".y.wav", "notes.txt"):
        (root / name).write_bytes(b"1")
    (root / "b.txt").write_text("  ")
    (root / "b.lab").write_text("from  the lab")
    (root / "sub" / "a.txt").write_text("text")
    (root / "sub" / "a.lab").write_text("lab")
    found = files.find_audio(spark, str(root))
    assert [r.rel for r in found.collect()] == ["b.WAV", "sub/a.flac"] and [r.rel for r in files.find_audio(spark, str(root), recursive=False).collect()] == ["b.WAV"]
    assert [r.rel for r in files.find_audio(spark, str(root / "b.WAV")).collect()] == ["b.WAV"]
    assert {r.rel: r.text for r in files.read_sidecars(spark, str(root), found).collect()} == {"b.WAV": "from the lab", "sub/a.flac": "text"}
    with pytest.raises(FileNotFoundError):
        files.find_audio(spark, str(tmp_path / "none"))
    (root / "metadata.csv").write_text("file_name,text,gender,tags,rating\nb.WAV,hello,female,a; b,7.9\nc.wav,gone,,,9\nsub/a.flac,,,,\n")
    assert [(r.preset, r.text, r.tags, r.rating) for r in lookups.presets(spark, str(root)).collect()] == [("b", "hello", ["a", "b"], 7)]
    for n in ("two", "one"):
        (root / n).mkdir()
        (root / n / "adapter_config.json").write_text('{"base_model_name_or_path": "/gone"}')
    assert [r.name for r in lookups.adapters(spark, str(root)).collect()] == ["one", "two"] and lookups.folder_size(spark, str(root / "one")) == 36
    config = spark.createDataFrame([('{"base_model_name_or_path": "/gone"}', False), ('{"base_model_name_or_path": "hub/id"}', None), ("{}", None)], "c string, e boolean")
    assert [r[0] for r in config.select(lookups.base_model_of(F.col("c"), F.col("e"), "default")).collect()] == ["default", "hub/id", "default"]


def test_labelled_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("PLAIN\tThe\t<self>\nCARDINAL\t3\tthree\nPUNCT\t.\tsil\n<eos>\t<eos>\nPLAIN\tEnd\t<self>\n")
    rows = lookups.labelled_tokens(spark, str(tmp_path / "t.tsv")).orderBy("line").collect()
    assert [(r.line, r.kind, r.written, r.spoken) for r in rows] == [(1, "PLAIN", "the", "the"), (2, "CARDINAL", "3", "three"), (4, "EOS", "", ""), (5, "PLAIN", "end", "end")]
    (tmp_path / "l.tsv").write_text("kg\tkilogram\nself\n")
    assert {r.written: r.spoken for r in lookups.labels(spark, str(tmp_path / "l.tsv")).collect()} == {"kg": "kilogram", "self": "self"}
    (tmp_path / "c.jsonl").write_text('{"text": "x"}\n\nbad\n{"text": ""}\n{"text": 4}\n[1]\n')
    assert [(r.text, r.fate) for r in lookups.training_rows(spark, str(tmp_path / "c.jsonl")).collect()] == [("x", None), (None, "unparseable"), (None, "no_text"), (None, "no_text"), (None, "no_text")]

    def missing():
        raise FileNotFoundError("gone")

    assert lookups.artifact_report({"a": lambda: "x", "b": lambda: None, "c": missing, "d": lambda: 1 / 0})[1:] == [("b", "not configured", ""), ("c", "error", "gone"), ("d", "unavailable", "division by zero")]


def test_settings(tmp_path):
    made = settings.read(settings.Training, {"dataset": "c.jsonl", "lr": "2e-5", "epochs": 2, "tags": ["a"], "ending_weight": {"ramp_tokens": 4}}, "/base")
    assert (made.dataset, made.output_dir, made.lr, made.epochs, made.ending_weight.ramp_tokens) == ("/base/c.jsonl", "/base/runs", 2e-5, 2.0, 4)
    made.validate(exists=lambda p: True)
    for data, what in (({"datset": 1}, "Did you mean 'dataset'"), ({"bf16": "yes"}, "true or false"), ({"lr": "x"}, "a number"), ({"tags": "a"}, "a list"), ({"ending_weight": 3}, "a mapping"), ({"ending_weight": {"ramp": 1}}, "ending_weight.ramp")):
        with pytest.raises(settings.SettingsError, match=what):
            settings.read(settings.Training, data, "/")
    for change in ({"dataset": None}, {"val_split": 1.0}, {"max_length": 8}, {"epochs": 0}, {"batch_size": 0}, {"lr": 1.0}, {"warmup_ratio": 2}, {"weight_decay": -1}, {"save_strategy": "x"}):
        with pytest.raises(settings.SettingsError):
            replace(made, **change).validate(exists=lambda p: True)
    with pytest.raises(settings.SettingsError, match="not found"):
        made.validate(exists=lambda p: False)
    settings.Segmenting().validate()
    with pytest.raises(settings.SettingsError):
        settings.Segmenting(min_seconds=40).validate()
    assert json.load(open(settings.snapshot(made, str(tmp_path / "run"))))["lr"] == 2e-5
    assert settings.run_name(["ft_007_a_x", "other", "ft_002_b_y"], "v", datetime(2024, 1, 2, 3, 4, 5)) == "ft_008_v_2024-01-02_03-04-05"
    assert settings.parse_aliases(["A=x, b = y", "", "a=z"]) == {"a": "z", "b": "y"}
    for bad in ("a", "=x", "a="):
        with pytest.raises(ValueError, match="name=voice"):
            settings.parse_aliases([bad])
    assert settings.first_given("e", "env", "d") == "e" and settings.first_given(None, "env", "d") == "env" and settings.first_given(None, None, "d") == "d"
    with pytest.raises(FileNotFoundError):
        settings.first_given("./none", None, "d", exists=lambda p: False)
    assert settings.resolve_name(None, []) is None and settings.resolve_name("a", ["a"]) == "a"
    for name, what in (("x.wav", "audio file"), ("x", "Available: a")):
        with pytest.raises(LookupError, match=what):
            settings.resolve_name(name, ["a"])


def test_reports(spark):
    totals = dict(source="in", output="o.jsonl", audio_files=9, emitted=4, reused=1, split=2, total_seconds=3661.0, longest_seconds=29.96, longest_tokens=4000, max_tokens=4096, train_rows=5, val_rows=0, val_output="v.jsonl", unmatched_rows=2)
    skips = spark.createDataFrame([(i, f"f{i}.wav", i % 2, "1 s" if i == 3 else "", "short" if i else "silent") for i in range(6)], "seq int, name string, segment int, detail string, reason string")
    text = report.summary(totals, skips)
    assert text.split("\n") == [
        "source       in (9 audio files)", "transcripts  none found", "clips        4 encoded, 1 reused from the existing corpus, from 2 recordings that were split", "duration     1:01:01 total, longest 30.0 s / 4000 tokens",
        "written      o.jsonl (5 rows), v.jsonl (0 rows)", "skipped      6 clips", "                 5  short            f1.wav#1, f2.wav, f3.wav#1 (1 s), +2 more", "                 1  silent           f0.wav",
        "warning      longest row is 4000 tokens, 98% of the 4096-token limit; lower --max-seconds to leave headroom", "warning      2 metadata rows name a file that is not in the source directory",
        "warning      val split rounded to zero rows; the corpus is too small to hold any out",
    ]
    with pytest.raises(ValueError, match="no training examples"):
        corpus.build_split(spark.range(1), "id", 0.5)
    assert corpus.build_split(spark.range(10), "id", 0.01).where("held_out").count() == 1


def test_pairing_tries_each_name_in_lower_case_at_once(spark):
    fs = spark.createDataFrame([("a/x.wav", "/r/a/x.wav"), ("b/X.wav", "/r/b/X.wav")], "file string, path string")
    m = spark.createDataFrame([(0, "A/X.wav"), (1, "X.wav"), (2, "/r/b/X.wav"), (3, "x"), (4, "./b//X.wav")], "row long, name string")
    got = {r.row: (r.status, r.file) for r in corpus.pair(fs, m).collect()}
    assert got == {0: ("matched", "a/x.wav"), 1: ("matched", "b/X.wav"), 2: ("matched", "b/X.wav"), 3: ("ambiguous", None), 4: ("matched", "b/X.wav")}


def test_rewriting_a_corpus_leaves_nothing_behind(spark, tmp_path):
    out = str(tmp_path / "o.jsonl")
    for text in ("x", "y"):
        files.write_corpus(spark.createDataFrame([("1", text)], "id string, text string"), out)
    assert os.listdir(tmp_path) == ["o.jsonl"] or sorted(os.listdir(tmp_path)) == ["o.jsonl"]
    assert [r.text for r in files.read_corpus(spark, out).collect()] == ["y"]
