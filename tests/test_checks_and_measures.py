"""Checks, measures and array operators on nulls, empty values, ties and hand-made cases."""

from pyspark.sql import functions as F

from voxloom.operators import alignment, checks, measures, signal


def one(spark, column, **values):
    row = spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_requests(spark):
    rows = spark.createDataFrame(
        [(None, 16000, 1.0, None, None), (" \n", 16000, 1.0, None, None), ("x" * 5001, 16000, 1.0, None, None), ("a", 7999, 1.0, None, None), ("a", 48000, 1.1, None, None), ("a", 8000, 1.0, "v", "r"), ("a", 8000, 1.0, "v", None)],
        "t string, rate int, speed double, v string, r string",
    )
    got = [r[0] for r in rows.select(checks.request_problem(*map(F.col, rows.columns))).collect()]
    assert got == ["blank text", "blank text", "text too long", "sample rate", "speed", "voice and reference", None]


def test_suffixes_and_references(spark):
    names = spark.createDataFrame([("a/b.WAV",), (".wav",), ("a.wav/b",), ("x.txt",), (None,)], "n string")
    assert [r[0] for r in names.select(checks.looks_like_audio(F.col("n"))).collect()] == [True, False, False, False, None]
    seconds = spark.createDataFrame([(0.9, True), (1.0, True), (20.5, True), (20.5, False), (20.0, True)], "s double, live boolean")
    assert [r[0] for r in seconds.select(checks.reference_fate(F.col("s"), F.col("live"))).collect()] == ["too short", "whole", "too long", "cut", "whole"]


def test_presets_keep_repeated_rows(spark):
    manifest = spark.createDataFrame([("a.wav", "t"), ("a.wav", "t"), ("b.wav", None), ("c.wav", " "), ("d.wav", "t"), (None, "t")], "file_name string, text string")
    files = spark.createDataFrame([("a.wav", "clash"), ("a.wav", "clash"), ("b.wav", "clash")], "file_name string, text string")
    assert checks.presets(manifest, files).count() == 2
    assert checks.presets(manifest, files.limit(0)).count() == 0


def test_sentences_and_delivery(spark):
    tokens = spark.createDataFrame([(1, 0, "W", "a"), (1, 1, "N", "5"), (1, 2, "E", None), (1, 3, "E", None), (1, 4, "W", "rest")], "k int, i int, kind string, w string")
    got = sorted(measures.sentences(tokens, "k", "i", "kind", "w", "E").collect())
    assert [tuple(r) for r in got] == [(1, 0, "a 5", ["N", "W"]), (1, 1, "", [])]
    chunks = spark.createDataFrame([(1, 0, 2.0, 1.0), (1, 1, 2.5, 1.0), (1, 2, 5.0, 1.0), (2, 0, 1.0, 3.0)], "s int, i int, arrival double, seconds double")
    a, b = sorted(measures.delivery(chunks, "s", ["i"]).collect())
    assert (a["first"], a["closed"], a["audio"], a["buffer_floor"], a["realtime"]) == (2.0, 5.0, 3.0, -1.0, 1.0)
    assert b["buffer_floor"] is None and b["realtime"] is None


def test_arrays(spark):
    grid = F.col("g")
    assert one(spark, signal.mono(grid), g="array(array(1.0D, 3.0D, 5.0D), array(3.0D, 5.0D, 7.0D))") == [2.0, 4.0, 6.0]
    assert one(spark, signal.mono(grid), g="array(array(1.0D, 3.0D), array(3.0D, 5.0D))") == [2.0, 4.0]
    assert one(spark, signal.mono(grid), g="cast(array() as array<array<double>>)") == []
    assert one(spark, signal.trim_leading(F.col("g"), F.lit(0.25), 10), g="array(1, 2, 3, 4)") == [3, 4]
    assert one(spark, signal.trim_leading(F.col("g"), F.lit(9.0), 10), g="array(1, 2)") == []
    assert one(spark, signal.trim_leading(F.col("g"), F.lit(-1.0), 10), g="array(1, 2)") == [1, 2]
    assert one(spark, signal.stretch(F.col("g"), F.lit(4)), g="array(0.0D, 1.0D)") == [0.0, 0.25, 0.75, 1.0]
    assert one(spark, signal.step_percentile(F.col("g"), 0.5), g="array(0.0D, 1.0D, 4.0D)") == 2.0
    assert one(spark, signal.step_percentile(F.col("g"), 0.5), g="array(0.0D)") == 0.0


def test_words(spark):
    words = spark.createDataFrame([("u", 0, 1, 4), ("u", 1, 3, 9), ("u", 2, 5, 2)], "utt string, i int, start int, stop int")
    assert [(r.start, r.stop) for r in alignment.clamp_forward(words, "utt", "i", 2).orderBy("i").collect()] == [(2, 4), (4, 9), (9, 9)]
    ranged = spark.createDataFrame([("u", 0, 0, 1), ("u", 1, 2, 2)], "utt string, word int, first int, last int")
    frames = spark.createDataFrame([("u", 0, None, -1.0), ("u", 1, 0, -2.0), ("u", 2, 1, -4.0)], "utt string, frame int, state int, log_p double")
    assert sorted(map(tuple, alignment.word_frames(ranged, frames).collect())) == [("u", 0, 1, 3, -3.0), ("u", 1, 0, 0, None)]
