"""Decontamination against brute force over all documents, items and diagonals."""

import random

import regex

from voxloom.llm import decontamination as dc

SCHEMA = "doc_id long, text string, item_id string, hash string"


def tokens(text):
    text = regex.sub(dc.NAME, "\u0001\\g<0>", (text or "").replace("\u0001", " ")).lower()
    raw = regex.findall(dc.TOKEN, text)
    shape = ["#" if "0" <= w < ":" or w in dc.NUMBER_WORDS else "@" if w < "\u0002" else "%" if w in dc.UNITS else w for w in raw]
    return raw, shape


def brute(docs, items):
    found = {}
    for d, text, *_ in docs:
        raw, shape = tokens(text)
        for i, item in items:
            iraw, ishape = tokens(item)
            if len(iraw) < dc.MIN_ITEM:
                continue
            n = min(dc.WINDOW, len(iraw))
            total = len(iraw) - n + 1
            for diagonal in range(-len(iraw), len(raw)):
                at = [
                    p for p in range(max(0, diagonal), min(len(raw) - n, diagonal + total - 1) + 1)
                    if shape[p : p + n] == ishape[p - diagonal : p - diagonal + n] and sum(w not in "#@%" for w in shape[p : p + n]) >= min(dc.MIN_PLAIN, n)
                ]
                if not at or len(at) < min(dc.MIN_WINDOWS, max(1, total - 1)):
                    continue
                span = range(at[0], min(at[-1] + dc.WINDOW, len(raw), diagonal + len(iraw)))
                slots = {(shape[p], iraw[p - diagonal], raw[p]) for p in span if shape[p] in "#@%" and shape[p] == ishape[p - diagonal]}
                if len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots}):
                    kind = "verbatim" if all(a == b for _, a, b in slots) else "re-parameterised"
                    row = (-len(at), at[0], diagonal, kind, total, len(slots))
                    found[d, i] = min(found.get((d, i), row), row)
    return sorted((str(d), str(i), r[3], -r[0], r[4], r[5], r[1]) for (d, i), r in found.items())


def data():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfglmnr" for b in ("ata", "elu", "iro", "osh")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    question = "If a farmer called Anna sells 12 apples for 3 dollars and later Anna buys 40 pears from her friend Boris, how many km does Boris walk?"
    items = [(0, question), (1, say(30)), (2, say(20)), (3, say(9)), (4, say(5)), (5, say(8)), (6, None), (7, "two words"), (8, ""), (None, say(16)), (9, say(25))]
    changed = question.replace("Anna", "Clara").replace("12", "17").replace("3 d", "5 d").replace("40", "99").replace("dollars", "euros")
    mixed = question.replace("later Anna", "later Dora")
    docs = [
        (1, f"{say(30)} {question} {say(10)}"), (2, f"{say(30)} so. {changed} {say(4)}"), (3, f"{say(3)}. {mixed} {say(9)}"), (4, say(400)),
        (5, f"{say(10)}! {items[1][1].upper()} {say(5)}"), (6, f"{say(10)} {items[4][1]}. {say(5)}"), (7, items[3][1]), (8, items[5][1] + " " + say(3)), (9, None), (10, ""),
        (11, items[9][1]), (None, items[2][1]), (12, " ".join(items[10][1].split()[:13])), (13, " ".join(items[10][1].split()[:12])), (5, items[2][1]), (11, items[9][1]),
        (14, "long " * 30000 + items[1][1]), (15, f"{items[1][1]} {items[1][1]}"), (16, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 dollars"),
    ]
    return [(*d, "clash", "clash") for d in docs], items


def test_against_brute_force(spark):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, item string")
    want = brute(docs, items)
    got = sorted((str(r[0]), str(r[1]), *r[2:]) for r in dc.contaminated(df, bench).collect())
    assert got == want
    kinds = {(d, i): k for d, i, k, *_ in want}
    assert kinds["1", "0"] == "verbatim" and kinds["2", "0"] == "re-parameterised" and ("3", "0") not in kinds
    assert {"5", "6", "7", "8", "11", "None", "12", "14", "15"} <= {d for d, _ in kinds} and not {"4", "9", "10", "13", "16"} & {d for d, _ in kinds}
    clean = dc.decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["10", "13", "16", "3", "4", "9"]


def test_shuffled_when_large(spark, monkeypatch):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr("voxloom.llm.common.BROADCAST_BYTES", 0)
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in dc.contaminated(df, bench).collect()) == brute(docs, items)


def test_empty(spark):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0
    assert dc.decontaminate(df, bench.limit(0)).count() == len(docs)


def found(spark, docs, items, **options):
    df, bench = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in dc.contaminated(df, bench, **options).collect()}


DENSE = "Please add 12 apples to 7 pears, 3 figs, 20 4 5 km"


def test_dense_items(spark):
    items = ["Solve: 12 x + 7 = 31", "Evaluate 12 + 7 - 3 * 5 + 20 / 4", DENSE]
    docs = [f"so here we go {items[0]} and on", f"now {items[1]} for all", "Solve: 13 x + 8 = 30", f"and {DENSE} is it", "12 7 3 5 20 4 and 12 7 31", f"we {DENSE.replace('20', '21').replace('12', '13')} now"]
    assert found(spark, docs, items) == {(0, 0): "verbatim", (1, 1): "verbatim", (3, 2): "verbatim", (5, 2): "re-parameterised"}


def test_names_in_other_cases_and_over_lines(spark):
    question = data()[1][0][1]
    over = question.replace(" Anna", "\n  Anna").replace(" Boris", "\t\u00a0Boris").replace("12", "17")
    assert found(spark, [question.lower(), question.upper(), over], [question]) == {(0, 0): "verbatim", (1, 0): "verbatim", (2, 0): "re-parameterised"}


def test_queries_split_a_span_at_a_changed_slot(spark, tmp_path):
    from voxloom.llm import queries

    docs, items = data()
    question, mixed = items[0][1], docs[2][1]
    merged = question.replace("12", "44").replace(" 3 ", " 44 ")
    spark.createDataFrame([(3, mixed), (4, merged), (5, question.replace("Boris", "Anna"))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: (r.kind, r.windows, r.start) for r in queries.op5_decontamination(spark, str(tmp_path)).collect()}
    assert rows[3][1] == 15 and rows[4][0] == "re-parameterised" and rows[4][1] == 20


def test_every_item_is_searched(spark):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(34))
    items = ["12 + 30 = 42 and 7 x 8 = 56, 9 x 9 = 81", han, "两字", "two words", "only"]
    docs = [*items, f"前{han}后", "here two words more", "Two  WORDS!", "7 x 8 = 56", "三两字"]
    want = {(i, i): "verbatim" for i in range(5)} | {(5, 1): "verbatim", (7, 3): "verbatim"}
    assert found(spark, docs, items) == found(spark, docs, items, whole_span=False) == want


def test_collapsed_items_lose_nothing(spark):
    say = "if a farmer sells {} apples and then buys {} pears how many pieces of fruit are left for all".format
    items = [say(n, m) for n in range(2, 8) for m in range(2, 8)] + ["12 + 30 = 42 and 7 x 8 = 56"]
    docs = [say(99, 98), say(4, 4), "and " + items[-1], "if a farmer sells nothing"]
    df = spark.createDataFrame([(i, t, "mine", "k") for i, t in enumerate(docs)], "doc_id long, text string, k1 string, __kid string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for options in ({}, {"collapse": False}):
        kept = dc.decontaminate(df, bench, whole_span=False, **options)
        assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(3, docs[3], "mine", "k")]
    searched = dc._candidates(df.select(*dc.text_keys(df.text), "text"), dc._sequences(bench, "item_id", "text", 8)[1], True, 6)
    everything = dc._candidates(df.select(*dc.text_keys(df.text), "text"), dc._sequences(bench, "item_id", "text", 8)[1], False, 6)
    assert searched.count() < everything.count() / 5


def test_native(spark, tmp_path, capsys):
    from voxloom.llm import queries

    docs, items = data()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    queries.op5_decontamination(spark, str(tmp_path)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
