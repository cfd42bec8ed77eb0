"""BPE by chunks against the tokenizers library on whole texts, and token counts against brute force."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from voxloom.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def want(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


LETTERS = st.text(st.sampled_from("ab 's'\n\t\r  \x1c\x85​éñ1٣!<|endoftext|>日本 🙂\x0b"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(st.one_of(LETTERS, st.text(max_size=200)))
def test_any_text(text):
    codec = bpe.Codec.of(PATH)
    text = text.encode("utf-8", "ignore").decode()
    for sizes in ({"mean": 8, "least": 1, "most": 16}, {"mean": 2, "least": 1, "most": 4}, {}):
        parts = bpe.chunks(text.encode(), **sizes)
        assert b"".join(parts) == text.encode()
        assert bpe.encode_by_chunks(codec, text, **sizes) == want(text)
    assert codec.decode(want(text)) == TOK.decode(want(text), skip_special_tokens=False) == text


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéñß") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(900))
    texts = [None, "", " ", "word", "<|endoftext|> in text", "x" * 30000, "no break " * 300, passage, passage, passage + " tail", "head " + passage]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 700))) + rng.choice(["", " " + passage]) for _ in range(40)]
    texts += ["long " * 60000 + passage]
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, "word", "clash")]


def test_table(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    expected = []
    for d, t, _ in rows:
        ids = want(t)
        expected.append((str(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(df).collect()) == sorted(expected)
    # a saturated filter sends every chunk through the join and gives the same ids
    texts = bpe.decode(bpe.encode(df, filter_bits=3))
    assert sorted((str(a), b) for a, b in texts.collect()) == sorted((str(d), t or "") for d, t, _ in rows)


def test_shared_chunks_are_found():
    rows = corpus()
    a, b = (set(map(bpe.digest, bpe.chunks(rows[i][1].encode()))) for i in (9, 10))
    assert len(a & b) >= min(len(a), len(b)) - 3 and a & b


def test_token_counts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    n = sorted(len(want(t)) for _, t, _ in rows)
    table = token_counts.token_counts(df)
    got = {r["length"]: r for r in table.collect()}
    assert sorted(got) == sorted(set(n))
    for length, r in got.items():
        assert r.n_docs == n.count(length)
        assert r.docs_reaching == sum(x >= length for x in n) and r.tokens_reaching == sum(x for x in n if x >= length)
        assert r.truncated_total == sum(min(x, length) for x in n) and r.docs_upto == sum(x <= length for x in n)
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))
    for limit in (0, 1, 17, 512, 10**6):
        assert token_counts.truncated_total(table, limit) == sum(min(x, limit) for x in n)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(table, q) == next(x for k, x in enumerate(n, 1) if k >= q * len(n))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "  a  b  "])
def test_safe_ends(text):
    ends = bpe._safe_ends(text)
    cuts = [i for i in range(1, len(text)) if not text[i - 1].isspace() and text[i] in " \n\t\r"]
    assert ends == ((cuts[0], cuts[-1]) if cuts else None)


def test_round_trip_takes_one_worker_a_task(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    steps = [x._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") for x in (bpe.encode(df), bpe.round_trip(df, with_ids=True))]
    assert steps[0] == steps[1]
