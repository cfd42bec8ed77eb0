"""Every registered query runs on the smallest tables, and equals its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from voxloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def canon(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows or name == "silence_spans"
    if name not in registry.ORACLE_SQL:
        return
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    names = sorted(df.columns)
    cols = ", ".join(f'"{c}"' for c in names)
    want = con.sql(f"SELECT {cols} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    got = [tuple(canon(r[c]) for c in names) for r in rows]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(canon, r))) for r in want)


def test_letters_of_every_token(spark, tmp_path):
    rows = [(1, 0, "Hi [laugh] you’re"), (1, 1, "[sigh] Ok"), (1, 2, ""), (1, 3, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.turn, r.pos): "".join(r.letters) for r in registry.QUERIES["letters_of_tokens"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): "hi", (0, 1): "@", (0, 2): "you're", (1, 0): "@", (1, 1): "ok"}


def test_every_text_is_normalized(spark, tmp_path):
    rows = [(1, "I have 3 cats", "en"), (2, "I have 3 cats", "de"), (3, "on 3/4/2020 it was 3/4", None), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 0, "I have 3 cats")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.doc_id: r.spoken for r in registry.QUERIES["normalize_text"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] and "three cats" in got[1]
    assert got[3].count("quarter") == 1  # a date is no fraction
    assert [r.spoken for r in registry.QUERIES["normalize_turns"](spark, str(tmp_path)).collect()] == [got[1]]
