"""A folder of recordings becomes a corpus, and again."""

import json

import numpy as np
import pytest

from voxloom.operators.settings import Segmenting
from voxloom.plans import prepare as pr
from voxloom.sources import corpus_files as files

RATE = 16000


def tone(seconds, level=0.3):
    return (level * 32767 * np.sin(np.arange(int(seconds * RATE)) * 0.3)).astype(int).tolist()


def rest(seconds):
    return [0] * int(seconds * RATE)


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_prepare(spark, tmp_path):
    root = tmp_path / "rec"
    (root / "sub").mkdir(parents=True)
    encoder = lambda wav, rate: [i % 7 for i in range(len(wav) // (rate // 80) + 5)]
    put = lambda name, samples: (root / name).write_bytes(files.wav_bytes(samples, RATE))
    put("a.wav", rest(0.3) + tone(1.0) + rest(0.3))
    put("sub/b.wav", tone(1.5) + rest(0.6) + tone(1.5) + rest(0.6) + tone(1.0))
    put("quiet.wav", rest(1.0))
    put("short.wav", tone(0.2))
    put("long.wav", tone(4.0))
    put("told.wav", tone(2.0) + rest(0.6) + tone(2.0))
    put("mute.wav", tone(1.2, 0.05))
    (root / "bad.wav").write_bytes(b"no audio")
    (root / "metadata.csv").write_text("file_name,text\na,Hello there\ntold.wav,two tones\nnone.wav,x\nlong.wav,\n")
    (root / "short.txt").write_text("side text")
    heard = lambda wav, rate: "" if np.abs(wav).max() < 0.2 and len(wav) < 1.3 * rate and np.std(wav) < 0.05 else f"heard {len(wav) // rate}"
    settings = Segmenting(max_seconds=3.0)
    out = tmp_path / "train.jsonl"
    totals, skips = pr.prepare(spark, str(root), str(out), encoder=encoder, transcriber=heard, settings=settings)
    rows = {r["id"]: r for r in lines(out)}
    assert set(rows) >= {"a.wav#0", "sub/b.wav#0", "sub/b.wav#1"} and list(rows) == sorted(rows)
    a = rows["a.wav#0"]
    assert a["audio"] == "a.wav" and abs(a["seconds"] - 1.1) < 0.05 and a["text"].startswith("<|bos|><|text_start|>Hello there<|text_end|>")
    assert a["text"].count("<|s_") == int(np.ceil(round(a["seconds"] * RATE) / 200)) and a["tokens"] == a["text"].count("<|s_") + len("Hello there") + 5
    why = {(r.name, r.reason) for r in skips.collect()}
    assert why >= {("quiet.wav", "silent"), ("short.wav", "too short"), ("long.wav", "too long"), ("told.wav", "too long"), ("bad.wav", "unreadable")}
    assert totals["audio_files"] == 8 and totals["unmatched_rows"] == 1 and totals["split"] == 1 and totals["emitted"] == totals["train_rows"] == len(rows)
    assert "skipped" in pr.summary(totals, skips) and "1 from .txt/.lab sidecars" in pr.summary(totals, skips)

    # again: what is there is not encoded again; part of it is held out
    put("new.wav", tone(1.0))
    again, _ = pr.prepare(spark, str(root), str(out), encoder=encoder, transcriber=heard, settings=settings, val_split=0.4)
    val = tmp_path / "val.jsonl"
    assert again["reused"] == len(rows) and again["emitted"] == 1 and again["val_rows"] == max(1, int((len(rows) + 1) * 0.4))
    both = {r["id"]: r for r in lines(out) + lines(val)}
    assert set(both) == set(rows) | {"new.wav#0"} and all(both[i] == rows[i] for i in rows)
    third, _ = pr.prepare(spark, str(root), str(out), encoder=encoder, transcriber=heard, settings=settings)
    assert third["emitted"] == 0 and third["stale_val"] == "val.jsonl" and third["train_rows"] == len(both)
    dry, skipped = pr.prepare(spark, str(root), str(tmp_path / "none.jsonl"), settings=settings, transcribe=False, dry_run=True)
    assert not (tmp_path / "none.jsonl").exists() and "no transcript" in {r.reason for r in skipped.collect()} and dry["emitted"] >= 1
    with pytest.raises(FileNotFoundError):
        pr.prepare(spark, str(tmp_path / "empty"), str(out))
