"""Text sessions as a stateful stream: start, text, flush, close; text is spoken at a size, on flush, or on close.

What is spoken before a flush is whole words outside of tags; a session that normalises its text speaks whole sentences,
or, of a sentence that runs past the longest chunk, whole words of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.structure import stable_sentence_end, word_end

SPEAK_AT = 50
#: Longest chunk: from so many characters on a sentence without an end is spoken up to a word.
LONGEST = 160
#: How long the state of an idle session, and of a closed one, is kept.
IDLE_MS, CLOSED_MS = 3_600_000, 600_000
KINDS = ("start_context", "send_text", "flush", "close_context")
OUT = "session string, seq long, kind string, payload string"
STATE = "opened boolean, closed boolean, buffer string, next long, waiting string"


def parse(frames: DataFrame) -> DataFrame:
    """``frame`` (JSON) to kind and value: of the known keys the first wins; other fields, or no key, are an error."""
    v = F.try_parse_json("frame")
    has = {k: F.try_variant_get(v, f"$.{k}", "string").isNotNull() for k in KINDS}
    kind, value = F.lit("error"), F.lit(None).cast("string")
    for k in reversed(KINDS):
        kind, value = F.when(has[k], F.lit(k)).otherwise(kind), F.when(has[k], F.try_variant_get(v, f"$.{k}", "string")).otherwise(value)
    fields = F.json_object_keys("frame")
    return frames.withColumn("kind", F.when(F.size(F.array_except(fields, F.array(*map(F.lit, KINDS)))) > 0, "error").otherwise(kind)).withColumn("value", value)


class Session:
    """The machine of one session; rows may come in any order and wait until their turn."""

    def __init__(self, opened: bool = False, closed: bool = False, buffer: str = "", next: int = 0, waiting: dict | None = None, normalize: bool = False):
        self.opened, self.closed, self.buffer, self.next, self.waiting, self.normalize = opened, closed, buffer, next, waiting or {}, normalize

    def _ready(self) -> int:
        """Length of the text that may be spoken before the turn ends."""
        if not self.normalize:
            return word_end(self.buffer, len(self.buffer))
        end = stable_sentence_end(self.buffer)
        return end if end or len(self.buffer) < LONGEST else word_end(self.buffer, LONGEST) or LONGEST

    def add(self, rows: list[tuple[int, str, str | None]]) -> Iterator[tuple[int, str, str]]:
        self.waiting |= {seq: (kind, value) for seq, kind, value in rows if seq >= self.next}
        while self.next in self.waiting:
            kind, value = self.waiting.pop(self.next)
            for out in self._step(kind, value or ""):
                yield self.next, *out
            self.next += 1

    def _step(self, kind: str, value: str) -> Iterator[tuple[str, str]]:
        if kind == "error" or self.closed:
            yield "error", "closed" if self.closed else "bad frame"
        elif kind == "start_context":
            yield ("error", "already started") if self.opened else ("started", value)
            self.opened = True
        elif not self.opened:
            yield "error", "not started"
        elif kind == "send_text":
            self.buffer += value
            if len(self.buffer) >= SPEAK_AT:
                cut = self._ready()
                if cut:
                    yield "speak", self.buffer[:cut]
                    self.buffer = self.buffer[cut:]
        else:
            if self.buffer.strip():
                yield "speak", self.buffer
            self.buffer = ""
            yield ("flushed", "") if kind == "flush" else ("closed", "")
            self.closed = kind == "close_context"


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    return [(int(s), k, v) for s, k, v in zip(pdf["seq"], pdf["kind"], pdf["value"])]


def batch(frames: DataFrame, normalize: bool = False) -> DataFrame:
    """All frames (session, seq, frame) at once: (session, seq, kind, payload).  A session is one group in one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], *x) for x in Session(normalize=normalize).add(_rows(pdf))]
        return pd.DataFrame(out, columns=["session", "seq", "kind", "payload"])

    return parse(frames).select("session", "seq", "kind", "value").groupBy("session").applyInPandas(run, OUT)


def stream(frames: DataFrame, normalize: bool = False, idle_out: bool = False) -> DataFrame:
    """The same over a streaming DataFrame; each session's state holds its buffer and frames that came early.

    A closed session keeps a mark only, by which late frames are refused.  With ``idle_out`` the state of an idle session
    goes after an hour and the mark of a closed one after ten minutes; such time-outs keep a stream running, so they are
    for streams without an end, not for an ``availableNow`` trigger.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["session", "seq", "kind", "payload"])
            return
        s = Session(normalize=normalize)
        if state.exists:
            opened, closed, buffer, at, waiting = state.get
            s = Session(opened, closed, buffer, at, {int(k): tuple(v) for k, v in json.loads(waiting).items()}, normalize)
        out = [(key[0], *x) for x in s.add([r for p in parts for r in _rows(p)])]
        state.update((s.opened, s.closed, s.buffer, s.next, json.dumps(s.waiting)))
        if idle_out:
            state.setTimeoutDuration(CLOSED_MS if s.closed else IDLE_MS)
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "payload"])

    parsed = parse(frames).select("session", "seq", "kind", "value")
    return parsed.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_out else GroupStateTimeout.NoTimeout)
