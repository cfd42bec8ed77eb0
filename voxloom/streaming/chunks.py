"""Chunks of a spoken session: how they fill, how far speech may run ahead of text, and what one hands to the next.

Rows (session, seq, kind, value) come in order: ``words`` (text ready to speak), ``codes`` (a count of codes that the
model has made), ``level`` (the model has read all it was given) and ``end`` (of the turn).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.structure import aligned_chunks, split_and_merge

#: Longest chunk, codes that a character accounts for in a burst and in a reserve, and the longest carry.
LONGEST, CODES_PER_CHAR, RESERVE_PER_CHAR = 160, 3, 6
MOST_CARRY = LONGEST * RESERVE_PER_CHAR
OUT = "session string, seq long, kind string, text string, codes int, room int"


@dataclass
class Chunk:
    """Words and codes so far, and the last point at which the model had read all of them."""

    words: list[str]
    codes: int = 0
    level: tuple[int, int] = (0, 0)

    @property
    def text(self) -> str:
        return " ".join(self.words)

    @property
    def target(self) -> int:
        """Codes that the text given so far can account for, counted from the last level point."""
        chars, codes = self.level
        return codes + CODES_PER_CHAR * (len(self.text) - chars)


class Chunks:
    """The chunk that grows, the words that wait for the next one, and the carry of the one before."""

    def __init__(self, aligned: bool = False):
        self.aligned, self.chunk, self.pending, self.carry = aligned, Chunk([]), [], None

    def pieces(self, text: str) -> list[str]:
        return aligned_chunks(text) if self.aligned else split_and_merge(text, LONGEST)

    def _fill(self) -> None:
        """Move as many waiting words as the chunk has room for; a boundary that would move back into words that the
        chunk has begun with leaves them waiting; a word longer than a chunk is said nevertheless."""
        if not self.pending:
            return
        first = self.pieces(" ".join(self.chunk.words + self.pending))[0]
        room = len(first.split()) - len(self.chunk.words)
        taken = max(0, min(room, len(self.pending)))
        if not self.chunk.words:
            taken = max(taken, 1)
        self.chunk.words += self.pending[:taken]
        self.pending = self.pending[taken:]

    def _rotate(self) -> tuple:
        """Close the chunk: its text and codes go on together if they are few enough, else neither."""
        done, self.chunk = self.chunk, Chunk([])
        fits = bool(done.codes) and done.codes <= MOST_CARRY
        self.carry = (done.text, done.codes) if fits else None
        return ("chunk", done.text, done.codes, None) if not self.carry else ("carried", done.text, done.codes, None)

    def add(self, kind: str, value: str | None) -> Iterator[tuple]:
        if kind == "words":
            self.pending += (value or "").split()
            self._fill()
            while self.pending:
                yield self._rotate()
                self._fill()
        elif kind == "codes":
            self.chunk.codes += int(value or 0)
        elif kind in ("level", "end"):
            if kind == "level" or self.chunk.words:
                self.chunk.level = (len(self.chunk.text), self.chunk.codes)
            # more speech than the words account for: nothing is added to such a chunk
            if self.chunk.codes > RESERVE_PER_CHAR * len(self.chunk.text) or kind == "end" and self.aligned and self.chunk.words:
                yield self._rotate()
        else:
            raise ValueError(f"unknown kind {kind}")
        if self.chunk.words:
            yield ("room", self.chunk.text, self.chunk.codes, max(0, self.chunk.target - self.chunk.codes))


def batch(rows: DataFrame, aligned: bool = False) -> DataFrame:
    """Rows (session, seq, kind, text, codes, room): chunks that closed (``carried`` ones lead the next), and the codes
    that the open one has room for after each row.  A session is one group in one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        machine, out = Chunks(aligned), []
        for seq, kind, value in pdf.sort_values("seq")[["seq", "kind", "value"]].itertuples(index=False):
            out += [(key[0], seq, *x) for x in machine.add(kind, value)]
        found = pd.DataFrame(out, columns=["session", "seq", "kind", "text", "codes", "room"])
        return found.astype({"room": "Int32"})

    return rows.select("session", "seq", "kind", "value").groupBy("session").applyInPandas(run, OUT)


def fits(prompt: int, carry: int, chars: int, most_tokens: int, cache: int) -> bool:
    """May the carry lead a prompt: with what the chunk will make it must fit the model's cache."""
    return prompt + carry + min(most_tokens, RESERVE_PER_CHAR * chars) <= cache
