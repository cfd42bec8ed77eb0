"""A compressed FM-index over word sequences, with matching statistics by backward search.

The Burrows-Wheeler transform of all sequences is stored in a wavelet matrix of packed bits (one bit per word and level,
plus a 32-bit count per 64 bits).  Backward search extends matches to the left by one word; whole batches of sequences
advance in step.  Matches are capped at ``threshold`` words: intervals of longer matches widen to their threshold class.

What is kept of an index: the wavelet matrix, one bit per place for the classes (with 4 bytes for the place and 8 for the
owner of each class), and, where foreign sequences are searched, the shared lengths of neighbours, one byte each up to a
threshold of 255.  The suffix array and the ranks it is built with are dropped; suffixes are sorted by a little more than
``threshold`` words, which is all that capped matches need.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)]).view("<u8")
        self.before = np.zeros(len(self.words) + 1, dtype=np.uint32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & low)


class _Wavelet:
    """Wavelet matrix: rank of any symbol before any position."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(ones), int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(size)
        self.start = self._descend(every, np.zeros(size, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.start[symbol]


def _sorted_suffixes(text: np.ndarray, length: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Places of all suffixes in the order of their first ``length`` symbols, and, by prefix doubling, the rank of every
    place by its first 1, 2, 4, ... symbols.

    Backward search for a pattern of up to ``length`` symbols needs no longer order: it looks at patterns that are
    one symbol shorter, and those lie together.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, step = {1: rank.astype(np.int32)}, 1
    order = np.argsort(rank, kind="stable")
    while step < length and n > 1 and rank[order[-1]] < n - 1:
        later = np.zeros(n, dtype=np.int64)
        later[:-step] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        step *= 2
        ranks[step] = rank.astype(np.int32)
    return order, ranks


def _agree(ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Do the texts from places ``a`` and ``b`` agree in ``length`` symbols?"""
    same, off, n = np.ones(len(a), dtype=bool), 0, len(ranks[1])
    top = max(ranks)
    while length:
        step = min(top, 1 << (length.bit_length() - 1))
        x, y = a + off, b + off
        inside = (x < n) & (y < n)
        same &= inside
        r = ranks[step]
        same[inside] &= r[x[inside]] == r[y[inside]]
        off, length = off + step, length - step
    return same


def _shared(ranks: dict[int, np.ndarray], order: np.ndarray, most: int) -> np.ndarray:
    """Symbols that neighbours in the order share, up to ``most``; 0 at both ends."""
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), dtype=np.int64)
    for step in sorted(ranks, reverse=True):
        for _ in range(2 if step == max(ranks) else 1):
            more = _agree(ranks, a + shared, b + shared, step)
            shared[more] += step
    return np.concatenate([[0], np.minimum(shared, most), [0]]).astype(np.uint8 if most < 256 else np.int32)


class Shard:
    """Index of word sequences, each with an owner; finds where ``threshold`` words in a row occur, and whose they are.

    ``foreign`` keeps what the search for other sequences than the indexed ones needs.
    """

    def __init__(self, sequences: Iterable[Sequence[bytes]], owners: Sequence[int], threshold: int, foreign: bool = True):
        self.threshold = t = threshold
        self.ids: dict[bytes, int] = {}
        new = self.ids
        # words become numbers as they come, so that the word objects of a shard need not be held together
        self._own = [np.array([new.setdefault(w, len(new)) for w in s], dtype=np.int32) for s in sequences]
        lengths = np.array([len(s) for s in self._own], dtype=np.int64)
        # each sequence ends in a separator of its own, so no match runs across
        separators = len(self._own)
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(int(lengths.sum()) + separators, dtype=np.int32)
        is_word = np.ones(len(text), dtype=bool)
        is_word[ends] = False
        text[is_word] = np.concatenate(self._own) + np.int32(separators) if separators else 0
        text[ends] = np.arange(separators, dtype=np.int32)
        self.first_word, self.n = separators, len(text)
        size = separators + max(1, len(new))
        order, ranks = _sorted_suffixes(text, t + 1)
        same = _agree(ranks, order[:-1], order[1:], t)
        starts = np.concatenate([[True], ~same])
        self.starts, self.start_of = _Bits(starts), np.append(np.flatnonzero(starts), self.n).astype(np.int32)
        owner = np.repeat(np.asarray(owners, dtype=np.int64), lengths + 1)
        self.first_owner = np.minimum.reduceat(owner[order], self.start_of[:-1])
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.wavelet = _Wavelet(text[order - 1], size)
        self.lcp = _shared(ranks, order, t) if foreign else None

    def _parent(self, low: int, high: int) -> tuple[int, int, int]:
        """The smallest larger interval, and its match length."""
        lcp = self.lcp
        if lcp is None:
            raise ValueError("the index was built for its own sequences only")
        length = int(max(lcp[low], lcp[high]))
        if length == 0:
            return 0, self.n, 0
        while lcp[low] >= length:
            low -= 1
        while lcp[high] >= length:
            high += 1
        return low, high, length

    def statistics(self, sequences: Sequence[Sequence[bytes]] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every position of every sequence: the longest match from there (up to the threshold), and, where it
        reaches the threshold, the smallest owner of the matched words (else -1).  Without ``sequences``: of the
        indexed ones."""
        if sequences is None:
            numbered = self._own
        else:
            find = self.ids.get
            numbered = [np.array([find(w, -1 - self.first_word) for w in s], dtype=np.int64) for s in sequences]
        lengths = np.array([len(s) for s in numbered], dtype=np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        symbols = [numbered[i].astype(np.int64) + self.first_word for i in by_length]
        match = [np.zeros(k, dtype=np.int64) for k in lengths]
        owner = [np.full(k, -1, dtype=np.int64) for k in lengths]
        m = len(symbols)
        begin = np.concatenate([[0], np.cumsum(lengths[by_length])])[:-1]
        flat = np.concatenate(symbols) if m else np.zeros(0, dtype=np.int64)
        flat_match, flat_owner = np.zeros(len(flat), dtype=np.int64), np.full(len(flat), -1, dtype=np.int64)
        low, high, size = np.zeros(m, dtype=np.int64), np.full(m, self.n), np.zeros(m, dtype=np.int64)
        sorted_lengths = lengths[by_length]
        for step in range(1, int(lengths.max(initial=0)) + 1):
            k = int(np.searchsorted(-sorted_lengths, -step, side="right"))
            at = begin[:k] + sorted_lengths[:k] - step
            c = flat[at]
            known = c >= 0
            safe = np.where(known, c, 0)
            lo = self.less[safe] + self.wavelet.rank(safe, low[:k])
            hi = self.less[safe] + self.wavelet.rank(safe, high[:k])
            grown = known & (lo < hi)
            new_size = np.where(grown, size[:k] + 1, 0)
            lo, hi = np.where(grown, lo, 0), np.where(grown, hi, self.n)
            for q in np.flatnonzero(known & ~grown):
                lo[q], hi[q], new_size[q] = self._shrink(int(c[q]), int(low[q]), int(high[q]))
            full = new_size >= self.threshold
            cls = self.starts.rank(lo[full] + 1) - 1
            lo[full], hi[full], new_size[full] = self.start_of[cls], self.start_of[cls + 1], self.threshold
            low[:k], high[:k], size[:k] = lo, hi, new_size
            flat_match[at] = new_size
            flat_owner[at[full]] = self.first_owner[cls]
        for rank, i in enumerate(by_length):
            part = slice(begin[rank], begin[rank] + lengths[i])
            match[i], owner[i] = flat_match[part], flat_owner[part]
        return match, owner

    def _shrink(self, symbol: int, low: int, high: int) -> tuple[int, int, int]:
        """Give up words on the right until the match can be extended by ``symbol``."""
        while True:
            low, high, length = self._parent(low, high)
            lo, hi = (int(self.less[symbol] + self.wavelet.rank(np.array([symbol]), np.array([at]))[0]) for at in (low, high))
            if lo < hi:
                return lo, hi, length + 1
            if length == 0:
                return 0, self.n, 0
