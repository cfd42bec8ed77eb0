"""Frames, runs, silence, cuts and weights over arrays and ordered rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let


def runs(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Run-length encoding: (key, run, label, start, stop, n) of equal neighbours; stop is inclusive."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    marked = rows.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("__new").over(w))
    return marked.groupBy(key, "run").agg(F.first(label).alias(label), F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("n"))


def frame_rms(wav: Column, frame: int, hop: int) -> Column:
    """Root mean square of every whole frame; a shorter array is one frame."""
    n = F.size(wav)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - frame), F.lit(hop))
    part = lambda i: F.slice(wav, i + 1, F.least(F.lit(frame), n))
    return F.transform(starts, lambda i: F.sqrt(F.aggregate(part(i), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.least(F.lit(frame), n)))


def frame_db(wav: Column, frame: int, hop: int) -> Column:
    """Decibels against the loudest frame; -inf throughout for silence."""
    level = lambda rms, top: F.transform(rms, lambda r: F.when(top <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(F.greatest(r, F.lit(1e-10)) / top)))
    return let(frame_rms(wav, frame, hop), lambda rms: let(F.array_max(rms), lambda top: level(rms, top)))


def silent_spans(db: Column, top_db: float, least: int) -> Column:
    """Array of (start, stop) frames, stop exclusive: runs below -top_db of ``least`` frames or more that touch no end."""
    none = F.lit(-1)
    step = lambda s, x: F.when(
        x["db"] > -top_db,
        F.struct(
            F.when((s["from"] > 0) & (x["i"] - s["from"] >= least), F.concat(s["spans"], F.array(F.struct(s["from"].alias("start"), x["i"].alias("stop"))))).otherwise(s["spans"]).alias("spans"),
            none.alias("from"),
        ),
    ).otherwise(F.struct(s["spans"].alias("spans"), F.when(s["from"] < 0, x["i"]).otherwise(s["from"]).alias("from")))
    start = F.struct(F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"), none.alias("from"))
    indexed = F.transform(db, lambda x, i: F.struct(x.alias("db"), i.alias("i")))
    return F.aggregate(indexed, start, step, lambda s: s["spans"])


def greedy_cuts(cuts: Column, end: Column, limit: int) -> Column:
    """Chosen cuts: always the last one within ``limit`` of the piece's start, else the next later one; none needed at the end.

    One pass over the ordered cuts: a cut is taken when the following stop (cut or end) would be too far.
    """
    stops = F.concat(cuts, F.array(end))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("last"))
    step = lambda s, x: F.when(
        (x - s["at"] > limit) & (s["last"] > s["at"]),
        F.struct(F.concat(s["out"], F.array(s["last"])).alias("out"), s["last"].alias("at"), x.alias("last")),
    ).otherwise(F.struct(s["out"].alias("out"), s["at"].alias("at"), x.alias("last")))
    return F.aggregate(F.transform(stops, lambda x: x.cast("long")), start, step, lambda s: s["out"])


def trim_silence(wav: Column, db: Column, top_db: float, hop: int, frame: int, pad: int) -> Column:
    """From the first to the last frame that is loud, ``pad`` samples around; silence leaves nothing.

    A clip that is loud in its last frame keeps its tail: the samples behind the last whole frame are speech as well.
    """

    def cut(loud: Column) -> Column:
        first = F.array_position(loud, True)
        last = F.size(loud) - F.array_position(F.reverse(loud), True) + 1
        lo = F.greatest(F.lit(0), (first - 1) * hop - pad).cast("int")
        hi = F.when(last == F.size(loud), F.size(wav)).otherwise(F.least(F.size(wav), (last - 1) * hop + frame + pad)).cast("int")
        return F.when(first == 0, F.slice(wav, 1, 0)).otherwise(F.slice(wav, lo + 1, hi - lo))

    return let(F.transform(db, lambda x: x > -top_db), cut)


def is_silent(wav: Column, floor: float = 1e-4) -> Column:
    return (F.size(wav) == 0) | (F.array_max(F.transform(wav, F.abs)) < floor)


def pcm16(wav: Column) -> Column:
    """Clipped 16-bit samples: negative ones by 32768, positive ones by 32767, halves to the even number."""
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))
    return F.transform(wav, lambda x: F.bround(F.when(clip(x) < 0, clip(x) * 32768).otherwise(clip(x) * 32767), 0).cast("int"))


def mask_labels(tokens: Column, start_token: Column) -> Column:
    """Positions up to the first ``start_token`` become -100; all of them if it is missing."""
    return let(F.array_position(tokens, start_token), lambda at: F.transform(tokens, lambda x, i: F.when((at == 0) | (i < at), F.lit(-100)).otherwise(x)))


def ramp_weights(labels: Column, end_token: int, ramp: int, most: float) -> Column:
    """Zeros; the last ``ramp`` positions before the end token rise evenly from 1 to ``most``, masked ones at the start
    of the ramp left out.  A single position has 1; without a supervised end token all are zero."""

    def weights(end: Column, free: Column) -> Column:
        n = end - free
        weight = lambda i: F.when(n == 1, F.lit(1.0)).otherwise(F.lit(1.0) + (i - free) * (most - 1.0) / (n - 1))
        return F.transform(labels, lambda x, i: F.when(free.isNotNull() & (i >= free) & (i < end), weight(i)).otherwise(0.0))

    def from_end(end: Column) -> Column:
        """``end`` is the first end token's place, -1 if there is none."""
        inside = lambda x, i: F.when((i >= F.greatest(F.lit(0), end - ramp)) & (i < end) & (x != -100), i)
        return let(F.array_min(F.transform(labels, inside)), lambda free: weights(end, free))

    return let(F.array_position(labels, F.lit(end_token)) - 1, from_end)


def lm_loss(tokens: DataFrame, key: str, order: str, end_token: int, end_weight: float = 1.0, items: int | None = None) -> DataFrame:
    """Weighted loss per ``key`` from rows (key, order, label, weight, nll): nll is the loss of predicting the NEXT label.

    Labels and weights are shifted by one here; -100 is not counted; weight 0 means 1; an end token weighs
    ``end_weight`` if that is above 1, whatever its weight.  Divided by ``items``, or by the sum of weights, 1 at least.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = tokens.withColumn("__label", F.lead("label").over(w)).withColumn("__w", F.lead("weight").over(w)).where("__label is not null and __label <> -100")
    weight = F.when(F.col("__w") > 0, F.col("__w").cast("double")).otherwise(1.0)
    weight = F.when((F.lit(end_weight) > 1) & (F.col("__label") == end_token), F.lit(float(end_weight))).otherwise(weight)
    total = F.sum(weight * F.col("nll"))
    return rows.groupBy(key).agg((total / (F.lit(float(items)) if items is not None else F.greatest(F.sum(weight), F.lit(1.0)))).alias("loss"))


def collate(rows: DataFrame, batch: str, values: str, fill: int, multiple: int = 8) -> DataFrame:
    """``rows`` with ``values`` padded on the right to the batch's longest, rounded up to a ``multiple``."""
    width = rows.groupBy(batch).agg((F.ceil(F.max(F.size(values)) / multiple) * multiple).cast("int").alias("__width"))
    return rows.join(width, batch).withColumn(values, pad_right(F.col(values), F.col("__width"), fill)).drop("__width")


def pad_right(values: Column, width: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), width - F.size(values)).cast("int")))


def plan_windows(n: Column, emit: int = 31, look: int = 9, back: int = 15) -> Column:
    """Hopping windows over ``n`` codes: (start, stop, emit_from, emit_to) with context on both sides."""
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(emit))).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.struct(
            F.greatest(F.lit(0), i - back).alias("start"), F.least(n, i + emit + look).alias("stop"), i.alias("emit_from"), F.least(n, i + emit).alias("emit_to")
        ),
    )


def mono(grid: Column) -> Column:
    """Mean over the shorter axis of a 2-D array: (samples, channels) and (channels, samples) both give samples."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(v)
    wide = F.transform(F.sequence(F.lit(0), F.size(grid[0]) - 1), lambda i: mean(F.transform(grid, lambda row: F.get(row, i))))
    empty = F.expr("cast(array() as array<double>)")
    return F.when((F.size(grid) == 0) | (F.size(F.get(grid, F.lit(0))) == 0), empty).when(F.size(grid) >= F.size(F.get(grid, F.lit(0))), F.transform(grid, mean)).otherwise(wide)


def trim_leading(wav: Column, seconds: Column, rate: int) -> Column:
    """Without the first ``seconds``; the count of samples is rounded, halves to the even number."""
    drop = F.least(F.greatest(F.bround(seconds * rate, 0), F.lit(0)), F.size(wav)).cast("int")
    return F.slice(wav, drop + 1, F.size(wav) - drop)


def stretch(values: Column, n: Column) -> Column:
    """Linear interpolation to ``n`` values; samples stand in the middle of their cells, the ends are held."""
    size = F.size(values)
    at = lambda i: F.greatest(F.lit(0.0), (i + 0.5) * size / n - 0.5)
    low = lambda i: F.floor(at(i)).cast("int")
    value = lambda k: F.get(values, F.least(k, size - 1)).cast("double")
    return F.when((size > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: value(low(i)) + (at(i) - low(i)) * (value(low(i) + 1) - value(low(i)))))


def step_percentile(wav: Column, share: float) -> Column:
    """Interpolated percentile of the absolute steps between neighbours; 0 below two samples."""
    steps = F.array_sort(F.zip_with(F.slice(wav, 2, F.greatest(F.size(wav) - 1, F.lit(0))), F.slice(wav, 1, F.greatest(F.size(wav) - 1, F.lit(0))), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    at = (F.size(steps) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    value = F.get(steps, low)
    return F.when(F.size(wav) < 2, 0.0).otherwise(value + (at - low) * (F.coalesce(F.get(steps, low + 1), value) - value))


#: Codes of a decoder's window: emitted ones, looked ahead and behind, and the convolution's own context on each side.
EMIT, LOOK, CONTEXT, HOP = 31, 9, 3, 600


def plan_window(position: Column, available: Column, finished: Column, emit: int = EMIT, look: int = LOOK, context: int = CONTEXT, hop: int = HOP) -> Column:
    """The next window to decode, null if more codes are needed: (start, stop, emit_start, emit_stop, state_at, is_last).

    ``start`` and ``stop`` count codes padded by ``context`` at both ends, the emits samples.  A window before the last
    waits until all its context is there; the last one, which only a finished stream has, runs to the end.
    """
    if look < 1:
        raise ValueError("look must be 1 or more")
    width = emit + 2 * look + 2 * context
    last = position + emit + look >= available
    first = F.when(position == 0, 0).otherwise(look * hop)
    none = F.lit(None).cast("int")
    plan = lambda stop, emit_stop, state, end: F.struct(
        position.cast("int").alias("start"), stop.cast("int").alias("stop"), first.cast("int").alias("emit_start"), emit_stop.alias("emit_stop"), state.alias("state_at"), F.lit(end).alias("is_last")
    )
    ready = finished | (position + width - context <= available)
    middle = plan(F.least(position + width, available + 2 * context), F.lit((look + emit) * hop).cast("int"), F.lit(emit).cast("int"), False)
    return F.when(position >= available, F.lit(None)).when(~last & ready, middle).when(last & finished, plan(available + 2 * context, none, none, True))


# ---------------------------------------------------------------- loudness and resampling

#: Loudness that clips are brought to, the highest peak, the peak below which a clip is silent, seconds of a block.
TARGET_LUFS, CEILING, SILENCE, BLOCK_SECONDS = -23.0, 0.99, 1e-3, 0.4


def _weighting(rate: int, freqs: np.ndarray) -> np.ndarray:
    """Response of the K weighting of ITU-R BS.1770: a high shelf (+4 dB from 1,500 Hz) and a high pass (38 Hz)."""
    z = np.exp(-1j * freqs)
    out = np.ones(len(freqs), dtype=complex)
    for kind, gain, q, f in (("shelf", 4.0, 1 / np.sqrt(2), 1500.0), ("pass", 0.0, 0.5, 38.0)):
        w, a = 2 * np.pi * f / rate, 10 ** (gain / 40)
        alpha, c, r = np.sin(w) / (2 * q), np.cos(w), np.sqrt(a)
        if kind == "shelf":
            num = a * np.array([a + 1 + (a - 1) * c + 2 * r * alpha, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - 2 * r * alpha])
            den = np.array([a + 1 - (a - 1) * c + 2 * r * alpha, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - 2 * r * alpha])
        else:
            num, den = np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]), np.array([1 + alpha, -2 * c, 1 - alpha])
        out *= (num[0] + num[1] * z + num[2] * z**2) / (den[0] + den[1] * z + den[2] * z**2)
    return out


def loudness(wav: np.ndarray, rate: int) -> float:
    """Integrated loudness (LUFS) over blocks of 400 ms that overlap by three quarters, gated at -70 and 10 below."""
    n = len(wav) + rate  # the filters have died down within a second
    weighted = np.fft.irfft(np.fft.rfft(np.asarray(wav, dtype=float), n) * _weighting(rate, np.linspace(0, np.pi, n // 2 + 1) if n % 2 == 0 else 2 * np.pi * np.arange(n // 2 + 1) / n), n)[: len(wav)]
    sums = np.concatenate([[0.0], np.cumsum(weighted**2)])
    blocks = int(np.round((len(wav) / rate - BLOCK_SECONDS) / (BLOCK_SECONDS / 4))) + 1
    low = (np.arange(blocks) * (BLOCK_SECONDS / 4) * rate).astype(int)
    high = np.minimum(low + int(BLOCK_SECONDS * rate), len(wav))
    power = (sums[high] - sums[low]) / (BLOCK_SECONDS * rate)
    level = lambda p: -0.691 + 10 * np.log10(np.maximum(p, 1e-300))
    loud = power[level(power) >= -70]
    if not len(loud):
        return float("-inf")
    loud = loud[level(loud) > level(loud.mean()) - 10]
    return float(level(loud.mean())) if len(loud) else float("-inf")


def level_out(wav: np.ndarray, rate: int, target: float = TARGET_LUFS) -> np.ndarray:
    """``wav`` at the target loudness, its peak held below the ceiling; what is silent, short or cannot be measured stays."""
    wav = np.asarray(wav, dtype=np.float32)
    if not len(wav) or np.abs(wav).max() < SILENCE or len(wav) < int(BLOCK_SECONDS * rate):
        return wav
    found = loudness(wav, rate)
    if not np.isfinite(found):
        return wav
    out = (wav * 10 ** ((target - found) / 20)).astype(np.float32)
    peak = float(np.abs(out).max())
    return out / peak * np.float32(CEILING) if peak > CEILING else out


def normalize_loudness(rate: int, target: float = TARGET_LUFS):
    """A function of an array column: Arrow-batched ``level_out``."""

    @F.pandas_udf("array<float>")
    def run(wavs: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else level_out(w, rate, target) for w in wavs], dtype=object)

    return run


class Resampler:
    """Windowed-sinc resampling of a stream: what ``push`` and ``flush`` give together is ``resample`` of the whole."""

    def __init__(self, old: int, new: int, zeros: int = 16):
        self.old, self.new, self.zeros = old, new, zeros
        self.scale = min(1.0, new / old)
        self.half = int(np.ceil(zeros / self.scale))
        self.held, self.from_, self.made, self.done = np.zeros(0), 0, 0, False

    def _make(self, stop: int) -> np.ndarray:
        at = np.arange(self.made, stop) * self.old / self.new
        near = np.floor(at).astype(int)[:, None] + np.arange(-self.half, self.half + 1)[None, :]
        x = (near - at[:, None]) * self.scale
        kernel = np.sinc(x) * np.cos(np.clip(x / self.zeros, -1, 1) * np.pi / 2) ** 2 * self.scale
        own = near - self.from_
        inside = (near >= 0) & (own >= 0) & (own < len(self.held))
        out = (np.where(inside, self.held[np.clip(own, 0, max(0, len(self.held) - 1))], 0) * kernel).sum(axis=1) if len(at) and len(self.held) else np.zeros(len(at))
        self.made = max(self.made, stop)
        first = max(self.from_, int(self.made * self.old // self.new) - self.half)
        self.held, self.from_ = self.held[first - self.from_ :], first
        return out.astype(np.float32)

    def push(self, wav: np.ndarray) -> np.ndarray:
        if self.done:
            raise ValueError("the stream is flushed")
        wav = np.asarray(wav, dtype=np.float64)
        if self.old == self.new:
            return wav.astype(np.float32)
        self.held = np.concatenate([self.held, wav])
        known = self.from_ + len(self.held)
        return self._make(max(self.made, int(np.floor((known - self.half - 1) * self.new / self.old))))

    def flush(self) -> np.ndarray:
        """The rest; nothing when asked again."""
        if self.done or self.old == self.new:
            self.done = True
            return np.zeros(0, dtype=np.float32)
        self.done = True
        return self._make(-(-self.new * (self.from_ + len(self.held)) // self.old))


def resampled(old: int, new: int):
    """A function of an array column: Arrow-batched resampling."""

    @F.pandas_udf("array<float>")
    def run(wavs: pd.Series) -> pd.Series:
        def whole(w):
            r = Resampler(old, new)
            return np.concatenate([r.push(np.asarray(w)), r.flush()])

        return pd.Series([None if w is None else whole(w) for w in wavs], dtype=object)

    return run


class CodeStream:
    """A streaming decoder's book-keeping: which windows are complete, and how many leading samples are dropped.

    ``decode(codes, window)`` is the codec: samples of a padded slice of codes.
    """

    def __init__(self, decode, emit: int = EMIT, look: int = LOOK, context: int = CONTEXT, hop: int = HOP, pad: int = 0):
        self.decode, self.emit, self.look, self.context, self.hop, self.pad = decode, emit, look, context, hop, pad
        self.codes, self.position, self.finished, self.drop = [pad] * context, 0, False, 0

    @property
    def count(self) -> int:
        return len(self.codes) - self.context

    def prime(self, codes: list[int]) -> None:
        """Codes that are context only: the samples that they make are dropped."""
        if self.count:
            raise RuntimeError("context must come before the first code")
        self.drop = len(codes) * self.hop
        self.codes += codes

    def push(self, codes: list[int]) -> list:
        if self.finished:
            raise RuntimeError("the stream is finished")
        self.codes += codes
        return self._drain(self.count, False)

    def finish(self) -> list:
        if self.finished:
            return []
        available, self.finished = self.count, True
        self.codes += [self.pad] * self.context
        return self._drain(available, True)

    def _drain(self, available: int, finished: bool) -> list:
        out, width = [], self.emit + 2 * self.look + 2 * self.context
        while self.position < available:
            last = self.position + self.emit + self.look >= available
            if last and not finished or not last and not finished and self.position + width - self.context > available:
                break
            stop = available + 2 * self.context if last else min(self.position + width, available + 2 * self.context)
            made = self.decode(self.codes[self.position : stop], (self.position, stop, last))
            made = made[0 if self.position == 0 else self.look * self.hop : None if last else (self.look + self.emit) * self.hop]
            gone = min(self.drop, len(made))
            self.drop -= gone
            out += list(made[gone:])
            self.position = available if last else self.position + self.emit
        return out
