"""Media columns: GIF.

``encode`` stores a byte string losslessly as an animated GIF of 8-bit samples under a grey palette: rows of 64 samples,
one frame for up to 65,535 rows, real LZW compression.  ``decode`` is a complete GIF reader: LZW code streams of every
code size with deferred clears, global and local palettes, interlacing, offsets, transparency and the disposal methods;
it returns timed RGB frames.  ``decoded`` turns a table with a media column into one row per value with its timed frames
and their colour histograms, ``frames`` into one row per frame, and ``features`` adds a feature string made of the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, small_batches, tidy

WIDTH = 64
MAX_ROWS = 65535
DELAY_MS = 100
BINS = 16
_GREY = bytes(v for i in range(256) for v in (i, i, i))


# ---------------------------------------------------------------- LZW


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of each of the ``n`` codes after a clear code: the table grows by one entry with every code but the first."""
    entries = (1 << size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)


_SCHEDULE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``_widths`` of at least ``n`` codes, and their running sums."""
    known = _SCHEDULE.get(size)
    if known is None or len(known[0]) < n:
        width = _widths(max(n, 4400), size)
        known = _SCHEDULE[size] = width, np.cumsum(width)
    return known


#: Tables that no call uses, all 0: the code, times 256, of a string and one more sample is at its code * 256 + the sample.
_TABLES: list[list[int]] = []
_ROOT = [b << 8 for b in range(256)]


def lzw_encode(samples: bytes) -> bytes:
    """Code stream of 8-bit ``samples``; the table is cleared when it is full."""
    table, root = _TABLES.pop() if _TABLES else [0] * (4096 << 8), _ROOT
    blocks: list[np.ndarray] = []
    keys: list[int] = []
    put = keys.append
    rest = iter(samples)
    at, free = next(rest, -1) << 8, 258 << 8
    for byte in rest:
        key = at | byte
        if known := table[key]:
            at = known
            continue
        put(key)
        table[key] = free
        free += 256
        at = root[byte]
        if free == 4096 << 8:
            for key in keys:
                table[key] = 0
            put(256 << 8)
            blocks.append(np.array(keys))
            keys.clear()
            free = 258 << 8
    for key in keys:
        table[key] = 0
    _TABLES.append(table)
    if at >= 0:
        put(at)
    put(257 << 8)
    blocks.append(np.array(keys))
    flat = np.concatenate([np.array([256 << 8]), *blocks]) >> 8
    width = np.concatenate([np.array([9])] + [_schedule(len(b), 8)[0][: len(b)] for b in blocks])
    end = np.cumsum(width)
    at_bit = end - width
    byte, value = at_bit >> 3, flat << (at_bit & 7)
    size = int(end[-1] + 7) >> 3
    out = sum(np.bincount(byte + k, weights=(value >> (8 * k)) & 255, minlength=size + 3) for k in range(3))
    return out.astype(np.uint8)[:size].tobytes()


def _expand(codes: np.ndarray, clear: int, room: int) -> bytes:
    """The samples of the ``codes`` after a clear code, up to the one that reaches ``room``.

    The table's entry k is the string of code k and the first sample of code k + 1, which follows it in the samples: a
    code of entry k copies what begins where code k began.
    """
    first = clear + 2
    wrong = np.flatnonzero(codes > np.arange(first - 1, first - 1 + len(codes)))
    if len(wrong):
        raise ValueError(f"code {codes[wrong[0]]} is not in the table")
    none = len(codes)  # what codes of one sample refer to
    entry = np.append(codes - first, none)
    single = np.flatnonzero(entry < 0)
    entry[single] = none
    length, up = np.ones(none + 1, dtype=np.int64), entry
    length[none] = 0
    while len(single) < none and (up != none).any():  # every round doubles the part of a string that is counted
        length += length[up]
        up = up[up]
    end = np.cumsum(length)
    start = end - length
    back = start - start[entry]
    back[single] = 0
    n, used = int(end[-1]), none
    if n > room:
        used = int(np.searchsorted(end, room)) + 1
        n, single = int(end[used - 1]), single[: np.searchsorted(single, used)]
    codes, length, start, back = codes[:used], length[:used], start[:used], back[:used]
    if n > 8 * used or used > 4096:  # long strings, or a table left full: copied one by one, in little memory
        out = bytearray(n)
        for to, size, source, code in zip(start.tolist(), length.tolist(), (start - back).tolist(), codes.tolist()):
            if size == 1:
                out[to] = code
            else:  # a code of the entry before it ends with its own first sample
                out[to : to + size - 1] = out[source : source + size - 1]
                out[to + size - 1] = out[source + size - 1]
        return bytes(out)
    source = np.arange(n)
    source -= np.repeat(back, length)
    while ((further := source[source]) != source).any():
        source = further
    out = np.zeros(n, dtype=np.uint8)
    out[start[single]] = codes[single]
    return out[source].tobytes()


def lzw_decode(stream: bytes, size: int, limit: int) -> bytes:
    """Up to ``limit`` samples of a code stream whose smallest code size is ``size``; a cut stream gives what is there."""
    if size > 8:
        raise ValueError(f"samples of {size} bits")
    clear, stop = 1 << size, (1 << size) + 1
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    bits, step = len(stream) * 8, int(_schedule(1, size)[0][0])
    out: list[bytes] = []
    n, bit, more = 0, 0, True
    while more and n < limit:
        # one block: the codes up to the next clear code
        while bit + step <= bits and int.from_bytes(stream[bit >> 3 : (bit >> 3) + 3], "little") >> (bit & 7) & ((1 << step) - 1) == clear:
            bit += step
        parts: list[np.ndarray] = []
        have = 0
        while True:
            want = min(4200 if not have else 4200 * 4, (bits - bit) // (size + 1) + 1)
            width, ends = (s[have : have + want] for s in _schedule(have + want, size))
            ends = ends + (bit - int(ends[0] - width[0]))
            fit = int(np.searchsorted(ends, bits, side="right"))
            width, ends = width[:fit], ends[:fit]
            first = ends - width
            byte = first >> 3
            found = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (first & 7)) & ((1 << width) - 1)
            halt = np.flatnonzero((found == clear) | (found == stop))
            if len(halt):
                k = int(halt[0])
                parts.append(found[:k])
                bit, more = int(ends[k]), int(found[k]) == clear
                break
            parts.append(found)
            if fit < want:
                more = False
                break
            have += fit
            bit = int(ends[-1])
        codes = np.concatenate(parts) if len(parts) > 1 else parts[0]
        if len(codes):
            out.append(_expand(codes, clear, limit - n))
            n += len(out[-1])
    return b"".join(out)[:limit]


# ---------------------------------------------------------------- container


@dataclass
class Frame:
    """One composed frame: RGB canvas, time from the start and duration in ms, disposal and transparent index, and the
    part of the canvas that its image covers."""

    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int | None
    rgb: np.ndarray
    area: tuple[slice, slice]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode(data: bytes, delay_ms: int = DELAY_MS) -> bytes:
    """The GIF that holds ``pad(data)``: every sample is a palette index, every row 64 samples."""
    data = pad(data)
    rows = len(data) // WIDTH
    height = min(rows, MAX_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _GREY]
    if rows > height:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for top in range(0, rows, height):
        part = data[top * WIDTH : (top + height) * WIDTH]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def _images(gif: bytes) -> Iterator[tuple]:
    """Yields the screen (width, height, palette, background), then each image with its graphic control values.

    Bytes that are no GIF, an image whose code stream ends early and a missing trailer raise ValueError.
    """
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", gif, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = np.frombuffer(gif[at : at + n], dtype=np.uint8).reshape(-1, 3), at + n
    yield width, height, palette, background
    disposal, delay, transparent = 0, 0, None

    def sub(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(gif) and gif[at]:
            parts.append(gif[at + 1 : at + 1 + gif[at]])
            at += 1 + gif[at]
        return b"".join(parts), at + 1

    while at < len(gif) and gif[at] != 0x3B:
        kind = gif[at]
        if kind == 0x21:
            label = gif[at + 1]
            body, at = sub(at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0] * 10
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", gif, at + 1)
            at += 10
            own = None
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                own, at = np.frombuffer(gif[at : at + n], dtype=np.uint8).reshape(-1, 3), at + n
            size = gif[at]
            body, at = sub(at + 1)
            index = np.frombuffer(lzw_decode(body, size, w * h), dtype=np.uint8)
            if len(index) < w * h:
                raise ValueError(f"damaged GIF: {len(index)} of {w * h} samples")
            index = index.reshape(h, w)
            if flags & 0x40:  # interlaced: rows 0, 8, ...; 4, 12, ...; 2, 6, ...; 1, 3, ...
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            yield left, top, index, own, disposal, delay, transparent
            disposal, delay, transparent = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind:#x}")
    if at >= len(gif):
        raise ValueError("damaged GIF: no trailer")


def decode(gif: bytes) -> Iterator[Frame]:
    """Composed frames in order.

    Where no palette is given, a grey one is used.  The canvas begins black; disposal 2 clears the image's area to
    black (transparent), 3 restores what was there before it.
    """
    images = _images(gif)
    width, height, shared, _ = next(images)
    canvas = np.zeros((height, width, 3), dtype=np.uint8)
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    start = 0
    for left, top, index, own, disposal, delay, transparent in images:
        palette = own if own is not None else shared if shared is not None else grey
        if len(palette) < 256:
            palette = np.concatenate([palette, np.zeros((256 - len(palette), 3), dtype=np.uint8)])
        area = (slice(top, min(top + index.shape[0], height)), slice(left, min(left + index.shape[1], width)))
        index = index[: area[0].stop - top, : area[1].stop - left]
        before = canvas[area].copy() if disposal == 3 else None
        colours = palette.take(index, axis=0)
        if transparent is None:
            canvas[area] = colours
        else:
            canvas[area] = np.where((index == transparent)[..., None], canvas[area], colours)
        yield Frame(start, delay, disposal, transparent, canvas.copy(), area)
        start += delay
        if disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas[area] = before


def _is_grey(rgb: np.ndarray) -> bool:
    return bool((rgb[..., 0] == rgb[..., 1]).all() and (rgb[..., 1] == rgb[..., 2]).all())


def samples(frame: Frame) -> bytes:
    """The composed pixels that the frame's image covers: one byte each if all are grey, else three."""
    rgb = frame.rgb[frame.area]
    return rgb[..., 0].tobytes() if _is_grey(rgb) else rgb.tobytes()


def payload(gif: bytes) -> bytes:
    """The padded bytes that ``encode`` stored: the samples of every frame, in order."""
    return b"".join(map(samples, decode(gif)))


def histogram(rgb: np.ndarray, bins: int = BINS) -> list[int]:
    """Pixels by luminance (integer BT.601 weights) in ``bins`` equal bins."""
    return _histograms(rgb, bins)[0]


def colour_histogram(rgb: np.ndarray, bins: int = BINS) -> list[int]:
    """Pixels by red, then green, then blue, in ``bins`` equal bins each."""
    return _histograms(rgb, bins)[1]


def _histograms(rgb: np.ndarray, bins: int = BINS) -> tuple[list[int], list[int]]:
    """Those of luminance and of the colours."""
    of = np.arange(256) * bins >> 8
    count = lambda v: np.bincount(of, np.bincount(v.reshape(-1), minlength=256), bins).astype(np.int64).tolist()
    if _is_grey(rgb):
        grey = count(rgb[..., 0])
        return grey, grey * 3
    light = rgb.astype(np.uint32) @ np.array([77, 150, 29], dtype=np.uint32) >> 8
    return count(light), count(rgb[..., 0]) + count(rgb[..., 1]) + count(rgb[..., 2])


# ---------------------------------------------------------------- tables


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media), one for each row of ``docs``: every text's UTF-8 as a GIF.

    A null text is empty, and an empty one a row of 64 zeros; null and repeated ids and repeated rows are kept; other
    columns, whatever their names, are not read; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(list(map(encode, texts)), pa.binary())], [id_col, "n_bytes", "media"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, media binary")


_FRAME = [
    ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()),
    ("disposal", pa.int32()), ("transparent", pa.int32()), ("histogram", pa.list_(pa.int64())), ("colours", pa.list_(pa.int64())),
]
_FRAME_SCHEMA = "frame int, start_ms bigint, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, histogram array<bigint>, colours array<bigint>"


def _frame_row(k: int, f: Frame) -> dict:
    height, width = f.rgb.shape[:2]
    values = [k, f.start_ms, f.delay_ms, f.area[1].start, f.area[0].start, width, height, f.disposal, f.transparent, *_histograms(f.rgb)]
    return {name: value for (name, _), value in zip(_FRAME, values)}


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, frame, start_ms, delay_ms, left, top, width, height, disposal, transparent, histogram (of
    luminance), colours (histograms of red, green and blue), pixels (RGB of the whole canvas).

    A null media value has no frames; bytes that are no whole GIF stop the job; null and repeated ids are kept; other
    columns are not read; an empty table gives an empty one.
    """
    small_batches(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, *(n for n, _ in _FRAME), "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                gif = b.column(1)[r].as_py()
                for k, f in enumerate(decode(gif) if gif is not None else ()):
                    row = _frame_row(k, f)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1)] + [pa.array([row[n]], t) for n, t in _FRAME] + [pa.array([f.rgb.tobytes()], pa.binary())], names)

    return media.select(id_col, media_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, {_FRAME_SCHEMA}, pixels binary")


def decoded(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """One row per media value, decoded once: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, frames).

    ``frames`` are the composed frames in order, with times and histograms as in ``frames()``, without their pixels.  The
    payload is the samples of all frames.  A null media value has nulls and no frames; bytes that are no whole GIF stop
    the job; null and repeated ids are kept; other columns are not read; an empty table gives an empty one.
    """
    small_batches(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct(_FRAME))]

    def one(gif: bytes | None) -> tuple:
        if gif is None:
            return (None,) * 5 + ([],)
        sha, tail, n, found = hashlib.sha256(), b"", 0, []
        for k, f in enumerate(decode(gif)):
            part = samples(f)
            sha.update(part)
            tail, n = (tail + part[-WIDTH:])[-WIDTH:], n + len(part)
            found.append(_frame_row(k, f))
        return n, sha.hexdigest(), zlib.crc32(tail), len(gif), hashlib.sha256(gif).hexdigest(), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [one(g.as_py()) for g in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)] + [pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names)

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{_FRAME_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
    return media.select(id_col, F.col(bytes_col).cast("long"), media_col).mapInArrow(tidy(run), schema)


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """The rows of ``decoded`` with a feature string of their frames.

    The feature lists the canvas, the number of frames, the playing time and the colour histograms summed over all
    frames; equal media, equal values; a value without frames has an empty histogram.
    """
    total = f"transform(sequence(0, {3 * BINS - 1}), i -> aggregate(frames, 0L, (n, f) -> n + f.colours[i]))"
    feature = F.concat(
        F.lit("canvas="), F.coalesce(F.expr("concat(get(frames, 0).width, 'x', get(frames, 0).height)"), F.lit("0x0")), F.lit(";frames="), F.size("frames").cast("string"),
        F.lit(";ms="), F.expr("cast(aggregate(frames, 0L, (n, f) -> n + f.delay_ms) as string)"), F.lit(";colours="), F.expr(f"if(size(frames) = 0, '', array_join({total}, ','))"),
    )
    return decoded(media, id_col, media_col, bytes_col).withColumn("feature", feature)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a GIF (checkpointed in the shared folder), decode the stored bytes, compute features.

    Nulls, repeated rows, other columns and empty tables are treated as in ``to_media``.  ``frames`` stays in the result.
    """
    media = cut(to_media(docs, id_col, text_col))
    found = features(media, id_col)
    return found.select(*[c for c in found.columns if c != "frames"], "frames")
