"""GIF media columns: exact round trips, and the decoder's palette, interlace, transparency and disposal rules."""

import hashlib
import random
import struct
import sys
import zlib

import numpy as np
import pytest

from voxloom.llm import gif


def slow_lzw(stream, size):
    """A bit-at-a-time reader of code streams."""
    clear, stop = 1 << size, (1 << size) + 1
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    at, out = 0, b""
    table, width, last = [], size + 1, None
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == stop:
            return out
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry


def test_lzw_against_a_slow_reader():
    rng = random.Random(3)
    for n, letters in ((0, 4), (1, 4), (300, 1), (5000, 3), (60000, 200), (20000, 256)):
        data = bytes(rng.randrange(letters) for _ in range(n))
        stream = gif.lzw_encode(data)
        assert slow_lzw(stream, 8) == data
        assert gif.lzw_decode(stream, 8, n) == data
    text = ("the quick brown fox " * 9000).encode()
    assert gif.payload(gif.encode(text)) == gif.pad(text) and len(gif.encode(text)) < len(text) / 10


def pack(codes, size):
    """The code stream of any codes, a clear code first; the reader's table is left full until the next one."""
    clear, out, at, n = 1 << size, 0, 0, 0
    for code in codes:
        out |= code << at
        at += min((clear + 1 + max(n, 1)).bit_length(), 12) if code != clear or n else size + 1
        n = 0 if code == clear else n + 1
    return out.to_bytes((at + 7) // 8, "little")


def plain_lzw(data):
    """A writer with a table of byte strings."""
    codes = [256]
    table, word = {bytes([i]): i for i in range(256)}, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        codes.append(table[word])
        table[longer] = len(table) + 2
        word = data[i : i + 1]
        if len(table) + 2 == 4096:
            codes.append(256)
            table = {bytes([i]): i for i in range(256)}
    return pack(codes + ([table[word]] if word else []) + [257], 8)


def test_streams_are_those_of_a_plain_writer():
    rng = random.Random(8)
    for data in (b"", b"a", b"aa", b"aaa", b"ab" * 3000, bytes(9000), bytes(range(256)) * 40, bytes(rng.choices(range(200), k=30000)), b"one more text, one more text. " * 900):
        stream = gif.lzw_encode(data)
        assert stream == plain_lzw(data) and gif.lzw_decode(stream, 8, len(data)) == data
        assert data.startswith(gif.lzw_decode(stream[: len(stream) // 2], 8, len(data))) and gif.lzw_decode(stream, 8, len(data) // 2) == data[: len(data) // 2]


def test_code_streams_of_any_writer():
    """Random codes of every size, those of the entry just before among them, with tables left full and repeated clears."""
    rng = random.Random(9)
    for size, n in ((2, 60), (3, 5000), (5, 9000), (8, 300), (8, 9000)):
        clear, codes, k = 1 << size, [1 << size, 1 << size], 0
        for _ in range(n):
            top = min(clear + 1 + k, 4095) if k else clear - 1
            code = top if rng.random() < 0.2 else rng.randrange(top + 1)
            code = 0 if code in (clear, clear + 1) else code
            if k and rng.random() < 2 / n:
                code = clear
            codes.append(code)
            k = 0 if code == clear else k + 1
        stream = pack(codes + [clear + 1], size)
        expected = slow_lzw(stream, size)
        assert gif.lzw_decode(stream, size, 1 << 30) == expected
        assert gif.lzw_decode(stream, size, len(expected) // 3) == expected[: len(expected) // 3]
    with pytest.raises(ValueError):
        gif.lzw_decode(pack([256, 65, 259, 257], 8), 8, 100)


def test_a_text_takes_fewer_calls_than_it_has_samples():
    rng = random.Random(10)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(400)]
    data = gif.pad(" ".join(rng.choices(words, k=4000)).encode())
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = [gif._frame_row(k, f) for k, f in enumerate(gif.decode(gif.encode(data)))]
    finally:
        sys.setprofile(None)
    assert sum(found[0]["histogram"]) == len(data) and calls[0] < len(data)


def image(index, left=0, top=0, size=2, palette=b"", interlaced=False, control=None):
    h, w = len(index), len(index[0])
    rows = index
    if interlaced:
        rows = [index[r] for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, s)]
    codes = [1 << size] + [c for r in rows for c in r] + [(1 << size) + 1]
    # a clear code before each sample keeps every code at size + 1 bits
    flat = [x for c in codes[1:-1] for x in (1 << size, c)] + [codes[-1]]
    bits = "".join(f"{c:0{size + 1}b}"[::-1] for c in flat)
    bits += "0" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    out = b""
    if control:
        disposal, delay, transparent = control
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    flags = (0x40 if interlaced else 0) | (0x81 if palette else 0)
    return out + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + palette + bytes([size]) + gif._blocks(body)


def movie(w, h, *images):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette + b"\x21\xfe\x02hi\0" + b"".join(images) + b"\x3b"


def test_rules():
    k, r, g, b = (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = movie(
        2, 2,
        image([[1, 1], [1, 1]], control=(1, 5, None)),
        image([[2, 3]], top=1, control=(3, 7, 3)),  # 3 is transparent, then restored
        image([[3]], left=1, control=(2, 2, None)),  # then cleared
        image([[1, 0], [0, 1]], palette=own, control=(0, 1, 0)),
    )
    got = list(gif.decode(data))
    assert [(f.start_ms, f.delay_ms, f.disposal) for f in got] == [(0, 50, 1), (50, 70, 3), (120, 20, 2), (140, 10, 0)]
    colours = [[tuple(map(int, p)) for row in f.rgb for p in row] for f in got]
    assert colours == [[r, r, r, r], [r, r, g, r], [r, b, r, r], [(8, 8, 8), k, r, (8, 8, 8)]]
    tall = [[i % 4] for i in range(11)]
    plain, laced = (next(gif.decode(movie(1, 11, image(tall, interlaced=i)))).rgb for i in (False, True))
    assert (plain == laced).all() and sum(gif.histogram(plain)) == 11


def test_long_texts_take_several_frames():
    data = bytes(gif.WIDTH * gif.MAX_ROWS) + b"tail"
    stored = gif.encode(data)
    got = list(gif.decode(stored))
    assert len(got) == 2 and got[1].start_ms == gif.DELAY_MS and gif.payload(stored) == gif.pad(data)


def test_tables(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "x" * 64, "y" * 65, "ñandú " * 500, "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(3000)), "a"]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in gif.round_trip(df).collect()}
    for d, t, _ in rows:
        data = (t or "").encode()
        full = data + bytes((-len(data)) % 64 or (64 if not data else 0))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-64:])
        assert r.media_sha256 == hashlib.sha256(gif.encode(data)).hexdigest() and r.media_bytes == len(gif.encode(data))
    assert got[2].feature == got[7].feature and got[None].feature == got[1].feature
    f = gif.frames(gif.to_media(df)).collect()
    assert len(f) == len(rows) and all(sum(r.histogram) == r.width * r.height for r in f)
    for r in f:
        assert np.frombuffer(r.pixels, dtype=np.uint8)[::3].tobytes().rstrip(b"\0") == (dict((d, t) for d, t, _ in rows)[r.doc_id] or "").encode()
    assert gif.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_features_of_any_media(spark):
    own = bytes([9, 9, 9, 200, 100, 50, 7, 7, 7, 6, 6, 6])
    data = movie(3, 2, image([[1, 1], [1, 1]], control=(1, 5, None)), image([[2, 3]], left=1, top=1, control=(3, 7, 3)), image([[3]], left=2, control=(2, 2, None)), image([[1, 0]], palette=own, control=(0, 1, 0)))
    df = spark.createDataFrame([(1, 5, bytearray(data), "x"), (None, None, None, "y")], "doc_id long, n_bytes long, media binary, frames string")
    got = {r.doc_id: r for r in gif.features(df).collect()}
    # the canvases, drawn by hand: black, red, green, blue from the shared palette; the second image's index 3 lets red show
    k, r, g, b = (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)
    canvases = [[r, r, k, r, r, k], [r, r, k, r, g, k], [r, r, b, r, r, k], [(200, 100, 50), r, k, r, r, k]]
    bins = [sum(p[c] // 16 == i for canvas in canvases for p in canvas) for c in range(3) for i in range(16)]
    assert got[1].feature == f"canvas=3x2;frames=4;ms=150;colours={','.join(map(str, bins))}"
    drawn = [[r, r, r, r], [g, k], [b], [(200, 100, 50), r]]
    raw = b"".join(bytes(v for p in part for v in p) for part in drawn)
    assert (got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert [(f.start_ms, f.delay_ms, f.left, f.top) for f in got[1].frames] == [(0, 50, 0, 0), (50, 70, 1, 1), (120, 20, 2, 0), (140, 10, 0, 0)]
    assert got[None].payload_sha256 is None and got[None].frames == [] and got[None].feature == "canvas=0x0;frames=0;ms=0;colours="


def test_feature_of_a_text(spark):
    text = "Ab " * 50
    data = gif.pad(text.encode())
    bins = [sum(v // 16 == i for v in data) for i in range(16)]
    row = gif.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.feature == f"canvas=64x3;frames=1;ms=100;colours={','.join(map(str, bins * 3))}"


def test_damage_is_noticed():
    stored = gif.encode(b"some text " * 50)
    for damaged in (stored[:-1], stored[:-9] + stored[-2:], b"GIF88a" + stored[6:], stored.replace(b"\x2c", b"\x2d", 1) if stored.count(b"\x2c") == 1 else stored[:-1]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            list(gif.decode(damaged))
