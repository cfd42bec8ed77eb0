"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut into chunks where a rolling hash of the last 16 bytes says so, so texts that share a passage share its
chunks.  A first scan finds, from chunk digests alone, which chunks occur more than once; only those travel: each is
encoded once and joined back to the texts that hold it.  All other chunks are encoded where they are read.

A chunk is encoded as a *piece*: the token ids between its first and its last safe cut, and the bytes outside them.  A
safe cut lies between a character that is no white space and a space, tab or line break: no pre-token spans it and the
pre-tokenizer has no look-behind, so the ids on both sides are those of the whole text.  Joins between chunks are
repaired by encoding the bytes between the neighbours' safe cuts again; where a chunk has no safe cut the repair widens
into the next chunk, until both sides agree.  The result equals the tokenizers library on the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import FILTER_BITS, cut, repeated_keys, small_batches, tidy

MEAN_CHUNK, MIN_CHUNK, MAX_CHUNK = 1024, 256, 8192
#: Token ids, or rows, of one batch of results.
EMIT_IDS = 1 << 18
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- tokenizer


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE), one per worker.

    Texts of Latin letters and printable ASCII, where all libraries agree on the character classes, are encoded by
    tiktoken with the same merges, which is several times faster; all others by the tokenizers library.  The fast way
    is taken only if the file's ids are in merge order and its pre-tokenizer is the plain byte-level one.
    """

    _known: dict[str, "Codec"] = {}
    _other = re.compile("[^\t\n\r\\x20-\\x7e\\xa1-\u024f]")

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["id"]: t["content"] for t in file["added_tokens"]}
        vocabulary = {**file["model"]["vocab"], **{content: i for i, content in special.items()}}
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        back = {c: b for b, c in enumerate(_byte_letters())}
        self.bytes = [b""] * size
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if i in special else bytes(back[c] for c in token)
        self.fast = self._fast(file, special)

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded only where a text needs it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _fast(self, file: dict, special: dict[int, str]):
        model, split = file["model"], file["pre_tokenizer"]
        plain = file["normalizer"] is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": split.get("trim_offsets"), "use_regex": True}
        plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"])
        plain &= not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain &= all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merged))
        if not plain:
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        return tiktoken.Encoding("voxloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={c: i for i, c in special.items()})

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as packed integers of ``dtype``."""
        if not text:
            return b""
        if self.fast is not None and self._other.search(text) is None:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(self.dtype).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


# ---------------------------------------------------------------- chunks and pieces


def chunks(data: bytes, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[bytes]:
    """Content-defined chunks of UTF-8 ``data``: their concatenation; none ends within a character."""
    if len(data) <= least:
        return [data] if data else []
    h = np.frombuffer(data, dtype=np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1)
    step = 1
    while step < 16 and len(h) > step:
        h = h[:-step] * np.uint32(0x85EBCA6B) + h[step:]
        h ^= h >> np.uint32(15)
        step *= 2
    window = len(data) - len(h) + 1
    hits = np.flatnonzero(h < np.uint32((1 << 32) // mean)) + window
    out, start = [], 0

    def cut_at(end: int) -> None:
        nonlocal start
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end > start:
            out.append(data[start:end])
            start = end

    for hit in hits.tolist():
        while hit - start > most:
            cut_at(start + most)
        if hit - start >= least:
            cut_at(hit)
    while len(data) - start > most:
        cut_at(start + most)
    cut_at(len(data))
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_SAFE = re.compile("(?<=[^\\s\u180e\u200b\ufeff])(?=[ \n\t\r])")


def _safe_ends(text: str) -> tuple[int, int] | None:
    """First and last safe cut of a chunk."""
    first = _SAFE.search(text)
    if first is None:
        return None
    last = first.start()
    # the last one, from the end
    at = len(text)
    while at > last:
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at), text.rfind("\t", 0, at), text.rfind("\r", 0, at))
        if at <= last:
            break
        if _SAFE.match(text, at):
            return first.start(), at
    return first.start(), last


def piece(codec: Codec, chunk: bytes) -> bytes:
    """Packed (head bytes, tail bytes, ids): a chunk without a safe cut is all head, marked by a tail of -1."""
    text = chunk.decode()
    ends = _safe_ends(text)
    if ends is None:
        return struct.pack("<ii", len(chunk), -1) + chunk
    head, tail = text[: ends[0]].encode(), text[ends[1] :].encode()
    return struct.pack("<ii", len(head), len(tail)) + head + tail + codec.encode(text[ends[0] : ends[1]])


class Assembler:
    """Puts pieces together in order; joins are encoded again up to the neighbours' safe cuts."""

    def __init__(self, codec: Codec):
        self.codec, self.open, self.parts = codec, [], []

    def add(self, packed: bytes) -> None:
        head, tail = struct.unpack_from("<ii", packed)
        self.open.append(packed[8 : 8 + head])
        if tail < 0:
            return
        self.parts.append(self.codec.encode(b"".join(self.open).decode()))
        self.parts.append(packed[8 + head + tail :])
        self.open = [packed[8 + head : 8 + head + tail]]

    def ids(self) -> np.ndarray:
        return np.frombuffer(b"".join([*self.parts, self.codec.encode(b"".join(self.open).decode())]), dtype=self.codec.dtype)


def encode_by_chunks(codec: Codec, text: str, **sizes) -> list[int]:
    """Ids of one text by way of its chunks."""
    a = Assembler(codec)
    for c in chunks(text.encode(), **sizes):
        a.add(piece(codec, c))
    return a.ids().tolist()


# ---------------------------------------------------------------- tables


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Rows (id, ids array<int>), one for each row of ``docs``.

    A null text is empty and has no ids; null and repeated ids and repeated rows are kept as they are; other columns,
    whatever their names, are not read; an empty table gives an empty one.  ``filter_bits`` sets the size of the filter
    of repeated chunks (2**bits bits, broadcast): a larger corpus makes it report more chunks as repeated, which then
    travel, and changes no ids.
    """
    return _encoded(docs, id_col, text_col, vocabulary, filter_bits, lambda batches: batches, "ids array<int>")


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, filter_bits: int, then: Run, columns: str) -> DataFrame:
    """Rows (id, ``columns``) that ``then`` makes of batches (id, ids), in the Python worker that encodes them."""
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(d[:8], dtype="<i8")[0] for t in b.column(1).to_pylist() for d in {digest(c) for c in chunks(t.encode())}]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, dtype=np.int64))], ["k"])

    repeated = repeated_keys(rows.mapInArrow(tidy(keys), "k long"), filter_bits)

    def cut_up(text: str) -> tuple[list[bytes], list[bytes], np.ndarray]:
        parts = chunks(text.encode())
        digests = [digest(c) for c in parts]
        return parts, digests, repeated.value(np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a repeated chunk, encoded where they are read."""
        codec = Codec.of(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                at, found = [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    parts, _, shared = cut_up(text)
                    if not shared.any():
                        a = Assembler(codec)
                        for c in parts:
                            a.add(piece(codec, c))
                        at.append(r)
                        found.append(a.ids())
                yield _ids_batch(part.column(0).take(pa.array(at, pa.int32())), found)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of all other texts: pieces of those that occur once, bytes of the others (once per task)."""
        codec, sent = Codec.of(path), set()
        for b in batches:
            out: dict[str, list] = {"at": [], "row": [], "pos": [], "digest": [], "body": []}
            for r, text in enumerate(b.column(1).to_pylist()):
                parts, digests, shared = cut_up(text)
                if not shared.any():
                    continue
                row = hashlib.blake2b(f"{b.column(0)[r].as_py()}|".encode() + b"".join(digests), digest_size=16).digest()
                for pos, (c, d, s) in enumerate(zip(parts, digests, shared.tolist())):
                    body = None
                    if not s:
                        body = piece(codec, c)
                    elif d not in sent:
                        body = c
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(d)
                    for name, value in zip(out, (r, row, pos, d if s else None, body)):
                        out[name].append(value)
            at = pa.array(out["at"], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(out["row"], pa.binary()), pa.array(out["pos"], pa.int32()), pa.array(out["digest"], pa.binary()), pa.array(out["body"], pa.binary())],
                ["id", "row", "pos", "digest", "body"],
            )

    parts = cut(rows.mapInArrow(tidy(pieces), f"id {kind}, row binary, pos int, digest binary, body binary"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([piece(codec, c.as_py()) for c in b.column(1)], pa.binary())], ["digest", "body"])

    shared = parts.where("digest is not null and body is not null").groupBy("digest").agg(F.first("body").alias("body"))
    encoded = shared.mapInArrow(tidy(once), "digest binary, body binary")
    joined = parts.where("digest is not null").select("id", "row", "pos", "digest").join(encoded, "digest").select("id", "row", "pos", "body")
    ordered = joined.unionByName(parts.where("digest is null").select("id", "row", "pos", "body")).repartition("row").sortWithinPartitions("row", "pos")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of one row follow each other; rows that repeat (same id, same text) bring each piece several times."""
        codec, row, pos, times, a, owner, kind = Codec.of(path), None, -1, 0, None, None, None

        owners: list = []
        found: list[np.ndarray] = []
        held = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Equal rows are put out in batches of bounded size."""
            nonlocal held, times
            ids = a.ids()
            while times:
                n = min(times, 1 + max(0, EMIT_IDS - held) // max(1, len(ids)))
                owners.extend([owner] * n)
                found.extend([ids] * n)
                held, times = held + n * len(ids), times - n
                if held >= EMIT_IDS or len(owners) >= EMIT_IDS or last and not times:
                    yield _ids_batch(pa.array(owners, kind), found)
                    owners.clear()
                    found.clear()
                    held = 0

        for b in batches:
            kind = b.schema.field(0).type
            for r, (of, at, body) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))):
                if of != row:
                    if row is not None:
                        yield from done(False)
                    row, pos, times, a, owner = of, -1, 0, Assembler(codec), b.column(0)[r].as_py()
                times += at == 0
                if at != pos:
                    a.add(body.as_py())
                    pos = at
        if row is not None:
            yield from done(True)

    whole = ordered.mapInArrow(tidy(lambda batches: then(assemble(batches))), f"id {kind}, {columns}")
    return rows.mapInArrow(tidy(lambda batches: then(alone(batches))), f"id {kind}, {columns}").unionByName(whole).withColumnRenamed("id", id_col)


def _ids_batch(owners: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum([len(f) for f in found], out=offsets[1:])
    flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, dtype=np.int32)
    return pa.RecordBatch.from_arrays([owners, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Rows (id, text) of rows (id, ids array<int>); null ids give a null text."""
    small_batches(tokens.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, text string")


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(path: str, with_ids: bool) -> tuple[Run, str]:
    """What makes batches (id, digests) of batches (id, ids), and its columns beside the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        names = list(map(str, range(len(codec.bytes))))
        for b in batches:
            n, of_ids, of_text = [], [], []
            for ids in b.column(1):
                ids = ids.values.to_numpy().tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            made = [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())] + [b.column(1)] * with_ids
            yield pa.RecordBatch.from_arrays(made, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(made)])

    return run, _DIGESTS + (", ids array<int>" if with_ids else "")


def digests(tokens: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256[, ids]) of rows (id, ids): the ids are decoded and the text hashed."""
    run, columns = _digested(vocabulary or default_vocabulary(), with_ids)
    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, "ids").mapInArrow(tidy(run), f"`{id_col}` {kind}, {columns}")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and return counts and digests, and the ids where they are wanted.

    The worker that encodes a text decodes and hashes it as well: two steps of one task would hold two workers at once.
    """
    path = vocabulary or default_vocabulary()
    return _encoded(docs, id_col, text_col, path, FILTER_BITS, *_digested(path, with_ids))
