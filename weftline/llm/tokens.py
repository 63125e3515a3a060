"""Problem 7: the whole corpus as token ids of a public byte-level BPE vocabulary.

The rank file is serialised into a sentencepiece BPE model: piece ``i`` is token ``i`` with its bytes
mapped to printable characters and the score ``-i``, so that sentencepiece merges in rank order; the
normaliser is the identity. A text is cut into pre-tokens by the vocabulary's pattern, each pre-token is
encoded by the model, and ids are decoded by the inverse of the byte mapping.

Defined results: null and empty text give an empty list; strings that look like special tokens are
ordinary text; lone surrogates (which UTF-8 can't hold) become a question mark; a repeated row gives a repeated row.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 200_000


def byte_chars() -> list[str]:
    """A printable character for each byte: the byte's own where it is printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order of a ``base64 rank`` file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece ModelProto. Pieces of several bytes are ordinary; after the last token comes the
    piece for unknown characters, which can't occur as every byte is a token."""
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", -1e9) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(24, 0) + _number(35, 0)
    trainer += _number(40, len(tokens)) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder over one serialised model; pre-tokens seen before come from a bounded cache."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unk = self.sp.unk_id()
        self.chars = byte_chars()
        self.table = {b: c for b, c in enumerate(self.chars)}
        self.back = {c: b for b, c in enumerate(self.chars)}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def _learn(self, new: list[str]) -> None:
        mapped = [x.encode("utf-8", "replace").decode("latin-1").translate(self.table) for x in new]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        self.cache.update(zip(new, self.sp.encode(mapped, num_threads=1)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text
        parts = self.split(text)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = set(parts).difference(self.cache)
        if new:
            self._learn(list(new))
        return list(chain.from_iterable(map(self.cache.__getitem__, parts)))

    def decode(self, ids: Iterable[int]) -> str:
        back = self.back
        return bytes(back[c] for i in ids for c in self.sp.id_to_piece(int(i))).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(model) -> Codec:
    key = id(model)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model.value)
    return _CODECS[key]


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids array<int>), one row for each row of ``df``. The model (about 1 MB, as large as the
    vocabulary file whatever the corpus) is serialised once on the driver and broadcast."""
    model = df.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            ids = pa.array([codec.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", vocabulary: str = f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, text) from token ids; a null list gives an empty text."""
    model = df.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            text = pa.array([codec.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)
