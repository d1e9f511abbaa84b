"""Byte-level BPE encoding and decoding.

The ranks of a public vocabulary are serialised as a sentencepiece BPE model: every piece is
byte-mapped (one character for each byte), scored by its negative rank and normalised by nothing, so
that sentencepiece's best-pair-first merging is the lowest-rank-first merging of the rank file.
Texts are cut by the pre-token pattern and each pre-token is encoded on its own; decoding is
the inverse mapping of ids to bytes.

Null texts count as empty and give no ids. Repeated rows and repeated or null ids give a row each. An
empty table gives an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Character of byte b is chr(FIRST + b): letters that no step of sentencepiece treats specially.
FIRST = 0x100
#: Pre-tokens kept with their ids in each Python worker before the cache starts anew.
CACHE = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in order of their rank, which must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


def byte_map(token: bytes) -> str:
    pairs = bytearray(2 * len(token))  # UTF-16: low byte b, high byte FIRST >> 8
    pairs[::2], pairs[1::2] = token, bytes([FIRST >> 8]) * len(token)
    return pairs.decode("utf-16-le")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: an int as varint, a float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value % (1 << 64))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece i is tokens[i]; the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, byte_map(t).encode()) + _field(2, float(-i)) + _field(3, normal) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            parts = self.find(text)
            cache = self.cache
            new = [p for p in dict.fromkeys(parts) if p not in cache]
            if new:
                if len(cache) > CACHE:
                    cache.clear()
                    new = list(dict.fromkeys(parts))
                self._learn(new)
            yield list(chain.from_iterable(map(cache.__getitem__, parts)))

    def _learn(self, parts: list[str]) -> None:
        """A pre-token that is itself in the vocabulary is one token, as in the rank encoding; the rest is merged."""
        rest = []
        for p in parts:
            i = self.ids.get(p.encode())
            if i is None:
                rest.append(p)
            else:
                self.cache[p] = (i,)
        if rest:
            for p, ids in zip(rest, self.model.encode([byte_map(p.encode()) for p in rest], num_threads=1), strict=True):
                self.cache[p] = tuple(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


#: Codecs of this Python worker by vocabulary and pattern: the model is built once for all of its tasks.
_CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(vocabulary: str, pattern: str, tokens: list[bytes]) -> Codec:
    if (vocabulary, pattern) not in _CODECS:
        _CODECS[vocabulary, pattern] = Codec(tokens, pattern)
    return _CODECS[vocabulary, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row for each input row: the id column, n_tokens, ids (array of int) and decoded
    (binary). The vocabulary file is read on the driver and travels with the task (under 1 MB).
    """
    tokens = read_ranks(vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary, pattern, tokens)
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.array(x, dtype=np.int32) for x in codec.encode_batch(texts)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]))
                decoded = pa.array([codec.decode(x.tolist()) for x in ids], pa.binary())
                n = pa.array(np.diff(offsets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.ListArray.from_arrays(pa.array(offsets), flat), decoded], ["id", "n_tokens", "ids", "decoded"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_tokens bigint, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but with SHA-256 digests in place of ids (as little-endian unsigned 32-bit) and decoded bytes."""
    tokens = read_ranks(vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary, pattern, tokens)
        for batch in batches:
            n, a, b = [], [], []
            for ids in codec.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
