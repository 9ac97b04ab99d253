"""Token ids of a byte-level BPE vocabulary, computed by a sentencepiece model written from that vocabulary.

The model file is serialised here: one piece per vocabulary entry, its bytes mapped to printable characters, scored
by negative rank, with identity normalisation. Texts are cut into pre-tokens, the distinct pre-tokens of an Arrow
batch are encoded together, and ids are laid out as list arrays.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE = 200_000  # pre-tokens whose ids a worker keeps


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for free, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + free)
    return [letters[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the vocabulary's ids. Ids have to run from 0 without gaps."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks have gaps")
    letters = byte_letters()
    body = bytearray()
    for rank, token in enumerate(ordered):
        piece = "".join(letters[b] for b in token).encode()
        body += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _flag(3, 1))
    body += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    trainer = _flag(3, 2) + _flag(4, len(ordered) + 1) + _flag(40, len(ordered)) + _flag(41, 2**64 - 1) + _flag(42, 2**64 - 1) + _flag(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return bytes(body) + _field(2, trainer) + _field(3, normalizer)


@functools.cache
def _model(path: str) -> bytes:
    lines = Path(path).read_bytes().split(b"\n")
    return serialise_model({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})


class Encoder:
    """Ids of texts and texts of ids, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=_model(path))
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.back = {c: b for b, c in enumerate(self.letters)}
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def mapped(self, piece: str) -> str:
        """The bytes of the piece as printable characters."""
        return piece.encode().decode("latin-1").translate(self.table)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.cut.findall(t) if t else [] for t in texts]
        fresh = list({p for pieces in cut for p in pieces if p not in self.known})
        if len(self.known) + len(fresh) > _CACHE:
            self.known = {}
            fresh = list({p for pieces in cut for p in pieces})
        for piece, ids in zip(fresh, self.processor.encode([self.mapped(p) for p in fresh], num_threads=1)):
            self.known[piece] = np.asarray(ids, np.int32)
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.known[p] for p in pieces]) if pieces else none for pieces in cut]

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self.processor.id_to_piece(int(i)) for i in ids)
        return bytes(self.back[c] for c in pieces).decode(errors="replace")


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of this process."""
    return Encoder(path)


def encode_corpus(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    A null and an empty text give an empty list; blank text is encoded as it is; texts of any length are encoded
    whole; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
    ``vocabulary`` is the path of the rank file on every executor.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            found = own.encode_batch(batch.column(1).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, ids])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")
