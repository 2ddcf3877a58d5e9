"""Byte-level BPE through a sentencepiece model that is written from the rank file.

No training: the model message is serialised straight from the vocabulary. Each piece is
the byte-mapped token, its score the negative rank, so that the highest-scoring merge is
the one of lowest rank; the normaliser is the identity. Pre-tokens are byte-mapped,
encoded by that model, and decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, id_text, slices
from .pretokens import Splitter


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else 256, 257, ..."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b if b in printable else next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in rank order; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(pieces: list[tuple[str, float, int]], model_type: int, unk_id: int, byte_fallback: bool = False) -> bytes:
    """A serialised sentencepiece model: (piece, score, type) in id order, identity normaliser."""
    body = b"".join(
        _chunk(1, _chunk(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
        for text, score, kind in pieces
    )
    trainer = _number(3, model_type) + _number(4, len(pieces)) + _number(35, byte_fallback) + _number(40, unk_id)
    normalizer = _chunk(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _chunk(2, trainer) + _chunk(3, normalizer)


NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2


class ByteBpe:
    """Encode and decode by a list of tokens in rank order (see :func:`read_ranks`)."""

    def __init__(self, tokens: list[bytes], pattern: str = Splitter.KNOWN, limit: int = 500_000):
        import sentencepiece

        self.tokens = tokens
        self.alphabet = byte_alphabet()
        self.map = {b: c for b, c in enumerate(self.alphabet)}
        listed = [("".join(self.alphabet[b] for b in t), -float(rank), NORMAL) for rank, t in enumerate(tokens)]
        model = model_bytes([*listed, ("<unk>", 0.0, UNKNOWN)], BPE, len(tokens))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {ord(c): b for b, c in enumerate(self.alphabet)}
        self.inverse = [bytes(back[ord(c)] for c in piece) for piece, _, _ in listed]
        self.splitter = Splitter(pattern)
        self.known = BoundedCache(limit)

    def _learn(self, asked: set[str]) -> None:
        new = list(asked.difference(self.known))
        if len(self.known) + len(new) > self.known.limit:
            self.known.clear()
            new = list(asked)
        # a one-byte-per-character string is what translate() needs to map bytes
        mapped = [w.encode().decode("latin-1").translate(self.map) for w in new]
        self.known.update(zip(new, map(tuple, self.model.encode(mapped, num_threads=1))))

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [self.splitter.split(t) for t in texts]
        self._learn(set().union(*words))
        get = self.known.__getitem__
        out = []
        for w in words:
            ids: list[int] = []
            for x in map(get, w):
                ids += x
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.inverse.__getitem__, ids))


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str = Splitter.KNOWN) -> ByteBpe:
    """One per Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = Splitter.KNOWN) -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text; null or empty texts give no ids.

    One map stage without a shuffle. Repeated rows are encoded as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for b in slices(batches):
            ids = bpe.encode(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str = Splitter.KNOWN) -> DataFrame:
    """``doc_id, data`` (binary): the bytes that the ids stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for b in slices(batches):
            data = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str = Splitter.KNOWN) -> DataFrame:
    """Encode each text, decode its ids, and return digests of both.

    ``ids_sha256`` is of the decimal ids joined by one space, ``decoded_sha256`` of the
    decoded bytes. A null or empty text has no ids, so both are digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for b in slices(batches):
            n, said, data = [], [], []
            for ids in bpe.encode(b.column(1).to_pylist()):
                n.append(len(ids))
                said.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                data.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(said), pa.array(data)],
                schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
