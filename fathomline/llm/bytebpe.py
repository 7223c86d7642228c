"""Byte-level BPE through a sentencepiece model serialised from the vocabulary alone."""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .charclass import Splitter, packed_disputes
from .common import map_texts, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Only pre-tokens of up to this many characters are remembered, up to this many in a worker.
REMEMBER_CHARS, REMEMBER = 48, 400_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, value) -> bytes:
    """One protobuf field: kind 0 an integer, 2 bytes, 5 a float."""
    import struct

    head = _varint(number << 3 | kind)
    if kind == 0:
        return head + _varint(value)
    if kind == 5:
        return head + struct.pack("<f", value)
    return head + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the byte-mapped token of rank i with score -i, BPE, identity normaliser.

    The unknown piece that the format demands comes last; every byte is a piece, so it is never produced.
    """
    names = byte_characters()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must count from 0 without gaps")
    missing = [b for b in range(256) if bytes((b,)) not in ranks]
    if missing:
        raise ValueError(f"bytes without a rank: {missing}")
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(names[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, -float(rank)) + _field(3, 0, 1))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, 0.0) + _field(3, 0, 2))
    none = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 0, 2) + _field(4, 0, len(by_rank) + 1) + _field(40, 0, len(by_rank)) + _field(41, 0, none) + _field(42, 0, none) + _field(43, 0, none)
    normaliser = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normaliser))


class ByteBpe:
    """Encode by pre-tokens and decode by the inverse byte mapping."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, disputes: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.split = Splitter(pattern, disputes)
        names = byte_characters()
        self.to_piece = {i: c for i, c in enumerate(names)}
        self.ranks = ranks
        # Decoding: each id's piece mapped back to its bytes.
        value = {c: i for i, c in enumerate(names)}
        self.token = [bytes(value[c] for c in self.pieces.id_to_piece(i)) for i in range(len(ranks))]
        self.known: dict[str, list[int]] = {}

    def pretoken(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.pieces.encode(raw.decode("latin-1").translate(self.to_piece))

    def encode(self, text: str, plain: bool = False) -> list[int]:
        """ids of a text; ``plain`` says that it was found undisputed already."""
        known, words = self.known, self.split(text, plain)
        for word in set(words).difference(known):
            if len(known) >= REMEMBER:
                known.clear()
                return self.encode_apart(words)
            if len(word) <= REMEMBER_CHARS:
                known[word] = self.pretoken(word)
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:  # a long pre-token
            return self.encode_apart(words)

    def encode_apart(self, words: list[str]) -> list[int]:
        known = self.known
        return list(chain.from_iterable(known[w] if w in known else self.pretoken(w) for w in words))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def load(path: str, disputes: bytes, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """One coder a worker and file; ``disputes`` come from the driver (``packed_disputes``)."""
    return ByteBpe(read_ranks(path), pattern, disputes)


def encode_decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids); a null text counts as empty: no ids, hashes of nothing.

    Whole texts are encoded, however long. Equal texts and rows that repeat an id give equal values, a row each; null ids stay; columns other
    than doc_id and text are not read; an empty table gives no rows. Of equal byte sequences in the vocabulary the last rank counts.
    """
    return _coded(df, path or public_tokenizers.path(VOCABULARY), True)


def _coded(df: DataFrame, path: str, with_ids: bool) -> DataFrame:
    disputes = packed_disputes()

    def run(ids, texts):
        coder = load(path, disputes)
        names = _names(len(coder.token))
        plain = coder.split.undisputed([t or "" for t in texts])
        n, shas, back, codes = [], [], [], []
        for text in texts:
            code = coder.encode(text or "", plain)
            n.append(len(code))
            shas.append(hashlib.sha256(",".join(map(names.__getitem__, code)).encode()).hexdigest())
            back.append(hashlib.sha256(coder.decode(code)).hexdigest())
            if with_ids:
                codes.append(code)
        out = {"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        return out | ({"ids": pa.array(codes, pa.list_(pa.int32()))} if with_ids else {})

    return map_texts(df, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


@functools.lru_cache(maxsize=2)
def _names(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    return _coded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), False)
