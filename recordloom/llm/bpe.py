"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

The model is serialised field by field: one piece for each token, its bytes mapped to printable
characters, scored by negative rank, under identity normalisation. Sentencepiece then merges the
pair of the best score first, leftmost on a tie, which is byte-level BPE. As in rank-based
encoders, a pre-token that is itself in the vocabulary is one token without merging. Decoding takes
the model's pieces by id and maps their characters back to bytes.

Defined cases: null or empty texts have no tokens; texts of any length are encoded whole; equal
rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import picked

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Strings kept with their ids in each of a Python worker's two caches, and the longest that is kept. Results don't depend on them.
CACHED, CACHED_CHARS = 600_000, 64


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model of tokens in rank order, so that ids are ranks; the unknown piece comes last."""
    letters = byte_letters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(map(letters.__getitem__, token)).encode()
        out.append(_field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


#: White_Space of Unicode, as the encoders' pattern engines have it (fixed values).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that the pattern never joins: a word with what is attached to it, or white space.
_UNIT = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.rank = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.pattern = regex.compile(pattern)
        self.unit = _UNIT if pattern == public_tokenizers.PATTERN else None
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.letters = dict(enumerate(byte_letters()))
        #: Pieces as the model has them, in two bytes a character, and the byte of each character.
        self.pieces = [self.model.id_to_piece(i).encode("utf-16-le") for i in range(len(self.tokens))]
        self.inverse = np.zeros(0x200, np.uint8)
        self.inverse[[ord(c) for c in byte_letters()]] = np.arange(256)
        self.units: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def _merged(self, pre_tokens: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pre_tokens]
        out = list(map(self.rank.get, raw))
        at = [i for i, x in enumerate(out) if x is None]
        found = self.model.encode([raw[i].decode("latin-1").translate(self.letters) for i in at], out_type=int, num_threads=1)
        for i, ids in zip(at, found, strict=True):
            out[i] = array("I", ids).tobytes()
        return out

    @staticmethod
    def _looked_up(cache: dict[str, bytes], keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        got = list(map(cache.get, keys))
        if None in got:
            new = list({k for k, x in zip(keys, got, strict=True) if x is None})
            found = dict(zip(new, make(new), strict=True))
            got = [found[k] if x is None else x for k, x in zip(keys, got, strict=True)]
            if len(cache) > CACHED:
                cache.clear()
            cache.update((k, x) for k, x in found.items() if len(k) <= CACHED_CHARS)
        return got

    def _split(self, units: list[str]) -> list[bytes]:
        """Ids of units; the pre-tokens of all of them are merged in one call."""
        parts = list(map(self.pattern.findall, units))
        ids = iter(self._looked_up(self.cache, list(chain.from_iterable(parts)), self._merged))
        return [b"".join(islice(ids, len(p))) for p in parts]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.unit:
            return b"".join(self._looked_up(self.units, self.unit.findall(text), self._split))
        return b"".join(self._looked_up(self.cache, self.pattern.findall(text), self._merged))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids' pieces, by the inverse mapping."""
        letters = b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))
        return self.inverse[np.frombuffer(letters, "<u2")].tobytes()


_loaded: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One instance for each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids array<int> and decoded binary, or with digests their SHA-256 instead.

    A narrow map: no shuffle, memory bounded by one Arrow batch cut into single texts."""
    path = path or public_tokenizers.path(VOCABULARY)
    one = picked(docs, id_col, text_col)
    kind = one.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for text in part.column("text"):
                    ids = bpe.encode(text.as_py())
                    back = bpe.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) if digests else (len(ids) // 4, np.frombuffer(ids, "<i4"), back))
                n, a, b = zip(*rows, strict=True)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1])], ["doc_id", "n_tokens", "a", "b"])

    out = one.mapInArrow(run, f"doc_id {kind}, n_tokens long, " + ("a string, b string" if digests else "a array<int>, b binary"))
    return out.toDF("doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")))
