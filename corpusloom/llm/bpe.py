"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

The model is not trained: every entry of the rank file becomes a piece whose bytes are mapped to
printable characters one to one, with minus its rank as score, so that sentencepiece's merge order
is that of the ranks; the normaliser is the identity. A piece's id is its rank. Texts are cut by the
pre-token pattern and every pre-token is encoded for itself; ids are decoded by the inverse mapping.

Defined results: a null text is the empty text, with no ids; texts are encoded whole; a bounded
cache of pre-tokens keeps the memory of a worker constant.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens that a worker remembers, and the longest of them: about 100 MB at most.
CACHE, CACHED_CHARS = 1 << 18, 32


def byte_characters() -> list[str]:
    """The character for each byte: itself if printable, else the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64, space, rank), in rank order."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without a gap")
    return [t for _, t in pairs]


# Protobuf's wire format: a field is its number and kind, then a varint, four bytes, or length and bytes.
def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes((n,))


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with ``tokens`` as pieces 0.. and one unknown piece behind them."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _bytes(1, _bytes(1, "".join(chars[b] for b in token).encode()) + _float(2, -float(rank)) + _int(3, 1))
    out += _bytes(1, _bytes(1, b"<unk>") + _float(2, 0.0) + _int(3, 2))
    trainer = _int(3, 2) + _int(4, len(tokens) + 1) + _int(24, 0) + _int(40, len(tokens)) + _int(41, (1 << 64) - 1) + _int(42, (1 << 64) - 1) + _int(43, (1 << 64) - 1)
    normaliser = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return bytes(out) + _bytes(2, trainer) + _bytes(3, normaliser)


class _Words(dict):
    """Pre-token -> its ids as decimal text. Two generations bound the size: a full one is set aside
    and words still in use come back from there."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> str:
        value = self.older.get(word)
        if value is None:
            value = " ".join(map(str, self.encode(word)))
        if len(word) > CACHED_CHARS:
            return value
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


#: Below this code point the pattern's classes are spelt out for Python's own, faster, regex engine.
_PLAIN = 0x250


def _spelt_out(pattern: str):
    """``pattern`` for ``re``: its classes as ranges below _PLAIN. Exact for texts without higher code points."""

    def ranges(cls: str) -> str:
        match, runs = regex.compile(cls).match, []
        for c in range(_PLAIN):
            if match(chr(c)):
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)

    spelt = {r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}"), r"\s": ranges(r"\s"), r"\S": ranges(r"\S")}
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = next((k for k in spelt if pattern.startswith(k, i)), pattern[i : i + 2] if pattern[i] == "\\" else pattern[i])
        if token in spelt:
            out.append(spelt[token] if inside else f"[{spelt[token]}]")
        elif len(token) == 2 and token[1].isalpha():
            return None  # a class that is not known here
        else:
            out.append(token)
            inside = token == "[" or inside and token != "]"
        i += len(token)
    return re.compile("".join(out))


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        plain = _spelt_out(pattern)
        self.find_plain = plain.findall if plain else self.find
        self.high = re.compile(f"[^\\x00-\\u{_PLAIN - 1:04x}]").search
        chars = byte_characters()
        self.table = {b: chars[b] for b in range(256)}
        self.words = _Words(self.encode_word)
        self.inverse = {str(k): t for k, t in enumerate(tokens)}
        self.unknown = len(tokens)

    def encode_word(self, word: str) -> list[int]:
        ids = self.sp.encode(word.encode().decode("latin-1").translate(self.table))
        if self.unknown in ids:
            raise ValueError("the vocabulary lacks a byte")
        return ids

    def encode(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space."""
        return " ".join(map(self.words.__getitem__, (self.find if self.high(text) else self.find_plain)(text)))

    def decode(self, ids: str) -> bytes:
        """The bytes of ids in decimal, joined by one space; an unknown id raises."""
        return b"".join(map(self.inverse.__getitem__, ids.split(" "))) if ids else b""


def _codec(spark, path: str, pattern: str):
    tokens = load_ranks(path)
    return spark.sparkContext.broadcast((serialise(tokens), tokens, pattern))


def encode(df: DataFrame, keep: list[str], *, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``ids`` (array of int) for every row."""
    shared = _codec(df.sparkSession, path, pattern)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids = [[int(x) for x in codec.encode(t or "").split()] for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return df.select(*keep, F.col(text_col).alias("text__")).mapInArrow(run, schema)


def decode(df: DataFrame, keep: list[str], *, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` with ``decoded`` (binary); ids outside the vocabulary raise, null ids decode to nothing."""
    shared = _codec(df.sparkSession, path, pattern)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                out = [codec.decode(" ".join(map(str, ids or []))) for ids in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return df.select(*keep, F.col(ids_col).alias("ids__")).mapInArrow(run, schema)


def roundtrip(df: DataFrame, keep: list[str], *, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``keep`` with n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids, in one pass."""
    shared = _codec(df.sparkSession, path, pattern)
    own = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if set(own.names) & set(keep):
        raise ValueError(f"rename these columns first: {own.names}")
    schema = T.StructType([*[df.schema[k] for k in keep], *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, coded, plain = [], [], []
                for text in part.column(len(keep)).to_pylist():
                    ids = codec.encode(text or "")
                    sizes.append(ids.count(" ") + 1 if ids else 0)
                    coded.append(hashlib.sha256(ids.encode()).hexdigest())
                    plain.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(sizes, pa.int64()), pa.array(coded), pa.array(plain)], names=[*keep, *own.names])

    return df.select(*keep, F.col(text_col).alias("text__")).mapInArrow(run, schema)
