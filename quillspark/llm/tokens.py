"""Encoding with a public byte-level BPE vocabulary through a sentencepiece model that is written out directly.

The vocabulary's ranks become a sentencepiece BPE model without training: every token's bytes are mapped to one
printable character each, a piece's score is its negative rank (so the merge of the lowest rank comes first, the
leftmost among equals, as in the vocabulary's own encoder), and the normaliser is the identity. Texts are cut into
pre-tokens by the vocabulary's pattern, pre-tokens are mapped, encoded and shifted back to ranks; decoding maps back.

Defined results: null and empty texts have no ids (an empty list); special tokens' strings are ordinary text; lone
surrogates cannot occur in stored text; texts of any length are encoded whole; each row is encoded alone, so repeated
rows repeat and an empty table gives no rows; other columns are ignored.

Scale: a map over the rows without a shuffle; the broadcast model is bounded by the vocabulary.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [ranks[k] for k in range(len(ranks))]


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it has one, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, bool) or isinstance(value, int):
        return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, piece k + 1 is the token of rank k."""
    letters = byte_letters()
    table = {b: letters[b] for b in range(256)}
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, "".join(table[b] for b in t)) + _field(2, float(-k)) + _field(3, 1)) for k, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(24, False) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, "identity") + _field(2, b"") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    def __init__(self, model: bytes, pat: str, cache: int = 200_000):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pat).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.bytes = {c: b for b, c in self.letters.items()}
        self.cache, self.size = {}, cache

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts, known = self.split(text), self.cache
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            if len(known) + len(new) > self.size:
                known.clear()
                new = list(dict.fromkeys(parts))
            for p, ids in zip(new, self.sp.encode([p.encode("utf-8").decode("latin-1").translate(self.letters) for p in new], num_threads=1)):
                known[p] = [k - 1 for k in ids]
        out: list[int] = []
        for p in parts:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        return bytes(self.bytes[c] for k in ids for c in self.sp.id_to_piece(int(k) + 1)).decode("utf-8", "replace")


def _mapped(df: DataFrame, key: str, text: str, path: str | None, make, fields: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((serialise(read_ranks(path or vocabulary_path())), pattern()))

    def run(batches):
        codec = Codec(*shared.value)
        for batch in batches:
            yield make(batch.column(0), [codec.encode(t) for t in batch.column(1).to_pylist()])

    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids)."""

    def make(keys, ids):
        ends = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        flat = np.fromiter((k for x in ids for k in x), np.int32, int(ends[-1]))
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return _mapped(df, key, text, path, make, "doc_id long, ids array<int>")


def count(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens)."""
    return _mapped(df, key, text, path, lambda keys, ids: pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "n_tokens"]), "doc_id long, n_tokens long")
