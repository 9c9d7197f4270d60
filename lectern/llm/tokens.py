"""Token ids by a public byte-level BPE vocabulary, encoded through a sentencepiece model made from it.

The vocabulary is written as a sentencepiece BPE model: each token's bytes become letters, one for each
byte value, its score is its negative rank, and nothing is normalised. Texts are cut into pre-tokens by
the vocabulary's pattern; each is encoded alone, so no token crosses a pre-token's border.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pattern and the file of the vocabulary that is used where none is named.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of which a worker keeps the ids.
MEMO = 200_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: visible Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: a varint, a 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks, which must run from 0 without gap."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gap")
    out = bytearray()
    for i, token in enumerate(order):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-i)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order)) + _field(45, b"<unk>")
    for name, number in ((b"<s>", 41), (b"</s>", 42), (b"<pad>", 43)):  # none of these
        trainer += _varint(number << 3) + b"\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01"
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The tokens of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    """Encodes texts to ids and back."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        letters = byte_letters()
        self.letters = {i: c for i, c in enumerate(letters)}
        self.bytes = {ord(c): i for i, c in enumerate(letters)}
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for word in self.split(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.sp.encode(word.encode("utf-8", "replace").decode("latin-1").translate(self.letters))
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, by the inverse of the byte letters."""
        pieces = "".join(map(self.sp.id_to_piece, map(int, ids)))
        return bytes(self.bytes[ord(c)] for c in pieces).decode("utf-8", "replace")


@lru_cache(4)
def _by_digest(digest: str, pattern: str) -> list[Tokenizer]:
    return []


def tokenizer(model: bytes, pattern: str = PATTERN) -> Tokenizer:
    """The worker's tokenizer of this model, made once."""
    held = _by_digest(hashlib.blake2b(model).hexdigest(), pattern)
    if not held:
        held.append(Tokenizer(model, pattern))
    return held[0]


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`key` and ids (array<int>) of every row; a null or empty text gives an empty array. No shuffle.

    The model, some 1 MB whatever the corpus, is made on the driver and goes to the workers with the function.
    """
    model = model_bytes(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(model, pattern)
        for batch in batches:
            found = [t.encode(x) for x in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            flat = np.fromiter((i for x in found for i in x), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    schema = T.StructType([documents.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, schema)
