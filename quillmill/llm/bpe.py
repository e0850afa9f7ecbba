"""Byte-level BPE through sentencepiece: a model serialised straight from a rank table, encoding and decoding.

Each byte of a vocabulary string is mapped to one printable character, a piece's score is its negative rank and the
normaliser is the identity, so that sentencepiece's merges (best score first, leftmost among equals) are those of the
rank table. A text is cut into pre-tokens by the vocabulary's pattern; each distinct pre-token is encoded once per task
and remembered.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import hand_back, settle, slices, small_batches, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a task remembers before it starts anew.
REMEMBERED = 250_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary string to rank, from a file of lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the one further id, the largest, is the unknown piece."""
    as_text = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    pieces = b"".join(
        _block(1, _block(1, "".join(as_text[b] for b in piece).encode()) + b"\x15" + struct.pack("<f", -rank))
        for piece, rank in by_rank
    )
    pieces += _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(by_rank) + 1) + _number(40, len(by_rank))
    trainer += b"".join(_varint(field << 3) + b"\xff" * 9 + b"\x01" for field in (41, 42, 43))  # no begin, end, padding
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encodes and decodes inside a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.to_characters = str.maketrans(byte_characters())
        self.ranks = ranks
        self.bytes_of = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [self.cut(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set(chain.from_iterable(cut))
        raw = [(x, x.encode()) for x in new]
        self.known.update((x, [self.ranks[b]]) for x, b in raw if b in self.ranks)
        rest = [(x, b) for x, b in raw if b not in self.ranks]
        ids = self.model.encode([b.decode("latin-1").translate(self.to_characters) for _, b in rest], num_threads=1)
        self.known.update(zip((x for x, _ in rest), ids))
        return [list(chain.from_iterable(map(self.known.__getitem__, c))) for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def with_codec(
    docs: DataFrame,
    each: Callable[[Codec, list, list[str]], list[tuple]],
    schema: str,
    vocabulary: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows that ``each(codec, ids, texts)`` makes of small batches; a null text is the empty one.

    The vocabulary, a file of fixed size, is read on the driver and goes to each executor once, as a broadcast."""
    import public_tokenizers

    ranks = read_ranks(vocabulary or tokenizer_path(VOCABULARY))
    pattern = pattern or public_tokenizers.PATTERN
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, pattern)
        for batch in batches:
            rows = []
            for part in slices(batch):
                rows += each(codec, part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        codec = None
        hand_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def token_ids(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the token ids of each whole text, as an array; a null or empty text has none."""
    each = lambda codec, ids, texts: list(zip(ids, codec.encode_batch(texts)))
    return with_codec(docs, each, "doc_id long, ids array<long>", vocabulary, pattern)


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode every whole text, decode its ids, and give the digests of both.

    One row per row of docs. Null and empty texts: no tokens, the digests of nothing. Repeated rows, repeated or null
    doc_ids: a row each. An empty table gives an empty result. Other columns of docs are not read."""

    def each(codec: Codec, ids: list, texts: list[str]) -> list[tuple]:
        out = []
        decimal = [str(i) for i in range(len(codec.bytes_of))] if not hasattr(codec, "decimal") else codec.decimal
        codec.decimal = decimal
        for doc, tokens in zip(ids, codec.encode_batch(texts)):
            listed = hashlib.sha256(" ".join(map(decimal.__getitem__, tokens)).encode()).hexdigest()
            out.append((doc, len(tokens), listed, hashlib.sha256(codec.decode(tokens)).hexdigest()))
        return out

    with small_batches(docs.sparkSession):
        return settle(with_codec(docs, each, SCHEMA, vocabulary, pattern), "encoded")
