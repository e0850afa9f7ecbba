"""Token counts by a whole-token shortcut.

Proven on the vocabulary, before any text is seen: (a) no piece goes on past a word mark, so that merges never leave a
stretch "word marks, then other characters"; (b) which strings of the vocabulary encode alone as one token. Texts are
cut into such stretches; a stretch that is one of (b) counts 1 at once, only the others are merged, each distinct one
once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Stretches that a task remembers before it starts anew.
REMEMBERED = 250_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Appended to a serialised model: field 3, the normaliser, with field 3 of it, the space put before a text, off.
_NO_PREFIX = b"\x1a\x02\x18\x00"


class Proof:
    """What is proven on a model before any text is seen; made once, on the driver, and sent to all tasks."""

    def __init__(self, model: bytes):
        import sentencepiece

        whole, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece goes on past a word mark: stretches are not independent")
        if len(whole.encode("a")) != len(own.encode(" a")) or len(own.encode("a  b ")) < 4:
            raise ValueError("the model changes white space: its texts cannot be cut here")
        #: A line feed in no piece parts stretches as well: it always stands alone.
        self.cut_lines = not any("\n" in p for p in pieces)
        self.line = len(own.encode("\n"))
        self.single = [p for p, ids in zip(pieces, own.encode(pieces, num_threads=1)) if len(ids) == 1]


class Counter:
    """Counts tokens inside a task."""

    def __init__(self, model: bytes, proof: Proof | None = None):
        import sentencepiece

        proof = proof or Proof(model)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        self.cut_lines, self.line, self.single = proof.cut_lines, proof.line, proof.single
        self.known = dict.fromkeys(self.single, 1)

    def cut(self, text: str) -> list[str]:
        """The stretches of a text without line feeds, which together are the text with its spaces as marks."""
        marked = text.replace(" ", MARK)
        if MARK + MARK in marked or marked.endswith(MARK):
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        head, *rest = marked.split(MARK)
        return [head] * bool(head) + [MARK + x for x in rest]

    def stretches(self, text: str) -> tuple[list[str], int]:
        """Those of a text as the model sees it, and the tokens of the line feeds between them."""
        if not text:
            return [], 0
        text = " " + text
        if not self.cut_lines:
            return self.cut(text), 0
        lines = text.split("\n")
        return [x for line in lines for x in self.cut(line)], (len(lines) - 1) * self.line

    def count_batch(self, texts: list[str]) -> list[int]:
        cut = [self.stretches(t) for t in texts]
        new = list(set(chain.from_iterable(c for c, _ in cut)).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict.fromkeys(self.single, 1)
            new = list(set(chain.from_iterable(c for c, _ in cut)).difference(self.known))
        self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        return [sum(map(self.known.__getitem__, c)) + lines for c, lines in cut]


def token_counts(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """Bytes and tokens of every whole text, and whether they are over the limit.

    One row per row of docs. Null and empty texts: no bytes, no tokens. Repeated rows, repeated or null doc_ids: a row
    each. An empty table gives an empty result. Other columns of docs are not read. The model, a file of fixed size, is
    read on the driver and broadcast."""
    with open(model or tokenizer_path(MODEL), "rb") as f:
        read = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((read, Proof(read)))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*sent.value)
        for batch in batches:
            rows = []
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, text, n in zip(part.column(0).to_pylist(), texts, counter.count_batch(texts)):
                    rows.append((doc, len(text.encode()), n, n > limit))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
