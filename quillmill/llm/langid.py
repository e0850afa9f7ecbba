"""Language identification by unigram pieces, summed over all segmentations.

A language is a probability for each piece of a fixed public vocabulary. The likelihood of a word under a language is
the sum, over every way to cut the word into pieces, of the product of the pieces' probabilities, which a forward
algorithm gives in one pass over the word; a text's likelihood is the product over its words. The probabilities are
learned from labelled rows by expectation maximisation (forward and backward sums), a Spark job a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hand_back, settle, slices, small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Labelled rows of each language that are learned from, at most: those with the smallest hashes.
SAMPLE_DOCS = 600
#: Rounds of expectation maximisation after the first estimate.
ROUNDS = 2
#: Words up to this long are taken by exact length; longer ones are filled up to one length with a character that no piece has.
EXACT, NOTHING = 32, "\U0010ffff"
#: Texts that a task scores together.
TEXTS = 256
#: Characters after which sums are scaled.
SCALED = 16
#: Probability of a character that no piece spells, and what every piece is taken to have been seen beside its count.
UNKNOWN, UNSEEN = 1e-7, 0.02
FOLDS, HELD_OUT = 5, 0
#: Languages, a row each, that may be broadcast; with more of them the texts are shuffled.
BROADCAST_LANGS = 10_000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_words = regex.compile(r"\p{L}[\p{L}\p{M}]*+").findall


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text, runs of letters with their marks; none if no character is a letter."""
    return _words(text.lower())


class Pieces:
    """The vocabulary, and for batches of words which piece stands at which place."""

    RADIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.powers = np.cumprod(np.full(self.longest + 1, self.RADIX), dtype=np.uint64)
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        if len(set(keys.tolist())) != len(keys):
            raise ValueError("two pieces have one key")
        self.tables = []
        left = np.arange(len(pieces))
        bits = 20
        while len(left):  # each table takes one piece a slot; the others go to the next
            slot = self._slot(keys[left], bits, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            k, v = np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(pieces), np.int32)
            k[slot[first]], v[slot[first]] = keys[left[first]], left[first]
            self.tables.append((k, v))
            left = np.delete(left, first)
            bits = 16

    def _key(self, piece: str) -> int:
        codes = np.array([ord(c) for c in piece], dtype=np.uint64)
        return int((codes * self.powers[: len(codes)]).sum(dtype=np.uint64))

    def _slot(self, keys: np.ndarray, bits: int, table: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * table)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers; the number after the last where there is none."""
        out = None
        for n, (k, v) in enumerate(self.tables):
            slot = self._slot(keys, 20 if n == 0 else 16, n)
            got = np.where(k[slot] == keys, v[slot], len(self.pieces))
            out = got if out is None else np.minimum(out, got)
        return out

    def lattices(self, words: list[str], most: int = 8192, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words of about one length at a time: their places in the list, their lengths with the mark, and the number of the piece of each (length - 1, start, word).

        Words of up to EXACT characters are taken by length; longer ones go together with up to an eighth shorter ones. A
        place behind a word's end has no piece."""
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            least = length[order[at]]
            limit = least if least <= EXACT else least + least // 8
            room = max(1, min(most, cells // (int(limit) * self.longest)))
            some = order[at : at + room]
            some = some[: np.searchsorted(length[some], limit, side="right")]
            at += len(some)
            n = int(length[some[-1]])
            text = "".join([(MARK + words[i]).ljust(n, NOTHING) for i in some])
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), n).T.astype(np.uint64)
            ids = np.full((min(self.longest, n), n, len(some)), len(self.pieces), np.int32)
            key = np.zeros((n, len(some)), np.uint64)
            for size in range(1, len(ids) + 1):
                key = key[: n - size + 1] + codes[size - 1 :] * self.powers[size - 1]
                ids[size - 1, : n - size + 1] = self.find(key)
            yield some, length[some], ids


def _here(p: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """The probabilities of pieces of one size; a character that no piece spells has UNKNOWN."""
    here = p[ids]
    return np.where((ids == len(p) - 1)[:, None], UNKNOWN, here) if size == 1 else here


def forward(ids: np.ndarray, length: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By end: the summed probability of all segmentations of what lies before, a column for each language, times exp of what the second array has.

    Sums are scaled as they go, so that words of any length are summed whole."""
    longest, n, m = ids.shape
    sums = np.zeros((n + 1, m, p.shape[1]))
    logs = np.zeros((n + 1, m, p.shape[1]))
    sums[0] = 1
    for end in range(1, n + 1):
        for size in range(1, min(longest, end) + 1):
            sums[end] += sums[end - size] * _here(p, ids[size - 1, end - size], size)
        logs[end] = logs[end - 1]
        if end % SCALED == 0:
            by = np.maximum(sums[end], 1e-300)
            back = slice(max(0, end - longest + 1), end + 1)
            sums[back] /= by
            logs[back] += np.log(by)
    return sums, logs


def backward(ids: np.ndarray, length: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by start, of what lies behind up to each word's end."""
    longest, n, m = ids.shape
    sums = np.zeros((n + 1, m, p.shape[1]))
    logs = np.zeros((n + 1, m, p.shape[1]))
    sums[n, length == n] = 1
    for start in range(n - 1, -1, -1):
        sums[start, length == start] = 1
        inside = length > start
        for size in range(1, min(longest, n - start) + 1):
            here = _here(p, ids[size - 1, start], size)
            sums[start] += np.where(inside[:, None], here * sums[start + size], 0)
        logs[start] = logs[start + 1]
        if (n - start) % SCALED == 0:
            by = np.where(sums[start] > 0, sums[start], 1)
            on = slice(start, min(n + 1, start + longest))
            sums[on] /= by
            logs[on] += np.log(by)
    return sums, logs


def vocabulary(model: str | None = None) -> list[str]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model or tokenizer_path(MODEL))
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


def _fold():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def training_sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """lang and text of at most so many labelled rows of each language outside the held-out fold, those with the smallest hashes."""
    own = docs.select("doc_id", "lang", "text").where((_fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A rate for each language first, so that the window below sorts few rows.
    rates = own.groupBy("lang").count().select("lang", (F.lit(1.5 * most) / F.col("count")).alias("rate"))
    if rates.count() <= BROADCAST_LANGS:
        rates = F.broadcast(rates)
    hashed = own.withColumn("hash", F.xxhash64("doc_id", "text"))
    near = hashed.join(rates, "lang").where(F.pmod("hash", F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    order = Window.partitionBy("lang").orderBy("hash")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "text")


def learn(docs: DataFrame, model: str | None = None, most: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and the pieces' probabilities, a column for each language, from the labelled rows of docs.

    What comes to the driver is a number for each piece and language."""
    pieces = vocabulary(model)
    context = docs.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                frame = pd.DataFrame({"lang": part.column(0).to_pylist(), "word": [words_of(t) for t in part.column(1).to_pylist()]})
                rows = frame.explode("word").dropna().groupby(["lang", "word"]).size().reset_index(name="n")
                if len(rows):
                    yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    words = training_sample(docs, most).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    try:
        langs = sorted(r.lang for r in words.select("lang").distinct().collect())
        p = np.zeros((len(pieces) + 1, len(langs)))

        def expect(sent):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table, known, p = Pieces(pieces), {x: i for i, x in enumerate(langs)}, sent.value
                for batch in batches:
                    words = batch.column(1).to_pylist()
                    lang = np.array([known[x] for x in batch.column(0).to_pylist()])
                    n = batch.column(2).to_numpy().astype(float)
                    counts = np.zeros((len(langs), len(pieces) + 1))
                    for some, length, found in table.lattices(words):
                        for x in np.unique(lang[some]):
                            own = lang[some] == x
                            mine, weight = found[:, :, own], n[some][own]
                            if p.any():
                                q = p[:, [x]]
                                (ahead, up), (behind, down) = forward(mine, length[own], q), backward(mine, length[own], q)
                                whole = behind[0, :, 0]
                            for size, ids in enumerate(mine, 1):
                                ids = ids[: len(ids) - size + 1]
                                w = np.broadcast_to(weight, ids.shape)
                                if p.any():
                                    scale = np.exp(up[: len(ids), :, 0] + down[size:, :, 0] - down[0, :, 0])
                                    w = weight * ahead[: len(ids), :, 0] * q[ids, 0] * behind[size:, :, 0] * scale / whole
                                counts[x] += np.bincount(ids.ravel(), w.ravel(), len(pieces) + 1)
                    x, i = np.nonzero(counts[:, :-1])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(i), pa.array(counts[x, i])], names=["lang", "piece", "n"])

            return run

        for _ in range(rounds + 1 if langs else 0):
            sent = context.broadcast(p)
            got = words.mapInArrow(expect(sent), "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
            counts = np.full((len(pieces), len(langs)), UNSEEN)
            np.add.at(counts, (got.piece.to_numpy(np.int64), got.lang.to_numpy(np.int64)), got.n.to_numpy(float))
            p = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(langs)))])
        return langs, pieces, p
    finally:
        words.unpersist()


def score_texts(table: Pieces, langs: list[str], p: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The most likely language of each text and its share; ``und`` and 0 where there is no letter or no language."""
    words = [words_of(t) if t and langs else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    if sizes.sum():
        codes, distinct = pd.factorize(np.array([x for w in words for x in w], dtype=object))
        logs = np.zeros((len(distinct), len(langs)))
        for some, length, found in table.lattices(list(distinct)):
            sums, scale = forward(found, length, p)
            own = np.arange(len(some))
            logs[some] = np.log(np.maximum(sums[length, own], 1e-300)) + scale[length, own]
        full = np.nonzero(sizes)[0]
        total = np.add.reduceat(logs[codes], (np.cumsum(sizes) - sizes)[full], axis=0)
        best[full] = total.argmax(axis=1)
        score[full] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[b] if n else "und" for b, n in zip(best, sizes)], score


def predict(docs: DataFrame, learned: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """The most likely language of every whole text, with its share among the languages' likelihoods.

    Nothing but the text is looked at. Null texts, and texts without a letter: ``und``, score 0; so is every text if
    nothing was learned. Equally likely languages: the first by name. A null doc_id counts as not held out. Repeated
    rows: a row each. An empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, p = sent.value
        table = Pieces(pieces)
        for batch in batches:
            for part in slices(batch, TEXTS):
                texts = part.column(2).to_pylist()
                named, score = score_texts(table, langs, p, texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of docs, then predict all of them."""
    return predict(docs, learn(docs))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text is in some learned language with a score of at least ``least``.

    Null and empty texts, and texts without a letter, go; so do all rows if nothing could be learned. Repeated rows stay or go
    together, ids may be null or repeated. Equally likely languages share the score, so that with a tie of three all are
    below a half. An empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.arrow_udf("double")
    def share(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, pieces, p = sent.value
        table = Pieces(pieces)
        for texts in batches:
            found = [score_texts(table, langs, p, texts.slice(i, TEXTS).to_pylist())[1] for i in range(0, len(texts), TEXTS)]
            yield pa.array(np.concatenate([np.zeros(0), *found]))
        table = None
        hand_back()

    with small_batches(docs.sparkSession):
        return settle(docs.where(share("text") >= least), "identified")
