"""Language-model scoring with a gated recurrent network over words.

Words are counted over all training documents. The most frequent ones have vectors of their own and lie in classes of one
size, so that the output is a softmax over classes times one over a class's words; all other words are one further class,
inside which the counts decide. Tasks train on their own documents by backpropagation through windows, the state
going on from window to window, and the networks are averaged by tokens after each round; every training document is in one
round. Scoring goes over whole documents, many side by side, with the state carried to the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, slices

#: What ends a text: no word, as words have no white space.
END = "\n"
#: Words with vectors of their own, the words of a class, and the width of the state.
HEAD, CLASS, WIDTH = 2048, 64, 16
#: Words whose counts every task knows, at most; counts of rarer ones are joined.
FREQUENT = 1 << 18
#: Rounds over disjoint shares of the training documents, lanes side by side, tokens of a window, and tokens read before they are dealt to lanes.
ROUNDS, LANES, WINDOW, READ = 3, 256, 32, 1 << 19
#: Windows that a lane has in training, at least; short streams have fewer lanes. Bytes of text that are scored together.
WINDOWS, SCORED_BYTES = 16, 8 << 20
RATE, CLIP = 0.01, 1.0
FOLDS, HELD_OUT = 7, 2
#: Rows in which a network travels, and rows of texts that are cut into words at once.
PARTS, ROWS = 16, 4096
LN10 = math.log(10)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, A-Z lower-cased, and how many each has; white space is ASCII's, a null text has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, n = split.flatten(), split.value_lengths().to_numpy()
    filled = pc.not_equal(words, "")  # white space at the ends gives empty ones
    return words.filter(filled), np.bincount(np.repeat(np.arange(len(n)), n)[filled.to_numpy(zero_copy_only=False)], minlength=len(n))


def ranked(words: pa.Array, known: pa.Array, other: int) -> np.ndarray:
    """The places of words among the known ones, ``other`` where there is none."""
    return pc.index_in(words, value_set=known).fill_null(other).to_numpy()


def with_ends(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts of n words each with a 0 behind each text, and where the texts end."""
    stops = np.cumsum(n + 1)
    out = np.zeros(len(ids) + len(n), ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, stops


def is_held_out(col: str = "doc_id") -> F.Column:
    """Whether a row is not learned from; a row without an id is learned from."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """token and c over all rows, each text with its end; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ROWS):
                found = words_of(part.column(0))[0].value_counts()
                ends = pa.array([END]), pa.array([part.num_rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(found.flatten(), ends)], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Sums over all counts, and the frequent words in order: the end first, then by count."""

    def __init__(self, counts: DataFrame):
        size = F.floor(F.log2("c") * 8)
        sizes = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect(), reverse=True)
        self.distinct, self.total = sum(r.v for r in sizes), sum(r.n for r in sizes)
        least, room = math.inf, FREQUENT
        for r in sizes:
            room -= r.v
            if room < 0:
                break
            least = r["size"]
        self.frequent = size >= (least if least < math.inf else 1 << 40)
        found = sorted(((r.token, r.c) for r in counts.where(self.frequent | (F.col("token") == F.lit(END))).collect()), key=lambda x: (x[0] != END, -x[1], x[0]))
        self.words = [w for w, _ in found] or [END]
        self.counts = np.array([c for _, c in found] or [0], np.int64)
        self.head = min(HEAD, len(self.words))
        self.classes = -(-self.head // CLASS)
        #: log10 of one count more in the class of all other words; a word never seen has one of its shares
        self.tail = math.log10(self.total - int(self.counts[: self.head].sum()) + self.distinct - min(self.head, self.distinct) + 1)


class Network:
    """A gated recurrent unit; ids are places in the head, ``head`` itself is any other word."""

    def __init__(self, head: int, classes: int, counts: np.ndarray | None = None, total: int = 0, seed: int = 1):
        self.head, self.classes = head, classes
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "in": draw(head + 1, 3 * WIDTH, s=0.3),
            "gates": draw(WIDTH, 2 * WIDTH, s=WIDTH**-0.5),
            "new": draw(WIDTH, WIDTH, s=WIDTH**-0.5),
            "class": draw(WIDTH, classes + 1, s=0.1),
            "class_bias": np.zeros(classes + 1, np.float32),
            "word": draw(classes, WIDTH, CLASS, s=0.1),
            "word_bias": np.zeros((classes, CLASS), np.float32),
        }
        if counts is not None:
            seen = np.zeros(classes * CLASS)
            seen[:head] = counts[:head] + 0.5
            by_class = seen.reshape(classes, CLASS)
            self.p["class_bias"][:] = np.log(np.append(by_class.sum(axis=1), total - counts[:head].sum() + 0.5))
            self.p["word_bias"][:] = np.log(np.maximum(by_class, 1e-30))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).astype(x.dtype)
            at += x.size
        return self

    def recur(self, ids: np.ndarray, alive: np.ndarray, h: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each (time, lane), and the last; where ``alive`` is 0 a document begins with an empty state."""
        states = np.empty((*ids.shape, WIDTH), h.dtype)
        for t in range(len(ids)):
            h = h * alive[t][:, None]
            x = self.p["in"][ids[t]]
            gates = 1 / (1 + np.exp(-(x[:, : 2 * WIDTH] + h @ self.p["gates"])))
            z, reset = gates[:, :WIDTH], gates[:, WIDTH:] * h
            new = np.tanh(x[:, 2 * WIDTH :] + reset @ self.p["new"])
            if kept is not None:
                kept.append((h, gates, reset, new))
            h = new + z * (h - new)
            states[t] = h
        return states, h

    def log_probs(self, states: np.ndarray, y: np.ndarray, grads: dict | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of each next id, a rare word's being that of its class; with grads also their gradient in the states."""
        places = np.arange(len(y))
        cls = np.where(y == self.head, self.classes, y // CLASS)
        soft, found = _softmax(states @ self.p["class"] + self.p["class_bias"], cls, grads is not None)
        back = None
        if grads is not None:
            soft[places, cls] -= 1
            grads["class"], grads["class_bias"] = states.T @ soft, soft.sum(axis=0)
            grads["word"], grads["word_bias"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["word_bias"])
            back = soft @ self.p["class"].T
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(ends)):
            rows = order[ends[c] : ends[c + 1]]
            here, word = states[rows], y[rows] - c * CLASS
            soft, more = _softmax(here @ self.p["word"][c] + self.p["word_bias"][c], word, grads is not None)
            found[rows] += more
            if grads is not None:
                soft[np.arange(len(rows)), word] -= 1
                grads["word"][c], grads["word_bias"][c] = here.T @ soft, soft.sum(axis=0)
                back[rows] += soft @ self.p["word"][c].T
        return found if grads is None else (found, back)

    def gradients(self, ids: np.ndarray, alive: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean loss of a window, the state behind it, and the loss."""
        kept: list = []
        states, after = self.recur(ids, alive, h, kept)
        grads: dict = {}
        found, back = self.log_probs(states.reshape(-1, WIDTH), y.ravel(), grads)
        back = back.reshape(states.shape)
        grads["gates"], grads["new"] = np.zeros_like(self.p["gates"]), np.zeros_like(self.p["new"])
        inputs = np.empty((*ids.shape, 3 * WIDTH), np.float32)
        dh = np.zeros_like(h)
        for t in reversed(range(len(ids))):
            dh = dh + back[t]
            before, gates, reset, new = kept[t]
            z, r = gates[:, :WIDTH], gates[:, WIDTH:]
            d_new = dh * (1 - z) * (1 - new * new)
            d_reset = d_new @ self.p["new"].T
            d_gates = np.concatenate([dh * (before - new), d_reset * before], axis=1) * gates * (1 - gates)
            grads["gates"] += before.T @ d_gates
            grads["new"] += reset.T @ d_new
            inputs[t] = np.concatenate([d_gates, d_new], axis=1)
            dh = (dh * z + d_reset * r + d_gates @ self.p["gates"].T) * alive[t][:, None]
        grads["in"] = np.zeros_like(self.p["in"])
        flat = ids.ravel()
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        grads["in"][seen] = np.add.reduceat(inputs.reshape(-1, 3 * WIDTH)[order], first, axis=0)
        return {k: grads[k] / y.size for k in self.p}, after, -float(found.mean())


def _softmax(a: np.ndarray, picked: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The probabilities if the whole of them is asked for, and the logarithms of those picked."""
    a -= a.max(axis=1, keepdims=True)
    at = a[np.arange(len(a)), picked]
    np.exp(a, out=a)
    total = a.sum(axis=1, keepdims=True)
    if whole:
        a /= total
    return a, at - np.log(total[:, 0])


class Adam:
    def __init__(self, net: Network):
        self.net, self.steps = net, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.steps += 1
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, CLIP / norm) if norm else 1.0
        rate = RATE * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.net.p[k] -= rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)


def train_on(net: Network, adam: Adam, stream: np.ndarray) -> None:
    """Truncated backpropagation over a stream of documents' ids, 0 at each end, in windows of lanes side by side."""
    lanes = max(1, min(LANES, len(stream) // (WINDOW * WINDOWS)))
    length = len(stream) // lanes
    grid = stream[: lanes * length].reshape(lanes, length).T
    before = np.concatenate([[0], stream[: lanes * length - 1]]).reshape(lanes, length).T
    h = np.zeros((lanes, WIDTH), np.float32)
    for at in range(0, length, WINDOW):
        ids = before[at : at + WINDOW]
        grads, h, _ = net.gradients(ids, (ids != 0).astype(np.float32), grid[at : at + WINDOW], h)
        adam.step(grads)
    if lanes * length < len(stream):  # fewer tokens than lanes are left
        train_on(net, adam, stream[lanes * length :])


def train(docs: DataFrame, vocabulary: Vocabulary) -> Network:
    """A network that has seen every row of docs once: ROUNDS rounds, in each of which tasks go on from the average of the round before."""
    net = Network(vocabulary.head, vocabulary.classes, vocabulary.counts, vocabulary.total)
    spark = docs.sparkSession
    head = vocabulary.words[: vocabulary.head]
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((head, net.flat()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head, flat = sent.value
            known = pa.array(head)
            own = Network(len(head), -(-len(head) // CLASS)).load(flat)
            adam, held, seen, size = Adam(own), [], 0, 0
            for part in (p for batch in batches for p in slices(batch, ROWS)):
                words, n = words_of(part.column(0))
                stream, _ = with_ends(ranked(words, known, len(head)), n)
                for at in range(0, len(stream), READ):  # what is left over goes on with the next texts
                    held.append(stream[at : at + READ])
                    size += len(held[-1])
                    if size >= READ:
                        train_on(own, adam, np.concatenate(held))
                        held, seen, size = [], seen + size, 0
            if held:
                train_on(own, adam, np.concatenate(held))
                seen += size
            if seen:
                parts = np.array_split(own.flat().astype(np.float64) * seen, PARTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int64()), pa.array([TaskContext.get().partitionId() % PARTS] * PARTS, pa.int64()), pa.array([seen] * PARTS, pa.int64()), pa.array([x.tolist() for x in parts], pa.list_(pa.float64()))],
                    names=["part", "salt", "seen", "x"],
                )

        share = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).select("text")
        sums = _added(_added(share.mapInArrow(run, SUMS), ["part", "salt"]), ["part"]).collect()
        sent.unpersist()
        if sums:
            net.load(np.concatenate([np.array(r.x) / r.seen for r in sorted(sums, key=lambda r: r.part)]))
    return net


SUMS = "part long, salt long, seen long, x array<double>"


def _added(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one part added up; a task holds one row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part, salt, seen = (batch.column(c)[i].as_py() for c in range(3))
                x = batch.column(3)[i].values.to_numpy()
                held[part] = (salt, held[part][1] + seen, held[part][2] + x) if part in held else (salt, seen, x)
        if held:
            salts, seen, xs = zip(*held.values())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(salts), pa.array(seen), pa.array([x.tolist() for x in xs], pa.list_(pa.float64()))], names=["part", "salt", "seen", "x"])

    return sums.repartition(*keys).mapInArrow(run, SUMS)


def score_documents(net: Network, docs: list[np.ndarray]) -> list[float]:
    """Natural log-probability of each whole document (ids with 0 at the end); documents follow each other in lanes, the longest first."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    loads = [(0, lane) for lane in range(min(LANES, len(docs)))]
    lanes: list[list[int]] = [[] for _ in loads]
    for i in order:
        load, lane = loads[0]
        lanes[lane].append(i)
        heapreplace(loads, (load + len(docs[i]), lane))
    lanes.sort(key=lambda ids: -sum(len(docs[i]) for i in ids))
    laid = [i for lane in lanes for i in lane]
    stream = np.concatenate([docs[i] for i in laid])
    before = np.concatenate([[0], stream[:-1]])
    lengths = np.array([sum(len(docs[i]) for i in lane) for lane in lanes])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    found = np.empty(len(stream))
    h = np.zeros((len(lanes), WIDTH), net.p["gates"].dtype)
    for at in range(0, int(lengths[0]), WINDOW):
        some = int(np.searchsorted(-lengths, -at))  # lanes that go on
        steps = min(WINDOW, int(lengths[0]) - at)
        places = starts[:some] + at + np.arange(steps)[:, None]
        inside = at + np.arange(steps)[:, None] < lengths[:some]
        places = np.where(inside, places, 0)
        ids = before[places]
        states, h = net.recur(ids, (ids != 0).astype(h.dtype), h[:some])
        found[places[inside]] = net.log_probs(states[inside], stream[places[inside]])
    sums = np.add.reduceat(found, np.concatenate([[0], np.cumsum([len(docs[i]) for i in laid])[:-1]]))
    out = [0.0] * len(docs)
    for i, x in zip(laid, sums):
        out[i] = float(x)
    return out


SCORED = "id long, doc_id long, held_out boolean, n_tokens long, n_frequent long, log_c double, n_tail long, log_head double, log_net double, rare array<struct<token: string, n: long>>"


def score_rows(docs: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """A row of SCORED for each row: what frequent words and the network say, and the rare words that are still to be looked up."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.counts, vocabulary.head, net.flat()))

    def scored(part: pa.RecordBatch, known: pa.Array, counts: np.ndarray, own: Network, at: int) -> pa.RecordBatch:
        words, n = words_of(part.column(2))
        ranks = ranked(words, known, -1)
        of_doc = np.repeat(np.arange(len(n)), n)
        logs = np.log10(np.append(counts, 0) + 1.0)  # the last place, reached by -1, adds nothing
        head, end = own.head, logs[0]
        total = lambda of, weight=None: np.bincount(of, weight, len(n))
        frequent, tail = ranks >= 0, (ranks < 0) | (ranks >= head)
        log_c, log_head = total(of_doc, logs[ranks]) + end, total(of_doc[~tail], logs[ranks[~tail]]) + end
        stream, stops = with_ends(np.where(tail, head, ranks), n)
        log_net = np.array(score_documents(own, np.split(stream, stops[:-1]))) / LN10
        rare = words.filter(pa.array(~frequent)).dictionary_encode()
        pairs, times = np.unique(of_doc[~frequent].astype(np.int64) << 32 | rare.indices.to_numpy().astype(np.int64), return_counts=True)
        begins = np.searchsorted(pairs >> 32, np.arange(len(n) + 1))
        tokens = rare.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())
        listed = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays([tokens, pa.array(times, pa.int64())], names=["token", "n"]))
        columns = [np.arange(at, at + len(n)), n + 1, total(of_doc[frequent]) + int(counts[0] > 0), log_c, total(of_doc[tail]), log_head, log_net]
        ids, n_tokens, n_frequent, log_c, n_tail, log_head, log_net = (pa.array(c) for c in columns)
        arrays = [ids, part.column(0), part.column(1), n_tokens, n_frequent, log_c, n_tail, log_head, log_net, listed]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "doc_id", "held_out", "n_tokens", "n_frequent", "log_c", "n_tail", "log_head", "log_net", "rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, head, flat = sent.value
        known = pa.array(words)
        own = Network(head, -(-head // CLASS)).load(flat)
        at = TaskContext.get().partitionId() << 40
        held, size = [], 0
        for batch in _and_last(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.column(2).nbytes
            if held and (batch is None or size > SCORED_BYTES):
                for part in pa.Table.from_batches(held).combine_chunks().to_batches():
                    yield scored(part, known, counts, own, at)
                    at += part.num_rows
                held, size = [], 0

    return docs.select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(run, SCORED)


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def scores(docs: DataFrame) -> DataFrame:
    """Counts and a network learned from the rows that are not held out, and every row scored by both.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the network), in log10. A
    null or empty text is its end alone. Rows without doc_id are learned from. Repeated rows count and are scored each. An
    empty table: no rows; nothing to learn from: the end is the only word with a vector, every other is one of one class.
    Columns beyond doc_id and text are not read."""
    learned = docs.where(~is_held_out())
    counts = settle(word_counts(learned), "counts")
    vocabulary = Vocabulary(counts)
    net = train(learned, vocabulary)
    scored = settle(score_rows(docs, vocabulary, net), "scored")
    rare = scored.select("id", F.explode("rare").alias("r")).select("id", "r.token", "r.n")
    looked_up = (
        rare.join(counts.where(~vocabulary.frequent), "token")
        .groupBy("id")
        .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").alias("rare_known"))
    )
    log_c = F.col("log_c") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(looked_up, "id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (log_c - F.col("n_tokens") * math.log10(vocabulary.total + vocabulary.distinct + 1)).alias("base_score"),
        (F.col("log_net") + log_c - F.col("log_head") - F.col("n_tail") * vocabulary.tail).alias("score"),
    )
