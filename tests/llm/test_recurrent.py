"""The recurrent language model against a plain version, its gradients against differences, its counts against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmill.llm import recurrent


def network(head=70, dtype=np.float64):
    net = recurrent.Network(head, -(-head // recurrent.CLASS), np.arange(head, 0, -1), 5000, seed=3)
    net.p = {k: v.astype(dtype) for k, v in net.p.items()}
    return net


def plain_log_prob(net, doc):
    """One document, a word at a time, with every probability of the vocabulary."""
    p, w = net.p, recurrent.WIDTH
    h, total, before = np.zeros(w), 0.0, 0
    soft = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    for word in doc:
        x = p["in"][before]
        z, r = np.split(1 / (1 + np.exp(-(x[: 2 * w] + h @ p["gates"]))), 2)
        n = np.tanh(x[2 * w :] + (r * h) @ p["new"])
        h = (1 - z) * n + z * h
        classes = soft(h @ p["class"] + p["class_bias"])
        words = [classes[c] * soft(h @ p["word"][c] + p["word_bias"][c]) for c in range(net.classes)]
        every = np.append(np.concatenate(words)[: net.head], classes[-1])
        assert abs(every.sum() - 1) < 1e-9
        total, before = total + math.log(every[word]), word
    return total


def test_documents_in_lanes_score_as_one_by_one(monkeypatch):
    monkeypatch.setattr(recurrent, "LANES", 3)
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(1, 71, n), 0).astype(np.int32) for n in (0, 5, 200, 33, 1, 64, 31, 0)]
    net = network()
    assert np.allclose(recurrent.score_documents(net, docs), [plain_log_prob(net, d) for d in docs], rtol=1e-9)


def test_gradients_are_differences():
    rng = np.random.default_rng(1)
    net = network()
    ids, y = rng.integers(0, 71, (6, 4)), rng.integers(0, 71, (6, 4))
    alive, h = (ids != 0).astype(float), rng.standard_normal((4, recurrent.WIDTH)) * 0.3
    loss = lambda: net.gradients(ids, alive, y, h)[2]
    grads = net.gradients(ids, alive, y, h)[0]
    for name, x in net.p.items():
        for at in zip(*(rng.integers(0, n, 6) for n in x.shape)):
            if name == "in":
                at = (ids.ravel()[int(at[0]) % ids.size], at[1])
            if name == "word_bias" and at[0] * recurrent.CLASS + at[1] >= net.head:
                continue
            old = x[at]
            x[at] = old + 1e-5
            up = loss()
            x[at] = old - 1e-5
            down = loss()
            x[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6, name


def plain_words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def test_words():
    import pyarrow as pa

    texts = ["  Ab Ç\tÉx\x0b\x0cy\n\nZ ", "", None, "a\u00a0b \u2003C\x1cd\x85e", "x", " ", "ÀB"]
    words, n = recurrent.words_of(pa.array(texts, pa.string()))
    assert n.tolist() == [len(plain_words(t)) for t in texts] and words.to_pylist() == [w for t in texts for w in plain_words(t)]
    assert recurrent.words_of(pa.array([], pa.string()))[1].tolist() == []


def plain_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words = [[*plain_words(t), recurrent.END] for _, t in rows]
    c = Counter(w for ws, out in zip(words, held) if not out for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), out, ws in zip(rows, held, words)]


@pytest.mark.parametrize("frequent", [1 << 18, 40, 1])
def test_counts_as_plain_counting(spark, odd, texts, monkeypatch, frequent):
    monkeypatch.setattr(recurrent, "FREQUENT", frequent)
    rows = [(i, t) for i, t in texts] + [(100 + i, "some words and Some more words " + "rare%d " % i * (i % 3 + 1)) for i in range(40)]
    docs = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], "doc_id long, text string, token string, id long, n string").repartition(3)
    found = recurrent.scores(docs).collect()
    got = Counter((*r[:5], round(r.base_score, 6)) for r in found)
    assert got == Counter(plain_base(rows)) and all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert recurrent.scores(docs.limit(0)).count() == 0
    out = recurrent.scores(docs.where(recurrent.is_held_out())).collect()  # nothing to learn from
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in out) and out


def test_probabilities_of_a_vocabulary_sum_to_one(spark, monkeypatch):
    """Each word of the vocabulary, and one never seen, as a text's first word: with the network's part they make one."""
    monkeypatch.setattr(recurrent, "HEAD", 8)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 23}" for j in range(1, 30))) for i in range(60)], "doc_id long, text string")
    learned = docs.where(~recurrent.is_held_out())
    counts = recurrent.word_counts(learned).collect()
    vocabulary = recurrent.Vocabulary(recurrent.word_counts(learned))
    net = recurrent.train(learned, vocabulary)
    states, _ = net.recur(np.zeros((1, 1), int), np.zeros((1, 1), np.float32), np.zeros((1, recurrent.WIDTH), np.float32))
    head = {w: i for i, w in enumerate(vocabulary.words[: vocabulary.head])}
    prob = lambda w: math.exp(net.log_probs(states[0], np.array([head.get(w, vocabulary.head)]))[0])
    total = sum(prob(r.token) * (1 if r.token in head else (r.c + 1) / 10**vocabulary.tail) for r in counts) + prob("never") / 10**vocabulary.tail
    assert abs(total - 1) < 1e-5


def test_learns_more_than_counts(spark, sf_dir):
    rows = recurrent.scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(rows) == 200
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    order = spark.createDataFrame([(i, "a b c d e f " * (150 + i)) for i in range(80)], "doc_id long, text string")
    rows = recurrent.scores(order).collect()
    assert all(r.score > 0.8 * r.base_score for r in rows)  # the order tells the next word
