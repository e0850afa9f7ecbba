import math

import numpy as np
import pytest

from quillmill.llm import langid


def test_forward_sums_all_segmentations(monkeypatch):
    pieces = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba"]
    table = langid.Pieces(pieces)
    p = np.vstack([np.random.default_rng(0).random((len(pieces), 2)), np.zeros((1, 2))])

    def brute(s, k):
        return 1.0 if not s else sum(p[i, k] * brute(s[len(x) :], k) for i, x in enumerate(pieces) if s.startswith(x)) + (langid.UNKNOWN * brute(s[1:], k) if s[0] not in pieces else 0)

    words = ["a", "ab", "abab", "baab", "azb"]
    seen = set()
    for exact, scaled in ((32, 16), (0, 1), (0, 2)):
        monkeypatch.setattr(langid, "EXACT", exact)
        monkeypatch.setattr(langid, "SCALED", scaled)
        for some, length, found in table.lattices(words):
            sums, up = langid.forward(found, length, p)
            back, down = langid.backward(found, length, p)
            for row, (w, n) in enumerate(zip(some, length)):
                seen.add((exact, scaled, w))
                for k in range(2):
                    got = sums[n, row, k] * math.exp(up[n, row, k])
                    assert math.isclose(got, brute("▁" + words[w], k), rel_tol=1e-9) and math.isclose(back[0, row, k] * math.exp(down[0, row, k]), got, rel_tol=1e-9)
    assert len(seen) == 3 * len(words)


def test_words_of_any_length_are_summed_whole():
    pieces = ["▁", "a", "b", "▁a", "ab", "ba"]
    table = langid.Pieces(pieces)
    p = np.vstack([np.random.default_rng(1).random((len(pieces), 2)) / 9, np.zeros((1, 2))])

    def by_logs(word, k):
        s, logs = "▁" + word, [0.0]
        for end in range(1, len(word) + 2):
            parts = [logs[end - len(x)] + math.log(p[i, k]) for i, x in enumerate(pieces) if s[:end].endswith(x)]
            top = max(parts)
            logs.append(top + math.log(sum(math.exp(x - top) for x in parts)))
        return logs[-1]

    words = ["ab" * 5000, "a" * 33, "ab" * 17, "b" * 36, "ba" * 100]
    for some, length, found in table.lattices(words):
        for sums, logs, at in ((*langid.forward(found, length, p), length), (*langid.backward(found, length, p), length * 0)):
            for row, w in enumerate(some):
                for k in range(2):
                    assert math.isclose(math.log(sums[at[row], row, k]) + logs[at[row], row, k], by_logs(words[w], k), rel_tol=1e-9)


def test_ties_and_long_words(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aaaa bbbb", "xx"), ("aaaa bbbb", "yy")] * 40)]
    rows += [(900, "aaaa bbbb", None), (901, "漢" * 10_000, None), (902, "a" * 10_000 + " b", None), (903, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).where("doc_id >= 900").collect()}
    # The folds of the two languages have unlike sizes, so that scores are near a half, not at it.
    assert got[903] == ("und", 0.0) and all(got[i][0] in ("xx", "yy") and 0 <= got[i][1] <= 1 for i in (900, 901, 902))
    even = (["xx", "yy"], ["▁", "a", "b"], np.array([[0.2, 0.2], [0.3, 0.3], [0.5, 0.5], [0, 0]]))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs.where("text is not null"), even).collect()} == {("xx", 0.5)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 100 and (found.lang == found.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_only_the_text_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = langid.learn(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, learned).collect()}
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    b = {r.doc_id - 1000: (r.lang_pred, r.score) for r in langid.predict(moved, learned).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()} and all(math.isclose(a[k][1], b[k][1], rel_tol=1e-6) for k in a)


def test_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()]
    assert len(got) == odd.count()
    assert {(1, "und"), (2, "und"), (3, "und"), (10, "und"), (4, "en")} <= set(got)
    assert langid.identify(none).count() == 0 == langid.keep_identified(none).count()
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


@pytest.mark.parametrize("text,words", [("½ ² 12", []), ("Aé b²", ["aé", "b"]), ("हिन्दी में", ["हिन्दी", "में"]), ("naïve e\u0301t", ["naïve", "e\u0301t"]), ("", [])])
def test_words(text, words):
    assert langid.words_of(text) == words
