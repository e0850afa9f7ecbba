"""Learned sentence ends on labelled texts, and against a plain version."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.functions import sentences as S
from quillmill.functions import text as T

ABBREVIATED = ["We met Dr. {n} at the {x}.", "It was 5 p.m. when {n} left the {x}.", "A {x}, e.g. the {y}, is near the {x}.", "He took the {x}, i.e. a {y}.", "Mr. {n} and Mrs. {m} came with a {x}.", "See vol. 3 of the {x}.", "J. R. {n} wrote the {y}."]
PLAIN = ["The {x} saw the {y} and {n}.", "She left the {x} for a {y}!", "Is this the {x} of {n}?", "They gave the {x} to {m}.", "He likes the {x} near the {y}.", "The {x} came with the {y}.", "But {n} did not see the {x}.", "We saw the {x}.", "(They had the {y}.)", "\"The {x} is by the {y}.\"", "In May the {x} is by the {y}.", "The {x} rose by 3.5 percent of the {y}."]
NAMES = ["Smith", "Jones", "Miller", "Baker", "Stone", "Carter", "Fisher", "Mason", "Brook", "Field"]
THINGS = "house garden river mountain window table market harbour village forest bridge letter engine doctor school".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    fill = lambda: {"n": rng.choice(NAMES), "m": rng.choice(NAMES), "x": rng.choice(THINGS), "y": rng.choice(THINGS)}
    return [[rng.choice(ABBREVIATED + PLAIN * 2).format(**fill()) for _ in range(rng.randint(1, 30))] for _ in range(n)]


def test_abbreviations_end_no_sentence(spark):
    texts = corpus(400)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n")], "doc_id long, text string")
    ends = S.learn(docs)
    assert {"dr", "p.m", "e.g", "i.e", "mr", "mrs", "vol"} <= set(ends.abbreviations) and not {*THINGS, *(n.lower() for n in NAMES)} & set(ends.abbreviations)
    assert {"the", "they", "he"} <= set(ends.starters)
    got = {r.doc_id: r.s for r in docs.select("doc_id", S.sentences(F.col("text"), ends).alias("s")).collect()}
    wrong = sum(got[i] != t for i, t in enumerate(texts))
    assert wrong == 0 and got[900] == got[901] == got[902] == []
    simple = {r.doc_id: r.s for r in docs.select("doc_id", T.sentences(F.col("text")).alias("s")).collect()}
    assert sum(simple[i] != t for i, t in enumerate(texts)) > 300
    assert S.learn(docs.limit(0)) == S.Ends([], [], [])


def test_white_space_inside_a_sentence_stays(spark):
    ends = S.Ends(["dr"], ["the"], [])
    text = "Dr.  Smith came.\n\nThe  end...  it was. What?! Yes. (No.) \"Dr. The one.\" 3. May"
    row = spark.createDataFrame([(text,)], "text string").select(S.sentences(F.col("text"), ends).alias("s")).first()
    assert row.s == ["Dr.  Smith came.", "The  end...  it was.", "What?!", "Yes.", "(No.)", "\"Dr.", "The one.\"", "3.", "May"]


def plain_learn(texts):
    """The lists by plain counting."""
    bare = lambda w: re.sub(r"[\"'”’»)\]},;:]+$", "", re.sub(r"^[\"'“‘«(\[{]+", "", w))
    kind = lambda w: "##" if re.fullmatch(r"[-+]?[0-9]+([.,:][0-9]+)*", re.sub(r"\.$", "", w.lower())) else re.sub(r"\.$", "", w.lower())
    every, dotted, pairs = Counter(), Counter(), []
    for t in texts:
        ws = [bare(w) for w in (t or "").split()]
        for w, after in zip(ws, [*ws[1:], None]):
            if w:
                every[kind(w)] += 1
                dotted[kind(w)] += w.endswith(".") and not w.endswith("..")
                pairs.append((w, after))
    n, periods = sum(every.values()), sum(dotted.values())
    p, out = periods / n, {}
    for a in every:
        if dotted[a] and re.fullmatch(r"[^\W\d_]+(\.[^\W\d_]+)*", a):
            x, y = dotted[a], every[a] - dotted[a]
            ratio = -2 * (x * math.log(p) + y * math.log(1 - p) - x * math.log(0.99) - y * math.log(0.01))
            letters = len(a) - a.count(".")
            out[a] = ratio * math.exp(-letters) * (a.count(".") + 1) * letters ** -y
    return {a for a, s in out.items() if s >= S.ABBREVIATION}


def test_abbreviations_by_plain_counting(spark, sf_dir):
    texts = [" ".join(t) for t in corpus(60, 5)] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").limit(40).collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert set(S.learn(docs).abbreviations) == plain_learn(texts)


def test_chunks_of_learned_sentences(spark):
    docs = spark.createDataFrame([(1, "Dr. Smith came. " * 60)], "doc_id long, text string")
    chunks = [r.chunk for r in T.chunk_table(docs, ends=S.Ends(["dr"], [], [])).orderBy("chunk_index").collect()]
    assert len(chunks) > 1 and all(c.endswith("Dr. Smith came.") for c in chunks)


def test_only_words_with_a_period_are_counted_with_the_next(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(S, "settled", lambda df, tag: kept.setdefault(tag, df))
    S.learn(spark.createDataFrame([("a b a c a d. E a x. y",)], "text string"))
    rows = {(r.a, r.b): r.n for r in kept["word-pairs"].collect()}
    assert rows == {("a", None): 4, ("b", None): 1, ("c", None): 1, ("d", "e"): 1, ("e", None): 1, ("x", "y"): 1, ("y", None): 1}


def test_a_place_is_judged_by_its_own_words(spark):
    ends = S.Ends(["dr"], ["the"], ["nr ##"])
    texts = ["dr. x " * 6000, "A\u0001b came. Then\tc.\n\nThe end. \n", "\t. a.\x0b\x0cB. ", "Nr. 5 is it. \"Dr.\" The one.) the other... no", " \n", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    began = time.time()
    got = {r.doc_id: r.s for r in docs.select("doc_id", S.sentences(F.col("text"), ends).alias("s")).collect()}
    assert time.time() - began < 10  # the sentence so far is not gone through at each of 6,000 places
    assert got[0] == [texts[0].strip()] and got[4] == got[5] == []
    assert got[1] == ["A\u0001b came.", "Then\tc.", "The end."] and got[2] == [". a.\x0b\x0cB."]
    assert got[3] == ["Nr. 5 is it.", "\"Dr.\"", "The one.) the other... no"]


def test_lists_of_any_length_are_whole(spark, monkeypatch):
    texts = corpus(200)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    lists = S.learn(docs)
    assert min(map(len, lists)) > 1
    monkeypatch.setattr(S, "MOST", 1)
    tables = S.learn(docs)
    assert [{r.entry for r in t.collect()} for t in tables] == [set(x) for x in lists]
    one = S.Ends(lists.abbreviations, tables.starters, lists.together)
    for ends in (lists, tables, one):
        got = {r.doc_id: r.sentences for r in S.with_sentences(docs, ends).collect()}
        assert got == {**dict(enumerate(texts)), 900: [], 901: []}
    with pytest.raises(ValueError):
        S.sentences(F.col("text"), tables)
