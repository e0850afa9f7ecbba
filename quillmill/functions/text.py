"""Text transforms as column expressions: cleaning, sentences, chunks, windows, small classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .sentences import sentences as learned_sentences

CHUNK_CHARS, OVERLAP_CHARS = 512, 100
WINDOW_WORDS, FULL_TEXT_WORDS, ONE_CALL_WORDS = 10_000, 8_000, 11_000
PAGE_CHARS, ONE_PAGE_CHARS = 3_000, 5_000

# Phrases that ask for a short or a long answer.
BRIEF = ["3 bullet points", "summarize", "brief", "short", "concise", "in short", "quick summary"]
# Words that are never counted in a word cloud, beside the stop words of the language.
NOT_COUNTED = "u n r ur nthe said like cyou nhe ni ci us introduction conclusion method results page image img png jpg svg".split()
# The common English stop words, as a word cloud sees them, without apostrophes.
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn "
    "didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
# Blanks of spreadsheets that count as spaces.
SHEET_BLANKS = " ​‌‍﻿"


def words(text: Column) -> Column:
    """Words, split at white space, as they are."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased words, nothing stripped: the terms of the full-text index."""
    return words(F.lower(text))


def sentences(text: Column) -> Column:
    """Sentences by a rule that needs no corpus: split behind . ! or ? and white space (T1). ``functions.sentences`` learns abbreviations."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, ends=None) -> Column:
    """Greedy packing of whole sentences into chunks of about ``size`` characters.

    A full chunk goes out stripped; the next begins with the last ``overlap`` characters of the unstripped one. A sentence is
    never cut, so a chunk can be longer. Sentences end by a simple rule, or as ``ends``, learned from the corpus, says."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, s: Column) -> Column:
        full = (F.length(state["now"]) + F.length(s) + 1 > size) & (state["now"] != "")
        done = F.when(full, F.concat(state["done"], F.array(_strip(state["now"])))).otherwise(state["done"])
        now = F.when(full, F.concat(F.right(state["now"], F.lit(overlap)), F.lit(" "), s)).otherwise(_strip(F.concat(state["now"], F.lit(" "), s)))
        return F.struct(done.alias("done"), now.alias("now"))

    def end(state: Column) -> Column:
        last = _strip(state["now"])
        return F.when(last == "", state["done"]).otherwise(F.concat(state["done"], F.array(last)))

    return F.aggregate(sentences(text) if ends is None else learned_sentences(text, ends), start, add, end)


def pieces(text: str, size: int = CHUNK_CHARS, marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """text in pieces of at most ``size`` characters, cut behind the first of the marks that it has, and behind the next where that is not enough."""
    if len(text) <= size:
        return [text] if text else []
    for n, mark in enumerate(marks):
        if mark in text:
            *rest, last = text.split(mark)
            return [p for part in [*(r + mark for r in rest), last] for p in pieces(part, size, marks[n + 1 :])]
    return [text[i : i + size] for i in range(0, len(text), size)]


@F.pandas_udf(ArrayType(StringType()))
def cut_chunks(texts: pd.Series) -> pd.Series:
    """Chunks of texts without sentences (T3): pieces put together up to the size, each chunk beginning with the last pieces of the one before."""

    def cut(text: str | None) -> list[str]:
        out: list[str] = []
        now: list[str] = []
        for p in pieces(text or ""):
            if now and sum(map(len, now)) + len(p) > CHUNK_CHARS:
                out.append("".join(now).strip())
                while now and (sum(map(len, now)) > OVERLAP_CHARS or sum(map(len, now)) + len(p) > CHUNK_CHARS):
                    now.pop(0)
            now.append(p)
        out.append("".join(now).strip())
        return [c for c in out if c]

    return texts.map(cut)


def pages(text: Column, mark: str = "\n\n") -> Column:
    """Pages of a text without any (S17): one up to 5,000 characters, else sections packed to about 3,000."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, s: Column) -> Column:
        full = (F.length(state["now"]) + F.length(s) > PAGE_CHARS) & (state["now"] != "")
        done = F.when(full, F.concat(state["done"], F.array(_strip(state["now"])))).otherwise(state["done"])
        now = F.when(full | (state["now"] == ""), s).otherwise(F.concat(state["now"], F.lit(mark), s))
        return F.struct(done.alias("done"), now.alias("now"))

    def end(state: Column) -> Column:
        last = _strip(state["now"])
        return F.when(last == "", state["done"]).otherwise(F.concat(state["done"], F.array(last)))

    packed = F.aggregate(F.split(text, mark), start, add, end)
    return F.when(F.length(text) <= ONE_PAGE_CHARS, F.array(text)).otherwise(packed)


def enriched(title: Column, page: Column, chunk: Column) -> Column:
    """What is indexed and returned of a chunk (T4)."""
    return F.format_string("Document: %s\nPage %d\n\n%s", title, page.cast("int"), chunk)


def chunk_table(docs: DataFrame, mark: str = "\n", ends=None) -> DataFrame:
    """documents to (chunk_id, document_id, page_no, chunk_index, chunk, content), by page and chunk number (T5), of sentences as learned in ``ends``, if given."""
    paged = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(pages(F.coalesce("text", F.lit("")), mark)).alias("page", "page_text"))
    cut = paged.select("document_id", (F.col("page") + 1).alias("page_no"), F.posexplode(chunks(F.col("page_text"), ends=ends)).alias("chunk_index", "chunk"))
    name = F.format_string("%s_page%d_chunk%d", F.col("document_id").cast("string"), "page_no", "chunk_index")
    title = F.concat(F.lit("doc_"), F.col("document_id").cast("string"))
    return cut.select(name.alias("chunk_id"), "document_id", "page_no", "chunk_index", "chunk", enriched(title, F.col("page_no"), F.col("chunk")).alias("content"))


def first_words(text: Column, n: int) -> Column:
    """The first n words, joined by one space."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def word_windows(df: DataFrame, text: str, size: int = WINDOW_WORDS) -> DataFrame:
    """df with a row for each window of ``size`` words: window_no from 0, window_text."""
    listed = df.withColumn("_words", words(F.col(text)))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("_words") / size).cast("int") - 1))
    listed = listed.where(F.size("_words") > 0).withColumn("window_no", F.explode(at))
    return listed.withColumn("window_text", F.array_join(F.slice("_words", F.col("window_no") * size + 1, F.lit(size)), " ")).drop("_words")


def selected_text(text: Column, summary: Column, most: int = FULL_TEXT_WORDS) -> Column:
    """A short text itself, else its summary if it has one, else its first words."""
    return F.when(F.size(words(text)) < most, text).when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(first_words(text, most))


def summary_calls(text: Column) -> Column:
    """How many model calls a summary takes: one, or one a window and one to combine."""
    n = F.size(words(text))
    return F.when(n <= ONE_CALL_WORDS, F.lit(1)).otherwise(F.ceil(n / WINDOW_WORDS).cast("int") + 1)


def uncounted(stop_words: list[str] | None = None) -> list[str]:
    """The words that a word cloud leaves out; stop_words are English unless given."""
    return sorted({*NOT_COUNTED, *(ENGLISH if stop_words is None else stop_words)})


def letter_words(text: Column) -> Column:
    """A text's words of plain letters, lower-cased."""
    clean = F.replace(F.lower(text), F.lit("\n"), F.lit(" "))
    clean = F.regexp_replace(clean, r"\b[nur]\b", " ")
    clean = F.regexp_replace(clean, r"\\u[0-9a-f]{4}", " ")
    return words(F.regexp_replace(clean, r"[^a-z\s]", " "))


def cloud_words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words that a word cloud counts, repeats included."""
    return F.filter(letter_words(text), lambda w: ~w.isin(uncounted(stop_words)))


def clean_cell(value: Column) -> Column:
    """A spreadsheet cell's text: odd blanks and line ends are spaces, ends trimmed."""
    return F.trim(F.replace(F.regexp_replace(value, f"[{SHEET_BLANKS}]+", " "), F.lit("\n"), F.lit(" ")))


def identifier(name: Column, prefix: str = "t_", empty: str = "unnamed_table") -> Column:
    """A name that SQL takes without quotes."""
    x = F.regexp_replace(F.trim(name), "[^A-Za-z0-9_]", "_")
    x = F.when(x.rlike("^[0-9]"), F.concat(F.lit(prefix), x)).otherwise(x)
    x = F.lower(F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", ""))
    return F.when(x == "", F.lit(empty)).otherwise(x)


def answer_style(question: Column) -> Column:
    """brief if the question has one of the phrases, wherever it stands, else detailed."""
    low = F.lower(question)
    found = F.lit(False)
    for phrase in BRIEF:
        found = found | F.contains(low, F.lit(phrase))
    return F.when(found, "brief").otherwise("detailed")


def without_reasoning(text: Column) -> Column:
    """A model's answer without its marked reasoning."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def one_line(text: Column) -> Column:
    """NULs, line feeds and tabs as spaces."""
    return F.regexp_replace(text, r"[\x00\n\t]+", " ")
