"""Counts, groupings and budgets over documents, citations and conversations."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letter_words, uncounted

MAX_WORDS = 1000
SPARE_TOKENS, LEAST_TRIM, MOST_ROUNDS, CHARS_PER_TOKEN = 1000, 10, 1000, 4

#: Numbers covered by spans that may be broadcast; beyond it the join shuffles.
BROADCAST_SPANS = 500_000


def word_frequencies(docs: DataFrame, most: int = MAX_WORDS, stop_words: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """The most frequent cloud words, of all docs or for each value of ``by``; ties by word (A4)."""
    by = by or []
    counts = docs.select(*by, F.explode(letter_words(F.coalesce("text", F.lit("")))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    counts = counts.where(~F.col("word").isin(uncounted(stop_words)))  # once for each different word
    if not by:
        return counts.orderBy(F.desc("n"), "word").limit(most)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "word")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def chunks_per_document(ranked: DataFrame) -> DataFrame:
    """How many rows each document has in each list (A1)."""
    return ranked.groupBy("query_id", "document_id").agg(F.count("*").alias("chunks"))


def recent_history(turns: DataFrame, thread: str, order: str, most: int = 2) -> DataFrame:
    """The last 2 * most turns of each thread."""
    last = Window.partitionBy(thread).orderBy(F.desc(order))
    return turns.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= 2 * most).drop("_r")


def resolve_citations(used: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Each used (query_id, document_id, page_no) with the first retrieved chunk of that page; without one it goes, repeats stay."""
    first = Window.partitionBy("query_id", "document_id", "page_no").orderBy("rank", "title")
    found = retrieved.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return used.join(found, ["query_id", "document_id", "page_no"])


def unique_citations(citations: DataFrame) -> DataFrame:
    """The first of each (query_id, document_id, page_no) by rank."""
    first = Window.partitionBy("query_id", "document_id", "page_no").orderBy("rank", "title")
    return citations.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def source_groups(citations: DataFrame) -> DataFrame:
    """For each document cited: the title of its first citation, its pages in order, joined by commas."""
    pages = F.array_join(F.transform(F.array_sort(F.collect_set("page_no")), lambda p: p.cast("string")), ",")
    return citations.groupBy("query_id", "document_id").agg(F.min_by("title", F.struct("rank", "title")).alias("title"), pages.alias("pages"))


def source_counts(citations: DataFrame, web: DataFrame) -> DataFrame:
    """Different documents and web rows of each query."""
    docs = citations.groupBy("query_id").agg(F.count_distinct("document_id").alias("documents"))
    rows = web.groupBy("query_id").agg(F.count("*").alias("web"))
    both = docs.join(rows, "query_id", "full")
    return both.select("query_id", (F.coalesce("documents", F.lit(0)) + F.coalesce("web", F.lit(0))).alias("sources"))


def joined_text(docs: DataFrame, by: list[str], order: str, segment: int = 64) -> DataFrame:
    """(by, part, text): the texts of each group one after the other, by a space (A5), in parts of ``segment`` numbers of ``order``, a
    whole column; a writer puts parts behind one another. So no group has to fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    part = F.floor(F.col(order) / segment).cast("long").alias("part")
    return docs.groupBy(*by, part).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))


def ordered_distinct(values: Column) -> Column:
    """An array's different values in the order in which they first come."""
    return F.array_distinct(values)


# How the vocabularies that models count with cut a text into pre-tokens, by the vocabulary's name.
PATTERNS = {
    "cl100k_base": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s""",
    "o200k_base": "|".join(
        [
            r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
            r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
            r"""\p{N}{1,3}""",
            r""" ?[^\s\p{L}\p{N}]+[\r\n/]*""",
            r"""\s*[\r\n]+""",
            r"""\s+(?!\S)""",
            r"""\s+""",
        ]
    ),
}


def token_counter(path: str, pattern: str) -> Callable[[str], int]:
    """Counts by a tokenizer file of ranks (T11): lines of a base64 token and its rank, as tiktoken reads them, and the vocabulary's own
    pattern of pre-tokens (PATTERNS has some by name)."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding(name="given", pat_str=PATTERNS.get(pattern, pattern), mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def token_counts(texts: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """texts with n_tokens, counted in tasks (T11); a null text has none. The file of ranks goes to the executors once."""
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    sent = texts.sparkSession.sparkContext.broadcast((ranks, PATTERNS.get(pattern, pattern)))

    @F.pandas_udf("long")
    def count(column: pd.Series) -> pd.Series:
        import tiktoken

        ranks, pattern = sent.value
        encoding = tiktoken.Encoding(name="given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return column.map(lambda t: len(encoding.encode_ordinary(t or "")))

    return texts.withColumn("n_tokens", count(text))


def estimated_tokens(text: Column) -> Column:
    """Tokens by a rule of thumb, where no tokenizer is at hand: one for every four characters."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def compress(docs: DataFrame, most: int, offset: int = 0, batch: str = "batch", count: Callable[[str], int] | None = None) -> DataFrame:
    """(batch, title, content) trimmed from the ends until each batch's tokens fit most - offset - 1000.

    A round takes max(10, ceil(4 * excess / documents with over 10 characters)) characters from each of those, or all
    that it has; there are 1000 rounds at most. A batch is one prompt's documents."""
    limit = most - offset - SPARE_TOKENS
    count = count or (lambda s: math.ceil(len(s) / CHARS_PER_TOKEN))

    def trim(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame.content.fillna("").tolist()
        titles = frame.title.fillna("").tolist()
        for _ in range(MOST_ROUNDS):
            excess = sum(count(f"{a}\n{b}") for a, b in zip(titles, texts)) - limit
            open_ = [i for i, t in enumerate(texts) if len(t) > LEAST_TRIM]
            if excess <= 0 or not open_:
                break
            cut = max(LEAST_TRIM, math.ceil(CHARS_PER_TOKEN * excess / len(open_)))
            for i in open_:
                texts[i] = texts[i][:-cut] if len(texts[i]) > cut else ""
        return frame.assign(content=texts)

    return docs.select(batch, "title", "content").groupBy(batch).applyInPandas(trim, f"{batch} {dict(docs.dtypes)[batch]}, title string, content string")


def range_join(spans: DataFrame, low: str, width: int, values: DataFrame, value: str) -> DataFrame:
    """The rows of spans and values with whole numbers low <= value <= low + width, as an equal join: a span has a row for each number that it
    covers and that is a value at all, so the work goes with the matches and not with the pairs."""
    covered = spans.withColumn("_at", F.explode(F.sequence(F.col(low).cast("long"), F.col(low).cast("long") + width)))
    covered = covered.join(values.select(F.col(value).cast("long").alias("_at")).distinct(), "_at", "left_semi")
    covered = F.broadcast(covered) if covered.count() <= BROADCAST_SPANS else covered
    return values.withColumn("_at", F.col(value).cast("long")).join(covered, "_at").drop("_at")
