"""Sentence ends learned from a corpus (T1): abbreviations, words that begin sentences, and words that belong together across a period.

The scores are the likelihood ratios of Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006). Counting is
one aggregation over words and one over pairs; the model is three lists, and applying it is a column expression, or joins where a list is long.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: Scores from which a word is an abbreviation, begins sentences, or a pair belongs together; chance of a period behind an abbreviation.
ABBREVIATION, STARTER, TOGETHER, ALWAYS = 0.3, 30.0, 7.88, 0.99
#: Entries up to which a list is one; a longer one stays a table.
MOST = 20_000
#: What may stand before and behind a word.
OPENING, CLOSING = r"^[\"'“‘«(\[{]+", r"[\"'”’»)\]},;:]+$"
#: What a text is cut into: up to a sentence's last mark with the white space behind it, or what is left.
PIECE = r"(?s).*?[.!?][\"'”’»)\]}]*\s+|.+"
BLANKS = " \t\n\x0b\x0c\r"


class Ends(NamedTuple):
    """Abbreviations without their period; words that begin sentences; pairs of words with a period between them, joined by a blank.

    Each is whole: a list, or a table (entry, score) if it has more than MOST entries."""

    abbreviations: list[str] | DataFrame
    starters: list[str] | DataFrame
    together: list[str] | DataFrame


def _words(text: Column) -> Column:
    """Words as they are; a text without any has an empty one."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), r"\s+")


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, OPENING, ""), CLOSING, "")


def _type(word: Column) -> Column:
    """A word in lower case without its period; any number is ##."""
    return F.when(word.rlike(r"^[-+]?[0-9]+([.,:][0-9]+)*\.?$"), F.lit("##")).otherwise(F.regexp_replace(F.lower(word), r"\.$", ""))


def _is_initial(kind: Column) -> Column:
    return kind.rlike(r"^\p{L}$")


def _log(n: Column, p: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(n * F.log(p))


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's ratio that b stands with a more often than by chance; a, b, ab of n."""
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    rest = n - a - b + ab
    by_chance = _log(ab, p) + _log(a - ab, 1 - p) + _log(b - ab, p) + _log(rest, 1 - p)
    first = F.when(a == ab, 0.0).otherwise(_log(ab, p1) + _log(a - ab, 1 - p1))
    second = F.when(b == ab, 0.0).otherwise(_log(b - ab, p2) + _log(rest, 1 - p2))
    return -2 * (by_chance - first - second)


def _best(scored: DataFrame, least: float, tag: str) -> DataFrame:
    """All of scored (entry, score) that reach ``least``."""
    return settled(scored.where(F.col("score") >= least), tag)


def _entries(table: DataFrame) -> list[str] | DataFrame:
    return table if table.count() > MOST else [r.entry for r in table.orderBy(F.desc("score"), "entry").collect()]


def _marked(df: DataFrame, by: Column, entries: list[str] | DataFrame, name: str) -> DataFrame:
    """df with a column ``name``: whether ``by`` is one of the entries."""
    if isinstance(entries, list):
        return df.withColumn(name, by.isin(entries) if entries else F.lit(False))
    known = entries.select(F.col("entry").alias("_entry"), F.lit(True).alias("_known"))
    return df.withColumn("_by", by).join(known, F.col("_by") == F.col("_entry"), "left").withColumn(name, F.coalesce("_known", F.lit(False))).drop("_by", "_entry", "_known")


def learn(docs: DataFrame, text: str = "text") -> Ends:
    """The lists that the texts of docs teach. Null and empty texts teach nothing; an empty table gives empty lists."""
    # Words are counted as they stand, with the next one where there may be a period, before anything is looked for in them.
    beside = F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w")).alias("next"))
    raw = docs.select(_words(F.col(text)).alias("w")).select(F.explode(beside).alias("p")).select("p.w", F.when(F.contains("p.w", F.lit(".")), F.col("p.next")).alias("next"))
    raw = raw.where("w <> ''").groupBy("w", "next").agg(F.count("*").alias("n"))
    bare = raw.select(_bare(F.col("w")).alias("w"), _bare(F.col("next")).alias("next"), "n").where("w <> ''").withColumn("period", F.col("w").endswith("."))
    behind = lambda c: F.when(F.col("period"), c)
    pairs = bare.select(_type(F.col("w")).alias("a"), "period", F.col("w").endswith("..").alias("dots"), behind(_type(F.col("next"))).alias("b"), behind(F.col("next").rlike(r"^\p{Lu}")).alias("upper"), "n")
    counted = settled(pairs.groupBy("a", "period", "dots", "b", "upper").agg(F.sum("n").alias("n")), "word-pairs")
    kinds = settled(counted.groupBy("a").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("period") & ~F.col("dots"), F.col("n")).otherwise(0)).alias("with")), "words")
    whole = kinds.agg(F.sum("all").alias("n"), F.sum("with").alias("periods")).first()
    if not whole.n or not whole.periods or whole.periods == whole.n:
        return Ends([], [], [])
    n, p = F.lit(float(whole.n)), whole.periods / whole.n
    without = F.col("all") - F.col("with")
    ratio = -2 * (F.col("with") * F.log(F.lit(p)) + without * F.log(F.lit(1 - p)) - F.col("with") * F.log(F.lit(ALWAYS)) - without * F.log(F.lit(1 - ALWAYS)))
    inner = F.length(F.regexp_replace("a", r"[^.]", ""))
    letters = F.length("a") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters, -without.cast("double"))
    short = kinds.where(F.col("a").rlike(r"^\p{L}[\p{L}\p{M}]*(\.\p{L}[\p{L}\p{M}]*)*$") & (F.col("with") > 0)).select(F.col("a").alias("entry"), score.alias("score"))
    abbreviations = _best(short, ABBREVIATION, "abbreviations")
    ended = _marked(counted.where("period"), F.col("a"), abbreviations, "known").withColumn("known", F.col("known") | _is_initial(F.col("a")))
    # Words behind a period that ends a sentence, and words behind one that need not.
    breaks = ended.where(~F.col("known") & (F.col("a") != "##") & F.col("upper"))
    many = breaks.agg(F.sum("n")).first()[0] or 0
    at = breaks.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("ab"))
    begin = at.join(kinds, "a").where(F.col("a").rlike(r"^\p{L}") & (n / float(many or 1) > F.col("all") / F.col("ab")))
    starters = _best(begin.select(F.col("a").alias("entry"), _ratio(F.lit(float(many or 1)), F.col("all").cast("double"), F.col("ab").cast("double"), n).alias("score")), STARTER, "starters")
    near = ended.where((F.col("known") | (F.col("a") == "##")) & F.col("b").rlike(r"^\p{L}")).groupBy("a", "b").agg(F.sum("n").alias("ab"))
    near = near.join(kinds.select("a", F.col("all").alias("na")), "a").join(kinds.select(F.col("a").alias("b"), F.col("all").alias("nb")), "b").where((F.col("ab") > 1) & (n / F.col("na") > F.col("nb") / F.col("ab")))
    near = near.join(starters.select(F.col("entry").alias("b")), "b", "left_anti")
    pair = F.concat_ws(" ", "a", "b").alias("entry")
    together = _best(near.select(pair, _ratio(F.col("na").cast("double"), F.col("nb").cast("double"), F.col("ab").cast("double"), n).alias("score")), TOGETHER, "together")
    return Ends(*map(_entries, (abbreviations, starters, together)))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, wherever f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.trim(F.coalesce(text, F.lit(""))), F.lit(PIECE), F.lit(0))


def _boundaries(pieces: Column) -> Column:
    """For each piece but the last its last word and the next one's first (word, next), their types (a, b), and whether the next has a capital or a number."""
    last = lambda p: F.regexp_extract(F.substring_index(F.rtrim(p, F.lit(BLANKS)), " ", -1), r"(?s)^(?:.*\s)?(.*)$", 1)
    first = lambda p: F.regexp_extract(p, r"^\S*", 0)
    words = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: F.struct(_bare(last(p)).alias("word"), _bare(first(F.get(pieces, i + 1))).alias("next")))
    return F.transform(words, lambda x: F.struct(x["word"].alias("word"), x["next"].alias("next"), _type(x["word"]).alias("a"), _type(x["next"]).alias("b"), x["next"].rlike(r"^[\p{Lu}\p{N}]").alias("upper")))


def _is_end(x: Callable[[str], Column], abbreviation: Column, starter: Column, together: Column) -> Column:
    """Whether a sentence ends at a boundary, whose parts x gives, by what is listed."""
    word, following, upper = x("word"), x("next"), x("upper")
    starts = upper & starter
    return (
        F.when(~word.endswith("."), F.lit(True))  # ! and ?
        .when(word.endswith(".."), upper)
        .when(together, F.lit(False))
        .when(abbreviation, starts)
        .when(_is_initial(x("a")) & upper, starts & ~following.rlike(r"^\p{Lu}\.$"))
        .when((x("a") == "##") & ~upper, F.lit(False))
        .otherwise(upper | ~following.rlike(r"^\p{Ll}"))
    )


def _put_together(pieces: Column, ends: Column) -> Column:
    """The sentences: pieces up to each of the numbers in ends, and to the last."""

    def cut(all_: Column) -> Column:
        start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(all_, j - 1) + 1)
        return F.transform(all_, lambda end, j: F.btrim(F.array_join(F.slice(pieces, start(j) + 1, end - start(j) + 1), ""), F.lit(BLANKS)))

    return F.filter(_bound(F.concat(ends, F.array(F.size(pieces) - 1)), cut), lambda s: s != "")


def sentences(text: Column, ends: Ends) -> Column:
    """The sentences of a text, without the white space around them. A null text has none. Of ends that have tables ``with_sentences`` gives them."""
    if not all(isinstance(e, list) for e in ends):
        raise ValueError("lists of this length are joined, see with_sentences")
    listed = lambda x, some: x.isin(some) if some else F.lit(False)

    def found(pieces: Column) -> Column:
        end = lambda x: _is_end(x.getField, listed(x["a"], ends.abbreviations), listed(x["b"], ends.starters), listed(F.concat_ws(" ", x["a"], x["b"]), ends.together))
        return _put_together(pieces, F.filter(F.transform(_boundaries(pieces), lambda x, i: F.when(end(x), i)), lambda i: i.isNotNull()))

    return _bound(_pieces(text), found)


def with_sentences(docs: DataFrame, ends: Ends, text: str = "text") -> DataFrame:
    """docs with their texts' ``sentences``, by ends of any number: what is not a list is joined to the places where a sentence may end."""
    if all(isinstance(e, list) for e in ends):
        return docs.withColumn("sentences", sentences(F.col(text), ends))
    cut = settled(docs.withColumns({"_row": F.monotonically_increasing_id(), "_pieces": _pieces(F.col(text))}), "pieces")
    met = cut.select("_row", F.posexplode(_boundaries(F.col("_pieces"))).alias("_at", "x")).select("_row", "_at", "x.*")
    for by, entries, name in ((F.col("a"), ends.abbreviations, "abbreviation"), (F.col("b"), ends.starters, "starter"), (F.concat_ws(" ", "a", "b"), ends.together, "together")):
        met = _marked(met, by, entries, name)
    at = met.where(_is_end(F.col, F.col("abbreviation"), F.col("starter"), F.col("together"))).groupBy("_row").agg(F.array_sort(F.collect_list("_at")).alias("_ends"))
    whole = cut.join(at, "_row", "left").withColumn("_ends", F.coalesce("_ends", F.array().cast("array<int>")))
    return whole.withColumn("sentences", _put_together(F.col("_pieces"), F.col("_ends"))).drop("_row", "_pieces", "_ends")
