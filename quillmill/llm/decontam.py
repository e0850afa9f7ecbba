"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window of a document has as many word shingles as a benchmark item; a shorter document is one window as a whole. Its
SimHash is looked up in a multi-index of the SimHashes of all items of that size: with one block of bits more than the
radius, every fingerprint within the radius shares a block, so the blocks alone say which items a window may match.
Candidates are verified by the exact weighted Jaccard similarity of their shingles, repeats counted.

Not every window is fingerprinted. One of w shingles that reaches the similarity t with an item of m holds at least
t(w + m) / (1 + t) shingles of items of that size, and moving it to its first such shingle loses none of them. So windows
that begin at such a shingle and hold that many are all that can match; which item they belong to is left to the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

SHINGLE, LEAST_SIMILARITY = 5, 0.8
#: Two sets of shingles at similarity 0.8 are 9.7 bits apart on average, with a deviation of 2.9.
RADIUS = 20
#: Shingles of items, and documents with candidates, that may be broadcast; beyond it joins shuffle.
BROADCAST_SHINGLES, BROADCAST_DOCS = 500_000, 200_000


def words_of(text: Column) -> Column:
    """The lower-cased words of a text: runs of letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def with_shingles(df: DataFrame, size: int) -> DataFrame:
    """df with shingles, the hashes of its ``words``' runs of ``size`` words; a shorter text has none."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # Several references to the column keep it from being computed anew for each element.
    each = lambda i: F.xxhash64(F.size("hashes") * 0 + size, *[F.get("hashes", i + k) for k in range(size)])
    n = F.size("hashes") - size
    return df.withColumn("shingles", F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), each)).otherwise(F.array().cast("array<long>"))).drop("hashes")


def with_simhash(df: DataFrame, name: str) -> DataFrame:
    """df with the SimHash of its ``shingles``, an array of 64-bit hashes: a bit is set if it is in over half of them."""
    one = F.lit(1).cast("long")

    def bit(b: Column) -> Column:
        often = F.aggregate("shingles", F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, b).bitwiseAND(one))
        return F.when(often * 2 > F.size("shingles"), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return df.withColumn(name, F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """(block, bits) of the radius + 1 blocks of a fingerprint."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    cut = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), cut(a, b).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]))


def item_shingles(benchmark: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, k, m, shingles) of the items that have a word; the shingles of an item of fewer than ``size`` words are itself."""
    words = settle(benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    parts = [with_shingles(words.where(F.size("words") == k if k < size else F.size("words") >= size), k).withColumn("k", F.lit(k)) for k in range(1, size + 1)]
    found = reduce(DataFrame.unionByName, parts)
    return settle(found.select("item_id", "k", F.size("shingles").alias("m"), "shingles"), "item-shingles")


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, same, item_id, start, similarity) of each document and item of which some window reaches ``least``.

    The window is the most similar one, the first among equals; start counts words, same is a hash of the text. Null and
    empty texts and items match nothing. A text shorter than the item is its own window, with its own length. Repeated items match each;
    repeated documents and doc_ids are told apart by text only. Empty tables give an empty result; other columns are
    not read."""
    items = item_shingles(benchmark, size)
    wide = F.least("long", "m")  # shingles of a window
    need = F.ceil((wide + F.col("m")) * (least / (1 + least)) - 1e-9).cast("int")
    of_size = items.select("k", "m", F.explode("shingles").alias("shingle")).distinct()
    of_size = _small(of_size, of_size.count(), BROADCAST_SHINGLES)
    ks = [r.k for r in items.select("k").distinct().collect()]  # 1 to size
    if not ks:
        return docs.sparkSession.createDataFrame([], "doc_id long, same long, item_id long, start int, similarity double")
    own = docs.select("doc_id", F.xxhash64("text").alias("same"), words_of(F.col("text")).alias("words"))

    def shingled(rows: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [with_shingles(rows, k).select("doc_id", "same", F.lit(k).alias("k"), "shingles") for k in ks])

    # Where shingles of items stand. The outer form: with the other, Spark derives a filter that computes all shingles a second time, the hashes anew for each.
    each = shingled(own).select("doc_id", "same", "k", F.size("shingles").alias("long"), F.posexplode_outer("shingles").alias("pos", "shingle"))
    hits = each.join(of_size, ["k", "shingle"]).groupBy("doc_id", "same", "long", "k", "m").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    hits = hits.withColumn("need", need).where(F.size("at") >= F.col("need"))
    starts = F.filter("at", lambda p, i: F.get("at", i + F.col("need") - 1) < p + F.col("m"))
    starts = hits.select("doc_id", "same", "k", "m", "long", wide.alias("wide"), F.explode(starts).alias("p"))
    start = F.greatest(F.lit(0), F.least("p", F.col("long") - F.col("m"))).alias("start")  # at a text's end the window moves back
    windows = settle(starts.select("doc_id", "same", "k", "m", "wide", start).distinct(), "windows")
    # Their fingerprints, from the documents that have some.
    found = windows.select("doc_id", "same").distinct()
    found = _small(found, found.count(), BROADCAST_DOCS)
    null_safe = docs.select("doc_id", "text").withColumn("same", F.xxhash64("text")).alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.same = f.same"), "left_semi")
    again = shingled(null_safe.dropDuplicates(["doc_id", "same"]).select("doc_id", "same", words_of(F.col("text")).alias("words")))
    w = windows.alias("w").join(again.alias("a"), F.expr("w.doc_id <=> a.doc_id AND w.same = a.same AND w.k = a.k"))
    w = w.select("w.*", F.slice("a.shingles", F.col("w.start") + 1, F.col("w.wide")).alias("shingles"))
    w = settle(with_simhash(w, "fingerprint").withColumn("window", F.monotonically_increasing_id()), "fingerprints")
    # The multi-index: blocks of bits, among items of the window's size.
    index = with_simhash(items, "theirs").select("item_id", "k", "m", "theirs", blocks("theirs", radius).alias("b")).select("item_id", "k", "m", "theirs", "b.*")
    index = _small(index, items.count() * (radius + 1), BROADCAST_SHINGLES)
    probe = w.select("window", "k", "m", "fingerprint", blocks("fingerprint", radius).alias("b")).select("window", "k", "m", "fingerprint", "b.*")
    near = probe.join(index, ["k", "m", "block", "bits"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("theirs"))) <= radius).select("window", "item_id").distinct()
    # The exact similarity of those.
    ours = w.join(near, "window").select("window", "doc_id", "same", "item_id", "start", "m", "wide", F.explode("shingles").alias("shingle"))
    ours = ours.groupBy("window", "doc_id", "same", "item_id", "start", "m", "wide", "shingle").agg(F.count("*").alias("n"))
    theirs = items.select("item_id", F.explode("shingles").alias("shingle")).groupBy("item_id", "shingle").agg(F.count("*").alias("n2"))
    shared = ours.join(theirs, ["item_id", "shingle"]).groupBy("window", "doc_id", "same", "item_id", "start", "m", "wide").agg(F.sum(F.least("n", "n2")).alias("both"))
    scored = shared.withColumn("similarity", F.col("both") / (F.col("wide") + F.col("m") - F.col("both"))).where(F.col("similarity") >= least - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return scored.groupBy("doc_id", "same", "item_id").agg(best).select("doc_id", "same", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start and similarity of the best match of each document and item."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    found = matches(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.round("best.similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item.

    Null and empty texts hold none and stay. Of rows with one doc_id only those with a text that matches go; equal rows go
    or stay together. With an empty table of items all rows stay; an empty docs gives an empty result. Columns of any name
    are passed on."""
    found = settle(matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct(), "leaks")
    found = _small(found, found.count(), BROADCAST_DOCS)
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f._id")) & (F.xxhash64("d.text") == F.col("f._same")), "left_anti")


#: The same in DuckDB, for items of at least five words.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM documents
), ds AS (
  SELECT r, doc_id, len(ws) - 4 AS long, unnest(range(0, len(ws) - 4)) AS pos, ws FROM d WHERE len(ws) >= 5
), dsh AS (
  SELECT r, doc_id, long, pos, array_to_string(ws[pos + 1 : pos + 5], ' ') AS s FROM ds
), i AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM benchmark
), ish AS (
  SELECT item_id, len(ws) - 4 AS m, array_to_string(ws[pos + 1 : pos + 5], ' ') AS s FROM (SELECT *, unnest(range(0, len(ws) - 4)) AS pos FROM i WHERE len(ws) >= 5)
), icount AS (
  SELECT item_id, m, s, count(*) AS n2 FROM ish GROUP BY ALL
), win AS (
  SELECT DISTINCT r, doc_id, item_id, m, least(long, m) AS wide, greatest(0, least(pos, long - m)) AS start FROM dsh JOIN icount USING (s)
), held AS (
  SELECT win.*, dsh.s, count(*) AS n FROM win JOIN dsh ON dsh.r = win.r AND dsh.pos >= start AND dsh.pos < start + m GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, sum(least(n, n2)) / (any_value(held.m) + any_value(wide) - sum(least(n, n2))) AS similarity
  FROM held JOIN icount USING (item_id, s) GROUP BY r, doc_id, item_id, start
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rank FROM scored WHERE similarity >= 0.8
)
SELECT doc_id, item_id, start::BIGINT AS start, round(similarity, 6) AS similarity FROM best WHERE rank = 1
"""
