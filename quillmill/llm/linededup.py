"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of (hash, documents seen, owner), bucketed and sorted by hash. A new batch of documents is reduced to
its own run, merge-anti-joined with the runs so far (what they lack is owned by this batch) and added at level 0;
``FANOUT`` runs of a level are compacted into one of the next. Since all runs have the same buckets, joins and
compactions with them shuffle nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_path, scratch, settle

#: The white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
#: Keys that may be broadcast, 24 bytes each; beyond it the join shuffles.
BROADCAST_KEYS = 200_000


def keyed_lines(text: Column) -> Column:
    """An array of (h1, h2, pos): the 128-bit hash and the place of each line whose key is long enough."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n", -1)
    keys = F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(SPACE)).alias("key"), i.alias("pos")))
    long = F.filter(keys, lambda x: F.char_length(x["key"]) >= LEAST_CHARS)
    return F.transform(long, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["pos"].alias("pos")))


class LineRuns:
    """The levelled runs, tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.base = scratch(spark, "line-runs")
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.base}/{name}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, f"{self.base}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionAll, [self.spark.table(n) for n in names])
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of (doc_id, lines), lines as from keyed_lines. A hash's owner is the largest doc_id of the first batch that has it."""
        distinct = F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
        own = batch.select("doc_id", F.explode(distinct).alias("h")).groupBy("h.h1", "h.h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("owner"))
        have = [n for level in self.levels for n in level]
        if have:
            own = settle(own, "line-batch")
            new = own
            for name in have:
                new = new.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
            new = new.select("h1", "h2", "owner")
            # Counts of all, an owner only for hashes that no earlier run has.
            own = own.select("h1", "h2", "docs").join(new, ["h1", "h2"], "left").select("h1", "h2", "docs", "owner")
        self._put(self._write(own), 0)

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            for n in old:
                self._forget(n)
            self._put(merged, level + 1)

    def repeated(self, least: int = LEAST_DOCS) -> DataFrame:
        """(h1, h2, owner) of the hashes that at least so many documents have, as a table of its own."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, owner long")
        return settle(self._merged(names).where(F.col("docs") >= least).select("h1", "h2", "owner"), "line-repeats")

    def drop(self) -> None:
        """Give up all runs."""
        for n in [n for level in self.levels for n in level]:
            self._forget(n)
        self.levels = []


def kept_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """For each row of docs: row (all its columns), text (the kept lines), n_lines, n_dropped.

    A key is a line, stripped and with A-Z lower-cased. Keys of at least 20 characters in at least ``least_docs``
    documents keep their lines only in the largest doc_id that has them, all of them there; other lines stay. Null and
    empty texts are one empty line. A null doc_id ranks below all others; rows with one doc_id count as documents each
    and keep or lose a line together. An empty table gives an empty result; other columns pass through, whatever their
    names."""
    spark = docs.sparkSession
    same = F.xxhash64("text")
    keyed = docs.select("doc_id", same.alias("same"), keyed_lines(F.col("text")).alias("lines"))
    # Batches by doc_id, the largest first: a hash's first batch then has its owner.
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("at")).first()["at"] or []
    number = sum(((F.col("doc_id") <= c).cast("int") for c in cuts), F.lit(0))
    path = scratch(spark, "lines")
    keyed.where(F.size("lines") > 0).withColumn("batch", F.coalesce(number, F.lit(batches))).write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema(T.StructType([*keyed.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
    runs = LineRuns(spark)
    try:
        for b in range(batches + 1):
            part = keyed.where(F.col("batch") == b)
            if not part.isEmpty():
                runs.add(part)
        repeated = runs.repeated(least_docs)
    finally:
        runs.drop()
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    each = keyed.select("doc_id", "same", F.explode("lines").alias("l")).select("doc_id", "same", "l.*")
    lost = each.join(repeated, ["h1", "h2"]).where(F.col("owner").isNotNull() & F.coalesce(F.col("doc_id") < F.col("owner"), F.lit(True)))
    # Ids and texts that are null are brought to one side of the join by a flag beside a stand-in.
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), "_same"]
    lost = lost.withColumnRenamed("same", "_same").select(*key, "pos").groupBy("_id", "_no_id", "_same").agg(F.collect_set("pos").alias("_lost"))
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), "doc_id", same.alias("_same"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"))
    whole = whole.select("_row", "_lines", *key)
    joined = whole.join(lost, ["_id", "_no_id", "_same"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.when(F.col("_lost").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return joined.select(F.col("_row").alias("row"), kept.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept lines of every document."""
    return kept_lines(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with each text reduced to its kept lines; n_chars, where there is one, follows.

    All rows stay. Null texts become empty; nulls, ties, repeated rows and ids, empty tables and other columns are as in
    ``kept_lines``."""
    new = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {})
    return kept_lines(docs).select(*[new[n].alias(n) if n in new else F.col(f"row.`{n}`") for n in docs.columns])


#: The same in DuckDB.
ORACLE = f"""
WITH line AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), each_line AS (
  SELECT r, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM line
), keyed AS (
  SELECT *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM each_line
), repeated AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {LEAST_DOCS}
), marked AS (
  SELECT keyed.*, owner IS NOT NULL AND doc_id < owner AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
