"""The chunk index: chunks, packs of postings and statistics of users and threads, written as immutable segments.

A segment holds what one write brought: its chunks, their postings, the chunks of earlier segments that are gone, and how much
it changed the statistics. A manifest names the segments that make a version; it appears at once or not at all, so a
reader sees one whole version while the next is being written. Statistics are sums over segments, so a write costs
what it brings and what it takes away, and searching gives what a rebuilt index gives.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_table, tokens
from ..session import hand_back, settled, small_batches
from .retrieve import EPSILON, PACK, asked_terms, best_of, counts, gathered, packed, question_blocks

OWNER = ["user_id", "thread_id"]
KEY = [*OWNER, "chunk_id"]
#: The same in the order in which equal scores are ranked.
KEY_FOUND = ["chunk_id", *OWNER]
#: What stands for the owner of chunks without one.
NOBODY = "-"
#: Chunks of a range, which share a bound, and of a pack of ranges, which is a row of postings.
RANGE, PACKED = 64, 1024
#: Ranges of a pack that are scored for each question before the others are judged by their bounds.
FIRST_RANGES = 4
#: Keys of chunks that may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Chunks that a task hands to Python at once while packs are made.
HANDED = 128
#: How tables are written: small row groups, as a task has one in memory; as a pack has some MB, they and pages (compressed in memory) are measured each row, not each hundred.
SMALL_GROUPS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}
#: How they are read: one column after the other, as ranges read at once lie in buffers outside the heap that threads keep.
PLAIN = {"parquet.hadoop.vectored.io.enabled": "false"}
TABLES = ["chunks", "gone", "postings", "terms", "whole"]


class Conflict(RuntimeError):
    """Someone else has published the version that a write was to be; write again."""


def keep_latest(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Upsert (K3): the rows of both, of each key the newest; of equal new ones the one with the larger content."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    order = Window.partitionBy(key).orderBy("_age", *[F.desc(c) for c in old.columns if c != key])
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_age")


# Versions


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, rising."""
    fs, where = _folder(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.partition(".")[0]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version (the newest if none is named): its segments, the tables' schemas, and marks of what has been taken in."""
    known = versions(spark, path)
    if version is None and not known:
        return {"version": 0, "segments": [], "schemas": {}, "marks": {}}
    name = f"{path}/manifest/{known[-1] if version is None else version:012d}.json"
    return json.loads(spark.read.text(name, wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, new: dict) -> dict:
    """Make the version after new["version"] known (K7); Conflict if it is there already."""
    new = new | {"version": new["version"] + 1}
    name = f"{path}/manifest/{new['version']:012d}.json"
    fs, part = _folder(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(_folder(spark, name)[1]) or not fs.rename(part, _folder(spark, name)[1]):
        fs.delete(part, False)
        raise Conflict(name)
    return new


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete what the newest ``keep`` versions do not need; no write may be under way."""
    known = versions(spark, path)
    needed = {s for v in known[-keep:] for s in manifest(spark, path, v)["segments"]}
    for table in TABLES:
        fs, where = _folder(spark, f"{path}/{table}")
        for s in fs.listStatus(where) if fs.exists(where) else []:
            if s.getPath().getName().removeprefix("seg=") not in needed:
                fs.delete(s.getPath(), True)
    for v in known[:-keep]:
        fs, where = _folder(spark, f"{path}/manifest/{v:012d}.json")
        fs.delete(where, False)


# Segments


def read(spark: SparkSession, path: str, of: dict, table: str, user: str | None = None, thread: str | None = None) -> DataFrame:
    """A table over all segments of a version, of one user or thread if named; position counts the segments from 1."""
    paths = [f"{path}/{table}/seg={s}" for s in of["segments"]]
    found = spark.read.schema(f"{of['schemas'][table]}, seg string, user_id string, thread_id string").options(**PLAIN).option("basePath", f"{path}/{table}").parquet(*paths)
    for column, value in zip(OWNER, (user, thread)):
        found = found if value is None else found.where(F.col(column) == value)
    return found.withColumn("position", F.array_position(F.array(*map(F.lit, of["segments"])), F.col("seg"))).drop("seg")


def live(spark: SparkSession, path: str, of: dict, rows: DataFrame, user: str | None = None, thread: str | None = None) -> DataFrame:
    """Rows (KEY, position) whose chunk no later segment has replaced or deleted."""
    if len(of["segments"]) < 2:
        return rows
    gone = read(spark, path, of, "gone", user, thread).groupBy(*KEY).agg(F.max("position").alias("gone_at"))
    return rows.join(gone, KEY, "left").where("gone_at IS NULL OR gone_at <= position").drop("gone_at")


def chunks_of(spark: SparkSession, path: str, user: str | None = None, thread: str | None = None, version: int | None = None) -> DataFrame:
    """The chunks of a version (the newest), with their owners."""
    of = manifest(spark, path, version)
    return live(spark, path, of, read(spark, path, of, "chunks", user, thread), user, thread).drop("position")


def _write(rows: DataFrame, path: str, table: str, segment: str, sort: list, dealt: bool = False) -> str:
    """Written by owner, so that a search reads its own only; a large thread is written by several tasks. Rows that are ``dealt`` lie by owner as it is. Gives the schema."""
    laid = (rows if dealt else rows.hint("rebalance", *OWNER)).sortWithinPartitions(*OWNER, *sort)
    laid.write.options(**SMALL_GROUPS).partitionBy(*OWNER).parquet(f"{path}/{table}/seg={segment}")
    return ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c not in OWNER)


def _owned(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NOBODY)) if c in rows.columns else F.lit(NOBODY) for c in OWNER})


def _blocks(chunks: DataFrame) -> DataFrame:
    """The postings of chunks (KEY, tokens; in the order of a segment), for each pack of up to PACKED chunks of an owner that lie together."""
    most, longest = PACKED, RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in gathered(batches, most):
            owner = [batch.column(i).dictionary_encode().indices.to_numpy() for i in (0, 1)]
            new = [0, *(np.nonzero((np.diff(owner[0]) != 0) | (np.diff(owner[1]) != 0))[0] + 1).tolist(), batch.num_rows]
            for at, end in ((i, min(i + most, to)) for start, to in zip(new, new[1:]) for i in range(start, to, most)):
                part = batch.slice(at, end - at)
                chunk, term, tf, terms, lengths = counts(part.column(4))
                row = packed(part.select([2]), terms, lengths, np.arange(len(lengths)) // longest, np.stack([chunk, term, tf]))
                number = pa.array([part.column(3)[0].as_py() * 2**33 + place])
                place += 1
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), part.column(1).slice(0, 1), number, *row.columns], names=[*OWNER, "pack", *row.schema.names])
        hand_back()

    kind = dict(chunks.dtypes)["chunk_id"]
    dealt = chunks.select(*KEY, F.spark_partition_id().cast("long").alias("part"), "tokens")
    return dealt.mapInArrow(run, f"user_id string, thread_id string, pack long, ids array<struct<chunk_id:{kind}>>, {PACK}")


def _latest(chunks: DataFrame) -> DataFrame:
    """One row of each chunk: of repeated ones that with the larger text. Only chunks that are repeated are compared."""
    again = chunks.groupBy(*KEY).count().where("count > 1").select(*KEY)
    n = again.count()
    if not n:
        return chunks
    order = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("text"), *[F.desc(c) for c in chunks.columns if c not in (*KEY, "text")])
    first = lambda df: df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    if n > BROADCAST_KEYS:
        return first(chunks)
    known = F.broadcast(again.toDF(*[f"_{c}" for c in KEY]).withColumn("_again", F.lit(True)))
    named = chunks.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left").select(*chunks.columns, "_again")
    return named.where("_again IS NULL").drop("_again").unionByName(first(named.where("_again").drop("_again")))


def put(spark: SparkSession, path: str, chunks: DataFrame | None = None, gone: DataFrame | None = None, replaces: list[str] | None = None, mark: tuple[str, int] | None = None) -> dict:
    """Write a segment (K3, K4) and publish it: chunks (chunk_id, text, owner and further columns) replace those that have the same in the
    columns ``replaces`` (KEY; OWNER would be all of their owners'); the chunks ``gone`` names (KEY) are deleted. A mark (name, number) that the index already has, or a later one, is
    not taken in again. Returns the version's manifest."""
    of = manifest(spark, path)
    if mark and of["marks"].get(mark[0], -1) >= mark[1]:
        return of
    segment = uuid.uuid4().hex
    schemas = dict(of["schemas"])
    if chunks is None:
        if not of["segments"]:
            return of
        chunks = read(spark, path, of, "chunks").drop("position").limit(0)
    chunks = _latest(_owned(chunks))
    if of["segments"]:
        known = read(spark, path, of, "chunks").drop("position")
        if sorted(known.dtypes) != sorted(chunks.dtypes):
            raise ValueError(f"the index has chunks of {sorted(known.dtypes)}, not of {sorted(chunks.dtypes)}")
        chunks = chunks.select(known.columns)
    schemas["chunks"] = _write(chunks, path, "chunks", segment, [F.length("text"), F.col("chunk_id")])  # chunks of like length lie together, as their scores are alike
    alone = of | {"segments": [segment], "schemas": schemas}
    text = tokens(F.coalesce("text", F.lit("")))
    brought = read(spark, path, alone, "chunks")
    new = brought.select(*KEY, text.alias("tokens"))
    both = new.withColumn("sign", F.lit(1))
    if of["segments"]:
        old = read(spark, path, of, "chunks").select(*KEY, "position", *[c for c in replaces or [] if c not in KEY], "text")
        keys = live(spark, path, of, old.drop("text"))  # texts follow for those that leave only
        same = replaces or KEY
        leaving = keys.join(brought.select(*same).distinct(), same, "left_semi").select(*KEY)
        if gone is not None:
            leaving = leaving.unionByName(keys.join(_owned(gone).select(*KEY).distinct(), KEY, "left_semi").select(*KEY)).dropDuplicates(KEY)
    else:
        leaving = new.select(*KEY).limit(0)
    schemas["gone"] = _write(leaving, path, "gone", segment, ["chunk_id"])
    if of["segments"]:
        left = read(spark, path, alone | {"schemas": schemas}, "gone").select(*KEY)
        n = left.count()
        if n:
            leaves = live(spark, path, of, old.join(F.broadcast(left) if n <= BROADCAST_KEYS else left, KEY, "left_semi"))
            both = both.unionByName(leaves.select(*KEY, text.alias("tokens"), F.lit(-1).alias("sign")))
    df = both.select(*OWNER, "sign", F.explode(F.array_distinct("tokens")).alias("term")).groupBy(*OWNER, "term").agg(F.sum("sign").alias("df")).where("df <> 0")
    schemas["terms"] = _write(df, path, "terms", segment, ["term"])
    schemas["whole"] = _write(both.groupBy(*OWNER).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.size("tokens")).alias("length")), path, "whole", segment, [])
    with small_batches(spark, HANDED):
        schemas["postings"] = _write(_blocks(new), path, "postings", segment, ["pack"], dealt=True)
    marks = of["marks"] | ({mark[0]: mark[1]} if mark else {})
    return publish(spark, path, of | {"segments": [*of["segments"], segment], "schemas": schemas, "marks": marks})


def compact(spark: SparkSession, path: str) -> dict:
    """One segment in place of all, for readers from the next version on."""
    of = manifest(spark, path)
    if len(of["segments"]) < 2:
        return of
    part = f"{path}/_compact-{uuid.uuid4().hex}"
    alone = put(spark, part, chunks_of(spark, path))
    for table in TABLES:
        fs, where = _folder(spark, f"{path}/{table}/seg={alone['segments'][0]}")
        fs.rename(_folder(spark, f"{part}/{table}/seg={alone['segments'][0]}")[1], where)
    fs, where = _folder(spark, part)
    fs.delete(where, True)
    return publish(spark, path, of | {"segments": alone["segments"], "schemas": alone["schemas"]})


def parsed_chunks(parsed: DataFrame) -> DataFrame:
    """The chunks of parsed documents (doc_id, text, and user_id and thread_id where there are some), with their owners and indexed text."""
    by = [c for c in OWNER if c in parsed.columns]
    chunks = chunk_table(parsed)
    if by:
        chunks = chunks.join(parsed.select(*by, F.col("doc_id").alias("document_id")), "document_id")
    return chunks.withColumn("text", F.col("content"))


def reindex(spark: SparkSession, parsed: DataFrame, path: str) -> DataFrame:
    """The chunks of parsed documents in place of all that their owners have. Readers see the old ones until all is written."""
    put(spark, path, parsed_chunks(parsed), replaces=OWNER)
    return chunks_of(spark, path)


# Search


def scope_statistics(spark: SparkSession, path: str, of: dict, user: str | None = None, thread: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n, mean_length) over all that is searched: sums over segments and owners first, then idf and its floor."""
    whole = read(spark, path, of, "whole", user, thread).agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean_length"))
    df = read(spark, path, of, "terms", user, thread).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    idf = df.join(F.broadcast(whole.select("n"))).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("n")  # an aggregate without keys has one row
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    return idf, whole


class _Search:
    """The questions' terms with their weights, and the packs of postings in which they are looked for."""

    def __init__(self, spark: SparkSession, path: str, questions: DataFrame, user: str | None, thread: str | None):
        of, scope = manifest(spark, path), (user, thread)
        terms, whole = scope_statistics(spark, path, of, *scope)
        asked = asked_terms(questions).join(terms, "term").select("query_id", "term", (F.col("idf") * F.col("times")).alias("weight"))
        self.questions = question_blocks(asked, whole)
        packs = read(spark, path, of, "postings", *scope)
        place = [*OWNER, "position", "pack"]
        if len(of["segments"]) > 1:
            gone = read(spark, path, of, "gone", *scope).groupBy(*KEY).agg(F.max("position").alias("gone_at"))
            every = packs.select(*place, F.explode("ids.chunk_id").alias("chunk_id"))
            dead = settled(every.join(gone, KEY).where("gone_at > position").groupBy(*place).agg(F.collect_list("chunk_id").alias("gone"), F.count("*").alias("n")), "gone")
            few = (dead.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_KEYS
            packs = packs.join(F.broadcast(dead.drop("n")) if few else dead.drop("n"), place, "left")
        key = F.transform("ids", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), *OWNER))
        self.packs = packs.withColumn("ids", key)


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, user: str | None = None, thread: str | None = None) -> DataFrame:
    """S20, R4 over the newest version: (query_id, rank, chunk_id, score, owner) of the questions (query_id, text), over all owners or those named.

    What BM25 gives over the live chunks. Packs of postings are read once for a block of questions; a task leaves out ranges of
    chunks whose bound cannot reach a question's k best, and hands on its own k best only."""
    if not versions(spark, path):
        raise PySparkException(f"no index in {path}")
    s = _Search(spark, path, questions, user, thread)
    return best_of(s.packs, s.questions, k, KEY_FOUND, FIRST_RANGES, handed=1).select("query_id", "rank", "chunk_id", "score", *OWNER)


def search_cost(spark: SparkSession, path: str, questions: DataFrame, k: int, user: str | None = None, thread: str | None = None) -> DataFrame:
    """(query_id, postings, read): how many postings the question's terms have, and how many of them a search scores."""
    s = _Search(spark, path, questions, user, thread)
    each = best_of(s.packs, s.questions, k, KEY_FOUND, FIRST_RANGES, cost=True, handed=1)
    return each.groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))
