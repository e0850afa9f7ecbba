"""The index of vectors (R2, R8, K3): cells around centroids, written as segments and versions like the chunk index.

Centroids come from k-means over all vectors, a Spark job a round with sums per cell made in tasks. A search goes through the cells
nearest to each question, or, exactly, through every cell that can hold one of the k best: no product in a cell is larger
than the centroid's by more than the question's length times the cell's radius.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settled
from . import index

#: Rounds of k-means, and cells of the first pass of an exact search.
ROUNDS, FIRST_CELLS = 6, 2
#: Vectors of a block that is compared at once, and questions.
BLOCK = 4096
#: Relative error that sums of products in another order may have.
SLACK = 1e-9
ROW = "vec_id long, embedding array<double>, label long"


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array column without nulls, of one length."""
    flat = column.flatten() if isinstance(column, pa.ChunkedArray) else column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _rows(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Vectors that can be compared; those that are null, empty or hold null are in no list."""
    whole = "embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x))"
    label = F.col("label").cast("long") if "label" in vectors.columns else F.lit(None).cast("long")
    return vectors.where(whole).select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"), label.alias("label"))


def nearest_cells(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid next to each row, the first among equals."""
    return np.argmin((centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def train(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of up to ``cells`` cells: the vectors with the smallest hashes, moved to the means of what is next to them."""
    rows = _rows(vectors)
    spark = vectors.sparkSession
    first = rows.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(cells).collect()
    centroids = np.array([r.embedding for r in first], float)
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    cell = nearest_cells(x, sent.value)
                    np.add.at(sums, cell, x)
                    n += np.bincount(cell, minlength=len(n))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["cell", "n", "sum"])

        parts = rows.select("embedding").mapInArrow(run, "cell long, n long, sum array<double>")
        size = centroids.shape[1]
        means = parts.groupBy("cell").agg(F.array(*[F.sum(F.get("sum", F.lit(i))) / F.sum("n") for i in range(size)]).alias("mean"))
        for r in means.collect():
            centroids[r.cell] = r.mean
        sent.unpersist()
    return centroids


def _placed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """ROW with the cell of each vector and its distance from the centroid."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell = nearest_cells(x, sent.value)
                far = np.sqrt(((x - sent.value[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec_id", "embedding", "label", "cell", "far"])

    return _rows(vectors).mapInArrow(run, f"{ROW}, cell long, far double")


def _centroids(spark: SparkSession, of: dict) -> np.ndarray:
    rows = sorted(spark.read.parquet(of["centroids"]).collect(), key=lambda r: r.cell)
    return np.array([r.centroid for r in rows], float)


def build(spark: SparkSession, path: str, vectors: DataFrame, cells: int) -> dict:
    """A new version that holds these vectors (vec_id, embedding, label) alone, with centroids of their own."""
    centroids = train(vectors, cells)
    where = f"{path}/centroids/{uuid.uuid4().hex}"
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell long, centroid array<double>").write.parquet(where)
    of = index.manifest(spark, path)
    return _write(spark, path, vectors, of | {"centroids": where, "segments": []}, centroids)


def upsert(spark: SparkSession, path: str, vectors: DataFrame) -> dict:
    """Vectors that are new or replace those of the same id: a segment in the cells that they lie in; no other cell is written."""
    of = index.manifest(spark, path)
    return _write(spark, path, vectors, of, _centroids(spark, of))


def _write(spark: SparkSession, path: str, vectors: DataFrame, of: dict, centroids: np.ndarray) -> dict:
    segment = uuid.uuid4().hex
    order = Window.partitionBy("vec_id").orderBy(F.desc("embedding"), F.desc("label"))
    one = _rows(vectors).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    _placed(one, centroids).hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(f"{path}/vectors/seg={segment}")
    # a vector that comes as null or broken takes its old one away
    vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().write.parquet(f"{path}/gone/seg={segment}")
    return index.publish(spark, path, of | {"segments": [*of["segments"], segment]})


def _live(spark: SparkSession, path: str, of: dict) -> DataFrame:
    """ROW, cell and far of the newest vector of each id."""
    position = F.array_position(F.array(*map(F.lit, of["segments"])), F.col("seg"))
    read = lambda table, schema: spark.read.schema(f"{schema}, seg string").option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/seg={s}" for s in of["segments"]]).withColumn("position", position).drop("seg")
    found = read("vectors", f"{ROW}, far double, cell long")
    if len(of["segments"]) < 2:
        return found.drop("position")
    gone = read("gone", "vec_id long").groupBy("vec_id").agg(F.max("position").alias("gone_at"))
    return found.join(gone, "vec_id").where("gone_at <= position").drop("position", "gone_at")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, embedding, label, cell) in rows of up to BLOCK of one cell that lie together: cell, ids, labels and numbers as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(cell)]):
                for a in range(at, end, BLOCK):
                    part = batch.slice(a, min(BLOCK, end - a))
                    labels = [part.column(2).fill_null(0).to_numpy(), part.column(2).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)]
                    raw = [part.column(0).to_numpy().tobytes(), np.stack(labels).tobytes(), _matrix(part.column(1)).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[at])], pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], names=["cell", "ids", "labels", "numbers"])

    return rows.select(key, "embedding", "label", "cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, ids binary, labels binary, numbers binary")


def _compared(rows: DataFrame, pairs: DataFrame, k: int, filtered: bool) -> DataFrame:
    """(query_id, vec_id, score): of each block of a cell's vectors the k best for each question that goes through the cell."""
    asked = _blocks(pairs.repartition("cell"), "query_id").toDF("cell", "q_ids", "q_labels", "q_numbers")
    meeting = _blocks(rows, "vec_id").join(asked, "cell").drop("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = [batch.column(i)[r].as_py() for i in range(6)]
                ids, q_ids = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[3], np.int64)
                scores = np.frombuffer(raw[5]).reshape(len(q_ids), -1) @ np.frombuffer(raw[2]).reshape(len(ids), -1).T
                if filtered:
                    (of, has), (q_of, q_has) = (np.frombuffer(raw[i], np.int64).reshape(2, -1) for i in (1, 4))
                    scores[~((q_of[:, None] == of) & (q_has[:, None] * has == 1))] = -np.inf
                for query, row in zip(q_ids.tolist(), scores):
                    some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    some = some[np.lexsort((ids[some], -row[some]))[:k]]
                    some = some[row[some] > -np.inf]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), query)), pa.array(ids[some]), pa.array(row[some])], names=["query_id", "vec_id", "score"])

    return meeting.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, filtered: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest dot products, ties by vec_id, of each question (query_id, embedding, label).

    With ``probes`` only that many cells are gone through, those whose centroids are nearest; without, all that can matter, and the
    list is exact. With ``filtered`` only vectors of the question's label count (R8)."""
    of = index.manifest(spark, path)
    centroids = spark.sparkContext.broadcast(_centroids(spark, of))
    rows = _live(spark, path, of)
    asked = settled(_rows(queries, "query_id"), "questions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            for at in range(0, batch.num_rows if len(c) else 0, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1))
                dots = x @ c.T
                far = (c * c).sum(axis=1) - 2 * dots
                n = min(probes or len(c), len(c))
                order = np.argsort(far, axis=1, kind="stable")[:, :n]
                line = np.repeat(np.arange(len(x)), n)
                columns = [part.column(i).take(pa.array(line)) for i in range(3)]
                length = np.sqrt((x * x).sum(axis=1))
                more = [pa.array(order.ravel()), pa.array(np.tile(np.arange(n), len(x))), pa.array(dots[line, order.ravel()]), pa.array(length[line])]
                yield pa.RecordBatch.from_arrays([*columns, *more], names=["query_id", "embedding", "label", "cell", "place", "dot", "length"])

    pairs = asked.mapInArrow(run, "query_id long, embedding array<double>, label long, cell long, place long, dot double, length double")
    if probes:
        found = _compared(rows, pairs, k, filtered)
    else:
        radius = settled(rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")), "radii")
        pairs = settled(pairs.join(radius, "cell").withColumn("bound", F.col("dot") + F.col("length") * F.col("radius")), "pairs")
        found = settled(_compared(rows, pairs.where(F.col("place") < FIRST_CELLS), k, filtered), "first-cells")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") == k).select("query_id", F.col("score").alias("least"))
        rest = pairs.where(F.col("place") >= FIRST_CELLS).join(least, "query_id", "left")
        slack = SLACK * (1 + F.abs("bound") + F.col("length"))
        found = found.unionByName(_compared(rows, rest.where(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least"))), k, filtered))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", "rank", "vec_id", "score")


def written_cells(spark: SparkSession, path: str, segment: str) -> set[int]:
    """The cells that a segment has vectors in."""
    fs, where = index._folder(spark, f"{path}/vectors/seg={segment}")
    return {int(s.getPath().getName()[5:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("cell=")}
