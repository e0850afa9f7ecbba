"""Connected components of a graph given as a table of edges, by alternating stars.

Each round is two joins and aggregations; between rounds the edges are written to the shared folder. Nothing but
counts comes to the driver. Every task first reduces its own edges to a spanning forest, so that dense groups shrink
before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Edges that a task looks at together when it drops those that close a circle.
FOREST = 1_000_000
SCHEMA = "a long, b long"


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees, in the order given."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def local_forests(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task leaves out those that close a circle among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, int]] = []
        read = 0
        for batch in batches:
            kept = forest([*kept, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
            read += batch.num_rows
            if len(kept) > FOREST:
                yield _table(kept)
                kept = []
        if kept:
            yield _table(kept)

    return edges.select("a", "b").where("a <> b").mapInArrow(run, SCHEMA)


def _table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b), longs; the component is its smallest node.

    Repeated edges, both directions and edges from a node to itself are fine. No edges: an empty table."""
    now = settle(local_forests(edges), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if new == mark or not new[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = new
        now = settle(_small_star(_large_star(now)), "edges")
