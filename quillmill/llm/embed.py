"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

Each vector is turned by pseudo-random rotations (signs, then a Hadamard transform, three times) and hashed to the
nearest corner of the cross-polytope, that is the largest coordinate and its sign; two such hashes make a table's
bucket. Beside its own bucket a vector joins those of the second nearest corner of either hash. Inside a bucket all
cosines are computed in blocks; a pair is counted in the smallest bucket that both have in common, so that it counts
once. Equal vectors are one entry with a multiplicity. Buckets are ids only: a vector is fetched once for each block that it is compared in,
and only if its bucket has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import settle

LEAST_COSINE = 0.93
#: With these, 99.97 % of pairs at the least cosine meet in some bucket (simulated, 64 dimensions).
TABLES, PROBES = 6, 3
#: Rows of a bucket that are compared with each other at once; larger buckets are split into blocks.
BLOCK = 2048
CORNERS = 1 << 16


def usable(label: str = "label", vector: str = "embedding") -> Column:
    """Whether a row can have links: a label, and a vector of finite components that are not all zero."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; the length is a power of two."""
    step = 1
    while step < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
        step *= 2
    return x


def buckets(x: np.ndarray) -> np.ndarray:
    """Of each row of x: the buckets it joins, PROBES of each table, which the number of the table is not a part of."""
    wide = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    out = np.empty((len(x), TABLES, PROBES), np.uint32)
    rows = np.arange(len(x))
    for t in range(TABLES):
        corners = []
        for h in range(2):
            signs = np.random.default_rng([t, h, wide]).choice([-1.0, 1.0], (3, wide))
            y = x
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            first = size.argmax(axis=1)
            size[rows, first] = -1
            second = size.argmax(axis=1)
            corners.append([2 * at + (y[rows, at] < 0) for at in (first, second)])
        for p, (i, j) in enumerate(((0, 0), (1, 0), (0, 1))[:PROBES]):
            out[:, t, p] = corners[0][i] * CORNERS + corners[1][j]
    return out


def numbered(joins: np.ndarray) -> np.ndarray:
    """Buckets with the number of their table, rows of TABLES times PROBES."""
    return joins.reshape(-1, TABLES, PROBES).astype(np.int64) + (np.arange(TABLES, dtype=np.int64) << 32)[:, None]


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, dtype=float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest bucket that the rows of a and b, as from buckets(), have in common."""
    both = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    return np.where(both, a, np.iinfo(np.int64).max).min(axis=(1, 2))


def linked(x: np.ndarray, joins: np.ndarray, bucket: int, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of left and one of right each (or any two where those are the same), that are linked and whose first common bucket this is."""
    found = []
    alike = left is right
    for at in range(0, len(left), 512):
        i, j = np.nonzero(x[left[at : at + 512]] @ x[right].T >= least)
        i, j = left[at + i], right[j]
        if alike:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 50_000):
            own = common(joins[i[k : k + 50_000]], joins[j[k : k + 50_000]]) == bucket
            found.append((i[k : k + 50_000][own], j[k : k + 50_000][own]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n rows, the smallest that it reaches over the pairs."""
    own = np.arange(n)
    while True:
        new = own.copy()
        np.minimum.at(new, i, own[j])
        np.minimum.at(new, j, own[i])
        new = new[new]
        if (new == own).all():
            return own
        own = new


def _hashed(entries: DataFrame) -> DataFrame:
    """entries with joins, the buckets that each joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            joins = np.empty((len(vectors), TABLES * PROBES), np.int32)
            for n in np.unique(sizes):
                some = np.nonzero(sizes == n)[0]
                joins[some] = buckets(unit([vectors[k] for k in some])).reshape(len(some), -1).view(np.int32)
            yield batch.append_column("joins", pa.array(list(joins), pa.list_(pa.int32()))) if len(vectors) else pa.RecordBatch.from_pylist([], schema=batch.schema.append(pa.field("joins", pa.list_(pa.int32()))))

    return entries.mapInArrow(run, ", ".join([*(f"{c} {kind}" for c, kind in entries.dtypes), "joins array<int>"]))


def _memberships(hashed: DataFrame) -> DataFrame:
    """(node, place, bucket) for each bucket that an entry joins."""
    table = F.floor(F.col("at") / PROBES).cast("long")
    each = hashed.select("node", "place", F.posexplode("joins").alias("at", "key"))
    return each.select("node", "place", (F.call_function("shiftleft", table, F.lit(32)) + F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("bucket"))


def _blocks(members: DataFrame) -> DataFrame:
    """members in blocks (i, j): a bucket of up to BLOCK rows is one, a larger one is split and each two of its parts meet in a block."""
    sizes = members.groupBy("place", "bucket").count().where("count > 1")
    sized = members.join(sizes, ["place", "bucket"])  # a bucket of one row has no pair
    parts = F.ceil(F.col("count") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    sized = sized.withColumn("parts", parts).withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return sized.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("count", "parts", "other")


def _compare(blocks: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(node, links, root): within each block of ids, how many vectors each node links with and a node it is tied to."""

    def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The values of a column of lists one after the other, and where each list begins."""
        column = table.column(name).chunk(0)
        starts = column.offsets.to_numpy()
        return column.flatten().to_numpy(), starts - starts[0]

    def group(x: np.ndarray, n: np.ndarray, joins: np.ndarray, part: np.ndarray, bucket: int, i: int, j: int, node: np.ndarray) -> tuple | None:
        left = right = np.arange(len(n))
        if i != j:
            left, right = np.nonzero(part == i)[0], np.nonzero(part == j)[0]
        i, j = linked(unit(x), joins, bucket, left, right, least)
        if not len(i):
            return None
        links = np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n))
        some = np.nonzero(links)[0]
        return node[some].tolist(), links[some].astype(np.int64).tolist(), node[roots(len(n), i, j)[some]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            rest = yield from emit(table, False)
        if rest is not None:
            yield from emit(rest, True)

    def emit(table: pa.Table, last: bool):
        """The complete groups of the table; returns the rows of the last one, which may go on."""
        if not table.num_rows:
            return None
        table = table.combine_chunks()
        place = table.column("place").chunk(0).dictionary_encode().indices.to_numpy()
        bucket, i, j, part, n, node = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "part", "n", "node"))
        (vectors, begins), (joins, _) = lists(table, "embedding"), lists(table, "joins")
        joins = numbered(joins.view(np.uint32))
        keys = np.stack([place, bucket, i, j])
        starts = np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1, [table.num_rows]])
        out: tuple[list, list, list] = ([], [], [])
        for at, to in zip(starts[:-1] if last else starts[:-2], starts[1:] if last else starts[1:-1]):
            if to - at > 1:
                x = vectors[begins[at] : begins[to]].reshape(to - at, -1)
                if got := group(x, n[at:to], joins[at:to], part[at:to], bucket[at], i[at], j[at], node[at:to]):
                    for a, b in zip(out, got):
                        a.extend(b)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "links", "root"])
        return None if last else table.slice(starts[-2])

    keys = ["place", "bucket", "i", "j"]
    blocks = blocks.join(vectors.select("node", "n", "embedding", "joins"), "node")
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "node long, links long, root long")


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors are compared only when their labels are equal, not null, and their lengths are equal. A vector that is null,
    empty, zero, or has null or non-finite components links with nothing, equal ones neither. A null vec_id is never
    the smallest unless its component has no other; repeated rows are vectors each. An empty table gives an empty
    result; other columns are not read."""
    embedding = F.col("embedding") if dict(rows.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")  # as wide as it is given
    rows = rows.select("vec_id", F.col("label").cast("string").alias("place"), embedding.alias("embedding"), "label")
    rows = rows.withColumn("place", F.concat_ws(" ", F.size("embedding"), "place"))
    good = rows.where(usable()).select("vec_id", "place", "embedding")
    entries = good.groupBy("place", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    entries = settle(entries.withColumn("node", F.monotonically_increasing_id()), "entries")  # a node is one number from here on
    entries = settle(_hashed(entries), "vectors")
    found = settle(_compare(_blocks(_memberships(entries)), entries, least), "links")
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = entries.join(tied, "node", "left").select("node", "n", "first_id", "place", "embedding", F.coalesce("component", "node").alias("root"))
    first = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = own.join(first, "root").join(counts, "node", "left")
    own = own.select("place", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    out = good.join(own, ["place", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same in DuckDB, all pairs of a label.
ORACLE = f"""
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
), usable AS (
  SELECT * FROM good WHERE label IS NOT NULL AND list_sum([x * x FOR x IN v]) > 0
), link AS (
  SELECT a.r AS a, b.r AS b, b.vec_id FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= {LEAST_COSINE}
), reach AS (
  SELECT r AS a, r AS b FROM good UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), first AS (
  SELECT reach.a, min(good.vec_id) AS component_id FROM reach JOIN good ON good.r = reach.b GROUP BY reach.a
)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = r) AS n_links, component_id, vec_id = component_id AS kept
FROM good JOIN first ON first.a = r
"""
