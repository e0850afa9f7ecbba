"""A trie over conversations that share beginnings, merged family by family.

Conversations with one base id are a family: every member begins with turns of the base conversation and goes on with its
own. A family's rows are brought together, its members rebuilt and their small trie made in one pass over sorted rows; only
the family's combined nodes, without texts, are shuffled for the global trie. A node is known by a chained 128-bit digest
of its turns. Sums over subtrees need no walk over the tree: the smallest member of a node owns it, what a conversation
owns is the tail of its path, and so a subtree's sums are sums over members, made per family first as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Conversations of a family, and most turns that a member takes from the base conversation plus one.
FAMILY, SHARED = 5, 9
#: Conversation ids whose decimals are joined in one row before a node's ids are hashed in order.
IDS = 1024
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "base long, a long, b long, pa long, pb long, depth long, n_bytes long, before long, ended boolean, members array<long>"
COLUMNS = [f.split()[0] for f in NODES.split(", ")]


def turns(convs: DataFrame) -> DataFrame:
    """One row a turn, without its text: base, conv_id, pos (from 1), h, digest of role and text, bytes of the text; a family lies together, by pos."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = convs.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        "conv_id",
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    in_order = Window.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "key")
    placed = rows.repartition("base").withColumn("pos", F.row_number().over(in_order))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h")
    return placed.select("base", "conv_id", F.col("pos").cast("long"), h, "key", "n_bytes").sortWithinPartitions("base", "pos", "conv_id")


class Family:
    """The trie of one family, level by level; at most SHARED levels of it are held.

    Members' turns come by their place in the original conversation. A rebuilt conversation lies up to SHARED - 1 turns
    higher than its original, so a level is whole once all rows are that much further."""

    def __init__(self, base: int):
        self.base = base
        self.h: dict[int, int] = {}
        self.first: dict[int, list[tuple[bytes, int]]] = {}
        self.at: dict[int, tuple] = {}  # member to (node, parent, depth, n_bytes, before)
        self.levels: dict[int, dict[bytes, tuple]] = {}
        self.whole = 0

    def add(self, conv: int, pos: int, h: int, key: bytes, n_bytes: int) -> Iterator[tuple]:
        if pos < SHARED:
            self.h[conv] = h
            self.first.setdefault(conv, []).append((key, n_bytes))
            return
        if not self.at:
            self.rebuild()
        while self.whole <= pos - SHARED:
            yield from self.level()
        self.step(conv, key, n_bytes)

    def rebuild(self) -> None:
        shared = self.first.get(self.base, [])
        for conv, own in self.first.items():
            self.place(conv, (ROOT, None, 0, 0, 0))
            for turn in shared[: self.h[conv]] + own[self.h[conv] :]:
                self.step(conv, *turn)

    def step(self, conv: int, key: bytes, n_bytes: int) -> None:
        node, _, depth, last, before = self.at[conv]
        self.place(conv, (hashlib.blake2b(node + key, digest_size=16).digest(), node, depth + 1, n_bytes, before + last))

    def place(self, conv: int, at: tuple) -> None:
        self.at[conv] = at
        self.levels.setdefault(at[2], {}).setdefault(at[0], (at, []))[1].append(conv)

    def level(self) -> Iterator[tuple]:
        for at, members in self.levels.pop(self.whole, {}).values():
            yield self.row(at, False, members)
        self.whole += 1

    def end(self) -> Iterator[tuple]:
        if not self.at:
            self.rebuild()
        while self.levels:
            yield from self.level()
        for conv, at in self.at.items():
            yield self.row(at, True, [conv])

    def row(self, at: tuple, ended: bool, members: list[int]) -> tuple:
        node, parent, depth, n_bytes, before = at
        return (self.base, *_longs(node), *(_longs(parent) if parent is not None else (None, None)), depth, n_bytes, before, ended, members)


def _longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 8 + [pa.bool_(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=COLUMNS)


def family_nodes(convs: DataFrame) -> DataFrame:
    """The combined nodes of each family: where ``ended``, one row a conversation with the node that it ends at; else a row a node with its members.

    A task reads families one after the other and holds a few levels of one, however long its conversations are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, out = None, []
        for batch in batches:
            for base, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if family is None or base != family.base:
                    out += family.end() if family else []
                    family = Family(base)
                out += family.add(*turn)
            if len(out) > 4096:
                yield _table(out)
                out = []
        out += family.end() if family else []
        if out:
            yield _table(out)

    return turns(convs).mapInArrow(run, NODES)


def ends_digests(ends: DataFrame) -> DataFrame:
    """a, b and the SHA-256 of the ascending ids of the conversations that end there.

    Ids are joined in rows of up to IDS first, so that the task that hashes a node that very many share reads few rows."""
    conv = F.col("members")[0]
    parts = ends.groupBy("a", "b", F.floor(conv / IDS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(conv)), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, b) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield _digests(out)
        if node:
            yield _digests([(*node, digest.hexdigest())])

    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "part").mapInArrow(run, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["a", "b", "ends_sha256"])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, then by role and by digest; null role or text is the empty one. Rows that repeat
    are turns of their own. Rows without conv_id belong to no conversation and are left out. An empty table: no node, not
    even the root, as it has no member. Columns beyond conv_id, turn, role and text are not read. A conversation of any
    length is read as a stream; as each digest needs the one before, its rows (some 60 bytes each, without texts) pass
    through one task."""
    families = settle(family_nodes(convs), "families")
    nodes = settle(
        families.where("not ended")
        .groupBy("a", "b")
        .agg(*(F.min(c).alias(c) for c in ("pa", "pb", "depth", "n_bytes", "before")), F.sum(F.size("members")).alias("n_convs"), F.min(F.array_min("members")).alias("conv_id")),
        "nodes",
    )
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "nodes")

    # What a conversation owns: from which depth on, the bytes above that, and whether its end is a leaf.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"), F.min("before").alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    ends = families.where("ended")
    whole = ends.select("base", F.col("members")[0].alias("conv_id"), (F.col("depth") + 1).alias("beyond"), (F.col("before") + F.col("n_bytes")).alias("total"))
    told = whole.join(owned, "conv_id", "left").select(
        "base", "conv_id", F.struct(F.coalesce("from", "beyond").alias("from"), F.coalesce("above", "total").alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf")).alias("x")
    )
    of_family = told.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv_id", "x"))).alias("xs"))

    def over_members(value) -> F.Column:
        return F.aggregate("members", F.lit(0).cast("long"), lambda total, c: total + value(F.element_at("xs", c)))

    sums = (
        families.where("not ended")
        .join(of_family, "base")
        .select(
            "a",
            "b",
            over_members(lambda x: F.when(x["from"] > F.col("depth"), x["above"] - F.col("before")).otherwise(F.lit(0))).alias("saved"),
            over_members(lambda x: x["leaf"]).alias("leaves"),
        )
        .groupBy("a", "b")
        .agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    )
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, ["a", "b"])
        .join(ends_digests(ends), ["a", "b"], "left")
        .join(parents, ["pa", "pb"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    )


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text: each byte is followed by eight shifts, told as -1."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: list_prepend(CAST(ord(x) AS BIGINT), CAST([-1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[]))))"
    step = "CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, e: {step}), 4294967295)"


ORACLE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % {FAMILY} AND o.pos <= i.h
  UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt),
paths AS (
  SELECT conv_id, depth, strlen(text) AS n_bytes,
    sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
  FROM numbered UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM paths),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(n_bytes) AS saved FROM linked GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT x.node, y.node AS under FROM linked x JOIN linked y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
sums AS (
  SELECT b.node, sum(CASE WHEN c.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM below b JOIN nodes n ON n.node = b.under LEFT JOIN children c ON c.node = b.under GROUP BY b.node),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM linked WHERE last GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, '{EMPTY}') AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN ends e USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
