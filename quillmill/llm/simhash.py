"""SimHash near-duplicates by multi-index hashing.

Equal fingerprints are one entry. Each entry lies in a table under both 32-bit halves of its fingerprint. Two
fingerprints within 3 bits have a half in which they differ by one bit at most, so every entry looks up the ball of
radius one around each of its halves (only the half's zero bits are flipped: the other of the two does the rest),
and whole distances are verified.

Texts that are alike to 0.8 or more are some 10 bits apart, up to 20 (see ``decontam``), and so near lie two in a
thousand of all pairs of unlike fingerprints: a multi-index of that radius would look up a square of the input.
``similar_groups`` therefore takes what the multi-index finds within three bits first, and widens it by bands of min-hashes of the same
shingles: texts that share a band, are not tied yet and have fingerprints within WIDE bits are compared as well. All ties are verified by the exact similarity of
sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import hand_back, settle, slices, small_batches

SHINGLE, RADIUS, SEED = 3, 3, 42
HALF = 0xFFFFFFFF
#: Words of a shingle and similarity of sets of shingles from which texts are near copies.
SIMILAR_SHINGLE, LEAST_SIMILARITY = 5, 0.8
#: Bands of so many min-hashes each: of the pairs at similarity 0.8, 7 in 100,000 share none; further up fewer.
BANDS, ROWS = 24, 5
#: Bits within which fingerprints of texts that share a band lie if the texts may be similar: at similarity 0.8 they differ in 9.7 on average with a deviation of 2.9.
WIDE = 22
#: Texts of a band, and shingles of them, that are compared with each other at once; a larger band is split into blocks.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Texts with candidates that may be broadcast, an id and a hash each.
BROADCAST_TEXTS = 200_000


def runs_of_words(text: str, shingle: int) -> list[bytes]:
    """A text's word shingles, A-Z lower-cased; the whole text if it is shorter, none if there is no word."""
    words = text.encode().lower().split()  # of bytes: splits at and lowers ASCII only
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, A-Z lower-cased; 0 if there is no word."""
    return simhash_of(shingle_hashes(text, shingle))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.array([one(s, SEED) for s in runs_of_words(text, shingle)], np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 of none."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, same, fp) of every document; same is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t or "", shingle) for t in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.view(np.int64))], names=["doc_id", "same", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(run, "doc_id long, same long, fp long")


def links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): all pairs of different fingerprints ``fp`` of entries within ``radius`` bits, 3 at most; some of them twice."""
    if radius > 3:
        raise ValueError("balls of radius one around two halves reach 3 bits")
    halves = F.array(F.col("fp").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("fp", 32) + F.lit(1 << 32))
    table = entries.select(F.col("fp").alias("b"), F.explode(halves).alias("key"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    ball = F.transform(F.sequence(F.lit(-1), F.lit(31)), lambda i: F.when(i < 0, F.col("key")).when(F.col("key").bitwiseAND(bit(i)) == 0, F.col("key").bitwiseOR(bit(i))))
    near = entries.select(F.col("fp").alias("a"), F.explode(halves).alias("key"))
    near = near.select("a", F.col("key").alias("own"), F.explode(F.filter(ball, lambda k: k.isNotNull())).alias("key"))
    found = near.join(table, "key").where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & ((F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))))
    return found.select("a", "b").where("a <> b")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, same, fp, component_id, head) of every document: the smallest doc_id reachable over links, and (no_id, id, same) of the one that stands for the group.

    Links join documents whose fingerprints differ in ``radius`` bits or fewer. Null and empty texts have fingerprint 0 and
    link like any other. A null doc_id is never the smallest unless its group has no other; repeated rows and doc_ids
    are documents each. An empty table gives an empty result. Other columns of docs are not read."""
    own = settle(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("same"))).alias("head")
    entries = settle(own.groupBy("fp").agg(first), "entries")
    tied = components(links(entries, radius))
    root = F.coalesce("component", "fp").alias("root")
    entries = entries.join(tied, entries.fp == tied.node, "left").select("fp", "head", root)
    heads = entries.groupBy("root").agg(F.min("head").alias("head"))
    of_fp = entries.select("fp", "root").join(heads, "root").select("fp", "head")
    return own.join(of_fp, "fp").select("doc_id", "same", "fp", F.col("head.id").alias("component_id"), "head")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id of every document."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The different hashes of a text's word shingles, in order."""
    return np.unique(shingle_hashes(text, shingle))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set's bands; none of an empty set."""
    import xxhash

    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    salt, factor = rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    factor |= np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        for i in range(BANDS * ROWS):
            least[i] = min(least[i], ((part ^ salt[i]) * factor[i]).min())
    raw = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(raw[i].tobytes(), i) for i in range(BANDS)]


def shingled(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, same, node, n, fp, bands) of every document; node is a hash of its set of shingles, n the set's size, fp the fingerprint."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                every = [shingle_hashes(t or "", shingle) for t in part.column(2).to_pylist()]
                sets = [np.unique(h) for h in every]
                node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in ([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], [simhash_of(h) for h in every]))
                keys = pa.array([np.array(bands(s), np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), node, pa.array(list(map(len, sets)), pa.int64()), fp, keys], names=["doc_id", "same", "node", "n", "fp", "bands"])
        hand_back()

    return docs.select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(run, "doc_id long, same long, node long, n long, fp long, bands array<long>")


def sets_of(docs: DataFrame, heads: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the documents that heads (head.no_id, head.id, head.same) name, a row each node."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t or "", shingle) for t in part.column(0).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = settle(_named(heads).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    texts = _keyed(docs, F.col("text").alias("_text")).join(wanted, KEY, "left_semi").dropDuplicates(KEY).select("_text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _blocks(members: DataFrame) -> DataFrame:
    """members (key, node, n, ...) in blocks (i, j): a band of up to BLOCK texts with up to BLOCK_SHINGLES shingles is one; a larger one is split and each two of its parts meet."""
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = members.join(members.groupBy("key").agg(parts.alias("parts")), "key")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return sized.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")


def _may(k: int, fp: np.ndarray, n: np.ndarray, to: np.ndarray, part: np.ndarray, least: float) -> np.ndarray:
    """The texts of a block that may be similar to text k: of other components and, in a split block, another part, of like sizes, with near fingerprints."""
    good = (to != to[k]) & (np.bitwise_count(fp ^ fp[k]) <= WIDE) & (np.minimum(n, n[k]) >= least * np.maximum(n, n[k]) - 1e-9)
    if part.min() != part.max():
        return np.flatnonzero(good & (part != part[k]))
    return np.flatnonzero(good)


def _each_block(blocks: DataFrame, columns: list[str], of_block, schema: str) -> DataFrame:
    """What ``of_block`` makes of each block's table; a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if now is not None and tuple(keys[:, a]) != now:
                    yield from of_block(pa.Table.from_batches(rest).combine_chunks())
                    rest = []
                now = tuple(keys[:, a])
                rest.append(batch.slice(a, b - a))
        if rest:
            yield from of_block(pa.Table.from_batches(rest).combine_chunks())

    keys = ["key", "i", "j"]
    return blocks.select(columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _waiting(blocks: DataFrame, least: float) -> DataFrame:
    """The rows of blocks whose text may be similar to another of the block, by their fingerprints alone."""
    columns = ["key", "i", "j", "node", "n", "fp", "to", "part"]

    def of_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n, fp, to, part = (table.column(c).to_numpy() for c in ("n", "fp", "to", "part"))
        some = [k for k in range(len(n)) if len(_may(k, fp.view(np.uint64), n, to, part, least))]
        if some:
            yield from table.take(pa.array(some)).to_batches()

    return _each_block(blocks, columns, of_block, "key long, i int, j int, node long, n long, fp long, to long, part int")


def _ties(sets: list[np.ndarray], fp: np.ndarray, to: np.ndarray, part: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of a block: pairs of components ``to`` that a pair of texts at similarity ``least`` or more ties, without circles."""
    sizes = np.array(list(map(len, sets)))
    starts = np.cumsum(sizes) - sizes
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    mark = np.zeros(len(times), np.int32)
    now, pairs = to.copy(), []
    for k in range(len(sets)):
        others = _may(k, fp, sizes, now, part, least)
        others = others[others > k]
        if not len(others):
            continue
        own = at[starts[k] : starts[k] + sizes[k]]
        mark[own] = 1
        if 8 * len(others) > len(sets):
            both = np.add.reduceat(mark[at], starts)[others]
        else:
            both = np.array([mark[at[starts[j] : starts[j] + sizes[j]]].sum() for j in others])
        mark[own] = 0
        for j in others[both >= least * (sizes[others] + sizes[k] - both) - 1e-9]:
            if now[j] != now[k]:
                pairs.append((int(to[k]), int(to[j])))
                now[now == now[j]] = now[k]
    return pairs


def _across(blocks: DataFrame, least: float) -> DataFrame:
    """(a, b): components that some block ties; blocks have the texts' shingles."""
    columns = ["key", "i", "j", "fp", "to", "part", "shingles"]

    def of_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        fp, to, part = (table.column(c).to_numpy() for c in ("fp", "to", "part"))
        shingles = table.column("shingles").combine_chunks()
        shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
        sets = [x.values.to_numpy() for x in shingles]
        if pairs := _ties(sets, fp.view(np.uint64), to, part, least):
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _each_block(blocks, columns, of_block, "a long, b long")


def _multi_index(entries: DataFrame, least: float) -> DataFrame:
    """(a, b): texts of equal fingerprints, and of those within RADIUS bits one pair for each fingerprint; like in size."""
    fps = settle(entries.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("one")), "fps")
    near = links(fps.select("fp")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).groupBy("y").agg(F.min("x").alias("x"))
    of = lambda fp, name: fps.select(F.col("fp").alias(fp), F.col("one").alias(name))
    pairs = near.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b")
    equal = entries.join(fps, "fp").select(F.col("one").alias("a"), F.struct("node", "n").alias("b"))
    found = pairs.unionByName(equal).where("a.node <> b.node AND least(a.n, b.n) >= %r * greatest(a.n, b.n) - 1e-9" % least)
    return found.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``least`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs")), "b").join(sets.select(F.col("node").alias("a"), "shingles"), "a")
    both = both.select("a", "b", F.size(F.array_intersect("shingles", "theirs")).alias("both"), (F.size("shingles") + F.size("theirs")).alias("sum"))
    return both.where(F.col("both") >= least * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b")


def similar_groups(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_id, same, node, component_id, head) as ``groups`` has them, of links between documents whose sets of shingles have a Jaccard similarity of ``least`` or more.

    Texts without a word are alike. First the pairs of the multi-index are compared, and in each band that several share all with the one that shares most
    bands with most texts, the middle of a group of copies. Where that leaves several components in a band, texts of different ones
    with near fingerprints are compared, in blocks that give ties and no pairs. Ids and fingerprints meet first, and only texts that have
    a near fingerprint in their block bring their shingles. So a group of copies never becomes rows of pairs, though comparing
    texts that share a band and are not tied goes with the square of their number."""
    with small_batches(docs.sparkSession):
        own = settle(shingled(docs, shingle), "shingled")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("same"))).alias("head")
        entries = settle(own.groupBy("node").agg(first, F.max("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "entries")
        keys = entries.select("node", "n", "fp", F.explode("bands").alias("key"))
        members = settle(keys.join(keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "key"), "members")
        central = members.join(members.groupBy("node").agg(F.sum("many").alias("met")), "node")
        top = central.groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("top"))
        crowded = settle(members.drop("many").join(top, "key"), "crowded")
        star = crowded.where("node <> top.node AND least(n, top.n) >= %r * greatest(n, top.n) - 1e-9" % least).select(F.col("top.node").alias("a"), F.col("node").alias("b"))
        star = settle(star.unionByName(_multi_index(entries, least)).distinct(), "star")
        nodes = crowded.select("node").unionAll(star.select("a")).unionAll(star.select("b")).distinct()
        sets = settle(sets_of(docs, entries.select("node", "head").join(nodes, "node"), shingle), "sets")
        tied = settle(components(_similar(star, sets, least)), "tied")
        to = F.coalesce("component", "c.node").alias("to")
        placed = crowded.alias("c").join(tied.alias("t"), F.expr("c.node = t.node"), "left").select("c.node", "n", "fp", "key", to)
        several = placed.groupBy("key").agg(F.min("to").alias("lo"), F.max("to").alias("hi")).where("lo <> hi").select("key")
        rest = settle(placed.join(several, "key"), "rest")
        more = _across(settle(_waiting(_blocks(rest), least), "waiting").join(sets, "node"), least)
        tied = components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)).withColumnRenamed("node", "at")
    entries = entries.join(tied, F.col("node") == F.col("at"), "left").select("node", "head", F.coalesce("component", "node").alias("root"))
    heads = entries.groupBy("root").agg(F.min("head").alias("head"))
    of_node = entries.select("node", "root").join(heads, "root").select("node", "head")
    return own.select("doc_id", "same", "node").join(of_node, "node").select("doc_id", "same", "node", F.col("head.id").alias("component_id"), "head")


KEY = ["_no_id", "_id", "_same"]


def _named(heads: DataFrame) -> DataFrame:
    return heads.select("head.*").select(F.col("no_id").alias("_no_id"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("same").alias("_same"))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("text").alias("_same"))


def _standing(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are heads of grouped, one of each."""
    heads = _named(grouped.select("head").distinct())
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row")
    return _keyed(docs, row).join(heads, KEY, "left_semi").dropDuplicates(KEY).select("_row.*")


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that stand for their groups: one of each, the one with the smallest doc_id.

    Of rows with this doc_id it is the one whose text has the smallest hash; of equal rows one stays. Null and empty texts are
    alike and form one group. A row without a doc_id stands only for a group in which none has one. An empty table gives an
    empty result; columns of any name are passed on."""
    return _standing(docs, groups(docs, shingle, radius))


def keep_one_similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The same for the groups of similar texts; texts without a word, null ones among them, are one group."""
    return _standing(docs, similar_groups(docs, shingle, least))
