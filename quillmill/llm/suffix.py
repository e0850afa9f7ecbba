"""Removal of long byte strings that repeat, by column-wise sorting of suffixes.

Two equal strings of SPAN bytes hold the same anchor at the same place: their GRAM-byte substring with the smallest
hash, the first among equals. So the starts in a document are cut into runs with one anchor, and only runs with equal
anchors can repeat each other; a run and the SPAN bytes behind its last start are its segment. The segments of an anchor
are a small collection, aligned at the anchor, and are sorted by the column-wise construction of a collection's
Burrows-Wheeler transform and common prefixes: one symbol of each segment is inserted a round, from the last column to the
first, and order and common prefixes of neighbours are updated from those of the round before; where they reach SPAN, the
string at that column repeats. Equal segments are inserted once, with how many they are. Aligned so, a collection has
COLUMNS rounds however long the documents are: a round for every byte of the longest document over the whole corpus, with
a pass over external files each, would be as many Spark jobs as that document has bytes. What the steps pass on lies in
files of the shared folder, which tasks read one after the other in the order of their anchors.

An anchor with more segments than one task should sort is split: its segments are cut again by longer anchors (GRAMS),
down to single strings, so that no common passage gathers in one task.

Segments count as equal by a cryptographic digest of 128 bits over their bytes (BLAKE2b); hashes that can be met by other
strings only choose anchors, where a clash costs time and no result, as the bytes themselves are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, settle, slices

#: Bytes of a string that is removed if it repeats.
SPAN = 400
#: Bytes of the anchors of a string, and of those that split the segments of a frequent anchor further.
GRAMS = (80, 200, SPAN)
#: Columns of aligned segments.
COLUMNS = SPAN - GRAMS[0] + SPAN
#: Bytes that a task looks at together, segments that it sorts together, and those of one anchor beyond which it is split.
CHUNK, SORTED, GROUP = 1 << 20, 8192, 8192
#: Hot anchors that may be broadcast.
BROADCAST_ANCHORS = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 22) - 1)
_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, and a random value for each byte."""
    if not _tables:
        n = 2 * CHUNK + SPAN + 1
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _tables.append(np.multiply.accumulate(p))
        _tables.append(np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64))
    return _tables


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sums_of(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``stretch`` gets the hash of any stretch of data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tables()[2][data] * tables()[0][: len(data)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (sums[stop] - sums[start]) * tables()[1][start]


def digests(raw: bytes, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each segment, over its bytes, where its anchor lies in it and how many starts it has, as two numbers."""
    blake = hashlib.blake2b
    view = memoryview(raw)
    found = []
    for a, b, x, y in zip(start.tolist(), stop.tolist(), (anchor - start).tolist(), (last - start).tolist()):
        h = blake(view[a:b], digest_size=16)
        h.update(b"%d:%d:%d" % (x, y, b - a))
        found.append(h.digest())
    both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def anchors(data: np.ndarray, gram: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of ``span`` bytes in data: the place of its anchor; and for each place the hash of its gram."""
    at = np.arange(len(data) - gram + 1)
    grams = stretch(sums_of(data), at, at + gram)
    least = (mixed(grams) & ~_POSITION) | at.astype(np.uint64)  # the first among equals
    places, width = span - gram + 1, 1
    while 2 * width <= places:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < places:
        least = np.minimum(least[: width - places], least[places - width :])
    return (least & _POSITION).astype(np.int64), grams


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: number of the text, hash of the anchor, its place, first and last start, and both halves of the segment's digest, for each run."""
    out = []
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def look() -> None:
        raw = b"".join(p for _, _, p in pieces)
        data = np.frombuffer(raw, np.uint8)
        size = np.array([len(p) for _, _, p in pieces])
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(pieces)), size)
        place, grams = anchors(data, GRAMS[0])
        start = np.arange(len(place))
        own = owner[: len(place)]
        stop = end - SPAN + 1  # no string reaches into the next text
        good = start < stop[own]
        cut = np.ones(len(place), bool)
        cut[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
        first = np.nonzero(cut & good)[0]
        if not len(first):
            return
        ends = np.append(np.nonzero(cut)[0], len(place))
        last = np.minimum(ends[np.searchsorted(ends, first, side="right")], stop[own[first]]) - 1
        to = np.minimum(last + SPAN, end[own[first]])
        a = place[first]
        back = np.array([at for _, at, _ in pieces])[own[first]] - (end - size)[own[first]]
        out.append((np.array([t for t, _, _ in pieces])[own[first]], grams[a].view(np.int64), a + back, first + back, last + back, *digests(raw, first, to, a, last)))

    for t, text in enumerate(texts):
        if len(text) < SPAN:
            continue
        for at in range(0, max(1, len(text) - SPAN + 1), CHUNK):
            pieces.append((t, at, text[at : at + CHUNK + SPAN - 1] if at + CHUNK + SPAN - 1 < len(text) else text[at:]))
            held += len(pieces[-1][2])
            if held >= CHUNK:
                look()
                pieces, held = [], 0
            if at + CHUNK + SPAN - 1 >= len(text):
                break
    if pieces:
        look()
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(7))


def sort_columns(rows: np.ndarray, group: np.ndarray, many: np.ndarray | None = None) -> np.ndarray:
    """The longest common prefix of the suffix of each segment at each column with that of another segment of its group.

    rows: a segment each, symbols 0 to 255, 256 where it has none. group: rising numbers. many: whether a segment stands
    for several equal ones, which have all of the suffix in common."""
    m, columns = rows.shape
    longest = np.zeros((m, columns), np.int16)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)  # common[i]: of the suffixes of order[i - 1] and order[i]
    length = np.zeros(m, np.int32)
    for c in range(columns - 1, -1, -1):
        symbol = rows[order, c].astype(np.int64)
        key = group[order] * 257 + symbol
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        new = np.zeros(m + 1, np.int32)
        same = np.nonzero((key[1:] == key[:-1]) & (symbol[moved[1:]] < 256))[0] + 1
        if len(same):
            lo, hi = moved[same - 1] + 1, moved[same] + 1  # the least common prefix on the way from one to the other
            near = hi - lo == 1
            least = np.empty(len(same), np.int32)
            least[near] = common[lo[near]]
            if not near.all():
                far = np.stack([lo[~near], hi[~near]], axis=1).ravel()
                least[~near] = np.minimum.reduceat(common, far)[::2]
            new[same] = least + 1
        order, common = order[moved], new
        longest[order, c] = np.maximum(common[:-1], common[1:])
        if many is not None:
            length = np.where(rows[:, c] < 256, length + 1, 0)
            longest[many, c] = np.maximum(longest[many, c], length[many])
    return longest


def _base(docs: DataFrame) -> DataFrame:
    """(doc_id, row, packed): a number for each row, and its text (null: empty) as compressed UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch):
                packed = [pack.compress((t or "").encode()) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["doc_id", "row", "packed"])

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return settle(numbered.mapInArrow(run, "doc_id long, row long, packed binary"), "texts")


def _runs(base: DataFrame) -> DataFrame:
    """(anchor, segment, other, row, place, lo, hi) of all runs: segment and other are a digest; starts count from the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 1024):
                number = part.column(0).to_numpy()
                t, anchor, place, first, last, *digest = runs([unpack.decompress(p) if p else b"" for p in part.column(1).to_pylist()])
                if len(t):
                    columns = [anchor, *digest, number[t], place, (first - place).astype(np.int32), (last - place).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "segment", "other", "row", "place", "lo", "hi"])

    return base.select("row", "packed").mapInArrow(run, "anchor long, segment long, other long, row long, place long, lo int, hi int")


SEGMENT = "anchor long, segment long, other long, n long, row long, place long, lo int, hi int, bytes binary"
#: Segments that are cut out of a text at once.
SLICE = 4096


def _segments(base: DataFrame, classes: DataFrame) -> DataFrame:
    """SEGMENT rows of classes (anchor, segment, other, n, row, place, lo, hi), with the bytes from each one's row."""
    by_row = classes.groupBy("row").agg(F.collect_list(F.struct("anchor", "segment", "other", "n", "place", "lo", "hi")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                raw = unpack.decompress(batch.column(1)[r].as_py())
                parts = batch.column(2)[r].values
                for at in range(0, len(parts), SLICE):  # as many as a long text has, in slices
                    anchor, segment, other, n, place, lo, hi = parts.slice(at, SLICE).flatten()
                    starts, stops = place.to_numpy() + lo.to_numpy(), place.to_numpy() + hi.to_numpy() + SPAN
                    cut = pa.array([raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())], pa.binary())
                    row = pa.array(np.full(len(n), batch.column(0)[r].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([anchor, segment, other, n, row, place, lo, hi, cut], names=[f.split()[0] for f in SEGMENT.split(", ")])

    return base.select("row", "packed").join(by_row, "row").select("row", "packed", "parts").mapInArrow(run, SEGMENT)


FOUND = "anchor long, segment long, other long, n long, row long, place long, cut array<int>"
KEYS = ["anchor", "segment", "other", "n", "row", "place"]


def spans(starts: np.ndarray, size: int) -> list[int]:
    """The maximal stretches that strings of this size at these rising starts cover: start, stop, start, stop."""
    if not len(starts):
        return []
    gap = np.nonzero(np.diff(starts) > size)[0]
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + size], axis=1).ravel().tolist()


def _compared(segments: DataFrame) -> DataFrame:
    """FOUND rows: of each segment the stretches that strings of SPAN bytes cover which its anchor's others hold too."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, lo = table.column("anchor").to_numpy(), table.column("lo").to_numpy()
        zero = SPAN - GRAMS[0]  # the column of the anchor
        rows = np.full((len(anchor), COLUMNS), 256, np.uint16)
        for r, (at, raw) in enumerate(zip((lo + zero).tolist(), table.column("bytes").to_pylist())):
            rows[r, at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
        longest = sort_columns(rows, group, table.column("n").to_numpy() > 1)
        cut, at = [], []
        for r in np.nonzero((longest >= SPAN).any(axis=1))[0]:
            at.append(r)
            cut.append(spans(np.nonzero(longest[r] >= SPAN)[0] - zero, SPAN))
        if at:
            kept = table.select(KEYS).take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns), pa.array(cut, pa.list_(pa.int32()))], names=[*KEYS, "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            rest.append(batch)
            rows += batch.num_rows
            if rows < SORTED:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            anchor = table.column("anchor").to_numpy()
            cuts = np.nonzero(anchor[1:] != anchor[:-1])[0] + 1
            at = 0
            while len(ahead := cuts[cuts > at]) and ahead[-1] - at >= SORTED:
                to = int(ahead[ahead - at >= SORTED][0])
                yield from compare(table.slice(at, to - at))
                at = to
            rest = table.slice(at).to_batches()
            rows = table.num_rows - at
        if rows:
            yield from compare(pa.Table.from_batches(rest).combine_chunks())

    return segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, FOUND)


def _cut_again(segments: DataFrame, gram: int) -> DataFrame:
    """The segments cut into runs by longer anchors, SEGMENT rows with what they were a part of: KEYS after up_."""
    fields = [(c, pa.int64()) for c in ("anchor", "segment", "other", "n", "place")] + [("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary())]
    up = [(f"up_{c}", pa.int64()) for c in KEYS]
    schema = pa.schema(fields + up)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for r in part.to_pylist():
                    data = np.frombuffer(r["bytes"], np.uint8)
                    place, grams = anchors(data, gram)
                    place = place[: r["hi"] - r["lo"] + 1]
                    first = np.nonzero(np.append(True, place[1:] != place[:-1]))[0]
                    last = np.append(first[1:], len(place)) - 1
                    to = np.minimum(last + SPAN, len(data))
                    a = place[first]
                    offset = (a + r["lo"] + (1 << 20)).astype(np.uint64)
                    anchor = mixed(grams[a] + mixed(offset + np.int64(r["anchor"]).astype(np.uint64))).view(np.int64)
                    segment, other = digests(r["bytes"], first, to, np.full(len(first), -r["lo"]), last)
                    over = {f"up_{c}": r[c] for c in KEYS}
                    for x, y, z, f, l, t in zip(anchor.tolist(), segment.tolist(), other.tolist(), first.tolist(), last.tolist(), to.tolist()):
                        out.append(over | {"anchor": x, "segment": y, "other": z, "n": r["n"], "place": 0, "lo": r["lo"] + f, "hi": r["lo"] + l, "bytes": r["bytes"][f:t]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    text = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int' if f.type == pa.int32() else 'long'}" for f in schema)
    return segments.mapInArrow(run, text)


def _resolved(segments: DataFrame, group: int, level: int = 0) -> DataFrame:
    """FOUND rows of the segments; an anchor with over ``group`` of them is split by longer anchors first."""
    hot = settle(segments.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > group).select("anchor"), "hot")
    if hot.isEmpty():
        return _compared(segments)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ANCHORS else hot
    found = _compared(segments.join(hot, "anchor", "left_anti").select(segments.columns))
    much = segments.join(hot, "anchor", "left_semi").select(segments.columns)
    if level + 1 == len(GRAMS):  # a string of SPAN bytes each: only equal ones repeat
        return found.unionAll(much.where("n > 1").select(*KEYS, F.array(F.col("lo"), F.col("lo") + SPAN).alias("cut")))
    parts = settle(_cut_again(much, GRAMS[level + 1]), "parts")
    first = F.min(F.struct("lo", "hi", "bytes")).alias("f")
    same = ["anchor", "segment", "other"]
    classes = parts.groupBy(*same).agg(F.sum("n").alias("n"), first)
    zero = F.lit(0).cast("long")
    classes = settle(classes.select(*same, "n", zero.alias("row"), zero.alias("place"), "f.lo", "f.hi", "f.bytes"), "part-classes")
    finer = _resolved(classes, group, level + 1).select(*same, "cut")
    again = parts.drop("n", "place", "lo", "hi", "bytes").join(finer, same)
    return found.unionAll(again.select(*[F.col(f"up_{c}").alias(c) for c in KEYS], "cut"))


def repeats(base: DataFrame, group: int = GROUP) -> DataFrame:
    """(row, place, cut), of texts as from _base: stretches, relative to place, of strings that start elsewhere too."""
    all_runs = settle(_runs(base), "runs")
    # Written first, so that the join may split the runs of a frequent anchor.
    several = settle(all_runs.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "shared-anchors")
    shared = settle(all_runs.join(several, "anchor", "left_semi").select(all_runs.columns), "shared-runs")
    forget(all_runs)
    first = F.min(F.struct("row", "place", "lo", "hi")).alias("first")
    same = ["anchor", "segment", "other"]
    classes = settle(shared.groupBy(*same).agg(F.count("*").alias("n"), first), "classes")
    segments = settle(_segments(base, classes.select(*same, "n", "first.*")), "segments")
    found = settle(_resolved(segments, group), "found")
    forget(segments)
    one = found.where("n = 1").select("row", "place", "cut")
    equal = shared.join(found.where("n > 1").select(*same, "cut"), same)
    return one.unionAll(equal.select("row", "place", "cut"))


def strip_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every document.

    A byte goes if some string of SPAN bytes that covers it starts anywhere else too, in this document or another;
    strings do not cross documents and are judged on the input. A null text is empty. Shorter texts keep all. Repeated
    rows are documents each and so repeat each other; null doc_ids are no less. An empty table gives an empty result; other
    columns are not read. A text of any length: anchors and segments are made and cut out in slices of it."""
    base = _base(docs)
    found = repeats(base, group).groupBy("row").agg(F.collect_list(F.struct("place", "cut")).alias("found"))
    joined = base.join(found, "row", "left").select("doc_id", "packed", "found")

    def stretches(found: list) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted((f["place"] + a, f["place"] + b) for f in found for a, b in zip(f["cut"][::2], f["cut"][1::2])):
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 64):
                out = []
                for doc, packed, found in zip(*(c.to_pylist() for c in part.columns)):
                    raw, kept, at = unpack.decompress(packed), [], 0
                    gone = stretches(found or [])
                    for a, b in gone:
                        kept.append(raw[at:a])
                        at = b
                    out.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), b"".join([*kept, raw[at:]])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.binary(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: Column) -> Column:
    return F.sha2(kept, 256)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every document."""
    return strip_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", digest(F.col("kept")).alias("kept_sha256"))
