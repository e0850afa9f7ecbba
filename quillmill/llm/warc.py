"""WARC archives of pages, read back, and the capture index merged from sorted runs.

Archives are written by Spark's text sink, whose line end is the blank line that ends a WARC record; they can lie in
any store that Spark writes to. Reading an archive back gives a capture run, sorted by URL key, time and page. Runs are merged
in levels, FAN_IN of them to one: each is written before the next level reads it, so that however many archives there are, a merge has long
stretches of few runs. A level is dealt out by ranges of the key; each task merges its stretches with a tree of losers, and the
partitions of the last level, in order, are the capture histories of all URLs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, settle

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive file holds about so many bytes of payload; a reader holds one file at a time.
FILE_BYTES = 16 << 20
#: How many times the smallest page of a class of sizes the largest may be.
SIZE_CLASS = 16
#: Captures that a task merges, and runs that are merged to one.
MERGED, FAN_IN = 200_000, 64
#: Payloads of fewer bytes are always written out.
LEAST_BYTES = 0
#: Payloads that several pages have, about 60 bytes each, that may be broadcast; with more of them the pages are shuffled.
BROADCAST_PAYLOADS = 500_000
RUN = (
    "run string, seq long, url_key string, captured string, page_id long, url string, offset long, length long, "
    "record_type string, payload_bytes long, payload_digest string, refers_to long"
)


def base32(hexed: Column) -> Column:
    """The base32 form (RFC 4648) of a SHA-1 in hexadecimal: five hexadecimal digits are four of base32."""
    digits = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, captured, html, n_bytes, digest, first: first is the page that holds the payload, null for that page itself."""
    captured = F.regexp_replace(F.coalesce(F.col("captured").cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "_") if "captured" in pages.columns else F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", captured.alias("captured"), html.alias("html"))
    own = own.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    shared = own.where(F.col("n_bytes") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = settle(shared, "shared-payloads")
    if shared.count() <= BROADCAST_PAYLOADS:
        shared = F.broadcast(shared)
    own = own.join(shared, "sha", "left")
    first = F.when(F.col("first").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("first"))
    return own.withColumn("first", first).withColumn("digest", base32(F.hex("sha"))).drop("sha")


def records(roles: DataFrame) -> DataFrame:
    """One column, value: the WARC record of each row, without the blank line that ends it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n_bytes"))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return roles.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))  # a line that is null is left out


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each page to files under path, of FILE_BYTES at most on average and never over four times that, or one record that is larger.

    Pages are written by classes of size, a job each, in which the largest is at most SIZE_CLASS times the smallest (4 KB at least), so that a file
    need not be small because some page is large; equal payloads lie in one class."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    of_class = F.greatest(F.lit(0), F.floor(F.log(float(SIZE_CLASS), F.greatest(size, F.lit(1)) / 4096))).cast("int")
    classes = pages.groupBy(of_class.alias("c")).agg(F.avg(size).alias("mean"), F.max(size).alias("most")).collect()  # 5 at most, as a string has 2 GB
    for c, mean, most in [(r.c, r["mean"], r.most) for r in classes] or [(0, 0.0, 0)]:
        own = pages.where(of_class == c) if len(classes) > 1 else pages
        per_file = max(1, int(min(FILE_BYTES / (mean + 500), 4 * FILE_BYTES / (most + 500))))
        records(with_roles(own, least_bytes)).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query: what lies under one host or path sorts together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    tail = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + tail


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record, by the lengths that the records state."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = head + 4 + int(headers["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, end + 4 - at, headers, archive[head + 4 : end]
        at = end + 4


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def capture(headers: dict[str, str], block: bytes) -> tuple:
    """url key, time, page_id, url of a record, and its kind, payload size and digest and what it refers to; a stored payload is digested anew."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"damaged payload of {headers['warc-record-id']}")
    url = headers.get("warc-target-uri")
    return url_key(url or ""), headers.get("warc-date", ""), page_of(headers["warc-record-id"]), url, kind, size, digest, page_of(headers.get("warc-refers-to"))


def order(key: tuple) -> tuple:
    """A capture's place: URL key, time, page; a null page comes first."""
    return key[0], key[1], key[2] is not None, key[2] or 0


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under path: those of a file are a run, sorted and numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RUN.split(", ")]
        for batch in batches:
            for n in range(batch.num_rows):
                file = batch.column(0)[n].as_py().rpartition("/")[2]
                found = [(*capture(headers, block), at, size) for at, size, headers, block in parse(batch.column(1)[n].as_py())]
                found.sort(key=order)
                rows = [(file, i, x[0], x[1], x[2], x[3], x[8], x[9], *x[4:8]) for i, x in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RUN)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RUN.split(", ")])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that a step replays one path only."""

    LAST = (1,)

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.head = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * max(1, self.k)  # at 0 the winner; -1 beats all until every leaf has played
        for i in reversed(range(self.k)):
            self._play(i)

    def _next(self, i: int) -> tuple:
        key = next(self.runs[i], None)
        return self.LAST if key is None else (0, key)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1 or (i != -1 and self.head[other] < self.head[i]):
                self.tree[node], i = i, other
            if i == -1:
                break
            node //= 2
        if i != -1:
            self.tree[0] = i

    def __iter__(self) -> Iterator[int]:
        """The number of the run that the next smallest key comes from, until all are empty."""
        while self.k and self.head[self.tree[0]] is not self.LAST:
            i = self.tree[0]
            yield i
            self.head[i] = self._next(i)
            self._play(i)


def merge_level(runs: DataFrame, groups: int, most: int = MERGED) -> DataFrame:
    """Runs merged to ``groups`` longer ones: each is sorted, and seq rises along it. Partitions are ranges of group and key, of about ``most`` captures or fewer.

    Spark deals the ranges and puts each run's stretch side by side, spilling as it has to; a task holds its range as Arrow and of each
    stretch the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        group = table.column("group").to_numpy()
        name = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = [0, *(np.flatnonzero((np.diff(name) != 0) | (np.diff(group) != 0)) + 1).tolist(), len(name)]

        def keys(a: int, b: int) -> Iterator[tuple]:
            for at in range(a, b, 1024):
                part = table.slice(at, min(1024, b - at))
                yield from map(order, zip(*(part.column(c).to_pylist() for c in ("url_key", "captured", "page_id"))))

        merged: list[int] = []
        for g in np.unique(group):
            own = [(a, b) for a, b in zip(starts, starts[1:]) if group[a] == g]
            at = [a for a, _ in own]
            for i in LoserTree([keys(a, b) for a, b in own]):
                merged.append(at[i])
                at[i] += 1
        table = table.set_column(0, "run", pa.compute.cast(table.column("group"), pa.string())).drop_columns("group")
        base = TaskContext.get().partitionId() << 33
        for first in range(0, len(merged), 8192):
            part = table.take(pa.array(merged[first : first + 8192]))
            yield from part.set_column(1, "seq", pa.array(np.arange(first, first + part.num_rows) + base)).to_batches()

    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // most))
    dealt = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
    dealt = dealt.repartitionByRange(n, "group", "url_key", "captured", "page_id").sortWithinPartitions("group", "run", "seq")
    return dealt.mapInArrow(run, RUN)


def merge_runs(runs: DataFrame, most: int = MERGED, fan_in: int = FAN_IN) -> DataFrame:
    """All captures in global order, merged level by level; the last level's partitions lie in the order of the key."""
    left = runs.select("run").distinct().count()
    while left > fan_in:
        left = -(-left // fan_in)
        runs = settle(merge_level(runs, left, most), "runs")
    return merge_level(runs, 1, most)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives of pages, read them back, and return the merged capture index.

    A row for each page: its place in the archives and what the record says. Of pages with equal payloads the smallest
    page_id holds it and the others revisit it; rows that repeat this page_id with this payload hold it too. A null
    html is the empty payload. A null page_id never holds a payload that another page has; a null url has an empty
    key. An empty table gives an empty result; columns other than page_id, url, html and captured are not read."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path)
    return merge_runs(settle(capture_runs(spark, path), "captures"))


def page_records(pages: DataFrame) -> DataFrame:
    """What a page's record says, and its key, time and place."""
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB: the base32 digits are the hexadecimal digest's, five bits at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hexed, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p
)
SELECT page_id, payload_bytes,
  list_reduce([list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hexed, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::BIGINT, 1) FOR j IN range(4)],
    lambda x, y: x || y) FOR i IN range(8)], lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
