"""Repair of conversations by cheapest edits: shortest paths with a queue of buckets.

A repaired conversation's roles are ``(system? (user assistant)+)?``. A node of the graph is a place between rows and the
state of that grammar; arcs keep, rerole, delete or insert a row and cost 0 to 3, so Dial's circular buckets give all
distances to the goal in linear time. A walk over tight arcs, the first letter in the alphabet each time, is the audit.

Conversations of up to LONG rows are solved whole, each from one shuffle. Longer ones are cut into blocks that tasks solve apart: a block's
distances from each state to each state are a matrix of 16 numbers, and folding those gives every block the distances
behind it and the state it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefixtrie import crc32_sql
from .shared import settle

#: Rows up to which a conversation is solved in one piece, and rows of a block of a longer one.
LONG = 4096
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant row, and its role.
NEXT = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cost to the goal behind the last row: open exchanges are closed with inserted rows.
GOAL = [0, 4, 2, 0]
FAR = 1 << 60
INSERT = 2
WHITE = " \t\n\x0b\x0c\r"
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
PIECE = f"conv_id long, piece long, {STATS}, audit string, roles array<string>, texts array<string>"
PIECE_TYPES = [pa.int64()] * 8 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]


def _arcs(kind: int) -> list[list[tuple[str, int, int]]]:
    """For each state, the arcs over a row: letter, state behind it, cost. A kind is the initial (s, u, a, other), 4 if it must go, 8 if truncated."""
    initial, must, cut = kind & 3, kind & 4, kind >> 3
    kept = {(0, BEGUN): SYSTEM, (1, BEGUN): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}
    out = []
    for state in range(4):
        arcs = [("D", state, 3)]
        if not must:
            arcs += [("K", kept[initial, state], cut)] if (initial, state) in kept else []
            arcs += [("R", NEXT[state], 2 + cut)]
        out.append(arcs)
    return out


ARCS = [_arcs(kind) for kind in range(16)]
#: The same from behind: for each kind and state, the states before the row with their costs.
BACK = [[[(s, cost) for s in range(4) for _, t, cost in arcs[s] if t == state] for state in range(4)] for arcs in ARCS]
BEFORE_INSERT = [[s for s in range(4) if NEXT[s] == state] for state in range(4)]


def distances(kinds: list[int], goal: list[int]) -> list[int]:
    """Least costs from node 4 * place + state to the goal, which lies behind the last row at the given costs of its states."""
    n = len(kinds)
    dist = [FAR] * (4 * n + 4)
    reached = [g for g in goal if g < FAR]
    d = min(reached)
    ring = max(max(reached) - d, 4) + 1
    buckets: list[list[int]] = [[] for _ in range(ring)]
    waiting = len(reached)
    for state, g in enumerate(goal):
        if g < FAR:
            dist[4 * n + state] = g
            buckets[g % ring].append(4 * n + state)
    while waiting:
        bucket = buckets[d % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue
            place, state = node >> 2, node & 3
            before = [(4 * place - 4 + s, d + cost) for s, cost in BACK[kinds[place - 1]][state]] if place else []
            if place < n:
                before += [(4 * place + s, d + INSERT) for s in BEFORE_INSERT[state]]
            for other, cost in before:
                if cost < dist[other]:
                    dist[other] = cost
                    buckets[cost % ring].append(other)
                    waiting += 1
        d += 1
    return dist


def walk(kinds: list[int], dist: list[int], state: int) -> Iterator[tuple[str, int, int]]:
    """The cheapest edits from a state before the first row to behind the last: letter, row, state after it."""
    place = 0
    while place < len(kinds):
        node = 4 * place + state
        arcs = [("I", NEXT[state], INSERT, 4 * place), *((letter, t, cost, 4 * place + 4) for letter, t, cost in ARCS[kinds[place]][state])]
        letter, after, _, at = min(a for a in arcs if a[2] + dist[a[3] + a[1]] == dist[node])
        yield letter, place, after
        state, place = after, at >> 2


def closing(state: int) -> list[tuple[str, int, int]]:
    """The rows inserted behind the last one."""
    out = []
    while GOAL[state]:
        state = NEXT[state]
        out.append(("I", -1, state))
    return out


def apply(edits: list[tuple[str, int, int]], roles: list[str], texts: list[str]) -> tuple[str, list[str], list[str]]:
    """Audit, repaired roles and repaired texts."""
    left = [(roles[row] if letter == "K" else ROLES[state], "" if letter == "I" else texts[row]) for letter, row, state in edits if letter != "D"]
    return "".join(e[0] for e in edits), [r for r, _ in left], [t for _, t in left]


def _illegal(initials: list[int]) -> int:
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:]))


def _gaps(turns: list) -> int:
    seen = {t for t in turns if t is not None}
    return max(seen) - min(seen) + 1 - len(seen) if seen else 0


def with_faults(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key (a digest of role and text, which also settles the order of a turn's rows), initial, blank, cut; a null role or text is one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = convs.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"))
    first, stripped = F.substring("role", 1, 1), F.rtrim("text", F.lit(WHITE))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    last = F.substring(stripped, -1, 1)
    return rows.select("*", initial.alias("initial"), (stripped == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


#: Spark sorts nulls first.
ORDER = ["turn", "role", "key"]


def solve(conv: int | None, rows: list[tuple]) -> tuple:
    """A row of PIECE for a whole conversation, from its rows (turn, role, text, key, initial, blank, cut) in order."""
    seen: set[str] = set()
    kinds, faults = [], [0, 0, 0]
    for _, _, _, key, initial, blank, cut in rows:
        duplicate = key in seen
        seen.add(key)
        kinds.append(initial + 4 * (blank or duplicate) + 8 * cut)
        for fault, found in enumerate((blank, duplicate, cut)):
            if found:
                faults[fault] += 1
                break
    dist = distances(kinds, GOAL)
    edits = list(walk(kinds, dist, BEGUN))
    edits += closing(edits[-1][2] if edits else BEGUN)
    audit = apply(edits, [r[1] for r in rows], [r[2] for r in rows])
    return (conv, 0, _gaps([r[0] for r in rows]), *faults, _illegal([r[4] for r in rows]), dist[BEGUN], *audit)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE_TYPES)], names=[f.split()[0] for f in PIECE.split(", ")])


def short_pieces(rows: DataFrame) -> DataFrame:
    """Conversations of up to LONG rows, from with_faults, a row of PIECE each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out, size = None, [], [], 0
        for batch in batches:
            for this, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and this != conv:
                    out.append(solve(conv, held))
                    held = []
                conv = this
                held.append(row)
                size += len(row[2])
                if size > 1 << 22:
                    if out:
                        yield _pieces(out)
                    out, size = [], 0
        if held:
            out.append(solve(conv, held))
        if out:
            yield _pieces(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(run, PIECE)


def _same_block(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a with the columns of b for their block; conversations without an id are one too."""
    b = b.withColumnsRenamed({"conv_id": "its_conv", "block": "its_block"})
    return a.join(b, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("block") == F.col("its_block"))).drop("its_conv", "its_block")


def _matrix(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's costs from each state to each state, and its share of what is counted."""
    rows = rows.sort_values("place")
    kinds, initials = rows["kind"].tolist(), rows["initial"].tolist()
    cells = []
    for state in range(4):
        cells.append(distances(kinds, [0 if s == state else FAR for s in range(4)])[:4])
    turns = [int(t) for t in rows["turn"].dropna()]
    ends = [str(min(turns)), str(max(turns)), len(set(turns))] if turns else [None, None, 0]
    counts = [int((rows["fault"] == f).sum()) for f in (1, 2, 3)]
    return pd.DataFrame([[rows["conv_id"].iloc[0], rows["block"].iloc[0], [cells[t][s] for s in range(4) for t in range(4)], *ends, *counts, _illegal(initials), initials[0], initials[-1]]], columns=BLOCK_COLUMNS)


BLOCK = "conv_id long, block long, costs array<long>, least string, most string, turns long, blank long, duplicate long, truncated long, illegal long, first int, last int"
BLOCK_COLUMNS = [f.split()[0] for f in BLOCK.split(", ")]
BEHIND = f"conv_id long, block long, behind array<long>, piece long, final boolean, {STATS}"


def _behind(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation: the costs to the goal from its end, and its share of the counts with what meets the block before."""
    goal, out, behind = GOAL, [], []
    found = blocks.sort_values("block").to_dict("records")
    for b in reversed(found):
        behind.append(goal)
        goal = [min(int(b["costs"][4 * s + t]) + goal[t] for t in range(4)) for s in range(4)]
    most, last = None, None
    for piece, (b, vector) in enumerate(zip(found, reversed(behind))):
        gaps = 0
        if b["turns"]:
            least = int(b["least"])
            # turns between two blocks that neither has are gaps; one that both have counts once in the range and once among the turns
            gaps = int(b["most"]) - least + 1 - b["turns"] + (0 if most is None else max(0, least - most - 1))
            most = int(b["most"])
        joint = _illegal([last, b["first"]]) if last is not None else 0
        last = b["last"]
        out.append((b["conv_id"], b["block"], vector, piece, piece == len(found) - 1, gaps, b["blank"], b["duplicate"], b["truncated"], b["illegal"] + joint, goal[BEGUN] if piece == 0 else 0))
    return pd.DataFrame(out, columns=[f.split()[0] for f in BEHIND.split(", ")])


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """The state that a block ends in, for each state it may begin in."""
    rows = rows.sort_values("place")
    kinds = rows["kind"].tolist()
    dist = distances(kinds, [int(x) for x in rows["behind"].iloc[0]])
    ends = []
    for state in range(4):
        for _, _, state in walk(kinds, dist, state) if dist[state] < FAR else ():
            pass
        ends.append(state)
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "block": rows["block"].iloc[:1], "ends": [ends]})


def _entries(blocks: pd.DataFrame) -> pd.DataFrame:
    state, out = BEGUN, []
    for b in blocks.sort_values("block").to_dict("records"):
        out.append((b["conv_id"], b["block"], state))
        state = int(b["ends"][state])
    return pd.DataFrame(out, columns=["conv_id", "block", "entry"])


def _mended(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    top, kinds = rows.iloc[0], rows["kind"].tolist()
    edits = list(walk(kinds, distances(kinds, [int(x) for x in top["behind"]]), int(top["entry"])))
    if top["final"]:
        edits += closing(edits[-1][2])
    audit, roles, texts = apply(edits, rows["role"].tolist(), rows["text"].tolist())
    counts = [[top[c]] for c in ("conv_id", "piece", *(f.split()[0] for f in STATS.split(", ")))]
    return pd.DataFrame(dict(zip([f.split()[0] for f in PIECE.split(", ")], [*counts, [audit], [roles], [texts]])))


def long_pieces(rows: DataFrame) -> DataFrame:
    """Conversations of any length, from with_faults, a row of PIECE for each block of up to LONG rows; counts and costs are to be added up."""
    placed = rows.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).withColumn("place", F.monotonically_increasing_id())
    placed = settle(placed.withColumn("block", F.floor(F.col("place") / LONG)), "turns")
    first = placed.groupBy(F.col("conv_id").alias("its_conv"), F.col("key").alias("its_key")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    known = placed.join(first, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("key") == F.col("its_key")), "left")
    duplicate = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(duplicate, 2).when(F.col("cut"), 3).otherwise(0)
    kind = F.col("initial") + F.when(F.col("blank") | duplicate, 4).otherwise(0) + F.when(F.col("cut"), 8).otherwise(0)
    known = settle(known.select("conv_id", "block", "place", "turn", "role", "text", "initial", fault.alias("fault"), kind.alias("kind")), "turns")
    plain = known.drop("role", "text").withColumn("turn", F.col("turn").cast("string"))
    behind = settle(plain.groupBy("conv_id", "block").applyInPandas(_matrix, BLOCK).groupBy("conv_id").applyInPandas(_behind, BEHIND), "blocks")
    exits = _same_block(plain, behind.select("conv_id", "block", "behind")).groupBy("conv_id", "block").applyInPandas(_exits, "conv_id long, block long, ends array<int>")
    entries = exits.groupBy("conv_id").applyInPandas(_entries, "conv_id long, block long, entry int")
    told = settle(_same_block(behind, entries), "blocks")
    return _same_block(known, told).groupBy("conv_id", "block").applyInPandas(_mended, PIECE)


def _parts(convs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Short conversations' pieces, and long ones' if there are any."""
    rows = with_faults(convs)
    long = settle(convs.groupBy(F.col("conv_id").alias("its_conv")).count().where(F.col("count") > LONG).select("its_conv"), "long")
    if long.isEmpty():
        return short_pieces(rows), None
    same = F.col("conv_id").eqNullSafe(F.col("its_conv"))
    return short_pieces(rows.join(long, same, "left_anti")), long_pieces(rows.join(long, same, "left_semi"))


def repaired_turns(convs: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, piece, place in it, role, text."""
    short, long = _parts(convs)
    pieces = short.unionAll(long) if long is not None else short
    return pieces.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x")).select("conv_id", "piece", "place", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


def _said() -> Column:
    return F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")


SUMMARY = f"conv_id long, {STATS}, audit string, repaired_sha256 string"


def _whole(pieces: DataFrame) -> DataFrame:
    """Pieces of a conversation put together: counts added up, audits joined, texts hashed as they come by."""
    names = [f.split()[0] for f in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def row(found: dict) -> pa.RecordBatch:
            values = [found["conv_id"], *found["stats"], "".join(found["audits"]), found["digest"].hexdigest()]
            types = [pa.int64()] * 7 + [pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[f.split()[0] for f in SUMMARY.split(", ")])

        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now:
                        yield row(now)
                    now = {"conv_id": r["conv_id"], "stats": [0] * len(names), "audits": [], "digest": hashlib.sha256(), "any": False}
                now["stats"] = [a + r[n] for a, n in zip(now["stats"], names)]
                now["audits"].append(r["audit"])
                if r["n"]:
                    now["digest"].update((b"\n" if now["any"] else b"") + r["said"].encode())
                    now["any"] = True
        if now:
            yield row(now)

    said = pieces.select("conv_id", "piece", *names, "audit", F.size("roles").alias("n"), _said().alias("said"))
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, SUMMARY)


def repair_summaries(convs: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits' cost and audit, and the digest of what is left.

    Rows are ordered by turn, null first, then by role and digest. A null role or text is one space: such a role has no
    initial of the grammar, so it cannot be kept, nor can an empty one. Rows without conv_id are one conversation. Rows that
    repeat are duplicates. An empty table: no rows. Columns beyond conv_id, turn, role and text are not read. A long
    conversation's distances are found in blocks; its text passes through one task when it is hashed, as a stream."""
    short, long = _parts(convs)
    names = [f.split()[0] for f in STATS.split(", ")]
    found = short.select("conv_id", *names, "audit", F.sha2(_said(), 256).alias("repaired_sha256"))
    return found.unionAll(_whole(long)) if long is not None else found


def damaged(convs: DataFrame) -> DataFrame:
    """Rows with known faults, by the CRC-32 of ``conv_id:turn``: some dropped, emptied, without full stops, repeated or given to the user; nulls are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = convs.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        case.alias("case"),
    ).where("case <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_damaged(convs: DataFrame) -> DataFrame:
    """repair_summaries of the damaged rows, with zeros, an empty audit and the digest of nothing for conversations that lost every row."""
    found = repair_summaries(damaged(convs)).withColumnRenamed("conv_id", "its_conv")
    every = convs.select("conv_id").distinct()
    names = [f.split()[0] for f in STATS.split(", ")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("its_conv")), "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _oracle() -> str:
    """The same in DuckDB: all conversations go on by a row a step, with the cheapest and then least audit for each state."""
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    after = "[2, 2, 3, 2]"  # NEXT; lists begin at 1
    role = "CASE WHEN t = 2 THEN 'user:' ELSE 'assistant:' END"
    return f"""
WITH RECURSIVE cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
changed AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM cases WHERE k <> 0),
keyed AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS key, rtrim(text, {white}) AS stripped, left(role, 1) AS initial FROM changed),
numbered AS (
  SELECT *, row_number() OVER w AS pos, lag(initial) OVER w AS initial_before, stripped = '' AS blank, right(stripped, 1) NOT IN ('.', '!', '?') AS cut
  FROM keyed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key)),
placed AS (SELECT *, pos > min(pos) OVER (PARTITION BY conv_id, key) AS duplicate FROM numbered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT duplicate) AS truncated,
    count(*) FILTER (pos > 1 AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM placed GROUP BY conv_id),
steps AS (
  SELECT conv_id, 0 AS pos, 0 AS s, {{'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS best FROM counted
  UNION ALL
  SELECT conv_id, pos, t, min({{'cost': cost, 'audit': audit, 'said': said}}) FROM (
    SELECT p.conv_id, p.pos, x.cost + e.cost AS cost, x.audit || e.letter AS audit, e.t, CASE WHEN e.said IS NULL THEN x.said ELSE list_append(x.said, e.said) END AS said
    FROM (
      SELECT conv_id, pos, s, best.cost AS cost, best.audit AS audit, best.said AS said FROM steps
      UNION ALL SELECT conv_id, pos, t, best.cost + 2, best.audit || 'I', list_append(best.said, {role}) FROM (SELECT *, {after}[s + 1] AS t FROM steps)
      UNION ALL SELECT conv_id, pos, 3, best.cost + 4, best.audit || 'II', list_concat(best.said, ['user:', 'assistant:']) FROM steps WHERE s <> 2
    ) x JOIN placed p ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.pos = x.pos + 1,
    LATERAL (
      SELECT 'D' AS letter, x.s AS t, 3 AS cost, NULL AS said
      UNION ALL SELECT 'K', t, CAST(p.cut AS INT), p.role || ':' || p.text FROM (SELECT CASE WHEN p.initial = 's' AND x.s = 0 THEN 1 WHEN p.initial = 'u' AND x.s <> 2 THEN 2 WHEN p.initial = 'a' AND x.s = 2 THEN 3 END AS t) WHERE t IS NOT NULL AND NOT p.blank AND NOT p.duplicate
      UNION ALL SELECT 'R', t, 2 + CAST(p.cut AS INT), {role} || p.text FROM (SELECT {after}[x.s + 1] AS t) WHERE NOT p.blank AND NOT p.duplicate
    ) e) GROUP BY conv_id, pos, t),
ended AS (
  SELECT s.conv_id, min(CASE s.s WHEN 1 THEN {{'cost': best.cost + 4, 'audit': best.audit || 'II', 'said': list_concat(best.said, ['user:', 'assistant:'])}}
    WHEN 2 THEN {{'cost': best.cost + 2, 'audit': best.audit || 'I', 'said': list_append(best.said, 'assistant:')}} ELSE best END) AS best
  FROM steps s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.pos GROUP BY s.conv_id)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLE = _oracle()
