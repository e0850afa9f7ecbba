"""Repair of conversations and their trie against plain versions."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import pytest

from quillmill.llm import prefixtrie, repair

STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, base long, key string, piece long, n string, members string, kind string"
ROWS = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Hi!"), (1, 1, "assistant", "Hi!"), (1, None, "system", "Be kind."), (1, 9, "user", "and so"),
    (2, 3, None, None), (2, 3, "user", " \t"), (2, None, "assistant", "x?"), (2, None, "assistant", "x?"),
    (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (3, 1, "tool", "A tool."), (3, 2, "", "No role."), (3, 3, "umpire", "Out!"), (3, 4, "system", "Late."),
    (5, 0, "user", "a."), (5, 1, "assistant", "b."), (5, 2, "user", "c."), (6, 0, "user", "own."), (7, 0, "user", "w " * 50_000 + "."), (8, 0, "user", ""), (8, 1, "user", "漢字。"), (8, 2, "assistant", "é!\x0b \n"),
    (-3, 0, "user", "minus."), (10, 2**40, "assistant", "Far."), (10, 5, "user", "Near"), (11, 0, "system", "S."), (12, 0, "assistant", "first."), (12, 1, "user", "then."), (12, 2, "user", "then."),
]


@pytest.fixture(scope="module")
def odd_convs(spark):
    many = [(20 + i % 7, i // 7, ["user", "assistant", "system", "user"][i * i % 4], ["One.", "two", "Three!", "", "One."][i % 5] + str(i % 11)) for i in range(140)]
    return spark.createDataFrame([(*r, 1, "x", 1, "x", "x", "x") for r in [*ROWS, *many]], SCHEMA)


def ordered(rows):
    """conv_id to (turn, role, text) in the order that the operators state."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        out[conv].append((turn is not None, turn or 0, role, key, turn, text))
    return {c: [(t, r, x) for _, _, r, _, t, x in sorted(rs)] for c, rs in out.items()}


def plain_repair(rows):
    """All states with their least (cost, audit), from the first row on."""
    after = [2, 2, 3, 2]
    seen, faults, kinds = set(), Counter(), []
    for _, role, text in rows:
        end = text.rstrip(repair.WHITE)
        blank, again, cut = not end, (role, text) in seen, end[-1:] not in (".", "!", "?")
        seen.add((role, text))
        faults["blank" if blank else "duplicate" if again else "truncated" if cut else ""] += 1
        kinds.append((blank or again, cut))
    best = {0: (0, "", [])}

    def inserted(best):
        found = [(s, b) for s, b in best.items()]
        for s, (cost, audit, said) in best.items():
            for n in (1, 2):
                s = after[s]
                cost, audit, said = cost + 2, audit + "I", [*said, "user:" if s == 2 else "assistant:"]
                found.append((s, (cost, audit, said)))
        return {s: min(b for t, b in found if t == s) for s in {s for s, _ in found}}

    for (_, role, text), (must, cut) in zip(rows, kinds):
        found = []
        for s, (cost, audit, said) in inserted(best).items():
            found.append((s, (cost + 3, audit + "D", said)))
            if not must:
                t = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                if t is not None:
                    found.append((t, (cost + cut, audit + "K", [*said, f"{role}:{text}"])))
                t = after[s]
                found.append((t, (cost + 2 + cut, audit + "R", [*said, ("user:" if t == 2 else "assistant:") + text])))
        best = {s: min(b for t, b in found if t == s) for s in {s for s, _ in found}}
    cost, audit, said = min(b for s, b in inserted(best).items() if s in (0, 3))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def plain_damage(rows):
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case:
            text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
            yield from [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)


@pytest.mark.parametrize("long", [4096, 3, 1])
def test_repairs_as_a_plain_version(spark, odd_convs, monkeypatch, long):
    monkeypatch.setattr(repair, "LONG", long)
    rows = [tuple(r)[:4] for r in odd_convs.collect()]
    given = {c: plain_repair(rs) for c, rs in ordered([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items()}
    found = repair.repair_summaries(odd_convs).select("conv_id", *STATS).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == given and len(found) == len(given)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: nothing for c, *_ in rows} | {c: plain_repair(rs) for c, rs in ordered(plain_damage(rows)).items()}
    found = repair.repair_damaged(odd_convs).select("conv_id", *STATS).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == want and len(found) == len(want)


def test_repaired_turns_follow_the_grammar(spark, odd_convs):
    import re

    rows = repair.repaired_turns(odd_convs).collect()
    by_conv = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.piece, r.place)):
        by_conv[r.conv_id].append(r)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rs)) for rs in by_conv.values())
    for conv, r in {r.conv_id: r for r in repair.repair_summaries(odd_convs).collect()}.items():
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in by_conv[conv]).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_nothing(spark, odd_convs):
    assert repair.repair_damaged(odd_convs.limit(0)).count() == 0 and repair.repair_summaries(odd_convs.limit(0)).count() == 0


def test_distances_are_least(spark):
    for kinds in itertools.product((0, 1, 2, 3, 5, 9, 10), repeat=3):
        dist = repair.distances(list(kinds), repair.GOAL)
        assert dist[12:] == repair.GOAL
        for node in range(12):
            place, state = node >> 2, node & 3
            over = [cost + dist[4 * place + 4 + t] for _, t, cost in repair.ARCS[kinds[place]][state]]
            assert dist[node] == min([*over, 2 + dist[4 * place + repair.NEXT[state]]])


def plain_trie(rows):
    own = ordered([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None])
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(c - 5 * int(c / 5)), [])  # the remainder has the sign of c, as in SQL
        paths[c] = [(r, x) for _, r, x in base[:h] + turns[h:]]
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        ends = sorted(c for c in members if len(paths[c]) == len(node))
        childless = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        parent = min(nodes[node[:-1]]) if node else None
        n_children = sum(len(m) == len(node) + 1 for m in under)
        out.append((min(members), len(node), parent, len(members), n_children, len(childless), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def test_trie_as_a_plain_version(spark, odd_convs):
    rows = [tuple(r)[:4] for r in odd_convs.collect()]
    assert Counter(map(tuple, prefixtrie.prefix_trie(odd_convs).collect())) == plain_trie(rows)
    assert prefixtrie.prefix_trie(odd_convs.limit(0)).count() == 0


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "IDS", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 200, 5) for t in range(3)] + [(c, t, "user", f"turn {t}") for c in (1, 2, 3, 206) for t in range(40)] + [(3, 40, None, "more"), (4, 0, "user", "")]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert Counter(map(tuple, got)) == plain_trie(rows)


@pytest.mark.parametrize("operator, sql", [(repair.repair_damaged, repair.ORACLE), (prefixtrie.prefix_trie, prefixtrie.ORACLE)])
def test_sql_of_odd_conversations(spark, odd_convs, operator, sql):
    import duckdb

    con = duckdb.connect()
    con.register("conversations", odd_convs.toArrow())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    found = operator(odd_convs).select(*names).collect()
    assert Counter(map(tuple, found)) == Counter(cursor.fetchall())
