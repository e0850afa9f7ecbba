import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillmill.llm import components, linededup, simhash, suffix


def kept_lines(rows):
    space, lower = " \t\n\x0b\x0c\r", str.maketrans(linededup.UPPER, linededup.LOWER)
    key = lambda line: line.translate(lower).strip(space)
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    owner = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = t.split("\n")
        stay = [x for x in lines if not (owner.get(key(x)) is not None and (i is None or i < owner[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def test_lines(spark, odd, none, texts):
    assert Counter(map(tuple, linededup.line_digests(odd).collect())) == kept_lines(texts)
    assert linededup.line_digests(none).count() == 0
    kept = linededup.drop_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_are_compacted(spark, fanout):
    runs = linededup.LineRuns(spark, fanout, 3)
    lines = spark.createDataFrame([(i, f"shared line number {i % 7} of these") for i in range(40)], "doc_id long, text string")
    keyed = lines.select("doc_id", linededup.keyed_lines(lines.text).alias("lines"))
    for b in range(4):
        runs.add(keyed.where(f"doc_id >= {40 - 10 * (b + 1)} AND doc_id < {40 - 10 * b}"))
        assert all(len(level) < fanout for level in runs.levels)
    assert sorted(r.owner for r in runs.repeated(3).collect()) == list(range(33, 40))


def fingerprint(text):
    words = text.translate(str.maketrans(linededup.UPPER, linededup.LOWER)).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    own = list(range(n))
    for _ in range(n):
        new = [min(own[j] for j in range(n) if linked[i][j]) for i in range(n)]
        if new == own:
            break
        own = new
    return own


def labels(own, ids):
    least = {}
    for i, r in enumerate(own):
        if ids[i] is not None:
            least[r] = min(ids[i], least.get(r, ids[i]))
    return [least.get(r) for r in own]


def test_simhash(spark, odd, none, texts):
    prints = [fingerprint(t) for _, t in texts]
    linked = [[(a ^ b).bit_count() <= 3 for b in prints] for a in prints]
    own = groups(len(texts), linked)
    want = Counter(zip((i for i, _ in texts), (f"{f:016x}" for f in prints), labels(own, [i for i, _ in texts])))
    assert Counter(map(tuple, simhash.simhash_components(odd).collect())) == want
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(own))


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60)
    prints = {int(b) for b in base} | {int(b) ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 63, (3, 3))}
    entries = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert {frozenset((r.a, r.b)) for r in simhash.links(entries).collect()} == want and want


def test_similar_texts_are_one(spark, odd, none):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for g in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
        rows.append((10 * g, " ".join(words)))
        want.add(10 * g)
        # Each edited word breaks five shingles: similarity 0.96 to 0.81, and 0.74, which stays.
        for k, edits in enumerate([1, 2, 4], 1):
            edited = list(words)
            for e in range(edits):
                edited[20 + 40 * e] = "edit"
            rows.append((10 * g + k, " ".join(edited)))
        edited = list(words)
        for e in range(9):
            edited[10 + 20 * e] = "other"
        rows.append((10 * g + 9, " ".join(edited)))
        want.add(10 * g + 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_similar(docs).collect()} == want
    assert simhash.keep_one_each(docs).count() > len(want)
    kept = simhash.keep_one_similar(odd)
    assert kept.columns == odd.columns and simhash.keep_one_similar(none).count() == 0


def test_similar_groups_by_brute_force(spark, sf_dir, odd, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((odd, texts), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        sets = [set(simhash.shingle_set(t or "").tolist()) for _, t in rows]
        linked = [[a == b or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
        own = labels(groups(len(rows), linked), [i for i, _ in rows])
        got = simhash.similar_groups(df).select("doc_id", "component_id").collect()
        assert Counter(map(tuple, got)) == Counter((i, c) for (i, _), c in zip(rows, own))


def test_crowded_bands_by_brute_force(spark, monkeypatch):
    """Copies of one text with few and with many edits share bands; blocks of four texts, and of one."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 10_000, 150)]
    rows = []
    for k in range(90):
        edited = list(words)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            edited[at] = f"e{k}" if k % 3 else "edit"
        rows.append((k, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
    want = labels(groups(len(rows), [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]), range(len(rows)))
    assert 3 < len(set(want)) < 80
    for block, shingles in ((1024, 2_000_000), (4, 2_000_000), (1024, 100)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == dict(enumerate(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(5, 5), (3, 2)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 50 * 50 for i in range(300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def covered(raw, span=suffix.SPAN):
    seen = defaultdict(list)
    for k, t in enumerate(raw):
        for s in range(len(t) - span + 1):
            seen[t[s : s + span]].append((k, s))
    out = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                out[k][s : s + span] = True
    return out


def repeats(rows):
    raw = [t.encode() for _, t in rows]
    out = []
    for (i, _), t, c in zip(rows, raw, covered(raw)):
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((i, len(t), int(c.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~c])))
    return Counter(out)


def stripped(docs, *group):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.strip_repeats(docs, *group).collect())


def mixed():
    import random

    rng = random.Random(3)
    some = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    base = some(3000, "abcdefg hij")
    out = ["a" * 1500, "ab" * 700, "", base, base[:1000] + "X" + base[1000:], base[500:899], base[500:900], base[500:901] + "é", "q" + base[100:700] * 2, base[:399], "a" * 400, base]
    out += [some(100, "xyz") + base[200 : 200 + rng.randint(300, 900)] + some(300, "xyz") for _ in range(40)]
    return list(enumerate(out))


@pytest.mark.parametrize("group", [suffix.GROUP, 3, 1])
def test_suffixes(spark, none, group):
    rows = mixed()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stripped(docs, group) == repeats(rows)
    assert suffix.strip_repeats(none).count() == 0


def test_suffixes_of_odd_rows(spark, odd, texts):
    short = odd.where("text is null OR length(text) < 10000")
    rows = [(i, t) for i, t in texts if len(t) < 10_000]
    assert stripped(short) == repeats(rows)


def test_sums_that_collide_remove_nothing(spark):
    """Blocks in Thue-Morse order and its complement have equal sums modulo 2 ** 64, if the blocks' sums agree in some low bits."""
    import itertools

    found, blocks = {}, None
    for letters in itertools.product(b"abcdefghijklm", repeat=4):
        block = bytes(letters)
        key = int(suffix.sums_of(np.frombuffer(block, np.uint8))[-1]) % (1 << 26)
        if key in found:
            blocks = found[key], block
            break
        found[key] = block
    assert blocks
    order = [bin(i).count("1") % 2 for i in range(64)]
    a, b = (b"".join(blocks[x ^ flip] for x in order) for flip in (0, 1))
    assert a != b and suffix.sums_of(np.frombuffer(a, np.uint8))[-1] == suffix.sums_of(np.frombuffer(b, np.uint8))[-1]
    rng = np.random.default_rng(0)
    head, tail = (bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (240, 150))
    docs = spark.createDataFrame([(i, (head + x + tail).decode()) for i, x in enumerate((a, b))], "doc_id long, text string")
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in suffix.strip_repeats(docs).collect()] == [(646, 0, 0)] * 2


def test_texts_of_several_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 7)
    monkeypatch.setattr(suffix, "CHUNK", 3000)
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, long[:9000] + "#" + long[9001:]), (3, long[5000:5400]), (4, long[7000:7399])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stripped(docs) == repeats(rows)


def test_runs_do_not_depend_on_pieces(monkeypatch):
    texts = [t.encode() for _, t in mixed()]
    whole = {tuple(map(int, x)) for x in zip(*suffix.runs(texts))}
    starts = lambda found: {(t, s) for t, _, _, a, b, _, _ in found for s in range(a, b + 1)}
    monkeypatch.setattr(suffix, "CHUNK", 700)
    cut = {tuple(map(int, x)) for x in zip(*suffix.runs(texts))}
    assert starts(whole) == starts(cut) == {(t, s) for t, x in enumerate(texts) for s in range(len(x) - suffix.SPAN + 1)}
    anchor = lambda found: {(t, s): (h, p) for t, h, p, a, b, _, _ in found for s in range(a, b + 1)}
    assert anchor(whole) == anchor(cut)


def test_columns_by_brute_force():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (60, 40)).astype(np.uint16)
    rows[30:, :25] = rows[:30, :25]
    rows[5, 30:] = 256
    group = np.repeat([0, 1, 2], 20)
    got = suffix.sort_columns(rows, group) >= 6
    for i in range(60):
        for c in range(40):
            s = rows[i, c : c + 6]
            same = [j for j in range(60) if j != i and group[j] == group[i] and len(s) == 6 and 256 not in s and (rows[j, c : c + 6] == s).all()]
            assert got[i, c] == bool(same)
