import base64
import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillmill.llm import decontam, embed, html, queries, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(map(tuple, cursor.fetchall()))


ITEM = "The quick brown fox jumps over the lazy dog while seventeen purple elephants dance around a very old oak tree near the quiet river bank at dawn"


def test_leaks(spark, odd, none):
    words = ITEM.split()
    docs = [(1, "before " + ITEM + " after"), (2, ITEM.upper().replace(" ", "\n")), (3, "x " + " ".join(words[1:]) + " y"), (4, " ".join(words[::2])), (5, None), (6, " ".join(words[:13])), (None, ITEM)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs, bench).collect()}
    assert {k for k in got} == {(i, j) for i in (1, 2, 3, None) for j in (10, 11)} and got[1, 10] == 1 and 0.8 <= got[3, 10] < 1
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {4, 5, 6}
    assert decontam.contaminated(none, bench).count() == 0 == decontam.contaminated(docs, bench.limit(0)).count()
    assert decontam.drop_contaminated(odd, bench).count() == odd.count()
    two = decontam.contaminated(spark.createDataFrame([(1, "These two words are here")], "doc_id long, text string"), bench).collect()
    assert [(r.item_id, r.start) for r in two] == [(13, 1)]


def test_leaks_of_texts_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(30)]  # 26 shingles
    cuts = [(1, words[:27]), (2, words[3:]), (3, words[2:28]), (4, words[:24]), (5, words[:25]), (6, ["x", *words[:26]]), (7, words[1:15] + words[17:])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in cuts], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(words))], "item_id long, text string")
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {i: len(shingles(w) & shingles(words)) / len(shingles(w) | shingles(words)) for i, w in cuts}
    want = {i: round(s, 6) for i, s in want.items() if s >= 0.8}
    assert {r.doc_id: r.similarity for r in decontam.contaminated(docs, bench).collect()} == want and set(want) == {1, 2, 3, 5, 6}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {4, 7}


def test_blocks_find_all_fingerprints_within_the_radius(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, 200, dtype=np.int64)
    rows = []
    for i, b in enumerate(base):
        flips = rng.permutation(64)[: i % 25]
        rows.append((i, int(b), int(np.bitwise_xor.reduce(np.append(np.array([b]), np.left_shift(np.int64(1), flips))))))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    a = df.select("i", decontam.blocks("a").alias("x")).select("i", "x.*")
    b = df.select("i", decontam.blocks("b").alias("x")).select("i", "x.*")
    met = {r.i for r in a.join(b, ["i", "block", "bits"]).select("i").distinct().collect()}
    assert {i for i in range(200) if i % 25 <= decontam.RADIUS} <= met


def test_simhash_of_many_shingles(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for n in (1, 2, 7, 140_000)]
    rows[3][:70_001] = -1  # over a half of them have every bit
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "i long, shingles array<long>")
    got = {r.i: r.fp & (1 << 64) - 1 for r in decontam.with_simhash(df, "fp").select("i", "fp").collect()}
    for i, x in enumerate(rows):
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        assert got[i] == int.from_bytes(np.packbits(bits * 2 > len(x), bitorder="little").tobytes(), "little")


def test_archives(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
    rows = [(3, "http://WWW.b.org/x?q=1#t", "same"), (1, "http://a.org/y", "same"), (2, None, tricky), (5, "not a url \r\n", None), (4, "http://[bad", ""), (1, "http://a.org/y", "same"), (None, "http://c.org", "same"), (7, "http://a.org/y", "é漢")]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, captured int")
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 1, tricky: 2, "": 4, "é漢": 7}
    want = Counter((i, len((t or "").encode()), digest(t), "response" if first[t or ""] == i else "revisit", None if first[t or ""] == i else first[t or ""]) for i, _, t in rows)
    assert Counter(map(tuple, warc.page_records(pages).collect())) == want
    index = warc.archive_pages(pages).collect()
    assert [r.url_key for r in index] == sorted(r.url_key for r in index)
    assert warc.page_records(pages.limit(0)).count() == 0


def test_long_payloads_and_small_archives(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://h.org/{i % 3}", "x" * [10, 3000, 30_000, 2_000_000][i % 4] + str(i // 8)) for i in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive_pages(pages, str(tmp_path / "warc")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in index} == {(i, len(t), digest(t)) for i, _, t in rows}
    assert [(r.url_key, r.captured) for r in index] == sorted((r.url_key, r.captured) for r in index)
    files = [f for f in (tmp_path / "warc").iterdir() if f.name.startswith("part-")]
    assert all(f.stat().st_size < 4 * 20_000 + 10_000 for f in files if f.stat().st_size < 2_000_000) and len(files) > 6
    for most, fan_in in ((2, 64), (200_000, 2), (3, 2)):
        few = warc.merge_runs(warc.capture_runs(spark, str(tmp_path / "warc")), most, fan_in).collect()
        assert [r.page_id for r in few] == [r.page_id for r in index]
    level = warc.merge_level(warc.capture_runs(spark, str(tmp_path / "warc")), 3, 4).collect()
    for g in {r.run for r in level}:
        own = sorted((r for r in level if r.run == g), key=lambda r: r.seq)
        assert [(r.url_key, r.captured) for r in own] == sorted((r.url_key, r.captured) for r in own)
    assert len({r.run for r in level}) == 3 and sorted(r.page_id for r in level) == list(range(24))


def test_loser_tree():
    import random

    rng = random.Random(0)
    for _ in range(500):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        heads = [iter(r) for r in runs]
        assert [next(heads[i]) for i in warc.LoserTree([[(x,) for x in r] for r in runs])] == sorted(x for r in runs for x in r)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
%s<aside>Side</aside><section id="comments"><article class="comment"><p>Reader says</p></article></section>
<form><input><button>Go</button></form><footer>&copy; us</footer></body></html>"""
BODY = "<h1>Head &amp; shoulders</h1><p>One <b>bold</b>  word<br>here<p>Two&nbsp;x<div role=menu>Buy</div><ul><li>a<li>b</ul><!-- no --><p hidden>secret</p>"
TEXT = "Head & shoulders\nOne bold word here\nTwo x\na\nb"


@pytest.mark.parametrize("box", ["<article>%s</article>", "<main>%s</main>", "<div role=main>%s</div>", "<div id=content>%s</div>", "<article><div class='post-body'>%s</div></article>"])
def test_main_text(box):
    assert html.main_text(PAGE % (box % BODY)) == TEXT


def test_wrapper_finds_template_and_slot(spark):
    page = "<body><div class=top>Our shop, open daily</div><div class=x><p>{a}</p><p>{b}</p></div><div class=end>Visit us again</div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(a=f"First part of text {i} " * 5, b=f"second {i * i}")) for i in range(12)]
    rows += [(90, None, None), (91, "http://h.org/z", ""), (92, "::", "<p>one"), (92, "::", "<p>one")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[3].text == ("First part of text 3 " * 5).strip() + "\nsecond 9" and got[3].n_chars == len(got[3].text)
    assert got[90].text == got[91].text == "" and got[92].text == "one"
    assert html.extract(pages).count() == 16 and html.extract(pages.limit(0)).count() == 0


def test_every_layout_of_a_host_has_its_template(spark):
    one = "<body><div class=top>Our shop, open daily</div><div class=x><p>{a}</p></div><div class=end>Visit us again</div></body>"
    two = "<body><table class=frame><tr><td>Old site, kept for readers</td></tr></table><div class=y><p>{a}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", (two if i % 20 == 0 else one).format(a=f"Text {i} of its own, {i * i} " * 3)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {i: (f"Text {i} of its own, {i * i} " * 3).strip() for i in range(200)}


def test_articles_in_several_parts(spark):
    parts = "<body><nav>Menu</nav><article><p>Part one</article><div><article><p>Part two, longer</article></div><article class=comment>Reader</article></body>"
    assert html.main_text(parts) == "Part one\nPart two, longer"
    page = "<body><div class=top>Our shop, open daily</div><div class=x><header><h1>Head {i}</h1></header><div class=lead>Lead {i}</div><div class=b><p>{a}</p><p>{b}</p></div></div><div class=end>Visit us again</div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i=i, a=f"First part of text {i} " * 20, b=f"second {i * i}")) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Head {i}\nLead {i}\n" + (f"First part of text {i} " * 20).strip() + f"\nsecond {i * i}" for i in range(12)}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


PARTS = "<h1>Head {i}</h1><p>Text {i}</p><section class='related-work'><h2>Work {i}</h2><p>Like {i}</p></section><div class='notice-board'>Board {i}</div><div class=sidebar><p>Side {i}</p></div><div class=share>Share this</div>"
LINES = "Head {i}\nText {i}\nWork {i}\nLike {i}\nBoard {i}\nSide {i}"


def test_names_delete_no_part_of_an_article(spark):
    """Parts that vary stay whatever their names are; a named part that is the same on all pages goes, and on a lone page it stays."""
    page = "<body><nav>Menu</nav><h1 class={c}>Title {i}</h1><div class=ad>Buy {i}</div><p class={c}>Lead {i}</p><article class={c}>%s</article><aside>More</aside><footer>F</footer></body>" % PARTS
    rows = [(i, f"http://h.org/{i}", page.format(i=i, c=f"sc-{i:x}q")) for i in range(12)] + [(50, "http://lone.org", page.format(i=50, c="x"))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[50] == LINES.format(i=50) + "\nShare this"
    assert {i: got[i] for i in range(12)} == {i: f"Title {i}\nLead {i}\n" + LINES.format(i=i) for i in range(12)}


def test_generated_names_share_a_layout(spark):
    page = "<body><div class=a{c}>Our shop, open daily</div><div class=b{c}><p>{a}</p><p>{b}</p></div><div class=c{c}>Visit us again</div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(c=i * 7919, a=f"First {i}", b=f"second {i * i}")) for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"First {i}\nsecond {i * i}" for i in range(12)}


def test_two_hundred_levels(spark):
    deep = lambda i: "<div>" * 200 + f"<p>Inner {i}</p>" + "".join(f"<p>Out {i} {k}</p></div>" for k in range(200))
    rows = [(i, "http://h.org/x", f"<body><div><p>Same</p></div><section>{deep(i)}</section></body>") for i in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([f"Inner {i}", *(f"Out {i} {k}" for k in range(200))]) for i in range(4)}


def test_given_pages_by_their_articles(spark, sf_dir):
    """A plain reading of the given pages, whose texts all stand in one article element of headings, paragraphs and bold runs."""
    import re
    from html import unescape

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for r in rows:
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split("</?(?:h1|p)>", re.sub("</?b>|<!--.*?-->", "", re.sub("<br ?/?>", " ", inside)))
        assert got[r.page_id] == "\n".join(x for x in (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if x)


def test_deep_and_broken_pages():
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert html.main_text("<p a='x>y<b>z") and html.main_text("</p></div>a<b>b") == "ab" and html.main_text("<script>x") == ""


def test_simple_tree_matching():
    a, b = html.parse("<div><p>1</p><ul><li>x</ul></div>"), html.parse("<div><h1>t</h1><p>2</p><ul><li>y<li>z</ul></div>")
    assert [x.tag for x, _ in html.align(a, b)].count("li") == 1 and len(html.align(a, b)) == 5


@pytest.mark.parametrize("cells", [html.CELLS, 4])
def test_alignment_by_brute_force(monkeypatch, cells):
    import random

    rng = random.Random(1)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "section", "b"], k=rng.randint(0, 4)))

    def best(a, b):
        if a.tag != b.tag:
            return 0
        x, y = a.kids, b.kids
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            for j, q in enumerate(y, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + best(p, q))
        return table[-1][-1] + 1

    monkeypatch.setattr(html, "CELLS", cells)
    for _ in range(120):
        a, b = html.parse(page(2)), html.parse(page(2))
        pairs = html.align(a, b)
        below = {id(x): y for x, y in pairs}
        assert len(below) == len(pairs) == len({id(y) for _, y in pairs})
        assert all(below[id(x.parent)] is y.parent for x, y in pairs if x.parent is not None)
        if cells > 4:
            assert len(pairs) == best(a, b)


def test_pages_of_very_many_siblings():
    a = html.parse("<body><h1>q</h1>" + "<p>x</p>" * 50_000)
    b = html.parse("<body>" + "<p>x</p>" * 49_000 + "<div>e</div>")
    assert len(html.align(a, b)) == 49_002
    frame = html.Frame("<body><div class=top>Shop</div><div class=x><p>one</p></div></body>").decide({1: 3, 2: 2, 3: 1}, 3)
    page = "<body><div class=top>Shop</div><div class=x>" + "".join(f"<p>line {i}<h2>head {i}</h2>" for i in range(25_000)) + "</div></body>"
    assert html.main_text(page, frame).split("\n") == [x for i in range(25_000) for x in (f"line {i}", f"head {i}")]


def test_the_wrapper_decides_where_no_name_does(spark):
    """Labelled pages of four hosts whose frames outweigh their articles and name nothing."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows, want = [], {}
    for h in range(4):
        frame = [say(30) for _ in range(12)]
        box = ["div", "section", "table", "center"][h]
        for i in range(3 + 4 * h):
            lines = [say(6) for _ in range(1 + i % 4)] + ["The end of each of them"][: h % 2]
            body = "".join(f"<p>{x}</p>" for x in lines[: 1 + i % 4])
            page = f"<body><{box}>" + "".join(f"<div class=a>{x}</div>" for x in frame[:6]) + f"</{box}><div class=z>{body}</div>" + "".join(f"<div class=b>{x}</div>" for x in frame[6:]) + "</body>"
            want[len(rows)] = "\n".join(lines[: 1 + i % 4])
            rows.append((len(rows), f"http://host{h}.org/{i}", page))
    rows += [(None, "http://host1.org/x", rows[3][2]), (900, "http://host9.org/a", "<body><div>Alone</div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == want | {None: want[3], 900: "Alone"}


def test_lines_of_an_article_that_equal_template_stay(spark):
    page = "<body><p>Welcome</p><article><p>{a}</p><p>Welcome</p><p>Same on all</p></article><p>Bye</p></body>"
    rows = [(i, f"http://h.org/{i}", page.format(a=f"Text {i}")) for i in range(5)]
    got = {r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"Text {i}\nWelcome\nSame on all" for i in range(5)}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.08 * rng.normal(size=16) * (i >= 40)).tolist(), i % 40 % 3) for i in range(200)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[0][1], None), (304, rows[0][1], 0), (304, rows[0][1], 0), (305, [1.0, None], 1), (306, [], 1), (307, [2.0, 0.0], 1), (308, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    link = lambda a, b: a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93 - 1e-12
    near = [[j for j, b in enumerate(good) if j != i and link(a, b)] for i, a in enumerate(good)]
    own = list(range(len(good)))
    for _ in range(60):
        own = [min([own[i], *(own[j] for j in near[i])]) for i in range(len(good))]
    least = {r: min((good[i][0] for i in range(len(good)) if own[i] == r and good[i][0] is not None), default=None) for r in own}
    want = Counter((a[0], len(near[i]), least[own[i]], a[0] == least[own[i]]) for i, a in enumerate(good))
    want += Counter((r[0], 0, r[0], True) for r in rows if not any(r is g for g in good))
    assert Counter(map(tuple, embed.near_vectors(df).collect())) == want
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.1 * rng.normal(size=16)).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = Counter(map(tuple, embed.near_vectors(df).collect()))
    monkeypatch.setattr(embed, "BLOCK", 7)
    assert Counter(map(tuple, embed.near_vectors(df).collect())) == whole
