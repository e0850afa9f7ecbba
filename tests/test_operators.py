import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillmill.operators import analytics, hierarchy, index, metadata, rerank, retrieve, sheets
from quillmill.plans import agent, sqlsurface
from quillmill.session import small_batches


def test_fusion_keeps_first_seen_order_among_equals(spark):
    lists = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "a")], "query_id int, list_id int, rank int, key string")
    got = [(r.key, round(r.rrf_score, 9)) for r in retrieve.fuse(lists, ["key"]).orderBy("rank").collect()]
    assert got == [("a", round(1 / 61 + 1 / 62, 9)), ("c", round(1 / 61, 9)), ("b", round(1 / 62, 9))]


def test_hybrid_without_sparse_results(spark):
    dense = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id int, rank int, key string")
    got = retrieve.hybrid(dense, dense.limit(0), ["key"]).orderBy("rank").collect()
    assert [(r.key, r.rrf_score) for r in got] == [("a", None), ("b", None)]


def test_balanced_sizes(spark):
    for n, each, total in ((1, 20, 20), (2, 10, 20), (3, 17, 51), (5, 10, 50), (6, 17, 100), (10, 10, 100), (11, 10, 100)):
        ranked = spark.range(n * 40).select(F.lit(1).alias("query_id"), F.col("id").alias("rank"), (F.col("id") % n).alias("document_id"))
        got = retrieve.balanced(ranked).groupBy("document_id").count().collect()
        assert sum(r["count"] for r in got) == total
        assert max(r["count"] for r in got) == each


def test_negative_idf_has_a_floor(spark):
    chunks = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "c"])], "chunk_id int, tokens array<string>")
    terms, _ = retrieve.statistics(chunks)
    import math

    raw = {"a": math.log(0.5 / 3.5), "b": math.log(2.5 / 1.5), "c": math.log(2.5 / 1.5)}
    got = {r.term: r.idf for r in terms.collect()}
    assert abs(got["a"] - 0.25 * sum(raw.values()) / 3) < 1e-12 and abs(got["b"] - raw["b"]) < 1e-12


def test_mmr_prefers_different_chunks(spark):
    texts = spark.createDataFrame([(1, 1, "x y"), (1, 2, "x y"), (1, 3, "p q")], "query_id int, chunk_id int, text string")
    pairs = rerank.cosine_pairs(rerank.tfidf(texts))
    scored = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.5)], "query_id int, chunk_id int, relevance double")
    assert [r.chunk_id for r in rerank.mmr(scored, pairs, 3).orderBy("position").collect()] == [1, 3, 2]


def test_forest_rules(spark):
    rows = [("r", "R", None, 0), ("e", "E", "", 1), ("a", "A", "r", 2), ("lost", "L", "nobody", 3), ("x", "X", "y", 4), ("y", "Y", "x", 5), ("a", "A2", "e", 6)]
    nodes = spark.createDataFrame(rows, "id string, title string, parent_id string, position int")
    tree = hierarchy.forest(nodes)
    assert {(r.id, r.title, r.path) for r in tree.collect()} == {("r", "R", "r"), ("e", "E", "e"), ("a", "A2", "e/a")}
    assert {r.id: r.n for r in hierarchy.subtree_sizes(tree).collect()} == {"r": 1, "e": 2, "a": 1}


def test_deep_forest(spark):
    rows = [(str(i), "t", str(i - 1) if i else None, 0) for i in range(60)]
    tree = hierarchy.forest(spark.createDataFrame(rows, "id string, title string, parent_id string, position int"))
    assert {(r.id, r.level) for r in tree.collect()} == {(str(i), i) for i in range(60)}


def test_records(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "agent", "b")], "conv_id long, turn long, role string, text string")
    users = metadata.from_conversations(turns)
    new = users.withColumn("threads", metadata.create_thread("t2", "n", 9)).withColumn("threads", metadata.delete_chat("t1", 5)).withColumn("threads", metadata.clear_chats("t2"))
    assert tuple(metadata.totals(new).first()) == ("u1", 2, 0, 2)
    assert metadata.totals(new.withColumn("threads", metadata.delete_chat("t1", 1)).withColumn("threads", metadata.delete_thread("t2"))).first().chats == 1
    assert metadata.invalid(users).count() == 0
    assert metadata.create_users(users, users).count() == 1


def test_header_rows(spark):
    sheet = [["Confidential Report", None, None], ["Generated by: System X", None, None], [None, None, None], ["ID", "Name", "Revenue"], ["101", "Widget", "5000"]]
    rows = spark.createDataFrame([("s", i, c, 3) for i, c in enumerate(sheet)], "sheet string, row_no int, cells array<string>, width int")
    assert tuple(sheets.header_rows(rows).first()) == ("s", 3, "Confidential Report\nGenerated by: System X")
    assert sheets.sheet_text(rows).first().text.count("\n") == 3


def test_names():
    assert sheets.unique_names(["amount", "name", "amount"]) == ["amount", "name", "amount_2"]
    assert sheets.unique_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert sheets.flat_names([("Sales", "Q1"), ("Unnamed: 1", "nan"), (None, "x")]) == ["Sales_Q1", "Column_1", "x"]
    assert sheets.sql_name("1st col") == "col_1st_col" and sheets.sql_name("%%") == "unnamed_col"


def test_guards(spark):
    spark.range(600).createOrReplaceTempView("numbers")
    assert "Only SELECT" in sqlsurface.execute(spark, "WITH x AS (SELECT 1) SELECT * FROM x")["error"]
    assert "Forbidden" in sqlsurface.execute(spark, "SELECT 'update' AS x")["error"]
    got = sqlsurface.execute(spark, "select id from numbers;")
    assert (got["row_count"], got["truncated"], len(got["data"])) == (600, True, 500)
    assert not sqlsurface.execute(spark, "SELECT nothing FROM numbers")["success"]
    assert "600 rows" in sqlsurface.schema_report(spark, ["numbers"]) and sqlsurface.has_tables(spark, ["numbers"])
    row = spark.sql("SELECT '12abc' AS a, 'abc' AS b").select(sqlsurface.lenient_number(F.col("a")).alias("x"), sqlsurface.lenient_number(F.col("b")).alias("y"), sqlsurface.glob(F.col("b"), "a*[c]").alias("z")).first()
    assert tuple(row) == (12.0, 0.0, True)


def test_compress(spark):
    docs = spark.createDataFrame([(1, "t", "x" * 8000), (1, "u", "y" * 5)], "batch int, title string, content string")
    got = {r.title: len(r.content) for r in analytics.compress(docs, 2000).collect()}
    assert got["u"] == 5 and 3000 < got["t"] <= 4000


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, content string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "chunk_id string, content string")
    assert {tuple(r) for r in index.keep_latest(old, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def plain_loop(choices, tools, hits):
    """One question: what it chooses each time, and the notes it gets."""
    sql = web = 0
    notes = sorted(hits)
    for action in choices[:20]:
        node = {"web_search": "web_search" if web < 2 else "self_knowledge", "sql_query": "sql_query" if sql < 6 else "answer", "failure": "self_knowledge"}.get(action, action)
        if node not in tools:
            break
        notes.append(tools[node])
        sql, web = sql + (node == "sql_query"), web + (node == "web_search")
        if node == "self_knowledge":
            break
        if tools[node].startswith("FAILURE"):
            notes.append(tools["self_knowledge"])
            break
    return sql, web, notes


def test_the_question_loop_as_one_question_at_a_time(spark):
    choices = {1: ["sql_query"] * 30, 2: ["web_search"] * 30, 3: ["sql_query", "web_search", "answer"], 4: ["answer"], 5: ["document_summarizer", "sql_query", "answer"], 6: ["global_summarizer", "answer"], 7: ["odd"], 8: ["failure"], 9: [None], 10: ["sql_query", "document_summarizer"] * 15}
    said = {"sql_query": "rows", "web_search": "page", "document_summarizer": "summary", "global_summarizer": "FAILURE: none", "self_knowledge": "known"}
    hits = {1: ["b", "a"], 4: ["c"]}
    questions = spark.createDataFrame([(i, f"q{i}") for i in choices], "question_id long, question string")
    script = spark.createDataFrame([(i, a) for i, a in choices.items()], "question_id long, script array<string>")
    found = spark.createDataFrame([(i, n) for i, ns in hits.items() for n in ns], "question_id long, note string")
    step = F.size("notes") - F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, ns in hits.items() for x in (i, len(ns))]), F.col("question_id").cast("int")), F.lit(0))
    generate = lambda s: s.join(script, "question_id").select("question_id", F.get("script", step).alias("action"), F.lit("x").alias("answer"))
    tools = {name: (lambda word: lambda s: s.select("question_id", F.lit(word).alias("note")))(word) for name, word in said.items()}
    got = {r.question_id: (r.sql_tries, r.web_tries, r.notes) for r in agent.ask(questions, lambda q: found, generate, tools).collect()}
    assert got == {i: plain_loop(c, said, hits.get(i, [])) for i, c in choices.items()}
    assert agent.ask(questions.limit(0), lambda q: found.limit(0), generate, tools).count() == 0


def test_questions_in_parts(spark):
    questions = spark.createDataFrame([(1, "a b c"), (2, "one"), (3, " ".join("abcdefghijklmn")), (4, "")], "question_id long, question string")
    cut = lambda q: q.where("question <> ''").select("question_id", F.posexplode(F.split("question", " ")).alias("place", "question"))
    shout = lambda q: q.select("question_id", F.upper("question").alias("answer"))
    join = lambda q: q.select("question_id", F.array_join("answers", "+").alias("answer"))
    assert {r.question_id: r.answer for r in agent.ask_in_parts(questions, cut, shout, join).collect()} == {1: "A+B+C", 2: "ONE", 3: "A+B+C+D+E+F+G+H+I+J", 4: ""}


def test_forests_of_any_shape(spark):
    chain = [(f"n{i}", f"t{i}", f"n{i - 1}" if i else None, 0) for i in range(100)]
    odd = [("a/b", "slash", "", 0), ("a/b/c", "below", "a/b", 0), ("~1", "tilde", "a/b/c", 0), ("x", "lost", "nowhere", 0), ("y", "below lost", "x", 0), ("p", "round", "q", 0), ("q", "round", "p", 0), ("r", "hangs on a circle", "p", 0), ("s", "self", "s", 0), ("n5", "again", "n4", 1)]
    nodes = spark.createDataFrame(chain + odd, "id string, title string, parent_id string, position int")
    tree = hierarchy.forest(nodes)
    rows = {r.id: r for r in tree.select("*", hierarchy.path_ids(F.col("path")).alias("ids")).collect()}
    assert set(rows) == {f"n{i}" for i in range(100)} | {"a/b", "a/b/c", "~1"}
    assert all(rows[f"n{i}"].level == i and rows[f"n{i}"].ids == [f"n{j}" for j in range(i + 1)] for i in range(100)) and rows["n5"].title == "again"
    assert rows["~1"].ids == ["a/b", "a/b/c", "~1"] and rows["a/b"].parent_id is None
    sizes = {r.id: r.n for r in hierarchy.subtree_sizes(tree).collect()}
    assert sizes == {f"n{i}": 100 - i for i in range(100)} | {"a/b": 3, "a/b/c": 2, "~1": 1}
    assert hierarchy.forest(nodes, paths=False).columns == ["id", "title", "parent_id", "level"] and hierarchy.forest(nodes.limit(0)).count() == 0


def test_descriptions_come_in_groups_and_failed_groups_again(spark):
    tree = hierarchy.forest(spark.createDataFrame([(f"n{i}", f"t{i}", f"n{i // 3}" if i else None, 0) for i in range(60)], "id string, title string, parent_id string, position int"))
    asked = []

    def describe(groups, attempt):
        rows = groups.collect()
        asked.append({r.group: [n.id for n in r.nodes] for r in rows})
        out = []
        for r in rows:
            if len(r.nodes) > 1 and attempt <= int(r.nodes[0].id[1:]) % 4 or r.nodes[0].id == "n0":
                continue  # fails, the root's always
            answers = [(n.id, f"about {n.title}") for n in r.nodes]
            if r.nodes[0].id == "n1":
                answers = answers[:1] + [("other", "wrong")] * (len(answers) - 1)
            out.append((r.group, answers + [("more", "too much")]))
        return spark.createDataFrame(out, "group long, answers array<struct<id: string, description: string>>")

    got = {r.id: (r.description, r.attempt) for r in hierarchy.described(tree, describe, tries=3).collect()}
    groups = asked[0]
    assert sorted(i for g in groups.values() for i in g) == sorted(f"n{i}" for i in range(60)) and max(map(len, groups.values())) <= 4
    want = {}
    for ids in groups.values():
        tries = 1 if len(ids) == 1 else int(ids[0][1:]) % 4 + 1
        if tries > 3 or ids[0] == "n0":
            continue
        for place, i in enumerate(ids):
            if ids[0] != "n1" or place == 0:
                want[i] = (f"about t{i[1:]}", tries)
    assert got == want and len(asked) == 3 and set(asked[2]) < set(asked[1]) < set(asked[0])


def plain_layout(nodes):
    """One map: nodes as id to (parent, level, box), places as the drawing's rules say."""
    kids = {i: sorted(c for c, (p, _, _) in nodes.items() if p == i) for i in nodes}
    tall = {i: max(100, b) for i, (_, _, b) in nodes.items()}
    room = {}
    for i in sorted(nodes, key=lambda i: -nodes[i][1]):
        room[i] = max(nodes[i][2], max(sum(room[c] for c in kids[i]) + 48 * len(kids[i]), 100)) if kids[i] else tall[i]
    y, top = {}, 50.0

    def place(i, at):
        y[i] = at + room[i] / 2
        for c in kids[i]:
            place(c, at)
            at += room[c]

    for i in sorted(i for i in nodes if nodes[i][1] == 0):
        place(i, top)
        top += room[i] + 50

    def shift(i, by):
        y[i] += by
        for c in kids[i]:
            shift(c, by)

    def push():
        for level in sorted({n[1] for n in nodes.values()}):
            bottom = float("-inf")
            for i in sorted((i for i in nodes if nodes[i][1] == level), key=lambda i: y[i]):
                if y[i] - tall[i] / 2 < bottom + 52:
                    shift(i, bottom + 52 - (y[i] - tall[i] / 2))
                bottom = y[i] + tall[i] / 2

    push()
    for i in sorted(nodes, key=lambda i: -nodes[i][1]):
        if kids[i]:
            y[i] = sum(y[c] for c in kids[i]) / len(kids[i])
    push()
    return {i: (200.0 + 520 * nodes[i][1], round(y[i], 6)) for i in nodes}


def test_no_two_boxes_of_a_layout_meet(spark):
    import random

    rng = random.Random(3)
    maps = {}
    for m in range(6):
        nodes = {}
        for i in range(rng.randint(1, 40)):
            parent = rng.choice([*nodes, None]) if nodes and i > 1 else None
            nodes[f"{m}-{i:03}"] = (parent, nodes[parent][1] + 1 if parent else 0, rng.choice([72, 72, 154, 328]) + rng.random())
        maps[m] = nodes
    rows = [(m, i, p, level, box) for m, nodes in maps.items() for i, (p, level, box) in nodes.items()]
    got = hierarchy.layout(spark.createDataFrame(rows, "map int, id string, parent_id string, level int, box double")).collect()
    assert {(r.map, r.id): (r.x, round(r.y, 6)) for r in got} == {(m, i): xy for m, nodes in maps.items() for i, xy in plain_layout(nodes).items()}
    for a in got:
        for b in got:
            if a.map == b.map and a.level == b.level and a.id != b.id:
                assert abs(a.y - b.y) >= (max(100, maps[a.map][a.id][2]) + max(100, maps[b.map][b.id][2])) / 2 + 52 - 1e-6


def test_new_users_without_an_address_all_enter(spark):
    kind = "user_id string, name string, email string"
    new = spark.createDataFrame([("a", "ann", None), ("b", "bob", None), ("b", "bea", None), (None, "cy", "c@x"), (None, "di", "d@x"), (None, "ed", "d@x")], kind)
    got = metadata.create_users(spark.createDataFrame([("z", "Z", None)], kind), new).collect()
    assert sorted(r.name for r in got) == ["Ann", "Bea", "Cy", "Di", "Z"]


def test_writing_one_users_index_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = lambda user, thread, text: spark.createDataFrame([(user, thread, f"{user}{thread}", text)], "user_id string, thread_id string, chunk_id string, text string")
    for user, thread, text in (("007", "a", "x"), ("u2", "a", "y"), ("007", "b", "z"), ("007", "a", "new")):
        index.put(spark, path, chunks(user, thread, text))
    assert {(r.user_id, r.thread_id, r.text) for r in index.chunks_of(spark, path).collect()} == {("007", "a", "new"), ("u2", "a", "y"), ("007", "b", "z")}
    assert [r.text for r in index.chunks_of(spark, path, "007", "a").collect()] == ["new"]


def same_ranks(got, want):
    plain = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    return plain(got) == plain(want)


def test_search_in_a_written_index(spark, tmp_path):
    rows = [("u1", "a", 1, "red fox"), ("u1", "a", 2, "blue whale whale"), ("u1", "a", 3, "green tree"), ("u2", "a", 4, "whale"), ("u2", "a", 5, "fox"), ("u2", "a", 6, "owl"), ("u1", "b", 7, "fox fox fox")]
    parsed = spark.createDataFrame(rows, "user_id string, thread_id string, doc_id long, text string")
    path = str(tmp_path)
    chunks = index.reindex(spark, parsed, path)
    assert chunks.count() == 7
    asked = spark.createDataFrame([(1, "whale fox"), (2, "nothing")], "query_id long, text string")
    text = lambda df: df.select("chunk_id", "text")
    own = chunks.where("user_id = 'u1'")
    assert same_ranks(index.search(spark, path, asked, 5, "u1", "a"), retrieve.bm25(text(own.where("thread_id = 'a'")), asked, 5))
    assert same_ranks(index.search(spark, path, asked, 5, "u1"), retrieve.bm25(text(own), asked, 5))  # over several threads
    assert same_ranks(index.search(spark, path, asked, 5), retrieve.bm25(text(chunks), asked, 5))  # and users
    index.reindex(spark, parsed.where("user_id = 'u2'").limit(1), path)
    assert {r.chunk_id for r in index.chunks_of(spark, path, "u2").collect()} == {"4_page1_chunk0"} and index.chunks_of(spark, path, "u1").count() == 4
    with pytest.raises(Exception, match="no index"):
        index.search(spark, f"{path}/none", asked, 5)


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(4)
    monkeypatch.setattr(index, "RANGE", 8)
    monkeypatch.setattr(index, "FIRST_RANGES", 2)
    common = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randint(3, 60)) + ["rare"] * (rng.randint(1, 5) if i in (17, 18, 300) else 0))) for i in range(400)] + [(900, None), (901, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "rare w1"), (2, "w2 w3 w2"), (3, "rare"), (4, "absent")], "query_id long, text string")
    path = str(tmp_path)
    index.put(spark, path, chunks)
    for k in (1, 3, 50):
        assert same_ranks(index.search(spark, path, asked, k), retrieve.bm25(chunks, asked, k))
    cost = {r.query_id: (r.postings, r.read) for r in index.search_cost(spark, path, asked, 1).collect()}
    assert cost[1][1] < cost[1][0] / 2 and set(cost) == {1, 2, 3}


def test_a_task_hands_python_few_packs_at_once(spark, tmp_path, monkeypatch):
    limit = lambda: int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    write, settled, seen, usual = index._write, retrieve.settled, {}, limit()
    monkeypatch.setattr(index, "PACKED", 64)
    monkeypatch.setattr(retrieve, "CHUNKS", 64)
    monkeypatch.setattr(index, "_write", lambda rows, path, table, *a, **b: seen.update({table: limit()}) or write(rows, path, table, *a, **b))
    monkeypatch.setattr(retrieve, "settled", lambda df, tag: seen.update({tag: limit()}) or settled(df, tag))
    chunks = spark.createDataFrame([(i, f"one {i % 7} {i % 11}") for i in range(150)], "chunk_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "3 one"), (2, "10 6 absent")], "query_id long, text string")
    index.put(spark, str(tmp_path), chunks)
    found = index.search(spark, str(tmp_path), asked, 5)
    assert seen["postings"] == index.HANDED and seen["found"] == 1 and limit() == usual
    assert same_ranks(found, retrieve.bm25(chunks, asked, 5))
    with small_batches(spark, 9):  # a pack is as large as before, however few rows come at once
        packs = retrieve._counted(chunks.select("chunk_id", F.split("text", " ").alias("tokens"))).select(F.size("ids").alias("n")).collect()
    assert sorted(r.n for r in packs) == [22, 64, 64]


def test_an_index_in_parts_is_the_same_as_one_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 4)
    words = ["red fox", "blue whale whale", "green tree fox", "owl", "the owl and the fox", "whale song song song", "fox"]
    one = lambda ids, extra="": spark.createDataFrame([(i, words[i % 7] + extra) for i in ids], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "whale fox"), (2, "owl song"), (3, "tree new")], "query_id long, text string")
    path = str(tmp_path / "a")
    index.put(spark, path, one(range(20)))
    index.put(spark, path, one(range(10, 30), " new"))  # ten of them replace others
    index.put(spark, path, one([5, 12], " newer"), spark.createDataFrame([(7,), (25,), (99,)], "chunk_id long"))
    index.put(spark, path, None, spark.createDataFrame([(0,)], "chunk_id long"))
    left = {**{i: "" for i in range(20)}, **{i: " new" for i in range(10, 30)}, 5: " newer", 12: " newer"}
    whole = spark.createDataFrame([(i, words[i % 7] + x) for i, x in left.items() if i not in (7, 25, 0)], "chunk_id long, text string")
    statistics = lambda p: tuple(sorted(map(tuple, df.collect())) for df in index.scope_statistics(spark, p, index.manifest(spark, p)))
    index.put(spark, str(tmp_path / "b"), whole)
    assert statistics(path) == statistics(str(tmp_path / "b"))
    assert same_ranks(index.search(spark, path, asked, 9), retrieve.bm25(whole, asked, 9))
    before = index.manifest(spark, path)
    assert len(before["segments"]) == 4 and len(index.compact(spark, path)["segments"]) == 1
    assert statistics(path) == statistics(str(tmp_path / "b")) and same_ranks(index.search(spark, path, asked, 9), retrieve.bm25(whole, asked, 9))
    assert index.chunks_of(spark, path, version=before["version"]).count() == whole.count()  # a reader of the version before
    index.vacuum(spark, path)
    assert index.versions(spark, path) == [before["version"] + 1] and index.chunks_of(spark, path).count() == whole.count()


def test_half_written_versions_are_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    chunks = spark.createDataFrame([(1, "one"), (2, "two")], "chunk_id long, text string")
    first = index.put(spark, path, chunks)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_blocks", fail)
        with pytest.raises(RuntimeError):
            index.put(spark, path, chunks.withColumn("text", F.lit("three")))
    assert index.manifest(spark, path) == first and {r.text for r in index.chunks_of(spark, path).collect()} == {"one", "two"}
    index.publish(spark, path, first)
    with pytest.raises(index.Conflict):
        index.publish(spark, path, first)
    assert index.put(spark, path, chunks, mark=("s", 3))["marks"] == {"s": 3} and index.put(spark, path, chunks, mark=("s", 2))["version"] == 3


def test_new_users_have_one_id_and_one_address(spark):
    kind = "user_id string, name string, email string"
    users = spark.createDataFrame([("a", "A", "a@x")], kind)
    new = spark.createDataFrame([("d", "dan b", "d@x"), ("b", "bea", "d@x"), ("b", "ann", "e@x"), ("c", "c", "a@x"), ("a", "q", "q@x")], kind)
    assert {tuple(r) for r in metadata.create_users(users, new).collect()} == {("a", "A", "a@x"), ("b", "Ann", "e@x"), ("d", "Dan B", "d@x")}


def test_statements_mean_what_their_users_mean(spark):
    import sqlite3

    rows = [(1, "Alpha", 1.5, "12abc"), (2, "beta", None, "x"), (3, "ALPHABET", 2.5, None), (4, "it's", 4.0, "3.7")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE goods (id INTEGER, name TEXT, price REAL, code TEXT)")
    con.executemany("INSERT INTO goods VALUES (?, ?, ?, ?)", rows)
    spark.createDataFrame(rows, "id long, name string, price double, code string").createOrReplaceTempView("goods")
    for sql in (
        "SELECT id, name FROM goods WHERE name LIKE 'alpha%' ORDER BY id",
        "SELECT id FROM goods WHERE name GLOB 'A*' ORDER BY id",
        "SELECT id FROM goods WHERE name GLOB '[a-c]?ta' OR name = 'it''s' ORDER BY id",
        'SELECT "id", [name] AS "the name" FROM goods ORDER BY "id" LIMIT 1, 2',
        "SELECT id FROM goods ORDER BY id LIMIT 2 OFFSET 1;",
        "SELECT id FROM (SELECT id FROM goods ORDER BY id LIMIT 3) ORDER BY id DESC",
        "SELECT total(price) AS t, total(id) AS i FROM goods WHERE id > 10",
        "SELECT iif(price > 2, 'high', 'low') AS p, ifnull(price, 0) AS q FROM goods ORDER BY id",
        "SELECT CAST(code AS INTEGER) AS i, CAST(code AS REAL) AS r, CAST(id AS TEXT) AS t FROM goods ORDER BY id",
        "SELECT max(id, 2) AS m, min(price, 2.0) AS n, max(id, max(2, 3)) AS o FROM goods ORDER BY id",
        "SELECT max(id) AS m, min(name) AS n, count(*) AS c FROM goods -- all of them",
        "SELECT group_concat(DISTINCT 5) AS g, length(group_concat(name)) AS h, length(group_concat(id, ' - ')) AS k FROM goods",
        "SELECT name || '(,)' || id AS x FROM goods WHERE name <> 'LIKE \"a\"' AND id == 1",
        "SELECT strftime('%Y/%m/%d', '2024-03-05 10:00:00') AS d",
    ):
        got = sqlsurface.execute(spark, sql)
        assert got["success"], (sql, got)
        assert [tuple(r.values()) for r in got["data"]] == con.execute(sql).fetchall(), (sql, sqlsurface.translated(sql))


def test_blocks_of_questions(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3 if i % 10 else None) for i in range(120)] + [(500, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    asked = vectors.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(retrieve, "BLOCK", 8)
    for filtered in (False, True):
        got = {(r.query_id, r["rank"], r.vec_id) for r in retrieve.knn(vectors, asked, 6, filtered).collect()}
        want = set()
        for q, e, y in rows[:-1]:
            if q % 7 == 0:
                near = sorted((-float(np.dot(e, v)), i) for i, v, z in rows[:-1] if not filtered or (z is not None and z == y))
                want |= {(q, n, i) for n, (_, i) in enumerate(near[:6])}
        assert got == want


def test_token_counter(tmp_path):
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(ranks)))
    count = analytics.token_counter(str(tmp_path / "ranks"), "cl100k_base")
    assert (count("abc"), count("abcab d"), count("")) == (1, 4, 0)


def test_patterns_are_the_vocabularies_own():
    from tiktoken_ext import openai_public

    import inspect

    source = inspect.getsource(openai_public)
    for name in ("cl100k_base", "o200k_base"):
        assert all(part in source for part in [analytics.PATTERNS[name][:40], analytics.PATTERNS[name][-9:]])


def test_token_counts_of_a_table(spark):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "It's 12345 o'clock\n\n  now", "é漢字 🙂" * 50]
    rows = analytics.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), path, public_tokenizers.PATTERN).collect()
    assert {r.i: r.n_tokens for r in rows} == {i: len(plain.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_vectors_in_cells(spark, tmp_path):
    import numpy as np

    from quillmill.operators import vectors

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centre[i % 12] + rng.normal(size=8)).tolist(), i % 4 if i % 9 else None) for i in range(900)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 8, 1), (1003, rows[0][1], 0), (1004, [0.0] * 8, 2)]
    kind = "vec_id long, embedding array<double>, label int"
    whole = spark.createDataFrame(rows + odd, kind).repartition(5)
    path = str(tmp_path)
    vectors.build(spark, path, whole, 16)
    asked = whole.where("vec_id % 11 = 0").withColumnRenamed("vec_id", "query_id")
    plain = lambda df: {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect()}
    good = whole.where("size(embedding) = 8 AND vec_id <> 1002")
    sound = asked.where("size(embedding) = 8")
    for filtered in (False, True):
        assert plain(vectors.nearest(spark, path, asked, 7, filtered=filtered)) == plain(retrieve.knn(good, sound, 7, filtered))
    new = [(3, rows[700][1], 1), (5, None, 1), (2000, (centre[4] + 0.1).tolist(), 0)]
    of = vectors.upsert(spark, path, spark.createDataFrame(new, kind))
    assert 8 < len(vectors.written_cells(spark, path, of["segments"][0])) <= 16 and 1 <= len(vectors.written_cells(spark, path, of["segments"][1])) <= 2
    after = spark.createDataFrame([r for r in rows + odd if r[0] not in (3, 5)] + new, kind).where("size(embedding) = 8 AND vec_id <> 1002")
    assert plain(vectors.nearest(spark, path, asked, 7)) == plain(retrieve.knn(after, sound, 7))
    assert vectors.nearest(spark, path, asked.limit(0), 7).count() == 0


def test_few_cells_find_most(spark, sf_dir, tmp_path):
    """Of vectors in groups few cells hold the nearest; of the given ones, which lie evenly, only most cells do, and the exact search is there for them."""
    import numpy as np

    from quillmill.operators import vectors

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16)) * 2
    groups = spark.createDataFrame([(i, (centre[i % 20] + 0.5 * rng.normal(size=16)).tolist(), 0) for i in range(2000)], "vec_id long, embedding array<double>, label int")
    ids = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    for n, (own, probes, least) in enumerate(((groups, (1, 4, 16), 0.95), (spark.read.parquet(f"{sf_dir}/embeddings.parquet"), (2, 15, 16), 0.95))):
        asked = own.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
        path = f"{tmp_path}/{n}"
        vectors.build(spark, path, own, 16)
        exact = ids(retrieve.knn(own, asked, 10))
        assert ids(vectors.nearest(spark, path, asked, 10)) == exact
        recall = [len(ids(vectors.nearest(spark, path, asked, 10, probes=p)) & exact) / len(exact) for p in probes]
        print(recall)
        assert recall == sorted(recall) and recall[1] >= least and recall[2] == 1


def test_a_range_join_meets_no_pairs_that_do_not_match(spark):
    spans = spark.createDataFrame([(1, 5.0), (4, 1.0), (4, 9.0), (90, 0.0), (None, 0.0)], "s long, low double")
    values = spark.createDataFrame([(i, i % 8) for i in range(40)] + [(99, None)], "v long, size int")
    got = analytics.range_join(spans, "s", 2, values, "size")
    assert sorted((r.s, r.low, r.v) for r in got.collect()) == sorted((s, b, i) for s, b in ((1, 5.0), (4, 1.0), (4, 9.0)) for i in range(40) if s <= i % 8 <= s + 2)
    plan = __spark_entry__.queries()["sql_join_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bm25_in_small_blocks_and_packs(spark, monkeypatch):
    import math
    import random

    for name, value in (("QUESTIONS", 2), ("CHUNKS", 3), ("BLOCKS", 1), ("OFTEN", 2)):
        monkeypatch.setattr(retrieve, name, value)
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices("a b c d e f g h i j k l".split(), k=rng.randint(0, 9))) for i in range(60)} | {60: "a a b", 61: "a a b"}
    asked = {q: " ".join(rng.choices("a b c d e f x".split(), k=3)) for q in range(9)}
    lists = {i: t.split() for i, t in texts.items()}
    n, mean = len(texts), sum(map(len, lists.values())) / len(texts)
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t in "abcdefghijkl" if (d := sum(t in x for x in lists.values()))}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    want = []
    for q, words in asked.items():
        score = {i: sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in words.split() if w in x) for i, x in lists.items() if set(x) & set(words.split())}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        want += [(q, r, i, round(score[i], 9)) for r, i in enumerate(best) if score[i] > 0]
    frame = lambda d, key: spark.createDataFrame([(i, t) for i, t in d.items()], f"{key} long, text string").repartition(3)
    got = retrieve.bm25(frame(texts, "chunk_id"), frame(asked, "query_id"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in got) == sorted(want)


def test_blocks_of_vectors_are_small(spark):
    vectors = spark.range(3000).selectExpr("id AS vec_id", "array(1.0, id) AS embedding", "1 AS label").coalesce(1)
    assert max(r[0] for r in retrieve._packed(vectors, "vec_id").selectExpr("size(ids)").collect()) <= 1024


def test_texts_are_not_shuffled_to_look_for_repeated_chunks(spark):
    chunks = index._owned(spark.createDataFrame([(i, str(i)) for i in range(20)], "chunk_id long, text string"))
    assert "Window" not in index._latest(chunks)._jdf.queryExecution().toString()
    again = chunks.unionByName(chunks.where("chunk_id = 3").withColumn("text", F.lit("zz")))
    assert {r.chunk_id: r.text for r in index._latest(again).collect()} == {i: "zz" if i == 3 else str(i) for i in range(20)} and index._latest(again).count() == 20
