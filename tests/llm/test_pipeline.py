import hashlib

import pytest

import corpus_pipeline
from quillmill.llm import bpe, decontam, langid, linededup, shared, simhash


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pred = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    by_hand = docs.where(docs.doc_id.isin([i for i, (lang, score) in pred.items() if lang != "und" and score >= 0.5]))
    by_hand = linededup.drop_repeated_lines(by_hand)
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(by_hand).collect()}
    by_hand = by_hand.where(by_hand.doc_id.isin([i for i, c in groups.items() if i == c]))
    leaks = [r.doc_id for r in decontam.contaminated(by_hand, bench).select("doc_id").distinct().collect()]
    by_hand = by_hand.where(~by_hand.doc_id.isin(leaks))
    want = {tuple(r) for r in bpe.round_trip(by_hand).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want and 0 < len(want) < docs.count()


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_take_odd_and_empty_tables(spark, sf_dir, tmp_path, odd, none, which):
    docs = {"odd": odd, "none": none}[which]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = [corpus_pipeline.run(spark, str(tmp_path)).count(), docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = whole[1].count()
        whole[1] = stage(spark, whole[1], str(tmp_path))
        assert whole[1].columns == docs.columns and whole[1].count() <= before, name
    assert whole[0] == whole[1].count() and (whole[0] > 0) == (which == "odd")


def test_planted_copies_and_clean_documents(spark, sf_dir, tmp_path):
    """Exact copies, near ones at 0.8 to 0.97 and unlike ones below, repeated lines and benchmark items, through the whole pipeline."""
    import random

    rng = random.Random(6)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    vocabulary = sorted({w for r in given.where("lang = 'en'").limit(60).collect() for w in r.text.split()})
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    similarity = lambda x, y: len(x & y) / len(x | y)
    shingles = lambda words: {tuple(w.lower() for w in words[i : i + 5]) for i in range(len(words) - 4)}
    rows, gone, stay = [], set(), set()

    def add(words, goes):
        rows.append((1_000_000 + len(rows), " ".join(words), "en"))
        (gone if goes else stay).add(rows[-1][0])

    for _ in range(12):
        base = say(400)
        add(base, False)
        add(base, True)
        for edits in (2, 5, 9, 13, 30):  # each breaks five shingles
            words = list(base)
            for at in rng.sample(range(10, 390), edits):
                words[at] = "edited" + rng.choice("abcdefgh") + str(at)
            like = similarity(shingles(base), shingles(words))
            if not 0.78 < like < 0.82:
                add(words, like >= 0.8)
    for item in items[:5]:
        add([*say(100), *item.split(), *say(50)], True)
    for n in (30, 200, 3000):
        add(say(n), False)
    docs = given.limit(0).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True)
    docs.unionByName(given.where("lang IS NOT NULL")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {i: t for i, t, _ in rows}
    kept = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id >= 1_000_000}
    assert set(kept) == stay and len(gone) > 40
    assert all(hashlib.sha256(texts[i].encode()).hexdigest() == digest for i, digest in kept.items())


def test_python_gets_few_rows_at_once(odd, monkeypatch):
    """The plans of language ID and of the encoding hand Python 1,000 rows at once, not the 10,000 that the session is left at."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    conf = odd.sparkSession.conf
    before = conf.get(key)
    for module, stage in ((langid, langid.keep_identified), (bpe, bpe.round_trip)):
        monkeypatch.setattr(module, "settle", lambda df, tag: seen.append(conf.get(key)) or df)
        stage(odd)
    assert seen == ["1000", "1000"] and conf.get(key) == before


def test_a_task_hands_back_free_memory():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = [bytearray(100_000) for _ in range(2000)]
    above = bytearray(100_000)  # the heap's end stays in use, so the C library keeps what is freed below
    del held
    before = resident()
    shared.hand_back()
    assert resident() < before - 100_000_000 and len(above)
