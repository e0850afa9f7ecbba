import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def packed(text, size=512, overlap=100):
    """The chunk rule, written down plainly."""
    import re

    out, cur = [], ""
    for s in [x for x in re.split(r"(?<=[.!?])\s+", text.strip(" ")) if x]:
        if cur and len(cur) + len(s) + 1 > size:
            out.append(cur.strip())
            cur = cur[-overlap:] + " " + s
        else:
            cur = (cur + " " + s).strip()
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunks_follow_the_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", T.chunks(F.col("text")).alias("c")).collect()
    for r in docs:
        assert r.c == packed(r.text)


@pytest.mark.parametrize("n", [511, 512, 513, 900])
def test_chunk_limits(spark, n):
    text = "a" * (n - 1) + ". " + "b" * 100 + ". c."
    assert one(spark, text, T.chunks) == packed(text)


def test_pages(spark):
    assert one(spark, "x" * 5000, T.pages) == ["x" * 5000]
    got = one(spark, "\n\n".join("y" * 1400 for _ in range(5)), T.pages)
    assert [len(p) for p in got] == [2802, 2802, 1400]


def test_small_ones(spark):
    assert one(spark, "Give a SHORTAGE report", T.answer_style) == "brief"
    assert one(spark, "Explain", T.answer_style) == "detailed"
    assert one(spark, "<think>a\nb</think> yes ", T.without_reasoning) == "yes"
    assert one(spark, "a\x00\n\tb", T.one_line) == "a b"
    assert one(spark, " a​​b\nc ", T.clean_cell) == "a b c"
    assert one(spark, "1st col%%", T.identifier) == "t_1st_col"
    assert one(spark, "%%", T.identifier) == "unnamed_table"
    assert one(spark, "The n page café u like\nx", T.cloud_words) == ["caf", "x"]  # English stop words go
    assert one(spark, "The n page café u like\nx", lambda c: T.cloud_words(c, [])) == ["the", "caf", "x"]
    assert one(spark, "w " * 11001, T.summary_calls) == 3


def test_cut_chunks(spark):
    text = "word " * 300 + "x" * 1200
    got = one(spark, text, T.cut_chunks)
    assert all(len(c) <= 512 for c in got) and got[0] == ("word " * 102).strip() and got[-1] == "x" * 176
    assert got[1].startswith("word") and sum(c.count("word") for c in got) > 300 and one(spark, None, T.cut_chunks) == []
    assert "".join(T.pieces(text)) == text


def test_windows_and_selection_of_long_texts(spark):
    texts = [None, "", "one", "a b c", "a b c d", " a  b\nc d e f g "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {(r.doc_id, r.window_no): r.window_text for r in T.word_windows(df, "text", 3).collect()}
    assert got == {(i, k): " ".join((t or "").split()[3 * k : 3 * k + 3]) for i, t in enumerate(texts) for k in range(-(-len((t or "").split()) // 3))}
    chosen = T.selected_text(F.col("text"), F.when(F.col("doc_id") == 4, F.lit("short")), 4)
    assert [r.c for r in df.orderBy("doc_id").select(chosen.alias("c")).collect()] == ["", "", "one", "a b c", "short", "a b c d"]
