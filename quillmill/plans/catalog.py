"""All registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import text as T
from ..operators import analytics, hierarchy, index, metadata, rerank, retrieve, vectors
from ..sources import files
from ..streaming import ingest
from ..session import read_spread, settled, shared_folder
from . import agent, sqlsurface
from .sql_queries import DUCK, SQL, SURFACE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that queries spend the most on a row of."""
    return read_spread(spark, f"{sf_dir}/documents.parquet")


def _sql(name: str, statement: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in statement:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(statement)

    QUERIES[name], ORACLES[name] = query, DUCK.get(name, statement)


for _name, _statement in SQL.items():
    _sql(_name, _statement)


def _surface(name: str, statement: str, oracle: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = sqlsurface.session_with(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES if t in statement})
        return sqlsurface.select(own, statement)

    QUERIES[name], ORACLES[name] = query, oracle


for _name, (_statement, _oracle) in SURFACE.items():
    _surface(_name, _statement, _oracle)


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query(ORACLES["sql_join_range"])
def sql_join_range(spark, d):
    """Parts whose size lies in a supplier's span and that cost more than its balance."""
    spans, parts = table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return analytics.range_join(spans, "s_suppkey", 2, parts, "p_size").where("p_retailprice > s_acctbal").select("s_suppkey", "p_partkey")


# Text

_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({_TOKENS}) AS n, len(list_distinct({_TOKENS})) AS different FROM documents")
def token_stats(spark, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("different"))


@query()
def sentence_chunks(spark, d):
    """Documents cut to pages and chunks, as they are indexed."""
    return T.chunk_table(documents(spark, d))


@query()
def learned_sentences(spark, d):
    """Every document's sentences by ends that are learned from all documents."""
    docs = documents(spark, d)
    found = S.with_sentences(docs.select("doc_id", "text"), S.learn(docs))
    return found.select("doc_id", F.posexplode("sentences").alias("place", "sentence"))


@query(f"SELECT doc_id, i AS window_no, array_to_string(ws[i * {T.WINDOW_WORDS} + 1 : (i + 1) * {T.WINDOW_WORDS}], ' ') AS window_text FROM (SELECT doc_id, ws, unnest(range(0, (len(ws) + {T.WINDOW_WORDS} - 1) // {T.WINDOW_WORDS})) AS i FROM (SELECT doc_id, {_WORDS} AS ws FROM documents))")
def word_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return T.word_windows(docs, "text").select("doc_id", F.col("window_no").cast("long").alias("window_no"), "window_text")


@query(f"SELECT doc_id, CASE WHEN len(ws) < {T.FULL_TEXT_WORDS} THEN text WHEN lang = 'en' THEN lang ELSE array_to_string(ws[1:{T.FULL_TEXT_WORDS}], ' ') END AS chosen FROM (SELECT *, {_WORDS} AS ws FROM documents)")
def text_selection(spark, d):
    docs = table(spark, d, "documents").withColumn("summary", F.when(F.col("lang") == "en", F.col("lang")))
    return docs.select("doc_id", T.selected_text(F.col("text"), F.col("summary")).alias("chosen"))


@query("SELECT conv_id, turn, CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in T.BRIEF) + " THEN 'brief' ELSE 'detailed' END AS style FROM conversations")
def answer_style(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.answer_style(F.col("text")).alias("style"))


_CLOUD = (
    "list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), chr(10), ' '), '\\b[nur]\\b', ' ', 'g'), '\\\\u[0-9a-f]{4}', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), ' '), "
    "lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in sorted({*T.NOT_COUNTED, *T.ENGLISH})) + "], w))"
)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_CLOUD}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 1000")
def wordcloud_freq(spark, d):
    """The thousand most frequent words, a top-k report."""
    return analytics.word_frequencies(documents(spark, d))


@query("SELECT c_custkey, lower(regexp_replace(regexp_replace(trim(c_name), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g')) AS name FROM customer")
def identifiers(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.identifier(F.col("c_name")).alias("name"))


# Retrieval

_KNN = """
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) - 1 AS rank
  FROM {queries} q JOIN embeddings e ON {on}) WHERE rank < {k}
"""
_FIFTIETH = "(SELECT * FROM embeddings WHERE vec_id % 50 = 0)"


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names} | ({"rank": F.col("rank").cast("long")} if "rank" in df.columns else {}))


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


@query(f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ({_KNN.format(queries=_FIFTIETH, on='true', k=10)})")
def knn_topk(spark, d):
    """Ten nearest vectors of every fiftieth."""
    return _round(retrieve.knn(table(spark, d, "embeddings"), _asked(spark, d), 10), "score")


@query(f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ({_KNN.format(queries=_FIFTIETH, on='q.label = e.label', k=10)})")
def knn_filtered(spark, d):
    return _round(retrieve.knn(table(spark, d, "embeddings"), _asked(spark, d), 10, filtered=True), "score")


#: Cells of the index of vectors in these queries.
CELLS = 32


@query(ORACLES["knn_topk"])
def vector_index_topk(spark, d):
    """Ten nearest vectors through an index, exactly: cells that can hold none of them are left out."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.build(spark, path, table(spark, d, "embeddings"), CELLS)
    return _round(vectors.nearest(spark, path, _asked(spark, d), 10), "score")


@query(f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ({_KNN.format(queries=_FIFTIETH, on='q.label = e.label', k=10)})".replace("JOIN embeddings e", "JOIN (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding, label FROM embeddings) e"))
def vector_index_upsert(spark, d):
    """The same within labels, after every third vector has been written anew, turned round."""
    path, own = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", table(spark, d, "embeddings")
    vectors.build(spark, path, own.where("vec_id % 3 <> 1"), CELLS)
    vectors.upsert(spark, path, own.where("vec_id % 3 <> 2").withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))))
    return _round(vectors.nearest(spark, path, _asked(spark, d), 10, filtered=True), "score")


def _bm25_sql(k: int) -> str:
    return f"""
WITH own AS (SELECT doc_id, {_TOKENS} AS ts FROM documents
), whole AS (SELECT count(*) AS n, avg(len(ts)) AS mean_length FROM own
), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM own) GROUP BY term
), raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, whole
), idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw
), tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM own) GROUP BY ALL
), asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL
), scored AS (SELECT query_id, doc_id, sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM tf JOIN asked USING (term) JOIN idf USING (term), whole GROUP BY query_id, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM scored)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank < {k} AND score > 0"""


def _bm25(spark, d, k: int) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.bm25(docs, questions, k).withColumnRenamed("chunk_id", "doc_id")


@query(f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({_bm25_sql(10)})")
def bm25_topk(spark, d):
    """Ten best documents of every benchmark item by BM25."""
    return _round(_bm25(spark, d, 10), "score")


#: Entries of the dense and the sparse list that are fused, and of the list that is reranked.
DENSE, SPARSE, CANDIDATES = 200, 100, 20


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, d, "embeddings")
    questions = vectors.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    dense = retrieve.knn(vectors, questions.withColumnRenamed("vec_id", "query_id"), DENSE).select("query_id", F.col("vec_id").alias("document_id"), "rank")
    return dense, _bm25(spark, d, SPARSE).select("query_id", F.col("doc_id").alias("document_id"), "rank")


_ITEMS = "(SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))"
_HYBRID = f"""
WITH lists AS (SELECT query_id, 0 AS list_id, rank, vec_id AS document_id FROM ({_KNN.format(queries=_ITEMS, on='true', k=DENSE)})
  UNION ALL SELECT query_id, 1, rank, doc_id FROM ({_bm25_sql(SPARSE)})
), fused AS (SELECT query_id, document_id, sum(1.0::DOUBLE / (60 + rank + 1)) AS rrf_score, min(list_id * 1000 + rank) AS seen FROM lists GROUP BY ALL)
SELECT query_id, document_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, seen) - 1 AS rank FROM fused"""


@query(f"SELECT query_id, document_id, rank, round(rrf_score, 6) AS rrf_score FROM ({_HYBRID})")
def hybrid_search(spark, d):
    """Nearest vectors and BM25, fused by reciprocal ranks."""
    dense, sparse = _lists(spark, d)
    return _round(retrieve.hybrid(dense, sparse, ["document_id"]), "rrf_score").select("query_id", "document_id", "rank", "rrf_score")


@query(f"""
WITH ranked AS (SELECT h.query_id, h.rank, h.document_id AS chunk_id, s.source AS document_id FROM ({_HYBRID}) h JOIN documents s ON s.doc_id = h.document_id
), n AS (SELECT query_id, count(DISTINCT document_id) AS n FROM ranked GROUP BY query_id
), r AS (SELECT ranked.*, n, min(rank) OVER (PARTITION BY query_id, document_id) AS first, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS i FROM ranked JOIN n USING (query_id)
), k AS (SELECT *, greatest(ceil(CASE WHEN n <= 2 THEN 20 WHEN n <= 5 THEN 50 WHEN n <= 10 THEN 100 ELSE least(100, n * 10) END / n), 10) AS per FROM r
), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, rank) - 1 AS position FROM k WHERE i <= per)
SELECT query_id, position, document_id, chunk_id FROM p WHERE position < least(per * n, 100)""")
def balanced_select(spark, d):
    """The fused lists with about as many rows of each source."""
    dense, sparse = _lists(spark, d)
    ranked = retrieve.hybrid(dense, sparse, ["document_id"]).withColumnRenamed("document_id", "chunk_id")
    source = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"))
    return retrieve.balanced(ranked.join(source, "chunk_id")).select("query_id", F.col("position").cast("long").alias("position"), "document_id", "chunk_id")


@query(f"""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0
), per AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.label AS document_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) - 1 AS rank
  FROM q JOIN embeddings e ON e.label IN (1, 2, 3)) WHERE rank < 4
), have AS (SELECT query_id, count(*) AS have FROM per GROUP BY query_id
), more AS (SELECT k.query_id, e.label AS document_id, k.vec_id AS chunk_id, k.rank FROM ({_KNN.format(queries=_FIFTIETH, on='true', k=12)}) k JOIN embeddings e ON e.vec_id = k.vec_id LEFT JOIN have h ON h.query_id = k.query_id WHERE k.rank < 12 - coalesce(have, 0)
), both_ AS (SELECT query_id, document_id, chunk_id, 0 AS part, document_id AS a, rank AS b FROM per UNION ALL SELECT query_id, document_id, chunk_id, 1, rank, 0 FROM more)
SELECT * FROM (SELECT query_id, document_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, a, b, chunk_id) - 1 AS position FROM both_) WHERE position < 12""")
def multi_document_topk(spark, d):
    """Vectors of three stated labels, evenly."""
    vectors, asked = table(spark, d, "embeddings"), _asked(spark, d)
    label = vectors.select("vec_id", F.col("label").alias("document_id"))
    parts = None
    for one in (1, 2, 3):
        own = retrieve.knn(vectors.where(F.col("label") == one), asked, 4).withColumn("document_id", F.lit(one)).withColumn("position", F.lit(one))
        parts = own if parts is None else parts.unionByName(own)
    overall = retrieve.knn(vectors, asked, 12).join(label, "vec_id")
    out = retrieve.multi_document(parts.withColumnRenamed("vec_id", "chunk_id"), overall.withColumnRenamed("vec_id", "chunk_id"), 3, total=12)
    return out.withColumn("position", F.col("position").cast("long"))


_TFIDF = f"""
WITH own AS (SELECT query_id, doc_id AS chunk_id, {_TOKENS} AS ts FROM ({_bm25_sql(CANDIDATES)}) JOIN documents USING (doc_id)
), n AS (SELECT query_id, count(*) AS n FROM own GROUP BY query_id
), tf AS (SELECT query_id, chunk_id, term, count(*) / any_value(length) AS tf FROM (SELECT query_id, chunk_id, len(ts) AS length, unnest(ts) AS term FROM own) GROUP BY query_id, chunk_id, term
), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY query_id, term
), w AS (SELECT query_id, chunk_id, term, tf * ln((n + 1) / (df + 1)) AS weight FROM tf JOIN df USING (query_id, term) JOIN n USING (query_id) WHERE tf * ln((n + 1) / (df + 1)) <> 0
), norm AS (SELECT query_id, chunk_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY query_id, chunk_id)
SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, round(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 6) AS cosine
FROM w a JOIN w b ON a.query_id = b.query_id AND a.term = b.term AND a.chunk_id < b.chunk_id
JOIN norm na ON na.query_id = a.query_id AND na.chunk_id = a.chunk_id JOIN norm nb ON nb.query_id = b.query_id AND nb.chunk_id = b.chunk_id
GROUP BY a.query_id, a.chunk_id, b.chunk_id"""


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), "text")


def _candidates(spark, d) -> DataFrame:
    """(query_id, rank, chunk_id, text): what each benchmark item found by BM25, a short list however large the corpus is, and so searched for once."""
    docs = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    found = settled(_bm25(spark, d, CANDIDATES).select("query_id", "rank", F.col("doc_id").alias("chunk_id")), "candidates")
    return settled(found.join(docs, "chunk_id"), "candidates")


@query(_TFIDF)
def tfidf_cosine_pairs(spark, d):
    """Cosines of the candidates of each question."""
    return rerank.cosine_pairs(settled(rerank.tfidf(_candidates(spark, d)), "weights")).withColumn("cosine", F.round("cosine", 6))


_MMR = f"""
WITH RECURSIVE rel AS (SELECT query_id, doc_id AS chunk_id, 1 - (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1) / count(*) OVER (PARTITION BY query_id) AS relevance FROM ({_bm25_sql(CANDIDATES)})
), p AS ({_TFIDF.replace("round(sum(a.weight", "(sum(a.weight").replace(", 6) AS cosine", ") AS cosine")}
), near AS (SELECT query_id, a AS chunk_id, b AS other, cosine FROM p UNION ALL SELECT query_id, b, a, cosine FROM p
), pick AS (
  SELECT DISTINCT query_id, -1 AS position, CAST([] AS BIGINT[]) AS chosen, {{'score': 0.0::DOUBLE, 'relevance': 0.0::DOUBLE, 'back': 0::BIGINT}} AS best FROM rel
  UNION ALL
  SELECT query_id, position + 1, list_append(chosen, -best.back), best FROM (
    SELECT query_id, position, chosen, max({{'score': {1 - rerank.LAMBDA} * relevance - {rerank.LAMBDA} * closest, 'relevance': relevance, 'back': -chunk_id}}) AS best FROM (
      SELECT s.query_id, s.position, s.chosen, r.chunk_id, r.relevance, coalesce(max(CASE WHEN list_contains(s.chosen, n.other) THEN n.cosine END), 0) AS closest
      FROM pick s JOIN rel r ON r.query_id = s.query_id LEFT JOIN near n ON n.query_id = r.query_id AND n.chunk_id = r.chunk_id
      WHERE NOT list_contains(s.chosen, r.chunk_id) AND s.position < {CANDIDATES - 1} GROUP BY s.query_id, s.position, s.chosen, r.chunk_id, r.relevance)
    GROUP BY query_id, position, chosen))
SELECT query_id, position::BIGINT AS position, chosen[-1] AS chunk_id, round(best.score, 6) AS mmr FROM pick WHERE position >= 0"""


@query(_MMR)
def mmr_rerank(spark, d):
    """The candidates of each question, relevant and different ones first."""
    found = _candidates(spark, d)
    scored = rerank.fallback_scores(found.drop("text"))
    return rerank.mmr(scored.select("query_id", "chunk_id", "relevance"), rerank.cosine_pairs(settled(rerank.tfidf(found), "weights")), CANDIDATES).withColumn("mmr", F.round("mmr", 6))


@query("SELECT conv_id AS query_id, turn AS chunk_id, round(1 - (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / count(*) OVER (PARTITION BY conv_id), 6) AS relevance FROM conversations")
def fallback_scores(spark, d):
    scored = rerank.fallback_scores(_turns(spark, d).withColumn("rank", F.col("chunk_id")))
    return scored.select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


# Conversations, citations, records

_RECENT = "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4"


@query(_RECENT)
def recent_history(spark, d):
    return analytics.recent_history(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


def _cited(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("document_id"), (F.col("l_partkey") % 25).alias("page_no"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("title"))


_CITED = "(SELECT l_orderkey AS query_id, l_suppkey AS document_id, l_partkey % 25 AS page_no, l_linenumber AS rank, l_returnflag AS title FROM lineitem)"


@query(f"SELECT query_id, document_id, page_no, rank, title FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page_no ORDER BY rank, title) AS r FROM {_CITED}) WHERE r = 1")
def unique_citations(spark, d):
    return analytics.unique_citations(_cited(spark, d)).select("query_id", "document_id", "page_no", "rank", "title")


@query(f"SELECT query_id, document_id, arg_min(title, row(rank, title)) AS title, array_to_string(list_sort(list_distinct(list(page_no))), ',') AS pages FROM {_CITED} GROUP BY query_id, document_id")
def source_groups(spark, d):
    return analytics.source_groups(_cited(spark, d))


@query(f"SELECT u.query_id, u.document_id, u.page_no, c.title FROM (SELECT o_orderkey AS query_id, o_custkey % 100 AS document_id, o_custkey % 25 AS page_no FROM orders) u JOIN (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page_no ORDER BY rank, title) AS r FROM {_CITED}) c ON c.r = 1 AND c.query_id = u.query_id AND c.document_id = u.document_id AND c.page_no = u.page_no")
def citation_join(spark, d):
    used = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 100).alias("document_id"), (F.col("o_custkey") % 25).alias("page_no"))
    return analytics.resolve_citations(used, _cited(spark, d)).select("query_id", "document_id", "page_no", "title")


@query("""
WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS title, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer
), tree AS (SELECT id, title, parent_id, 0 AS level, id AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, n.title, n.parent_id, level + 1, path || '/' || n.id FROM nodes n JOIN tree t ON n.parent_id = t.id)
SELECT id, title, parent_id, level, path FROM tree""")
def mindmap_tree(spark, d):
    """Regions, nations, suppliers and customers as one forest."""
    node = lambda t, p, key, name, up, parent: table(spark, d, t).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(name).alias("title"), (F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")).alias("parent_id"), F.lit(0).alias("position"))
    nodes = node("region", "r", "r_regionkey", "r_name", "", None).unionByName(node("nation", "n", "n_nationkey", "n_name", "r", "n_regionkey"))
    nodes = nodes.unionByName(node("supplier", "s", "s_suppkey", "s_name", "n", "s_nationkey")).unionByName(node("customer", "c", "c_custkey", "c_name", "n", "c_nationkey"))
    return hierarchy.forest(nodes)


@query("SELECT 'u' || conv_id AS user_id, 1::BIGINT AS threads, 0::BIGINT AS documents, count(*) AS chats FROM conversations GROUP BY conv_id")
def metadata_totals(spark, d):
    return metadata.totals(metadata.from_conversations(table(spark, d, "conversations")))


@query("SELECT 'u' || conv_id AS user_id, 'new' AS name, count(*) + 1 AS chats, max(turn) AS last_ts FROM conversations GROUP BY conv_id")
def metadata_append(spark, d):
    """A chat more in every thread, which is renamed, and its first chat put behind and taken away again."""
    users = metadata.from_conversations(table(spark, d, "conversations"))
    users = users.withColumn("threads", metadata.rename_thread("t1", "new", 5))
    users = users.withColumn("threads", metadata.append("t1", "chats", F.slice(F.element_at("threads", "t1")["chats"], 1, 1), 6))
    t = F.element_at("threads", "t1")
    return users.select("user_id", t["name"].alias("name"), F.size(t["chats"]).cast("long").alias("chats"), F.array_max(F.transform(t["chats"], lambda c: c["ts"])).alias("last_ts"))


@query("SELECT 'u' || conv_id AS user_id, count(*) - 1 AS chats FROM conversations GROUP BY conv_id")
def metadata_delete_chat(spark, d):
    users = metadata.from_conversations(table(spark, d, "conversations")).withColumn("threads", metadata.delete_chat("t1", 0))
    return users.select("user_id", F.size(F.element_at("threads", "t1")["chats"]).cast("long").alias("chats"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Tumbling windows over events, an extension; the same plan runs on a stream."""
    out = ingest.windowed_counts(table(spark, d, "events"))
    return out.withColumn("total", F.round("total", 6))


@query("SELECT quality, count(*) AS documents, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY quality")
def label_filter(spark, d):
    own = table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 0"), "doc_id")
    return own.groupBy("quality").agg(F.count("*").alias("documents"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


_RANKED = "SELECT p_brand AS query_id, {n} AS list_id, rank, p_partkey AS document_id FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {by} DESC, p_partkey) - 1 AS rank FROM part) WHERE rank < 20"


@query(f"""
WITH lists AS ({_RANKED.format(n=0, by='p_retailprice')} UNION ALL {_RANKED.format(n=1, by='p_size')}
), fused AS (SELECT query_id, document_id, sum(1.0::DOUBLE / (60 + rank + 1)) AS rrf_score, min(list_id * 1000 + rank) AS seen FROM lists GROUP BY ALL)
SELECT query_id, document_id, round(rrf_score, 6) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, seen) - 1 AS rank FROM fused""")
def rrf_fusion(spark, d):
    """Two rankings of each brand's parts, fused."""
    parts = table(spark, d, "part")
    ranked = None
    for n, by in enumerate(("p_retailprice", "p_size")):
        order = Window.partitionBy("p_brand").orderBy(F.desc(by), "p_partkey")
        own = parts.select(F.col("p_brand").alias("query_id"), F.lit(n).alias("list_id"), (F.row_number().over(order) - 1).alias("rank"), F.col("p_partkey").alias("document_id")).where("rank < 20")
        ranked = own if ranked is None else ranked.unionByName(own)
    return _round(retrieve.fuse(ranked, ["document_id"]), "rrf_score")


@query("""
WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
), up AS (SELECT id AS below, id, parent_id FROM nodes UNION ALL SELECT below, n.id, n.parent_id FROM up JOIN nodes n ON up.parent_id = n.id)
SELECT id, count(*) AS n FROM up GROUP BY id""")
def subtree_sizes(spark, d):
    return hierarchy.subtree_sizes(mindmap_tree(spark, d))


@query("SELECT source, doc_id // 64 AS part, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY ALL")
def joined_text(spark, d):
    """The texts of each source behind one another, in parts."""
    return analytics.joined_text(documents(spark, d), ["source"], "doc_id")


@query(f"SELECT query_id, count(DISTINCT document_id) + coalesce(any_value(web), 0) AS sources FROM {_CITED} LEFT JOIN (SELECT o_orderkey AS query_id, count(*) AS web FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderkey) USING (query_id) GROUP BY query_id")
def source_counts(spark, d):
    web = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("query_id"))
    cited = _cited(spark, d)
    return analytics.source_counts(cited, web.join(cited.select("query_id"), "query_id", "left_semi"))


@query(f"""
WITH tree AS ({ORACLES["mindmap_tree"]})
SELECT id, 'about ' || title AS description, 1 AS attempt FROM tree""")
def mindmap_descriptions(spark, d):
    """What a deterministic describer says of every node of the forest, asked in groups."""

    def describe(groups, attempt):
        return groups.select("group", F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), F.concat(F.lit("about "), n["title"]).alias("description"))).alias("answers"))

    return hierarchy.described(mindmap_tree(spark, d), describe).withColumn("attempt", F.col("attempt").cast("int"))


@query()
def mindmap_layout(spark, d):
    """Where the nodes of each region's map are drawn, every second description open."""
    tree = mindmap_tree(spark, d)
    open_ = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    box = hierarchy.box_height(F.repeat(F.col("title"), 20), open_)
    return hierarchy.layout(tree.select(F.get(hierarchy.path_ids(F.col("path")), F.lit(0)).alias("map"), "id", "parent_id", "level", box.alias("box")))


@query(f"""
WITH q AS (SELECT item_id AS question_id, item_id % 4 AS kind FROM benchmark
), hits AS (SELECT query_id AS question_id, count(*) AS n FROM ({_bm25_sql(3)}) GROUP BY query_id)
SELECT question_id, CASE kind WHEN 1 THEN 'sql_query' WHEN 2 THEN 'web_search' ELSE 'answer' END AS action, CASE kind WHEN 1 THEN 6 WHEN 3 THEN 1 ELSE 0 END AS sql_tries,
  CASE kind WHEN 2 THEN 2 ELSE 0 END AS web_tries, coalesce(n, 0) + CASE kind WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS notes, true AS done FROM q LEFT JOIN hits USING (question_id)""")
def question_loop(spark, d):
    """Every benchmark item through the loop with deterministic choices: some ask for statements or searches without end, some once, some not."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    found = settled(_bm25(spark, d, 3).select(F.col("query_id").alias("question_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("note")), "notes")
    kind = F.col("question_id") % 4
    action = F.when(kind == 1, "sql_query").when(kind == 2, "web_search").when((kind == 3) & (F.col("sql_tries") == 0), "sql_query").otherwise("answer")
    generate = lambda states: states.select("question_id", action.alias("action"), F.concat(F.lit("after "), F.size("notes").cast("string")).alias("answer"))
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("k")).agg(F.count("*").alias("n"))
    sql = lambda states: states.join(rows, F.col("question_id") % 10 == F.col("k")).select("question_id", F.concat(F.lit("rows "), F.col("n").cast("string")).alias("note"))
    say = lambda word: lambda states: states.select("question_id", F.lit(word).alias("note"))
    states = agent.ask(questions, lambda q: found.join(q, "question_id", "left_semi"), generate, {"sql_query": sql, "web_search": say("web"), "self_knowledge": say("known")})
    return states.select("question_id", "action", "sql_tries", "web_tries", F.size("notes").cast("long").alias("notes"), "done")


@query(r"""
WITH parts AS (SELECT item_id, unnest(string_split_regex(trim(text), '\s*\n+\s*')) AS part FROM benchmark)
SELECT item_id AS question_id, CASE WHEN count(*) = 1 THEN any_value(length(part))::VARCHAR ELSE count(*)::VARCHAR || ' parts' END AS answer FROM (SELECT *, row_number() OVER (PARTITION BY item_id) AS r FROM parts) WHERE r <= 10 GROUP BY item_id""")
def question_parts(spark, d):
    """Every item cut into its lines, each answered by its length, the answers put together."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    cut = lambda q: q.select("question_id", F.posexplode(F.split(F.btrim("question", F.lit(" \t\n\x0b\x0c\r")), r"\s*\n+\s*")).alias("place", "question"))
    size = lambda q: q.select("question_id", F.length("question").cast("string").alias("answer"))
    combine = lambda q: q.select("question_id", F.concat(F.size("answers").cast("string"), F.lit(" parts")).alias("answer"))
    return agent.ask_in_parts(questions, cut, size, combine)


# Index, records, context


def _new_index(spark) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def _indexed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("chunk_id"), "text")


def _found(spark, d, path: str, **scope) -> DataFrame:
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = index.search(spark, path, questions, 10, **scope)
    return _round(found.withColumnRenamed("chunk_id", "doc_id").select("query_id", "rank", "doc_id", "score"), "score")


_SEARCHED = f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({_bm25_sql(10)})"


@query(_SEARCHED)
def index_search(spark, d):
    """The same search over a written index: blocks of postings, of which those are read that can reach the ten best."""
    path = _new_index(spark)
    index.put(spark, path, _indexed(documents(spark, d)))
    return _found(spark, d, path)


@query(_SEARCHED)
def index_search_owners(spark, d):
    """Over an index of many users and threads, neither named: one collection."""
    path = _new_index(spark)
    index.put(spark, path, documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("user_id"), F.col("lang").alias("thread_id")))
    return _found(spark, d, path)


@query(_SEARCHED.replace("FROM documents", "FROM (SELECT * FROM documents WHERE lang = 'de')"))
def index_search_thread(spark, d):
    """Over one thread of all users."""
    path = _new_index(spark)
    index.put(spark, path, documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("user_id"), F.col("lang").alias("thread_id")))
    return _found(spark, d, path, thread="de")


@query(_SEARCHED.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN lang || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"))
def index_incremental(spark, d):
    """Over an index that was written in parts: new chunks, changed ones and deletions give what one written at once gives."""
    path, docs = _new_index(spark), documents(spark, d)
    index.put(spark, path, _indexed(docs.where("doc_id % 2 = 0")))
    index.put(spark, path, _indexed(docs.where("doc_id % 2 <> 0")))
    gone = docs.where("doc_id % 7 = 3").select(F.col("doc_id").alias("chunk_id"))
    index.put(spark, path, _indexed(docs.where("doc_id % 5 = 1 AND doc_id % 7 <> 3").withColumn("text", F.concat_ws(" ", "lang", "text"))), gone)
    return _found(spark, d, path)


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0")
def index_snapshot(spark, d):
    """What a reader of the first version sees while and after another is published."""
    path, docs = _new_index(spark), documents(spark, d)
    first = index.put(spark, path, _indexed(docs.where("doc_id % 3 <> 0")))
    index.put(spark, path, _indexed(docs.where("doc_id % 4 = 0").withColumn("text", F.lit("new"))))
    return index.chunks_of(spark, path, version=first["version"]).select(F.col("chunk_id").alias("doc_id"), "text")


@query("SELECT source AS user_id, term, count(*) AS df FROM (SELECT source, unnest(list_distinct(" + _TOKENS + ")) AS term FROM documents) GROUP BY ALL")
def index_term_counts(spark, d):
    """The document frequencies of each user's terms, as an index in three segments sums them."""
    path, docs = _new_index(spark), documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("user_id"))
    index.put(spark, path, docs.withColumn("text", F.when(F.col("chunk_id") % 4 == 0, "old words").otherwise(F.col("text"))).where("chunk_id % 3 <> 1"))
    index.put(spark, path, docs.where("chunk_id % 3 = 1"))
    index.put(spark, path, docs.where("chunk_id % 4 = 0"))
    terms = index.read(spark, path, index.manifest(spark, path), "terms")
    return terms.groupBy("user_id", "term").agg(F.sum("df").alias("df")).where("df > 0")


@query("SELECT p_partkey AS chunk_id, CASE WHEN p_size % 3 = 0 THEN 'new' ELSE p_name END AS content FROM part WHERE p_size % 3 = 0 OR p_partkey % 2 = 0")
def index_upsert(spark, d):
    """Chunks that are written anew replace those of the same id."""
    parts = table(spark, d, "part").withColumnRenamed("p_partkey", "chunk_id")
    old = parts.where("chunk_id % 2 = 0").select("chunk_id", F.col("p_name").alias("content"))
    return index.keep_latest(old, parts.where("p_size % 3 = 0").select("chunk_id", F.lit("new").alias("content")))


@query("SELECT conv_id AS query_id, turn % 3 AS document_id, count(*) AS chunks FROM conversations GROUP BY ALL")
def chunks_per_document(spark, d):
    return analytics.chunks_per_document(table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") % 3).alias("document_id")))


@query("SELECT conv_id, turn, '[Document: ' || role || ']' || chr(10) || chr(10) || text AS context FROM conversations WHERE text IS NOT NULL")
def prompt_context(spark, d):
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", retrieve.context(F.col("role"), F.col("text")).alias("context"))


@query("SELECT conv_id AS query_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations WHERE text IS NOT NULL) WHERE r < 8 GROUP BY conv_id")
def node_context(spark, d):
    turns = table(spark, d, "conversations").where("text IS NOT NULL")
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return retrieve.node_context(ranked.select(F.col("conv_id").alias("query_id"), "rank", F.col("text").alias("content")))


@query("SELECT vec_id, 64::BIGINT AS size FROM embeddings")
def dimension_check(spark, d):
    return retrieve.check_dimension(table(spark, d, "embeddings"), 64).select("vec_id", F.size("embedding").cast("long").alias("size"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00\n\t]+', ' ', 'g') AS line FROM documents")
def prompt_line(spark, d):
    return table(spark, d, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("SELECT doc_id, trim('answer ' || coalesce(text, '')) AS answer FROM documents")
def reasoning_strip(spark, d):
    """Each text as an answer behind marked reasoning, which goes."""
    marked = F.concat(F.lit("<think>first\nthis</think>answer "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", T.without_reasoning(marked).alias("answer"))


@query("SELECT c_custkey, trim(c_name || ' x') AS cell FROM customer")
def cell_cleaning(spark, d):
    cell = F.concat(F.lit("\u00a0"), F.col("c_name"), F.lit("\u200b\ufeff\u00a0x\n"))
    return table(spark, d, "customer").select("c_custkey", T.clean_cell(cell).alias("cell"))


@query("SELECT source, list(DISTINCT lang ORDER BY lang) FILTER (WHERE lang IS NOT NULL) AS langs FROM documents GROUP BY source")
def ordered_distinct(spark, d):
    docs = table(spark, d, "documents").where("lang IS NOT NULL").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    every = table(spark, d, "documents").select("source").distinct()
    return every.join(docs.select("source", analytics.ordered_distinct(F.array_sort(F.concat("langs", "langs"))).alias("langs")), "source", "left")


_USERS = "SELECT 'u' || conv_id AS user_id"


@query(f"{_USERS}, 2::BIGINT AS made, 0::BIGINT AS cleared, 1::BIGINT AS deleted FROM conversations GROUP BY conv_id")
def metadata_threads(spark, d):
    """Threads made, cleared and deleted in every record."""
    users = metadata.from_conversations(table(spark, d, "conversations"))
    users = users.withColumn("threads", metadata.create_thread("t2", "second", 7)).withColumn("made", F.size("threads").cast("long"))
    users = users.withColumn("threads", metadata.clear_chats("t1")).withColumn("cleared", F.size(F.element_at("threads", "t1")["chats"]).cast("long"))
    users = users.withColumn("threads", metadata.delete_thread("t2"))
    return users.select("user_id", "made", "cleared", F.size("threads").cast("long").alias("deleted"))


@query(f"{_USERS}, 'd' || conv_id || '_2' AS doc_id FROM conversations GROUP BY conv_id")
def metadata_find_document(spark, d):
    users = metadata.from_conversations(table(spark, d, "conversations"))
    own = F.array(*[F.struct(F.concat(F.lit("d"), F.substring("user_id", 2, 20), F.lit(f"_{i}")).alias("doc_id"), F.lit(f"file{i}").alias("file_name")) for i in (1, 2)])
    users = users.withColumn("threads", metadata.append("t1", "documents", own, 3))
    return users.select("user_id", metadata.find_document("t1", "file2")["doc_id"].alias("doc_id"))


@query(f"{_USERS}, position, CASE WHEN position = 0 THEN 't1' ELSE 't2' END AS thread FROM (SELECT DISTINCT conv_id FROM conversations), range(2) p(position)")
def thread_order(spark, d):
    users = metadata.from_conversations(table(spark, d, "conversations")).withColumn("threads", metadata.create_thread("t2", "abc", -1))
    return metadata.thread_order(users, "updated").withColumn("position", F.col("position").cast("long"))


@query(f"{_USERS}, conv_id % 2 = 0 AS before, true AS after FROM conversations GROUP BY conv_id")
def extra_done_flag(spark, d):
    users = metadata.from_conversations(table(spark, d, "conversations")).withColumn("extras", F.create_map(F.lit("t1"), F.substring("user_id", 2, 20).cast("long") % 2 == 0))
    return users.withColumn("before", metadata.extra_done("t1")).withColumn("extras", metadata.extra_done("t1", F.lit(True))).select("user_id", "before", metadata.extra_done("t1").alias("after"))


@query("SELECT c_custkey::VARCHAR AS user_id, c_name AS name, c_custkey || '@x' AS email FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 's' || s_suppkey, 'New User', 's' || s_suppkey || '@x' FROM supplier")
def create_users(spark, d):
    """Suppliers as new users twice, and customers that are users already."""
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("name"), F.concat(F.col("c_custkey").cast("string"), F.lit("@x")).alias("email"))
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    s = table(spark, d, "supplier").select(key.alias("user_id"), F.lit("new user").alias("name"), F.concat(key, F.lit("@x")).alias("email"))
    again = s.withColumn("user_id", F.concat(F.lit("z"), "user_id"))
    return metadata.create_users(c, s.unionByName(again).unionByName(c))


@query("SELECT 'u7' AS user_id, count(*) AS chats FROM conversations WHERE conv_id = 7 HAVING count(*) > 0")
def user_profile(spark, d):
    found = metadata.profile(metadata.from_conversations(table(spark, d, "conversations")).withColumn("password", F.lit("x")), "u7")
    return metadata.totals(found).select("user_id", "chats")


# Sources, sinks and envelopes, over what Spark has written of the tables


@query("SELECT p_partkey, p_name, p_brand AS p_brand_2, p_size FROM part")
def csv_round_trip(spark, d):
    """Parts as a CSV file whose header has blanks, and two names that are one to SQL, read as a table."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("\u00a0")).alias("p_name"), "p_brand", "p_size")
    parts.toDF("P partkey", "p name", "P-brand!", "p_size").withColumnRenamed("p_size", "p.size").coalesce(1).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    found = files.read_csv(spark, path)
    return found.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_brand").alias("p_brand_2"), F.col("p_size").cast("int").alias("p_size"))


@query("SELECT 'd' || conv_id AS id, turn::INTEGER AS number, text FROM conversations WHERE text IS NOT NULL")
def parsed_round_trip(spark, d):
    """Conversations as parsed documents, a page a turn, written by owner, read again and cut into pages."""
    path = f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    page = F.struct(F.col("turn").cast("int").alias("number"), "text", F.array().cast("array<string>").alias("images"))
    parsed = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("content"))
    name = F.concat(F.lit("d"), F.col("conv_id").cast("string"))
    files.write_parsed(parsed.select(name.alias("id"), F.lit("txt").alias("type"), name.alias("file_name"), name.alias("title"), F.lit("").alias("full_text"), "content", (F.col("conv_id") % 7).cast("string").alias("user_id"), F.lit("t").alias("thread_id")), path)
    return files.document_pages(files.read_written(spark, path))


_ENVELOPES = [
    "SELECT o_orderkey FROM orders WHERE o_orderkey / 2 > 10",
    "  select c_custkey from customer limit 3;",
    "SELECT 'drop' FROM orders",
    "WITH x AS (SELECT 1) SELECT * FROM x",
    "SELECT nothing FROM orders",
]


@query("""
WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey // 2 > 10), c AS (SELECT least(count(*), 3) AS n FROM customer)
SELECT 0::BIGINT AS place, true AS success, n AS row_count, n > 500 AS truncated, least(n, 500) AS shown FROM n UNION ALL SELECT 1, true, n, false, n FROM c
UNION ALL SELECT unnest([2, 3, 4]), false, 0, false, 0""")
def surface_envelopes(spark, d):
    """What the guard and the envelope say of five statements."""
    own = sqlsurface.session_with(spark, {t: f"{d}/{t}.parquet" for t in ("orders", "customer")})
    said = [sqlsurface.execute(own, s) for s in _ENVELOPES]
    rows = [(i, e["success"], e.get("row_count", 0), e.get("truncated", False), len(e.get("data", []))) for i, e in enumerate(said)]
    return spark.createDataFrame(rows, "place long, success boolean, row_count long, truncated boolean, shown long")
