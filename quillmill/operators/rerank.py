"""Reranking: sparse TF-IDF vectors, their cosines, and greedy diversification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

LAMBDA = 0.5


def fallback_scores(ranked: DataFrame) -> DataFrame:
    """ranked with ``relevance`` 1 - i / n at place i of n: what stands in for a model's score."""
    place = Window.partitionBy("query_id")
    i = F.row_number().over(place.orderBy("rank")) - 1
    return ranked.withColumn("relevance", 1 - i / F.count("*").over(place))


def tfidf(texts: DataFrame, group: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(group, item, term, weight) of texts (group, item, text) (R10): tf = count / length, idf = ln((n + 1) / (df + 1)) within the group."""
    own = texts.select(group, item, tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    n = own.groupBy(group).agg(F.count("*").alias("_n"))
    tf = own.select(group, item, F.size("_t").alias("_len"), F.explode("_t").alias("term")).groupBy(group, item, "_len", "term").agg((F.count("*") / F.col("_len")).alias("_tf"))
    df = tf.groupBy(group, "term").agg(F.count("*").alias("_df"))
    weighed = tf.join(df, [group, "term"]).join(n, group)
    return weighed.select(group, item, "term", (F.col("_tf") * F.log((F.col("_n") + 1) / (F.col("_df") + 1))).alias("weight"))


def cosine_pairs(vectors: DataFrame, group: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(group, a, b, cosine) of all pairs within a group that share a term of some weight (R11); the groups are short lists."""
    vectors = vectors.where("weight <> 0")
    norms = vectors.groupBy(group, item).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a = vectors.select(group, "term", F.col(item).alias("a"), F.col("weight").alias("wa"))
    b = vectors.select(group, "term", F.col(item).alias("b"), F.col("weight").alias("wb"))
    dots = a.join(b, [group, "term"]).where("a < b").groupBy(group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(group, F.col(item).alias("a"), F.col("norm").alias("na")), norms.select(group, F.col(item).alias("b"), F.col("norm").alias("nb"))
    return dots.join(na, [group, "a"]).join(nb, [group, "b"]).select(group, "a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def mmr(scored: DataFrame, pairs: DataFrame, k: int, weight: float = LAMBDA) -> DataFrame:
    """(query_id, position, chunk_id, mmr): greedy choice of (1 - weight) relevance - weight * largest cosine to those chosen.

    scored: query_id, chunk_id, relevance; pairs as from cosine_pairs. Ties: the more relevant first, then the smaller id. A group is
    one question's short list, chosen from in one task."""
    near = F.collect_list(F.struct("chunk_id", "cosine"))
    both = pairs.select("query_id", F.col("a").alias("of"), F.col("b").alias("chunk_id"), "cosine").unionAll(pairs.select("query_id", F.col("b").alias("of"), F.col("a").alias("chunk_id"), "cosine"))
    lists = scored.join(both.groupBy("query_id", F.col("of").alias("chunk_id")).agg(near.alias("near")), ["query_id", "chunk_id"], "left")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["relevance", "chunk_id"], ascending=[False, True])
        left = dict(zip(frame.chunk_id, frame.relevance))
        near = {c: {} if n is None else {x["chunk_id"]: x["cosine"] for x in n} for c, n in zip(frame.chunk_id, frame.near)}
        closest, rows = dict.fromkeys(left, 0.0), []
        while left and len(rows) < k:
            best = max(left, key=lambda c: (1 - weight) * left[c] - weight * closest[c])  # the first of equals
            rows.append((frame.query_id.iloc[0], len(rows), best, (1 - weight) * left.pop(best) - weight * closest[best]))
            for c in left:
                closest[c] = max(closest[c], near[best].get(c, 0.0))
        return pd.DataFrame(rows, columns=["query_id", "position", "chunk_id", "mmr"])

    kind = dict(scored.dtypes)
    return lists.groupBy("query_id").applyInPandas(choose, f"query_id {kind['query_id']}, position long, chunk_id {kind['chunk_id']}, mmr double")
