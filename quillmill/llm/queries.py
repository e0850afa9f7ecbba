"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_spread
from . import bpe, decontam, embed, html, langid, linededup, prefixtrie, recurrent, repair, simhash, suffix, tokencount, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE, encoded and decoded."""
    return bpe.round_trip(read_spread(spark, f"{sf_dir}/documents.parquet"))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by segmentation-marginalised unigram pieces."""
    return langid.identify(read_spread(spark, f"{sf_dir}/documents.parquet"))


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share, kept only in the last of them."""
    return linededup.line_digests(read_spread(spark, f"{sf_dir}/documents.parquet"))


ORACLES["op3_line_dedup"] = linededup.ORACLE


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, read back through the merged capture index."""
    return warc.page_records(read_spread(spark, f"{sf_dir}/pages.parquet"))


ORACLES["op4_warc"] = warc.ORACLE


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly one."""
    return decontam.contaminated(read_spread(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op5_decontamination"] = decontam.ORACLE


@_query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the groups that near ones form."""
    return simhash.simhash_components(read_spread(spark, f"{sf_dir}/documents.parquet"))


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of strings that repeat anywhere, removed."""
    return suffix.repeat_digests(read_spread(spark, f"{sf_dir}/documents.parquet"))


@_query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of web pages, by wrappers induced for each host."""
    return html.extract(read_spread(spark, f"{sf_dir}/pages.parquet"))


@_query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label that are close to each other, and the components they form."""
    return embed.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op9_embedding_dedup"] = embed.ORACLE


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts with the whole-token shortcut."""
    return tokencount.token_counts(read_spread(spark, f"{sf_dir}/documents.parquet"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired by cheapest edits."""
    return repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op11_conversation_repair"] = repair.ORACLE


@_query
def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text by a recurrent network and by counts."""
    return recurrent.scores(read_spread(spark, f"{sf_dir}/documents.parquet"))


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations."""
    return prefixtrie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = prefixtrie.ORACLE
