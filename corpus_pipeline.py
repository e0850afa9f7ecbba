"""A corpus pipeline: raw documents to token ids, in five stages.

Each stage works on all rows that the one before kept and is written as Parquet; the first four drop rows or lines and
return the columns of ``documents``, the last encodes what is left.

What rows of any kind become: null and empty texts, and texts without a letter, go in the first stage. Repeated rows, and rows with
one doc_id, are documents each until near-dedup, which keeps one of equal texts. A null doc_id is kept like any other, but
never in place of one that is not null. Texts of any length are worked on whole. An empty table gives an empty result, and without
benchmark items nothing is contaminated. Columns beyond those of ``documents`` pass the first four stages whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import bpe, decontam, langid, linededup, simhash
from quillmill.llm.shared import settle
from quillmill.session import read_spread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no learned language explains better than all others together, go."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that three documents or more share stay only in the last of them; all documents stay."""
    return linededup.drop_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents tied by a similarity of 0.8 or more of five-word shingles, the one with the smallest doc_id stays. SimHashes
    within three bits give the first ties; bands of min-hashes, filtered by the SimHashes, the others; all are verified."""
    return simhash.keep_one_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a passage at least 0.8 like one, go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, decoded again: counts and digests."""
    return bpe.round_trip(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: SQL cannot say the language model, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_spread(spark, f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage-{i + 1}")
    return docs
