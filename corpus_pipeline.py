"""The training-data pipeline: documents to token ids.

Each stage takes all rows its predecessor kept and its decisions take effect; all but
the last return the columns of documents.  run() writes each stage as a Parquet table in
the shared folder and reads it again for the next.

In every stage an empty table gives an empty one, a null text is an empty text that stays
null, columns besides doc_id, text and n_chars pass unchanged whatever their names, and
rows with equal texts are treated alike.  What a stage does with null ids, ties and repeated
rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tendersift.llm import bpe, decontamination, ngram_join, pii, quality
from tendersift.llm.common import read_table, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; repeated rows are judged alike, and null ids have no label."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the least doc_id.

    Of repeated rows one stays; a null id counts as greater than all others; documents
    without words have no near duplicates and stay, one of each id.
    """
    return ngram_join.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a passage of a benchmark item stands; repeated rows and rows without words or id stay or go by their text alone."""
    return decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the kind in brackets for each span of personal data; n_chars follows, null stays null; all rows stay."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids (little-endian unsigned 32-bit) of each document; all rows stay, other columns end here."""
    return bpe.encoded(docs).selectExpr("doc_id", "lang", "source", "octet_length(ids) div 4 AS n_tokens", "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", encode),
]

#: No stage but decontamination can be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; an empty table gives the last stage's columns without rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
