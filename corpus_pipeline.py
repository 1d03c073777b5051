"""The corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result
is written as Parquet and read again. All but the last return the columns of documents, whatever
other columns the table has.

Odd rows, in every stage: an empty table stays empty; texts of any length are read whole; rows
with a null doc_id are judged alone and never count as copies; repeated rows of a doc_id stay or go
together; other null columns and clashing column names change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlake.llm import exact_dedup, language, near_dedup, packing, secrets
from weftlake.llm.common import Scratch, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and empty texts and texts without a letter go. Of languages
    with equal cosines the alphabetically first counts, which keeps the document either way."""
    return language.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of equal texts; a null text counts as empty, and
    empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five words, similarity 0.8); texts
    without words stay."""
    return near_dedup.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by a mark and n_chars brought up to date; null and
    empty texts, and those without a secret, are unchanged. Overlapping secrets become one mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens; a null or empty text is the end id alone, repeated rows
    are packed each, and fill levels that cost the same tie to the fullest."""
    return packing.pack(docs, cache_mb=packing.STAGE_CACHE_MB)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Language identification, MinHash and tokenizing can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
