"""Exact deduplication by progressive refinement (operator 1), DataFrame functions only.

Groups are refined from cheap keys to the full hash: length, then a hash of the prefix, then
SHA-256 of the whole text. Each level groups only the rows that the level before left with
company, and each is an aggregation that Spark combines before the shuffle, so a text that a
third of all rows repeat leaves each task as one row. A row whose length or prefix nobody
shares is done at that level: its full hash is never compared.

`drop_copies` reads whole texts for full hashes only where length and prefix are shared. The
report of `exact_dedup` gives every row's SHA-256, so its one scan of the texts makes all keys,
and the levels work on those; texts are never shuffled there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import HOT, SPACE, Scratch, counted, documents, drop_ids, text_or_empty

#: Code points of the normalised text that the second level hashes.
PREFIX_CHARS = 64


def _normalised() -> Column:
    return F.regexp_replace(text_or_empty(), SPACE, " ")


def text_keys(docs: DataFrame, full: bool = True) -> DataFrame:
    """doc_id, n_chars_norm, prefix_hash and (where full) text_sha256 of each row's normalised text."""
    norm = docs.select("doc_id", _normalised().alias("norm"))
    keys = [F.length("norm").alias("n_chars_norm"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash")]
    return norm.select("doc_id", *keys, *([F.sha2("norm", 256).alias("text_sha256")] if full else []))


def _with_company(rows: DataFrame, *cols: str) -> DataFrame:
    """The rows whose cols another row has too."""
    return rows.join(counted(rows.groupBy(*cols).agg(F.count("*").alias("c")).filter("c > 1").select(*cols)), list(cols), "left_semi")


def levels(keys: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows that share their length with another row, and of these the rows that share their prefix too."""
    by_length = scratch.write(_with_company(keys, "n_chars_norm"), "by_length")
    return by_length, scratch.write(_with_company(by_length, "n_chars_norm", "prefix_hash"), "by_prefix")


def equal_texts(rows: DataFrame) -> DataFrame:
    """The groups of two rows or more with equal full hashes: keys, keep_id and group_size."""
    groups = rows.groupBy("n_chars_norm", "prefix_hash", "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.filter("group_size > 1")


def _joined(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """rows with keep_id and group_size of their group, null where they have none. The few hot groups
    are broadcast, so no key with a large part of all rows goes through the shuffle."""
    on = ["n_chars_norm", "prefix_hash", "text_sha256"]
    hot = F.broadcast(groups.filter(F.col("group_size") > HOT * n).select(*on, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")))
    cold = counted(groups.filter(F.col("group_size") <= HOT * n))
    # Rows of hot groups get a key of their own each, so the second join spreads them.
    mark = F.when(F.col("hot_size").isNull(), F.lit(0)).otherwise(F.xxhash64("doc_id").bitwiseOR(F.lit(1)))
    rows = rows.join(hot, on, "left").withColumn("mark", mark)
    out = rows.join(cold.withColumn("mark", F.lit(0).cast("long")), [*on, "mark"], "left")
    both = {"keep_id": F.coalesce("hot_id", "keep_id"), "group_size": F.coalesce("hot_size", "group_size")}
    return out.withColumns(both).drop("hot_id", "hot_size", "mark")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars_norm.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text
    counts as empty; all empty texts are equal. Texts differ unless they are identical after
    each run of white space became one space; texts of any length are hashed whole. doc_id is a
    key: repeated rows of one doc_id share one decision. A null doc_id is never the smallest; it
    stays only in a group without other ids. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    keys = scratch.write(text_keys(docs), "keys")
    _, by_prefix = levels(keys, scratch)
    groups = scratch.write(equal_texts(by_prefix), "groups")
    joined = _joined(keys, groups, keys.count())
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return scratch.result(joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "n_chars_norm",
    ))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each group of equal texts: the one with the smallest doc_id.

    A null text counts as empty, and all empty texts are equal. Rows with a null doc_id stay, and
    repeated rows of a doc_id that stays all stay. Texts of any length are compared whole.
    An empty table stays empty; no column is added, so names cannot clash.
    """
    scratch = Scratch(docs.sparkSession, "drop_copies")
    _, by_prefix = levels(scratch.write(text_keys(docs, full=False), "keys"), scratch)
    # Only now are whole texts hashed, those of the rows left.
    left = counted(by_prefix.select("doc_id").distinct())
    texts = docs.select("doc_id", "text").join(left, "doc_id", "left_semi")
    full = scratch.write(text_keys(texts), "full")
    copies = _joined(full, scratch.write(equal_texts(full), "groups"), full.count()).filter("doc_id <> keep_id")
    return drop_ids(docs, scratch.result(copies.select("doc_id").distinct()))


def op1(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), k AS (SELECT doc_id, sha256(norm) AS text_sha256, CAST(length(norm) AS INTEGER) AS n_chars_norm FROM n)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       text_sha256,
       n_chars_norm
FROM k WINDOW w AS (PARTITION BY text_sha256)
"""
