"""Sharding by proportional stratified interleaving (operator 6), DataFrame functions only.

Rows are shuffled by a seeded hash within their source, each gets its fractional rank
(rank + 1/2) / rows of the source, and all rows are sorted by it. A cut of that order into
equal runs holds every source in its share of the whole, to within a row or two.

Both ranks come from range-partitioned sorts: a row's rank is its place in its partition plus
the rows of the partitions before, so no source and no total order ever meets in one task.
Only ids, sizes and checksums move; the texts stay in the scan.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, documents, partitions, text_or_empty

SHARDS = 8
SEED = "weft-6"


def _placed(df: DataFrame, scratch: Scratch, name: str, *order: str) -> DataFrame:
    """df in a total order over range partitions, with part and its place idx in it; written once,
    as range bounds come from samples and may differ between two evaluations."""
    parts = partitions(df.sparkSession)
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return scratch.write(placed, name)


def shard_stratified(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, stratum rank.

    docs needs doc_id, source and text; other columns are ignored. size is the UTF-8 length
    plus 1; a null text has length 0 and the checksum of the empty text. Rows with a null
    source form a stratum of their own. Equal rows are ranked by doc_id, then by checksum;
    rows alike in all of these are interchangeable. Texts of any length only give their size and checksum. Shard counts differ by one at most; fewer
    rows than shards leave shards empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    # Written once: the sort below reads its input twice, for the bounds and to deal it out.
    rows = scratch.write(docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("stratum"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
    ), "rows")
    by_source = _placed(rows, scratch, "by_source", "stratum", "draw", "doc_id", "text_crc32")
    # One row for each partition and each source in it: at most partitions + sources rows.
    runs = by_source.groupBy("part", "stratum").agg(F.count("*").alias("c"), F.min("idx").alias("first"))
    before = Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part",
        "stratum",
        (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(Window.partitionBy("stratum")).alias("stratum_rows"),
    )
    ranked = by_source.join(runs, ["part", "stratum"]).select(
        "doc_id",
        "stratum",
        "size",
        "text_crc32",
        (F.col("idx") + F.col("shift")).alias("stratum_rank"),
        ((F.col("idx") + F.col("shift") + 0.5) / F.col("stratum_rows")).alias("fraction"),
    )
    mixed = _placed(ranked, scratch, "mixed", "fraction", "stratum", "stratum_rank")
    counts = sorted(mixed.groupBy("part").count().collect())  # a number for each partition
    starts = list(accumulate((c for _, c in counts), initial=0))
    total = max(starts[-1], 1)
    offsets = spark.createDataFrame([(p, n) for (p, _), n in zip(counts, starts)], "part int, offset long")
    place = mixed.join(F.broadcast(offsets), "part").withColumn("place", F.col("idx") + F.col("offset"))
    place = place.withColumn("shard", F.expr(f"CAST(place * {shards} DIV {total} AS INT)"))
    return scratch.result(place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"place - (CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "stratum_rank",
    ))


def op6(spark, sf_dir: str) -> DataFrame:
    return shard_stratified(documents(spark, sf_dir))
