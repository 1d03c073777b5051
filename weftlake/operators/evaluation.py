"""Retrieval metrics and graded relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_qrels(rows: DataFrame) -> DataFrame:
    """The highest grade of each query and work."""
    return rows.groupBy("query_id", "work_id").agg(F.max("relevance").alias("grade"))


def _graded(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    return rankings.join(group_qrels(qrels), ["query_id", "work_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """By query; queries without a relevant work are left out, unranked ones score 0."""
    got = _graded(rankings, qrels).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "work_id")
    best = group_qrels(qrels).filter("grade > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("ideal"))
    return ideal.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))


def recall(rankings: DataFrame, qrels: DataFrame, k: int = 20, capped: bool = False) -> DataFrame:
    """Relevant works in the first k over all relevant ones (capped: over at most k)."""
    total = group_qrels(qrels).filter("grade > 0").groupBy("query_id").agg(F.count("*").alias("n"))
    got = _graded(rankings, qrels).filter((F.col("rank") <= k) & (F.col("grade") > 0)).groupBy("query_id").agg(F.count("*").alias("found"))
    of = F.least(F.col("n"), F.lit(k)) if capped else F.col("n")
    return total.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("found", F.lit(0)) / of, 6).alias("recall"))


def reciprocal_rank(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """One over the first relevant rank, 0 if none is ranked."""
    some = group_qrels(qrels).filter("grade > 0").select("query_id").distinct()
    first = _graded(rankings, qrels).filter("grade > 0").groupBy("query_id").agg(F.min("rank").alias("r"))
    return some.join(first, "query_id", "left").select("query_id", F.coalesce(F.round(1.0 / F.col("r"), 6), F.lit(0.0)).alias("rr"))


def mean_scores(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Means over the scored queries."""
    m = ndcg(rankings, qrels).join(recall(rankings, qrels), "query_id").join(reciprocal_rank(rankings, qrels), "query_id")
    return m.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "rr")])


def grade_relevance(rows: DataFrame, ids: list[str], topics: list[str], keywords: list[str]) -> DataFrame:
    """2 for a listed id or topic, else 1 if a keyword is in the title, else 0. rows: id, topics, title."""
    strong = F.col("id").cast("string").isin(*ids) | F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics]))
    weak = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower("title"), k))
    return rows.select("id", F.when(strong, 2).when(weak, 1).otherwise(0).alias("grade"))


def recommend(scores: dict[str, dict[str, float]], default: str, margin: float = 0.05) -> str:
    """The best model by nDCG that beats the default by the margin on both metrics, else the default."""
    base = scores[default]
    better = [m for m, s in scores.items() if all(s[k] >= base[k] + margin for k in ("recall", "ndcg"))]
    return max(better, key=lambda m: (scores[m]["ndcg"], m), default=default)
