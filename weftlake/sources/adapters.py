"""The driver's star schema seen as works, topics, authors and countries.

Every frame is a plain projection or distinct join of the fact table with dimensions, so
filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, d: str) -> DataFrame:
    """work_id, pub_year, pub_month, pub_date (ISO string), cited_by."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("work_id"),
        F.year("o_orderdate").alias("pub_year"),
        F.month("o_orderdate").alias("pub_month"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"),
        F.col("o_totalprice").alias("cited_by"),
    )


def work_topics(spark: SparkSession, d: str) -> DataFrame:
    """work_id, topic_id, topic (display name), field, score; one row for each work and topic id. Dealt by work
    once: this aggregate, baskets by work and joins with works need no further exchange of it."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("work_id"), F.concat("p_brand", F.lit("#"), "p_type").alias("topic_id"), F.col("p_brand").alias("topic"), F.col("p_type").alias("field"))
        .agg(F.max(1 - F.col("l_discount")).alias("score"))
    )


def work_authors(spark: SparkSession, d: str) -> DataFrame:
    """work_id, author_id, author (name), country of the author."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author_id")).distinct()
    return lines.join(authors(spark, d), "author_id").select("work_id", "author_id", "author", "country")


def authors(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("author"), "s_nationkey")
    nat = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return sup.join(nat, sup.s_nationkey == nat.n_nationkey).select("author_id", "author", "country")


def work_countries(spark: SparkSession, d: str) -> DataFrame:
    """work_id, country: a paper counts once for each country."""
    return work_authors(spark, d).select("work_id", "country").distinct()


def work_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as authors, for the sparse graph of link prediction: work_id, author_id."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("author_id")).distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label"))


#: The same frames as common table expressions, for the oracle queries.
SQL = """WITH works AS MATERIALIZED (
  SELECT o_orderkey AS work_id, CAST(year(o_orderdate) AS INTEGER) AS pub_year, CAST(month(o_orderdate) AS INTEGER) AS pub_month,
         strftime(o_orderdate, '%Y-%m-%d') AS pub_date, o_totalprice AS cited_by FROM orders
), wt AS MATERIALIZED (
  SELECT l_orderkey AS work_id, p_brand || '#' || p_type AS topic_id, p_brand AS topic, p_type AS field, max(1 - l_discount) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), wa AS MATERIALIZED (
  SELECT DISTINCT l_orderkey AS work_id, s_suppkey AS author_id, s_name AS author, n_name AS country
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), wc AS MATERIALIZED (SELECT DISTINCT work_id, country FROM wa)
"""
