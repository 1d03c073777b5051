"""Apportionment, quotas and stratified samples. Strata are few; their rows are not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlake.session import counted, cut


def month_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Months from first to last (yyyy-MM), with their first and last day."""
    m = F.explode(F.expr(f"sequence(DATE'{first}-01', DATE'{last}-01', INTERVAL 1 MONTH)"))
    return spark.range(1).select(m.alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"), F.date_format("d", "yyyy-MM-dd").alias("first_day"), F.date_format(F.last_day("d"), "yyyy-MM-dd").alias("last_day"))


def distribute(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Whole numbers in proportion to the weights that sum to total; largest remainders, ties by name."""
    every = Window.partitionBy()
    exact = F.round(F.col(weight) * float(total) / F.sum(weight).over(every), 9)
    out = weights.withColumn("base", F.floor(exact)).withColumn("rem", exact - F.col("base"))
    out = out.withColumn("left", F.lit(total) - F.sum("base").over(every)).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("rem"), name)))
    return out.select(name, weight, (F.col("base") + F.when(F.col("rn") <= F.col("left"), 1).otherwise(0)).cast("long").alias("share"))


def waterfill(strata: DataFrame, target: int) -> DataFrame:
    """Month, existing -> quota: the largest level L with sum(max(0, L - existing)) <= target, the rest
    one each to the emptiest months (ties by month). Closed form over months sorted by existing: with
    the first k of them filled, L = floor((target + their sum) / k)."""
    by = Window.orderBy("existing", "month")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = strata.withColumn("k", F.row_number().over(by)).withColumn("held", F.sum("existing").over(upto))
    s = s.withColumn("level", F.floor((F.lit(target) + F.col("held")) / F.col("k")))
    # The prefix is right where its level reaches its own last month and does not pass the next one.
    s = s.withColumn("next", F.lead("existing").over(by))
    level = s.filter((F.col("level") >= F.col("existing")) & (F.col("next").isNull() | (F.col("level") <= F.col("next")))).agg(F.max("level").alias("level"))
    q = strata.crossJoin(F.broadcast(level)).withColumn("quota", F.greatest(F.lit(0), F.col("level") - F.col("existing")))
    q = q.withColumn("left", F.lit(target) - F.sum("quota").over(Window.partitionBy())).withColumn("rn", F.row_number().over(by))
    return q.select("month", "existing", (F.col("quota") + F.when(F.col("rn") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_quotas(sizes: DataFrame, budget: int, floor: int) -> DataFrame:
    """Cluster, size -> quota: a floor (at most the size) granted to the biggest clusters first until the
    budget ends, then proportional shares of the remaining sizes by largest remainder, ties by cluster."""
    big = Window.orderBy(F.desc("size"), "cluster")
    every = Window.partitionBy()
    f = sizes.withColumn("want", F.least(F.col("size"), F.lit(floor)))
    before = F.coalesce(F.sum("want").over(big.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = f.withColumn("got", F.greatest(F.lit(0), F.least(F.col("want"), F.lit(budget) - before)))
    f = f.withColumn("rest", F.col("size") - F.col("got")).withColumn("free", F.greatest(F.lit(0), F.least(F.lit(budget) - F.sum("got").over(every), F.sum("rest").over(every))))
    exact = F.when(F.sum("rest").over(every) > 0, F.round(F.col("rest") * F.col("free") * 1.0 / F.sum("rest").over(every), 9)).otherwise(0.0)
    f = f.withColumn("exact", exact).withColumn("base", F.floor("exact")).withColumn("rem", F.col("exact") - F.col("base"))
    f = f.withColumn("left", F.col("free") - F.sum("base").over(every)).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("rem"), "cluster")))
    return f.select("cluster", "size", (F.col("got") + F.col("base") + F.when(F.col("rn") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, quotas: DataFrame, seed: str = "0") -> DataFrame:
    """Of each cluster its quota of rows by support, year, then a seeded hash. The largest quota is a
    literal bound, by which each task cuts its rows of a cluster before they meet."""
    draw = F.md5(F.concat(F.lit(seed + ":"), F.col("id").cast("string")))
    w = Window.partitionBy("cluster").orderBy(F.desc("support"), F.desc("year"), draw, "id")
    q = counted(cut(quotas.select("cluster", "quota"), "quotas"))
    most = q.agg(F.max("quota")).first()[0] or 0
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= int(most)).join(q, "cluster").filter("rn <= quota").select("id", "cluster", "rn")


def closed_links(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links both of whose ends were kept."""
    ids = kept.select("id")
    return links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
