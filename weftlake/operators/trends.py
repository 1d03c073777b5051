"""Emerging topics, gaps and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING, CAP = 5, 2.0


def growth_steps(rows: DataFrame, keys: list[str], first: int, last: int, value: str) -> DataFrame:
    """For each key the volume, last value and robust growth of a zero-filled yearly series.

    Each step (next - this) / (this + smoothing) is clipped to [-1, cap]; growth is the smaller
    of the steps' mean and median. The series is built by one conditional sum a year, so no
    spine is joined and the key is shuffled once.
    """
    years = list(range(first, last + 1))
    agg = rows.filter(F.col("year").between(first, last)).groupBy(*keys).agg(*[F.sum(F.when(F.col("year") == y, F.col(value)).otherwise(0.0)).cast("double").alias(f"y{i}") for i, y in enumerate(years)])
    step = lambda i: F.least(F.lit(CAP), F.greatest(F.lit(-1.0), (F.col(f"y{i + 1}") - F.col(f"y{i}")) / (F.col(f"y{i}") + SMOOTHING)))
    steps = F.array_sort(F.array(*[step(i) for i in range(len(years) - 1)]))
    n = len(years) - 1
    mean = F.aggregate("steps", F.lit(0.0), lambda a, x: a + x) / n
    median = (F.element_at("steps", (n + 1) // 2) + F.element_at("steps", n // 2 + 1)) / 2
    volume = sum((F.col(f"y{i}") for i in range(len(years))), F.lit(0.0))
    out = agg.withColumn("steps", steps).withColumn("volume", volume)
    return out.select(*keys, F.round("volume", 6).alias("volume"), F.round(F.col(f"y{n}"), 6).alias("last"), F.round(F.least(mean, median), 6).alias("growth"))


def rank_emerging(cube: DataFrame, last: int, span: int = 3, country: str | None = None, min_total: float = 20, min_last: float = 5, limit: int = 20) -> DataFrame:
    """Topics by robust growth up to the last complete year; fractional counts globally, whole
    counts of a country. The name of a topic is its most frequent one, ties the larger string."""
    if country is not None:
        cube = cube.filter(F.upper("country") == country.upper())
    g = growth_steps(cube, ["topic_id"], last - span, last, "fractional" if country is None else "papers")
    named = cube.groupBy("topic_id", "topic").agg(F.sum("papers").alias("p")).groupBy("topic_id").agg(F.max_by("topic", F.struct("p", "topic")).alias("topic"))
    out = g.filter((F.col("volume") >= min_total) & (F.col("last") >= min_last) & (F.col("growth") > 0)).join(named, "topic_id")
    return out.orderBy(F.desc("growth"), F.desc("volume"), "topic", "topic_id").limit(limit).select("topic_id", "topic", "volume", "last", "growth")


def pct_rank_avg(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Percentile rank where ties share their mean rank; a single row gets 0.5. Rows are one a topic."""
    order, ties, every = Window.orderBy(value), Window.partitionBy(value), Window.partitionBy()
    n = F.count("*").over(every)
    rank = F.rank().over(order) - 1 + (F.count("*").over(ties) - 1) / 2.0
    return rows.withColumn(name, F.when(n == 1, 0.5).otherwise(F.round(rank / (n - 1), 9)))


def find_gaps(topic_years: DataFrame, last: int, span: int = 3, min_total: float = 20, min_last: float = 5, min_growth: float = 0.10, thin_ratio: float = 0.5, limit: int = 20) -> DataFrame:
    """Topics that grow more than their volume rank suggests: pct(growth) - pct(volume), above 0.

    Ranks are taken over all topics with enough volume, before the growth filter; with one such
    topic the score is its growth. thin_years counts span years whose corpus total is under
    thin_ratio of the busiest.
    """
    rows = topic_years.withColumnRenamed("pub_year", "year")
    g = growth_steps(rows, ["topic"], last - span, last, "papers").filter((F.col("volume") >= min_total) & (F.col("last") >= min_last))
    ranked = pct_rank_avg(pct_rank_avg(g, "growth", "pg"), "volume", "pv").withColumn("n", F.count("*").over(Window.partitionBy()))
    score = F.when(F.col("n") == 1, F.col("growth")).otherwise(F.round(F.col("pg") - F.col("pv"), 6))
    totals = rows.filter(F.col("year").between(last - span, last)).groupBy("year").agg(F.sum("papers").alias("t"))
    thin = totals.agg(F.max("t").alias("top"), F.collect_list("t").alias("all")).select(F.size(F.filter("all", lambda x: x < thin_ratio * F.col("top"))).cast("long").alias("thin_years"))
    out = ranked.withColumn("score", score).filter((F.col("growth") >= min_growth) & (F.col("score") > 0))
    return out.crossJoin(F.broadcast(thin)).orderBy(F.desc("score"), F.desc("growth"), "topic").limit(limit).select("topic", "volume", "growth", "score", "thin_years")


def explain_gap(topic: Column, growth: Column, volume: Column) -> Column:
    """E05."""
    return F.format_string("%s grows %.0f%% a year on %.0f papers", topic, growth * 100, volume)


def gap_examples(works: DataFrame, work_topics: DataFrame, topics: list[str], n: int) -> DataFrame:
    """Most recent works of each topic, dealt round-robin over the topics, n in all."""
    w = Window.partitionBy("topic").orderBy(F.desc("pub_date"), F.desc("work_id"))
    t = work_topics.filter(F.col("topic").isin(topics)).select("work_id", "topic").distinct().join(works.select("work_id", "pub_date"), "work_id")
    first = t.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return first.orderBy("rn", "topic").limit(n).select("topic", "work_id", "pub_date", "rn")


def cluster_emerging_scores(growth: DataFrame, papers: DataFrame) -> DataFrame:
    """Per paper the largest growth of its topics, the mean by colour, over the peak colour,
    in [0, 1]. Colour -1 is left out, papers without a growing topic count 0."""
    g = growth.groupBy("topic").agg(F.max("growth").alias("g"))
    per = papers.filter("colour >= 0").join(g, "topic", "left").groupBy("paper", "colour").agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("g"))
    mean = per.groupBy("colour").agg(F.avg("g").alias("m"))
    peak = F.max("m").over(Window.partitionBy())
    return mean.select("colour", F.when(peak > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") / peak)), 6)).otherwise(0.0).alias("score"))


def publications(works: DataFrame, rates: DataFrame | None, year: int | None = None) -> DataFrame:
    """Papers by year of the whole range, or by month of a year, zero-filled, with an
    estimated population: the sum of the known months' rates, null unless all months that hold papers are known."""
    by = works.groupBy("pub_year", "pub_month").agg(F.count("*").alias("papers"))
    month = F.concat_ws("-", F.col("pub_year"), F.lpad(F.col("pub_month").cast("string"), 2, "0"))
    by = by.withColumn("month", month)
    by = by.join(F.broadcast(rates), "month", "left") if rates is not None else by.withColumn("population", F.lit(None).cast("long"))
    if year is None:
        spine = works.agg(F.min("pub_year").alias("lo"), F.max("pub_year").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("bucket"))
        got = by.withColumn("bucket", F.col("pub_year"))
    else:
        spine = by.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("bucket"))
        got = by.filter(F.col("pub_year") == year).withColumn("bucket", F.col("pub_month"))
    got = got.groupBy("bucket").agg(F.sum("papers").alias("papers"), rollup("population").alias("estimate"))
    return spine.join(got, "bucket", "left").select("bucket", F.coalesce("papers", F.lit(0)).alias("papers"), "estimate")


def rollup(column: str) -> Column:
    """The sum of estimates, null if any is unknown."""
    return F.when(F.count(F.when(F.col(column).isNull(), 1)) == 0, F.sum(column))


def stream_bands(series: DataFrame) -> DataFrame:
    """The lower and upper edge of stacked bands, centred on zero in each year."""
    stack = Window.partitionBy("year").orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = F.sum("value").over(Window.partitionBy("year")) / 2.0
    top = F.sum("value").over(stack) - half
    return series.select("year", "name", F.round(top - F.col("value"), 6).alias("lo"), F.round(top, 6).alias("hi"))


def series_top_other(rows: DataFrame, top: int) -> DataFrame:
    """Yearly series of the top names and of the rest as "Other"."""
    totals = rows.groupBy("name").agg(F.sum("value").alias("t"))
    rank = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("t"), "name"))).select("name", "rank")
    label = F.when(F.col("rank") <= top, F.col("name")).otherwise("Other")
    return rows.join(rank, "name").groupBy("year", label.alias("name")).agg(F.sum("value").alias("value"))
