"""Relational analytics over works, topics, authors and countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# -- sources and sinks ---------------------------------------------------------------------


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The number of left rows without a partner on the right."""
    return left.join(right.select(F.col(right_key).alias(left_key)).distinct(), left_key, "left_anti").agg(F.count("*").alias("orphans"))


def corpus_profile(works: DataFrame, top: int = 3) -> DataFrame:
    """Rows, distinct ids, repeated rows, shares above citation thresholds."""
    share = lambda x: F.round(F.avg(F.when(F.col("cited_by") >= x, 1.0).otherwise(0.0)), 6)
    return works.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("work_id").alias("unique_ids"),
        (F.count("*") - F.countDistinct("work_id")).alias("duplicates"),
        share(100_000).alias("share_100k"),
        share(250_000).alias("share_250k"),
        F.max("pub_year").alias("newest_year"),
    )


def last_passing(rows: DataFrame, key: str, order: str, passes: Column) -> DataFrame:
    """Of the rows of a key that pass, the last one. An aggregate, so a hot key is combined before the shuffle."""
    cols = [c for c in rows.columns if c != key]
    best = rows.filter(passes).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r"))
    return best.select(key, "r.*")


def dedup_append(held: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of new whose key is not held; of a key's repeats the first."""
    cols = [c for c in new.columns if c != key]
    first = new.join(held.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("r"))
    return first.select(key, "r.*")


def upsert_latest(held: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The union with the highest version of each key."""
    both = held.unionByName(new)
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("r")).select(key, "r.*")


def derive_work_countries(work_authors: DataFrame) -> DataFrame:
    """Upper-cased distinct countries of a work from its authors; blank codes are left out."""
    code = F.upper(F.trim("country"))
    return work_authors.select("work_id", code.alias("country")).filter("country <> ''").distinct()


# -- summaries ------------------------------------------------------------------------------


def in_country(works: DataFrame, work_countries: DataFrame, country: str | None) -> DataFrame:
    """Works with the country, as a semi-join; all works for None."""
    if country is None:
        return works
    return works.join(work_countries.filter(F.col("country") == country), "work_id", "left_semi")


def year_range(works: DataFrame) -> DataFrame:
    """A01."""
    return works.agg(F.min("pub_year").alias("lo"), F.max("pub_year").alias("hi"))


def windows_catalog(patterns: DataFrame) -> DataFrame:
    """For each window the baskets and the number of patterns."""
    return patterns.groupBy("window_start", "window_end").agg(F.max("n_tx").alias("n_tx"), F.count("*").alias("patterns"))


def corpus_summary(works: DataFrame, work_topics: DataFrame, work_authors: DataFrame, work_countries: DataFrame, country: str | None = None) -> DataFrame:
    """One row of counts, of the whole corpus or of a country's works."""
    scope = in_country(works, work_countries, country)
    held = lambda df: df if country is None else df.join(scope.select("work_id"), "work_id", "left_semi")
    one = lambda df, c, name: df.agg(F.countDistinct(c).alias(name))
    parts = [
        scope.agg(F.count("*").alias("papers"), F.min("pub_year").alias("year_lo"), F.max("pub_year").alias("year_hi")),
        one(held(work_topics), "topic_id", "topics"),
        one(held(work_authors), "author_id", "authors"),
        one(held(work_countries), "country", "countries"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def country_list(work_countries: DataFrame, mined: DataFrame) -> DataFrame:
    """Papers of each country and whether patterns were mined for it."""
    counts = work_countries.groupBy("country").agg(F.count("*").alias("papers"))
    flag = mined.select("country").distinct().withColumn("m", F.lit(True))
    return counts.join(flag, "country", "left").select("country", "papers", F.col("m").isNotNull().alias("mined"))


def papers_per_year(works: DataFrame) -> DataFrame:
    """A05."""
    return works.groupBy("pub_year").agg(F.count("*").alias("papers"))


def topic_distribution(works: DataFrame, work_topics: DataFrame, lo: int, hi: int, limit: int) -> DataFrame:
    """Papers of each topic in a year range, the most frequent first (ties by name)."""
    scope = works.filter(F.col("pub_year").between(lo, hi)).select("work_id")
    counts = work_topics.join(scope, "work_id").groupBy("topic").agg(F.countDistinct("work_id").alias("papers"))
    return counts.orderBy(F.desc("papers"), "topic").limit(limit)


def cooccurrence(work_topics: DataFrame, topics: list[str]) -> DataFrame:
    """Papers with both topics, for ordered pairs of the given topics."""
    t = work_topics.filter(F.col("topic").isin(topics)).select("work_id", "topic").distinct()
    other = t.withColumnRenamed("topic", "topic_b")
    return t.withColumnRenamed("topic", "topic_a").join(other, "work_id").filter("topic_a <> topic_b").groupBy("topic_a", "topic_b").agg(F.count("*").alias("papers"))


def cooccurrence_matrix(work_topics: DataFrame, topics: list[str]) -> DataFrame:
    """A15 as a matrix, zero where a pair never occurs."""
    return cooccurrence(work_topics, topics).groupBy("topic_a").pivot("topic_b", topics).sum("papers").na.fill(0)


def country_papers(works: DataFrame, work_countries: DataFrame, lo: int, hi: int) -> DataFrame:
    """A06."""
    scope = works.filter(F.col("pub_year").between(lo, hi)).select("work_id")
    return work_countries.join(scope, "work_id", "left_semi").groupBy("country").agg(F.count("*").alias("papers"))


def collaboration_partners(work_countries: DataFrame, country: str) -> DataFrame:
    """Papers shared with each other country."""
    mine = work_countries.filter(F.col("country") == country).select("work_id")
    return work_countries.filter(F.col("country") != country).join(mine, "work_id", "left_semi").groupBy(F.col("country").alias("partner")).agg(F.count("*").alias("papers"))


def country_pairs(work_countries: DataFrame, limit: int) -> DataFrame:
    """Papers shared by two countries, the most first."""
    a, b = work_countries.withColumnRenamed("country", "a"), work_countries.withColumnRenamed("country", "b")
    return a.join(b, "work_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "a", "b").limit(limit)


def international_share(works: DataFrame, work_countries: DataFrame) -> DataFrame:
    """Share of papers with more than one country, by year."""
    n = work_countries.groupBy("work_id").agg(F.count("*").alias("c"))
    return works.join(n, "work_id").groupBy("pub_year").agg(F.round(F.avg(F.when(F.col("c") > 1, 1.0).otherwise(0.0)), 6).alias("share"))


def countries_having(work_countries: DataFrame, share: float) -> DataFrame:
    """Countries with at least a share of the papers."""
    total = work_countries.agg(F.countDistinct("work_id").alias("n"))
    counts = work_countries.groupBy("country").agg(F.count("*").alias("papers"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("papers") >= share * F.col("n")).select("country", "papers")


def papers_with_all_topics(work_topics: DataFrame, topics: list[str]) -> DataFrame:
    """Relational division."""
    t = work_topics.filter(F.col("topic").isin(topics))
    return t.groupBy("work_id").agg(F.countDistinct("topic").alias("k")).filter(F.col("k") == len(set(topics))).select("work_id")


def coauthor_edges(works: DataFrame, work_authors: DataFrame, lo: int, hi: int, min_papers: int, limit: int | None, scope: DataFrame | None = None, country: str | None = None) -> DataFrame:
    """Author pairs by papers. Pairs are oriented by id and grouped by name, so authors of
    one name merge; the first author's country is carried by its maximum. All pairs, or the strongest `limit`."""
    ids = works.filter(F.col("pub_year").between(lo, hi)).select("work_id")
    if scope is not None:
        ids = ids.join(scope, "work_id", "left_semi")
    wa = work_authors.join(ids, "work_id", "left_semi")
    if country is not None:
        wa = wa.filter(F.col("country") == country)
    x = wa.select("work_id", F.col("author_id").alias("x"), F.col("author").alias("a"), F.col("country").alias("ca"))
    y = wa.select("work_id", F.col("author_id").alias("y"), F.col("author").alias("b"))
    pairs = x.join(y, "work_id").filter("y > x").groupBy("a", "b").agg(F.count("*").alias("papers"), F.max("ca").alias("country_a"))
    pairs = pairs.filter(F.col("papers") >= min_papers)
    return pairs if limit is None else pairs.orderBy(F.desc("papers"), "a", "b").limit(limit)


def top_collaborators(edges: DataFrame, limit: int) -> DataFrame:
    """Partners and strength of each author, over both directions of the edges."""
    both = edges.select("a", "b", "papers").union(edges.select("b", "a", "papers"))
    return both.groupBy(F.col("a").alias("author")).agg(F.countDistinct("b").alias("partners"), F.sum("papers").alias("strength")).orderBy(F.desc("strength"), F.desc("partners"), "author").limit(limit)


def grouping_sets_counts(works: DataFrame, work_topics: DataFrame) -> DataFrame:
    """Papers by (year, month) and by (year, month, topic) in one scan."""
    rows = works.select("work_id", "pub_year", "pub_month").join(work_topics.select("work_id", "topic").distinct(), "work_id", "left")
    by = rows.groupingSets([["pub_year", "pub_month"], ["pub_year", "pub_month", "topic"]], "pub_year", "pub_month", "topic")
    return by.agg(F.grouping("topic").cast("int").alias("is_total"), F.countDistinct("work_id").alias("papers"))


def month_counts(rows: DataFrame, *dates: str) -> DataFrame:
    """Rows by month, from the first of the date strings that is not null; malformed dates are left out."""
    d = F.coalesce(*dates)
    return rows.filter(d.rlike("^[0-9]{4}-[0-9]{2}")).groupBy(F.substring(d, 1, 7).alias("month")).agg(F.count("*").alias("n"))


def json_props(rows: DataFrame, column: str, key: str) -> DataFrame:
    """JSON: rows and distinct users by a numeric member of a JSON column; a missing key is a null group."""
    v = F.get_json_object(column, f"$.{key}").try_cast("bigint")
    return rows.groupBy(v.alias(key)).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a ranked frame, with limits clamped to 1..10000."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), 10_000))


def cube_filter(cube: DataFrame, topic: str | None = None, country: str | None = None, year: int | None = None, limit: int = 10_000) -> DataFrame:
    """Cube rows by topic, country (any case) and year."""
    for c, v in (("topic_id", topic), ("year", year)):
        if v is not None:
            cube = cube.filter(F.col(c) == v)
    if country is not None:
        cube = cube.filter(F.upper("country") == country.upper())
    return cube.orderBy("topic_id", "country", "year").limit(min(max(1, limit), 10_000))


def valid_cube_rows(rows: DataFrame) -> DataFrame:
    """P10: trimmed and cast cube rows; a row with a missing or uncastable column is dropped."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    out = rows.select(
        text("topic_id").alias("topic_id"),
        text("topic").alias("topic"),
        F.upper(text("country")).alias("country"),
        F.col("year").cast("string").try_cast("int").alias("year"),
        F.col("papers").cast("string").try_cast("bigint").alias("papers"),
        F.col("fractional").cast("string").try_cast("double").alias("fractional"),
    )
    return out.dropna()


def running(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Running total. The frame is an aggregate with few rows; windows without a key run in one task."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum(value).over(w))
