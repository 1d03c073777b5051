"""Country bibliometrics: whole and fractional counting, growth, share, specialisation.

Fractional sums are built from exact integer counts by the number of countries of a paper
(sum over n of papers_n / n), so they don't depend on the order of addition and additive
marts can be merged exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PERIOD = 30


def clean_countries(column: str) -> Column:
    """Distinct upper-cased codes in first-seen order; null and blank ones are left out."""
    return F.array_distinct(F.filter(F.transform(column, lambda c: F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))), lambda c: c.isNotNull() & (c != "")))


def weighted(work_countries: DataFrame) -> DataFrame:
    """work_id, country, n (the work's distinct countries); a work's weight in each is 1/n."""
    n = work_countries.groupBy("work_id").agg(F.count("*").alias("n"))
    return work_countries.join(n, "work_id")


def fold(rows: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Whole and fractional counts by keys, from rows (..., n) with n countries each."""
    by_n = rows.groupBy(*keys, "n").agg(F.count("*").alias("c"))
    return by_n.groupBy(*keys).agg(F.sum("c").alias("papers"), F.round(F.sum(F.col("c") / F.col("n")), digits).alias("fractional"))


def country_year_counts(works: DataFrame, work_countries: DataFrame) -> DataFrame:
    """C03."""
    return fold(weighted(work_countries).join(works.select("work_id", "pub_year"), "work_id"), "country", "pub_year")


def topic_year_counts(works: DataFrame, work_topics: DataFrame, work_countries: DataFrame) -> DataFrame:
    """Papers by topic and year of works with a country; fractional shares sum to the papers."""
    has = work_countries.select("work_id").distinct()
    t = work_topics.select("work_id", "topic").distinct().join(has, "work_id", "left_semi")
    return t.join(works.select("work_id", "pub_year"), "work_id").groupBy("topic", "pub_year").agg(F.count("*").alias("papers"))


def topic_country(work_topics: DataFrame, work_countries: DataFrame) -> DataFrame:
    return fold(work_topics.select("work_id", "topic").distinct().join(weighted(work_countries), "work_id"), "topic", "country")


def topic_top_countries(work_topics: DataFrame, work_countries: DataFrame, top: int = 5) -> DataFrame:
    """The countries with the largest fractional count of each topic."""
    w = Window.partitionBy("topic").orderBy(F.desc("fractional"), "country")
    return topic_country(work_topics, work_countries).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("topic", "country", "fractional", "rank")


def collaborations(work_countries: DataFrame, mode: str, top: int = 200) -> DataFrame:
    """Country pairs; a pair of a paper with n countries weighs 1 (full), 1/n (per_country)
    or 2/(n(n-1)) (fractional, so that a paper's pairs sum to 1)."""
    w = weighted(work_countries).filter("n >= 2")
    a, b = w.select("work_id", "n", F.col("country").alias("a")), w.select("work_id", F.col("country").alias("b"))
    by_n = a.join(b, "work_id").filter("a < b").groupBy("a", "b", "n").agg(F.count("*").alias("c"))
    weight = {"full": F.lit(1.0), "per_country": 1.0 / F.col("n"), "fractional": 2.0 / (F.col("n") * (F.col("n") - 1))}[mode]
    return by_n.groupBy("a", "b").agg(F.round(F.sum(F.col("c") * weight), 6).alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(top)


def valid_date(column: str) -> Column:
    """The first ten characters of an ISO date, null if their positions aren't those of one (any month number passes)."""
    d = F.substring(column, 1, 10)
    return F.when(d.rlike("^[0-9]{4}-.{2}-.{2}$"), d)


def country_date_counts(works: DataFrame, work_countries: DataFrame) -> DataFrame:
    """C06."""
    w = works.select("work_id", valid_date("pub_date").alias("pub_date")).filter("pub_date IS NOT NULL")
    return fold(weighted(work_countries).join(w, "work_id"), "country", "pub_date")


def topic_country_year(works: DataFrame, work_topics: DataFrame, work_countries: DataFrame, min_papers: int = 1) -> DataFrame:
    """The cube, by topic id, country and year."""
    t = work_topics.select("work_id", "topic_id", "topic").distinct()
    rows = t.join(weighted(work_countries), "work_id").join(works.select("work_id", F.col("pub_year").alias("year")), "work_id")
    return fold(rows, "topic_id", "topic", "country", "year").filter(F.col("papers") >= min_papers)


def combine(previous: DataFrame, new: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """The sum of two additive marts."""
    total = previous.select(*keys, *values).unionByName(new.select(*keys, *values)).groupBy(*keys)
    return total.agg(*[F.round(F.sum(v), digits).alias(v) if dict(previous.dtypes)[v] == "double" else F.sum(v).alias(v) for v in values])


def growth_window(works: DataFrame) -> DataFrame:
    """This year up to the newest date in the data, and the same days of the year before.
    add_months moves 29 February to 28 February."""
    newest = works.agg(F.max(F.to_date(valid_date("pub_date"))).alias("cur_end"))
    out = newest.withColumn("cur_start", F.trunc("cur_end", "year"))
    out = out.withColumn("prev_start", F.add_months("cur_start", -12)).withColumn("prev_end", F.add_months("cur_end", -12))
    return out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("cur_start", "cur_end", "prev_start", "prev_end")])


def _periods(counts: DataFrame, window: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Sums of a value over both periods."""
    rows = counts.crossJoin(F.broadcast(window))  # one row
    inside = lambda p: F.sum(F.when(F.col("pub_date").between(F.col(f"{p}_start"), F.col(f"{p}_end")), F.col(value)).otherwise(0))
    return rows.groupBy(*key).agg(inside("cur").alias("cur"), inside("prev").alias("prev"))


def _reason(enough: Column, partial_years: tuple[int, ...]) -> Column:
    """Why a comparison is hidden: a year of the window that the corpus holds in part, or too few papers."""
    years = [F.substring(c, 1, 4).cast("int") for c in ("prev_start", "cur_start")]
    partial = F.lit(False)
    for y in years:
        partial = partial | (y.isin(*partial_years) if partial_years else F.lit(False))
    return F.when(F.coalesce(partial, F.lit(False)), "partial_year").when(~F.coalesce(enough, F.lit(False)), "too_few_papers")


def country_growth(counts: DataFrame, window: DataFrame, value: str = "papers", least: int = MIN_PERIOD, partial_years: tuple[int, ...] = ()) -> DataFrame:
    """Growth percent of equal periods. No percent but a reason where the window touches a partial
    year, or either period has fewer than `least` papers."""
    p = _periods(counts, window, value, ["country"]).crossJoin(F.broadcast(window))  # one row
    reason = _reason((F.col("cur") >= least) & (F.col("prev") >= least), partial_years)
    pct = F.when(reason.isNull(), F.round((F.col("cur") - F.col("prev")) * 100.0 / F.col("prev"), 1))
    return p.select("country", F.round(F.col("cur").cast("double"), 2).alias("cur"), F.round(F.col("prev").cast("double"), 2).alias("prev"), pct.alias("growth_pct"), reason.alias("reason"))


def country_share(counts: DataFrame, totals: DataFrame, window: DataFrame, value: str = "papers", least: int = MIN_PERIOD, partial_years: tuple[int, ...] = ()) -> DataFrame:
    """C11: share of all papers in both periods; the change is that of the rounded percents. Hidden, with a
    reason, under the rules of growth, and where a period has no paper at all."""
    p = _periods(counts, window, value, ["country"])
    t = _periods(totals, window, "papers", []).select(F.col("cur").alias("t_cur"), F.col("prev").alias("t_prev"))
    p = p.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(window))  # one row each
    enough = (F.col("cur") >= least) & (F.col("prev") >= least) & (F.col("t_cur") > 0) & (F.col("t_prev") > 0)
    reason = _reason(enough, partial_years)
    s = p.select(
        "country",
        F.when(reason.isNull(), F.round(F.col("cur") * 100.0 / F.col("t_cur"), 2)).alias("share_pct"),
        F.when(reason.isNull(), F.round(F.col("prev") * 100.0 / F.col("t_prev"), 2)).alias("prev_share_pct"),
        reason.alias("reason"),
    )
    return s.withColumn("share_change_pp", F.round(F.col("share_pct") - F.col("prev_share_pct"), 2))


def date_totals(works: DataFrame, work_countries: DataFrame) -> DataFrame:
    """Papers with a country by date."""
    return works.join(work_countries.select("work_id").distinct(), "work_id", "left_semi").groupBy("pub_date").agg(F.count("*").alias("papers"))


def location_quotient(works: DataFrame, work_topics: DataFrame, work_countries: DataFrame, min_papers: int = 10, top: int = 5) -> DataFrame:
    """(topic papers in country / papers of country) over (topic's fractional papers / all fractional
    papers). Whole counts above, fractional sums below; papers of a country are those with a year."""
    t = work_topics.select("work_id", "topic").distinct()
    tc = t.join(work_countries, "work_id").groupBy("topic", "country").agg(F.count("*").alias("papers"))
    n_c = work_countries.join(works.filter("pub_year IS NOT NULL").select("work_id"), "work_id", "left_semi").groupBy("country").agg(F.count("*").alias("n_c"))
    has = work_countries.select("work_id").distinct()
    topics = t.join(has, "work_id", "left_semi").groupBy("topic").agg(F.count("*").alias("n_t"))  # a work's shares sum to 1
    total = has.agg(F.count("*").alias("n"))
    lq = F.round((F.col("papers") / F.col("n_c")) / (F.col("n_t") / F.col("n")), 4)
    rows = tc.filter(F.col("papers") >= min_papers).join(n_c, "country").join(topics, "topic").crossJoin(F.broadcast(total)).withColumn("lq", lq)
    w = Window.partitionBy("country").orderBy(F.desc("lq"), F.desc("papers"), "topic")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("country", "topic", "papers", "lq", "rank")


def country_stats(works: DataFrame, work_topics: DataFrame, work_countries: DataFrame) -> DataFrame:
    """Papers, fractional papers, growth and the most specialised topic of each country."""
    years = country_year_counts(works, work_countries)
    base = years.groupBy("country").agg(F.sum("papers").alias("papers"), F.round(F.sum("fractional"), 4).alias("fractional"))
    growth = country_growth(country_date_counts(works, work_countries), growth_window(works)).select("country", "growth_pct")
    best = location_quotient(works, work_topics, work_countries, top=1).select("country", F.col("topic").alias("top_topic"))
    return base.join(growth, "country", "left").join(best, "country", "left")


def year_rows(counts: DataFrame) -> DataFrame:
    """Each country's years as one sorted array of (year, papers)."""
    return counts.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("pub_year", "papers"))).alias("by_year"))


def top_other(counts: DataFrame, name: str, value: str, top: int) -> DataFrame:
    """The top names and the rest as "Other" with the number of its names; no "Other" without a rest."""
    w = Window.orderBy(F.desc(value), name)
    ranked = counts.withColumn("rank", F.row_number().over(w))  # one row a name
    label = F.when(F.col("rank") <= top, F.col(name)).otherwise(F.lit("Other"))
    return ranked.groupBy(label.alias(name)).agg(F.round(F.sum(value), 6).alias(value), F.count("*").alias("names"))


def percent_shares(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Shares in tenths of a percent that sum to 100 by largest remainders, ties by name."""
    total = Window.partitionBy()
    exact = F.col(value) * 1000.0 / F.sum(value).over(total)
    out = rows.withColumn("base", F.floor(F.round(exact, 9))).withColumn("rem", F.round(exact, 9) - F.col("base"))
    out = out.withColumn("left", F.lit(1000) - F.sum("base").over(total)).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("rem"), name)))
    return out.select(name, value, ((F.col("base") + F.when(F.col("rn") <= F.col("left"), 1).otherwise(0)) / 10.0).alias("share"))


def country_chart(counts: DataFrame, top: int = 12) -> DataFrame:
    """Top countries and "Other" with shares that sum to 100."""
    return percent_shares(top_other(counts, "country", "papers", top).select("country", "papers"), "country", "papers")


def cube_year_totals(cube: DataFrame, country: str | None = None) -> DataFrame:
    """Whole and fractional papers by country and year from the cube, of one country (in any case) where given."""
    rows = cube if country is None else cube.filter(F.upper(F.trim("country")) == country.strip().upper())
    return rows.groupBy("country", "year").agg(F.sum("papers").alias("papers"), F.round(F.sum("fractional"), 6).alias("fractional"))


def country_dimension(codes: DataFrame, known: DataFrame) -> DataFrame:
    """Each code (as it comes) with its name, ISO-3 code and label from a dimension (code, name, iso3).

    Codes are trimmed and upper-cased; a blank one is Unknown, one that the dimension lacks is its own name
    with an empty ISO-3 code. A label is the name with the code."""
    clean = F.coalesce(F.upper(F.trim("code")), F.lit(""))
    d = known.select(F.col("code").alias("_c"), F.col("name").alias("_n"), F.col("iso3").alias("_i"))
    out = codes.withColumn("clean", clean).join(d, F.col("clean") == F.col("_c"), "left")
    name = F.when(F.col("clean") == "", "Unknown").otherwise(F.coalesce("_n", "clean"))
    label = F.when(F.col("clean") == "", "Unknown").otherwise(F.concat(name, F.lit(" ("), F.col("clean"), F.lit(")")))
    return out.select(*codes.columns, name.alias("name"), F.coalesce("_i", F.lit("")).alias("iso3"), label.alias("label"))
