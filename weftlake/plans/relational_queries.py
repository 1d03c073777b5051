"""Queries of the relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlake.functions import scalar
from weftlake.operators import countries, mining, relational, text
from weftlake.plans.catalog import query
from weftlake.sources.adapters import authors, table, work_authors, work_countries, work_topics, works

LO, HI = 1996, 1999
COUNTRY = "NATION_3"
SET3 = ["Brand#1", "Brand#10", "Brand#11", "Brand#12"]
IN3 = ", ".join(f"'{t}'" for t in SET3)


@query("orphan_check", "SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)", base=False)
def _(s, d):
    return relational.orphans(table(s, d, "orders").select("o_custkey"), table(s, d, "customer"), "o_custkey", "c_custkey")


@query("works_without_lines", "SELECT count(*) AS orphans FROM works WHERE work_id NOT IN (SELECT work_id FROM wt)")
def _(s, d):
    return relational.orphans(works(s, d).select("work_id"), work_topics(s, d), "work_id", "work_id")


@query("corpus_profile", """SELECT count(*) AS n_rows, count(DISTINCT work_id) AS unique_ids, count(*) - count(DISTINCT work_id) AS duplicates,
  round(avg(CASE WHEN cited_by >= 100000 THEN 1.0 ELSE 0.0 END), 6) AS share_100k, round(avg(CASE WHEN cited_by >= 250000 THEN 1.0 ELSE 0.0 END), 6) AS share_250k,
  max(pub_year) AS newest_year FROM works""")
def _(s, d):
    return relational.corpus_profile(works(s, d))


@query("clean_last_wins", "SELECT user_id, event_id, event_type, value FROM events WHERE value > 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1", base=False)
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "value")
    return relational.last_passing(e, "user_id", "event_id", F.col("value") > 5)


# A user's day is the key: days with a purchase are held, clicks and views of other days are new.
@query("dedup_append", """WITH e AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS day, event_id, event_type FROM events), n AS (SELECT * FROM e WHERE event_type IN ('click', 'view')),
  h AS (SELECT DISTINCT day FROM e WHERE event_type = 'purchase')
  SELECT * FROM n WHERE day NOT IN (SELECT day FROM h) QUALIFY row_number() OVER (PARTITION BY day ORDER BY event_id) = 1""", base=False)
def _(s, d):
    day = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    e = table(s, d, "events").select(day.alias("day"), "event_id", "event_type")
    return relational.dedup_append(e.filter("event_type = 'purchase'"), e.filter("event_type IN ('click', 'view')"), "day", "event_id")


@query("upsert_latest", """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""", base=False)
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "value")
    return relational.upsert_latest(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id")


@query("derive_work_countries", "SELECT DISTINCT work_id, upper(trim(country)) AS country FROM wa WHERE trim(country) <> ''")
def _(s, d):
    return relational.derive_work_countries(work_authors(s, d))


@query("year_range", "SELECT min(pub_year) AS lo, max(pub_year) AS hi FROM works")
def _(s, d):
    return relational.year_range(works(s, d))


_SUMMARY = """SELECT (SELECT count(*) FROM s) AS papers, (SELECT min(pub_year) FROM s) AS year_lo, (SELECT max(pub_year) FROM s) AS year_hi,
  (SELECT count(DISTINCT topic_id) FROM wt WHERE work_id IN (SELECT work_id FROM s)) AS topics,
  (SELECT count(DISTINCT author_id) FROM wa WHERE work_id IN (SELECT work_id FROM s)) AS authors,
  (SELECT count(DISTINCT country) FROM wc WHERE work_id IN (SELECT work_id FROM s)) AS countries"""


@query("corpus_summary", "WITH s AS (SELECT * FROM works) " + _SUMMARY)
def _(s, d):
    return relational.corpus_summary(works(s, d), work_topics(s, d), work_authors(s, d), work_countries(s, d))


@query("corpus_summary_country", f"WITH s AS (SELECT * FROM works WHERE work_id IN (SELECT work_id FROM wc WHERE country = '{COUNTRY}')) " + _SUMMARY)
def _(s, d):
    return relational.corpus_summary(works(s, d), work_topics(s, d), work_authors(s, d), work_countries(s, d), COUNTRY)


@query("country_list", """SELECT country, count(*) AS papers, country IN (SELECT country FROM wc GROUP BY country HAVING count(*) >= 0.15 * (SELECT count(DISTINCT work_id) FROM wc)) AS mined
  FROM wc GROUP BY country""")
def _(s, d):
    wc = work_countries(s, d)
    return relational.country_list(wc, relational.countries_having(wc, 0.15))


@query("papers_per_year", "SELECT pub_year, count(*) AS papers FROM works GROUP BY pub_year")
def _(s, d):
    return relational.papers_per_year(works(s, d))


@query("papers_per_year_country", f"SELECT pub_year, count(*) AS papers FROM works WHERE work_id IN (SELECT work_id FROM wc WHERE country = '{COUNTRY}') GROUP BY pub_year")
def _(s, d):
    return relational.papers_per_year(relational.in_country(works(s, d), work_countries(s, d), COUNTRY))


@query("topic_distribution", f"""SELECT topic, count(DISTINCT work_id) AS papers FROM wt JOIN works USING (work_id) WHERE pub_year BETWEEN {LO} AND {HI}
  GROUP BY topic ORDER BY papers DESC, topic LIMIT 10""")
def _(s, d):
    return relational.topic_distribution(works(s, d), work_topics(s, d), LO, HI, 10)


_CO = f"""WITH t AS (SELECT DISTINCT work_id, topic FROM wt WHERE topic IN ({IN3}))
  SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS papers FROM t a JOIN t b ON a.work_id = b.work_id AND a.topic <> b.topic GROUP BY ALL"""


@query("cooccurrence_pairs", _CO)
def _(s, d):
    return relational.cooccurrence(work_topics(s, d), SET3)


@query("cooccurrence_matrix", f"""WITH t AS (SELECT DISTINCT work_id, topic FROM wt WHERE topic IN ({IN3})),
  p AS (SELECT a.topic AS topic_a, b.topic AS topic_b FROM t a JOIN t b ON a.work_id = b.work_id AND a.topic <> b.topic)
  SELECT topic_a, {", ".join(f"count(*) FILTER (topic_b = '{t}') AS {chr(34)}{t}{chr(34)}" for t in SET3)} FROM p GROUP BY topic_a""")
def _(s, d):
    return relational.cooccurrence_matrix(work_topics(s, d), SET3)


@query("country_papers", f"SELECT country, count(*) AS papers FROM wc JOIN works USING (work_id) WHERE pub_year BETWEEN {LO} AND {HI} GROUP BY country")
def _(s, d):
    return relational.country_papers(works(s, d), work_countries(s, d), LO, HI)


@query("collaboration_partners", f"""SELECT b.country AS partner, count(*) AS papers FROM wc a JOIN wc b ON a.work_id = b.work_id AND a.country <> b.country
  WHERE a.country = '{COUNTRY}' GROUP BY b.country""")
def _(s, d):
    return relational.collaboration_partners(work_countries(s, d), COUNTRY)


@query("top_country_pairs", """SELECT a.country AS a, b.country AS b, count(*) AS papers FROM wc a JOIN wc b ON a.work_id = b.work_id AND a.country < b.country
  GROUP BY ALL ORDER BY papers DESC, a, b LIMIT 20""")
def _(s, d):
    return relational.country_pairs(work_countries(s, d), 20)


@query("international_share", """WITH c AS (SELECT work_id, count(*) AS c FROM wc GROUP BY work_id)
  SELECT pub_year, round(avg(CASE WHEN c > 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM works JOIN c USING (work_id) GROUP BY pub_year""")
def _(s, d):
    return relational.international_share(works(s, d), work_countries(s, d))


@query("countries_having", "SELECT country, count(*) AS papers FROM wc GROUP BY country HAVING count(*) >= 0.15 * (SELECT count(DISTINCT work_id) FROM wc)")
def _(s, d):
    return relational.countries_having(work_countries(s, d), 0.15)


@query("papers_with_all_topics", "SELECT work_id FROM wt WHERE topic IN ('Brand#1', 'Brand#2') GROUP BY work_id HAVING count(DISTINCT topic) = 2")
def _(s, d):
    return relational.papers_with_all_topics(work_topics(s, d), ["Brand#1", "Brand#2"])


def _edges_sql(scope: str, least: int, limit: int | None) -> str:
    return f"""SELECT x.author AS a, y.author AS b, count(*) AS papers, max(x.country) AS country_a FROM wa x JOIN wa y ON x.work_id = y.work_id AND y.author_id > x.author_id
  WHERE x.work_id IN (SELECT work_id FROM works WHERE pub_year BETWEEN 1995 AND 2001 {scope}) GROUP BY ALL HAVING count(*) >= {least}{"" if limit is None else f" ORDER BY papers DESC, a, b LIMIT {limit}"}"""


@query("coauthor_edges", _edges_sql("", 2, 600))
def _(s, d):
    return relational.coauthor_edges(works(s, d), work_authors(s, d), 1995, 2001, 2, 600)


@query("coauthor_edges_pattern", _edges_sql("AND work_id IN (SELECT work_id FROM wt WHERE topic IN ('Brand#1', 'Brand#2') GROUP BY work_id HAVING count(DISTINCT topic) = 2)", 1, 600))
def _(s, d):
    scope = relational.papers_with_all_topics(work_topics(s, d), ["Brand#1", "Brand#2"])
    return relational.coauthor_edges(works(s, d), work_authors(s, d), 1995, 2001, 1, 600, scope)


@query("coauthor_edges_local", f"""SELECT x.author AS a, y.author AS b, count(*) AS papers, max(x.country) AS country_a FROM wa x JOIN wa y ON x.work_id = y.work_id AND y.author_id > x.author_id
  WHERE x.country = '{COUNTRY}' AND y.country = '{COUNTRY}' GROUP BY ALL ORDER BY papers DESC, a, b LIMIT 600""")
def _(s, d):
    return relational.coauthor_edges(works(s, d), work_authors(s, d), 1995, 2001, 1, 600, country=COUNTRY)


@query("top_collaborators", f"""WITH e AS ({_edges_sql("", 2, 600)}), u AS (SELECT a, b, papers FROM e UNION ALL SELECT b, a, papers FROM e)
  SELECT a AS author, count(DISTINCT b) AS partners, CAST(sum(papers) AS BIGINT) AS strength FROM u GROUP BY a ORDER BY strength DESC, partners DESC, author LIMIT 15""")
def _(s, d):
    return relational.top_collaborators(relational.coauthor_edges(works(s, d), work_authors(s, d), 1995, 2001, 2, 600), 15)


@query("grouping_sets_counts", """WITH r AS (SELECT DISTINCT work_id, pub_year, pub_month, topic FROM works LEFT JOIN wt USING (work_id))
  SELECT pub_year, pub_month, topic, CAST(grouping(topic) AS INTEGER) AS is_total, count(DISTINCT work_id) AS papers FROM r
  GROUP BY GROUPING SETS ((pub_year, pub_month), (pub_year, pub_month, topic))""")
def _(s, d):
    return relational.grouping_sets_counts(works(s, d), work_topics(s, d))


@query("month_counts", "SELECT substr(pub_date, 1, 7) AS month, count(*) AS n FROM works WHERE regexp_matches(pub_date, '^[0-9]{4}-[0-9]{2}') GROUP BY 1")
def _(s, d):
    return relational.month_counts(works(s, d), "pub_date")


@query("json_props_agg", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1", base=False)
def _(s, d):
    return relational.json_props(table(s, d, "events"), "props", "k")


@query("search_page", "SELECT work_id, cited_by FROM works ORDER BY cited_by DESC, work_id LIMIT 20 OFFSET 40")
def _(s, d):
    return relational.page(works(s, d).select("work_id", "cited_by"), [F.desc("cited_by"), "work_id"], 40, 20)


CUBE_SQL = """WITH n AS (SELECT work_id, count(*) AS n FROM wc GROUP BY work_id), cube AS MATERIALIZED (
  SELECT topic_id, topic, country, pub_year AS year, count(*) AS papers, round(sum(CAST(1.0 AS DOUBLE) / n), 6) AS fractional
  FROM wt JOIN wc USING (work_id) JOIN n USING (work_id) JOIN works USING (work_id) GROUP BY ALL)"""


def cube(s, d):
    return countries.topic_country_year(works(s, d), work_topics(s, d), work_countries(s, d))


@query("tcy_filter", CUBE_SQL + f" SELECT * FROM cube WHERE country = '{COUNTRY}' AND year = 1998 ORDER BY topic_id, country, year LIMIT 10000")
def _(s, d):
    return relational.cube_filter(cube(s, d), country=COUNTRY.lower(), year=1998)


@query("valid_cube_rows", CUBE_SQL + " SELECT trim(topic_id) AS topic_id, topic, upper(country) AS country, year, papers, fractional FROM cube WHERE papers <> 2")
def _(s, d):
    c = cube(s, d)
    odd = c.withColumns({"country": F.concat(F.lit(" "), F.lower("country")), "papers": F.when(F.col("papers") == 2, "two").otherwise(F.col("papers").cast("string"))})
    return relational.valid_cube_rows(odd)


@query("runs_cumulative", "SELECT pub_year, papers, CAST(sum(papers) OVER (ORDER BY pub_year) AS BIGINT) AS total FROM (SELECT pub_year, count(*) AS papers FROM works GROUP BY pub_year)")
def _(s, d):
    return relational.running(relational.papers_per_year(works(s, d)), "pub_year", "papers")


@query("work_summary", "SELECT work_id, count(*) AS topics, max(score) AS best FROM wt GROUP BY work_id")
def _(s, d):
    return work_topics(s, d).groupBy("work_id").agg(F.count("*").alias("topics"), F.max("score").alias("best"))


@query("author_lookup", "SELECT s_suppkey AS author_id, s_name AS author, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity = 50)", base=False)
def _(s, d):
    ids = table(s, d, "lineitem").filter("l_quantity = 50").select(F.col("l_suppkey").alias("author_id")).distinct()
    return authors(s, d).join(ids, "author_id", "left_semi")


# -- scalar functions -------------------------------------------------------------------------


@query("short_id", "SELECT page_id, split_part(url, '/', -1) AS id FROM pages", base=False)
def _(s, d):
    return table(s, d, "pages").select("page_id", scalar.short_id("url").alias("id"))


@query("short_label", """WITH p AS (SELECT p_partkey, p_name || ' of the ' || p_type || ' | ' || p_brand AS i FROM part)
  SELECT p_partkey, (CASE WHEN length(split_part(i, ' | ', 1)) > 20 THEN substr(split_part(i, ' | ', 1), 1, 19) || '…' ELSE split_part(i, ' | ', 1) END) || ' + ' || split_part(i, ' | ', 2) AS label FROM p""", base=False)
def _(s, d):
    i = F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" | "), "p_brand")
    return table(s, d, "part").select("p_partkey", scalar.short_label(i).alias("label"))


@query("slugify", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part", base=False)
def _(s, d):
    return table(s, d, "part").select("p_partkey", scalar.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("flag_emoji", "SELECT c_custkey, CASE WHEN regexp_matches(substr(c_mktsegment, 1, 2), '^[A-Z]{2}$') THEN chr(CAST(127397 + ascii(substr(c_mktsegment, 1, 1)) AS INTEGER)) || chr(CAST(127397 + ascii(substr(c_mktsegment, 2, 1)) AS INTEGER)) ELSE '' END AS flag FROM customer", base=False)
def _(s, d):
    return table(s, d, "customer").select("c_custkey", scalar.flag_emoji(F.substring("c_mktsegment", 1, 2)).alias("flag"))


@query("iso_date_filter", """WITH x AS (SELECT work_id, CASE WHEN work_id % 3 = 0 THEN replace(pub_date, '-', '/') ELSE pub_date || 'T00:00' END AS x FROM works)
  SELECT work_id, substr(x, 1, 10) AS pub_date FROM x WHERE regexp_matches(substr(x, 1, 10), '^[0-9]{4}-.{2}-.{2}$')""")
def _(s, d):
    x = F.when(F.col("work_id") % 3 == 0, F.replace("pub_date", F.lit("-"), F.lit("/"))).otherwise(F.concat("pub_date", F.lit("T00:00")))
    return works(s, d).select("work_id", scalar.iso_date(x).alias("pub_date")).filter("pub_date IS NOT NULL")


@query("year_month", """SELECT work_id, CASE WHEN work_id % 3 = 0 THEN pub_year WHEN work_id % 3 = 1 THEN pub_year ELSE NULL END AS year,
  CASE WHEN work_id % 3 = 0 THEN pub_month END AS month FROM works""")
def _(s, d):
    k = F.col("work_id") % 3
    ym = scalar.year_month(F.when(k == 0, F.col("pub_date")), F.when(k == 1, F.col("pub_year")), F.when(k == 2, F.lit("bad")))
    return works(s, d).select("work_id", ym.alias("x")).select("work_id", F.col("x.year").alias("year"), F.col("x.month").alias("month"))


@query("reader_url", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://x.org/' || p_partkey WHEN p_partkey % 3 = 1 THEN 'https://doi.org/10.1/' || p_partkey ELSE 'https://f.org/' || p_partkey END AS url FROM part""", base=False)
def _(s, d):
    k = F.col("p_partkey")
    with_id = lambda p: F.concat(F.lit(p), k.cast("string"))
    url = scalar.reader_url(F.when(k % 3 == 0, with_id("https://x.org/")), F.when(k % 3 == 1, with_id("10.1/")).otherwise(F.lit("n/a")), with_id("https://f.org/"))
    return table(s, d, "part").select("p_partkey", url.alias("url"))


@query("inverted_index_text", "SELECT conv_id, turn, array_to_string(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') AS text FROM conversations WHERE text IS NOT NULL", base=False)
def _(s, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    t = table(s, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", words.alias("w"))
    entry = lambda k: F.struct(k.alias("key"), F.transform(F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["x"] == k), lambda e: e["i"]).alias("value"))
    index = F.map_from_entries(F.transform(F.array_distinct("w"), entry))
    return t.select("conv_id", "turn", scalar.inverted_text(index).alias("text"))


_TENTHS = "CASE WHEN t % 10 = 0 THEN CAST(t // 10 AS VARCHAR) ELSE (t // 10) || '.' || (t % 10) END"


@query("compact_count", f"""SELECT o_orderkey, CASE WHEN v >= 1000000 THEN (SELECT {_TENTHS} FROM (SELECT (v * 10 + 500000) // 1000000 AS t)) || 'M' WHEN v >= 1000 THEN (SELECT {_TENTHS} FROM (SELECT (v * 10 + 500) // 1000 AS t)) || 'k' ELSE CAST(v AS VARCHAR) END AS label
  FROM (SELECT o_orderkey, CAST(o_orderkey * 100 AS BIGINT) AS v FROM orders)""", base=False)
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", scalar.compact_count((F.col("o_orderkey") * 100).cast("long")).alias("label"))


@query("fractional_counts", """WITH n AS (SELECT work_id, count(*) AS n FROM wc GROUP BY work_id)
  SELECT country, count(*) AS papers, round(sum(CAST(1.0 AS DOUBLE) / n), 6) AS fractional FROM wc JOIN n USING (work_id) GROUP BY country""")
def _(s, d):
    return countries.fold(countries.weighted(work_countries(s, d)), "country")


@query("last_turns", "SELECT conv_id, turn, role, substr(text, 1, 1000) AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS INTEGER) AS rank FROM conversations QUALIFY rank <= 2", base=False)
def _(s, d):
    return text.last_turns(table(s, d, "conversations"))


@query("baskets_by_window", """WITH b AS (SELECT work_id, string_agg(DISTINCT topic, ' | ' ORDER BY topic) AS items FROM wt GROUP BY work_id HAVING count(*) >= 2)
  SELECT CAST(w AS INTEGER) AS window_start, items, count(*) AS weight FROM b JOIN works USING (work_id), range(1995, 2000) r(w) WHERE pub_year BETWEEN w AND w + 2 GROUP BY ALL""")
def _(s, d):
    b = mining.window_starts(mining.baskets(works(s, d), work_topics(s, d)), 1995, 2001)
    return mining.multiset(b, ["window_start"]).select("window_start", F.array_join("items", " | ").alias("items"), "weight")
