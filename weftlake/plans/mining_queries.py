"""Queries of the pattern miners, incremental operators and country bibliometrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlake.operators import countries, mining, relational, trends
from weftlake.plans.catalog import query
from weftlake.plans.relational_queries import COUNTRY, CUBE_SQL, cube
from weftlake.sources.adapters import table, work_countries, work_topics, works
from weftlake.streaming import incremental

Y0, Y1, SUPPORT = 1995, 2001, 0.005


def patterns_sql(groups: str = "window_start, window_end", support: float = SUPPORT, where: str = "true", max_len: int = 3, least: int = 20, min_count: int = 1, tx: str | None = None, include: str = "true") -> str:
    """CTEs tx (work, group), n, l1..l3 and p: the frequent itemsets of every group."""
    tx = tx or f"""SELECT work_id, CAST(w AS INTEGER) AS window_start, CAST(w + 2 AS INTEGER) AS window_end FROM bk JOIN works USING (work_id), range({Y0}, {Y1 - 1}) r(w) WHERE pub_year BETWEEN w AND w + 2"""
    on = f"USING ({groups}, work_id)" if groups else "USING (work_id)"
    g = f"{groups}, " if groups else ""
    using = f"USING ({groups})" if groups else "ON true"
    by = f"GROUP BY {groups}" if groups else ""
    out = f"""WITH bk AS (SELECT work_id FROM wt WHERE {where} GROUP BY work_id HAVING count(*) >= 2 AND {include}), tx AS MATERIALIZED ({tx}),
  n AS (SELECT {g}count(*) AS n_tx, greatest({min_count}, CAST(ceil(round({support} * count(*), 9)) AS BIGINT)) AS least FROM tx {by} HAVING count(*) >= {least}),
  it AS MATERIALIZED (SELECT DISTINCT {g}work_id, topic FROM tx JOIN wt USING (work_id) WHERE {where}),
  l1 AS MATERIALIZED (SELECT {g}topic AS a, count(*) AS c FROM it GROUP BY ALL),
  f1 AS MATERIALIZED (SELECT l1.*, n_tx FROM l1 JOIN n {using} WHERE c >= least),
  l2 AS (SELECT {g}x.topic AS a, y.topic AS b, count(*) AS c FROM it x JOIN it y {on} WHERE x.topic < y.topic GROUP BY ALL),
  f2 AS MATERIALIZED (SELECT l2.*, n_tx FROM l2 JOIN n {using} WHERE c >= least)"""
    parts = [f"SELECT {g}a AS itemset, 1 AS k, c AS support_count, n_tx FROM f1", f"SELECT {g}a || ' | ' || b, 2, c, n_tx FROM f2"]
    for k in range(3, max_len + 1):
        xs = [f"x{i}" for i in range(k)]
        joined = "it x0 " + " ".join(f"JOIN it x{i} {on}" for i in range(1, k))
        rising = " AND ".join(f"x{i}.topic < x{i + 1}.topic" for i in range(k - 1))
        names = " || ' | ' || ".join(f"{x}.topic" for x in xs)
        out += f""", l{k} AS (SELECT {g}{names} AS itemset, count(*) AS c FROM {joined} WHERE {rising} GROUP BY ALL)"""
        parts.append(f"SELECT {g}itemset, {k}, c, n_tx FROM l{k} JOIN n {using} WHERE c >= least")
    return out + f", p AS MATERIALIZED (SELECT *, support_count / n_tx AS support FROM ({' UNION ALL '.join(parts)}))"


P = patterns_sql()
OUT = "itemset, k, support_count, n_tx, round(support, 9) AS support"
RULES = """, i AS (SELECT *, string_split(itemset, ' | ') AS items FROM p WHERE k >= 2), e AS (SELECT *, unnest(items) AS consequent FROM i),
  ru AS MATERIALIZED (SELECT e.*, list_aggregate(list_filter(items, lambda x: x <> consequent), 'string_agg', ' | ') AS antecedent FROM e),
  rules AS MATERIALIZED (SELECT ru.window_start, ru.window_end, antecedent, consequent, ru.support, ru.support_count / pa.support_count AS confidence, ru.support_count / pa.support_count / pc.support AS lift
  FROM ru JOIN p pa ON pa.itemset = antecedent AND pa.window_start = ru.window_start JOIN p pc ON pc.itemset = consequent AND pc.window_start = ru.window_start)"""
LIFE = """, st AS (SELECT window_start, lead(window_start) OVER (ORDER BY window_start) AS nxt FROM (SELECT DISTINCT window_start FROM p)),
  life AS (SELECT itemset, k, born, nxt AS died, windows FROM (SELECT itemset, k, min(window_start) AS born, max(window_start) AS last, count(*) AS windows FROM p GROUP BY ALL) JOIN st ON last = window_start)"""
CHANGE = """, ch AS (SELECT itemset, k, min(window_start) AS first_window, max(window_start) AS last_window, arg_min(support, window_start) AS first_support, arg_max(support, window_start) AS last_support FROM p GROUP BY ALL),
  chg AS (SELECT itemset, k, first_window, last_window, round(first_support, 9) AS first_support, round(last_support, 9) AS last_support, round(last_support - first_support, 6) AS change FROM ch WHERE first_window < last_window)"""


def mined(s, d, **more):
    return mining.mine_windows(works(s, d), work_topics(s, d), Y0, Y1, min_support=SUPPORT, **more)


def _rounded(p):
    return p.withColumn("support", F.round("support", 9))


@query("mine_windows", P + f" SELECT window_start, window_end, {OUT} FROM p")
def _(s, d):
    return _rounded(mined(s, d))


@query("windows_catalog", P + " SELECT window_start, window_end, max(n_tx) AS n_tx, count(*) AS patterns FROM p GROUP BY ALL")
def _(s, d):
    return relational.windows_catalog(mined(s, d))


def whole(s, d):
    return mining.baskets(works(s, d), work_topics(s, d))


_WHOLE = dict(groups="", tx="SELECT work_id FROM bk", least=1)


@query("fp_itemsets", patterns_sql(**_WHOLE) + f" SELECT {OUT} FROM p")
def _(s, d):
    return _rounded(mining.frequent(mining.multiset(whole(s, d), []), [], SUPPORT))


@query("fp_itemsets_len5", patterns_sql(**_WHOLE | {"support": 0.0004, "max_len": 5}) + f" SELECT {OUT} FROM p")
def _(s, d):
    return _rounded(mining.frequent(mining.multiset(whole(s, d), []), [], 0.0004, max_len=5))


# With three baskets or more no set of more than seven items is frequent, so the SQL stops there.
@query("fp_itemsets_any_length", patterns_sql(**_WHOLE | {"support": 0.0004, "max_len": 7, "min_count": 3}) + f" SELECT {OUT} FROM p")
def _(s, d):
    return _rounded(mining.frequent(mining.multiset(whole(s, d), []), [], 0.0004, max_len=None, min_count=3))


@query("fp_itemsets_weighted", patterns_sql(**_WHOLE, max_len=2) + f" SELECT {OUT} FROM p")
def _(s, d):
    halves = [mining.multiset(whole(s, d).filter(f"work_id % 2 = {k}"), []) for k in (0, 1)]
    return _rounded(mining.frequent(incremental.merge_multisets(*halves, []), [], SUPPORT, max_len=2))


@query("fp_itemsets_mllib", patterns_sql(**_WHOLE) + " SELECT itemset, k, support_count FROM p")
def _(s, d):
    return mining.mllib_itemsets(whole(s, d), SUPPORT)


@query("fp_constrained", patterns_sql(where="score >= 0.93 AND field = 'ECONOMY' AND topic NOT IN ('Brand#3')", support=0.002, max_len=2) + f" SELECT window_start, window_end, {OUT} FROM p")
def _(s, d):
    wt = mining.filter_topics(work_topics(s, d), 0.93, "ECONOMY", ["Brand#3"])
    return _rounded(mining.mine_windows(works(s, d), wt, Y0, Y1, min_support=0.002, max_len=2))


@query("fp_include", patterns_sql(include="bool_or(topic = 'Brand#7')", support=0.05, max_len=2) + f" SELECT window_start, window_end, {OUT} FROM p")
def _(s, d):
    return _rounded(mining.mine_windows(works(s, d), work_topics(s, d), Y0, Y1, min_support=0.05, max_len=2, include="Brand#7"))


@query("association_rules", P + RULES + " SELECT window_start, window_end, antecedent, consequent, round(support, 9) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules WHERE confidence >= 0.1")
def _(s, d):
    r = mining.association_rules(mined(s, d), ["window_start", "window_end"], 0.1)
    return r.withColumns({"support": F.round("support", 9), "confidence": F.round("confidence", 6), "lift": F.round("lift", 6)})


@query("top_rules", P + RULES + " SELECT window_start, antecedent, consequent, round(lift, 6) AS lift FROM rules WHERE confidence >= 0.1 AND round(lift, 6) >= 0.8 ORDER BY round(lift, 6) DESC, antecedent, consequent, window_start LIMIT 25")
def _(s, d):
    r = mining.association_rules(mined(s, d), ["window_start", "window_end"], 0.1).select("window_start", "antecedent", "consequent", F.round("lift", 6).alias("lift"))
    return r.filter("lift >= 0.8").orderBy(F.desc("lift"), "antecedent", "consequent", "window_start").limit(25)


@query("derive_rules", patterns_sql(max_len=2) + """, i AS (SELECT *, string_split(itemset, ' | ') AS items FROM p WHERE k = 2), e AS (SELECT *, unnest(items) AS consequent FROM i)
  SELECT e.window_start, a.itemset AS antecedent, consequent, round(e.support_count / a.support_count, 6) AS confidence, round(e.support_count / a.support_count / c.support, 6) AS lift
  FROM e JOIN p a ON a.window_start = e.window_start AND a.itemset = list_filter(items, lambda x: x <> consequent)[1] LEFT JOIN p c ON c.window_start = e.window_start AND c.itemset = consequent AND consequent <> 'Brand#4'
  WHERE e.support_count / a.support_count >= 0.05 AND a.itemset <> 'Brand#4'""")
def _(s, d):
    p = mined(s, d, max_len=2).filter("itemset <> 'Brand#4'")
    r = mining.association_rules(p, ["window_start"], 0.05, keep_unknown=True)
    return r.select("window_start", "antecedent", "consequent", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("mine_countries", patterns_sql(groups="country, window_start, window_end", support=0.01, least=50, min_count=5, max_len=2, tx=f"""SELECT work_id, country, CAST(w AS INTEGER) AS window_start, CAST(w + 2 AS INTEGER) AS window_end
  FROM bk JOIN works USING (work_id) JOIN wc USING (work_id), range({Y0}, {Y1 - 1}) r(w) WHERE pub_year BETWEEN w AND w + 2 AND country IN (SELECT country FROM wc GROUP BY country HAVING count(*) >= 300)""") + f" SELECT country, window_start, window_end, {OUT} FROM p")
def _(s, d):
    return _rounded(mining.mine_countries(works(s, d), work_topics(s, d), work_countries(s, d), Y0, Y1, max_len=2))


@query("window_starts", "SELECT work_id, CAST(w AS INTEGER) AS window_start FROM works, range(1990, 2002) r(w) WHERE w % 2 = 0 AND pub_year BETWEEN w AND w + 2")
def _(s, d):
    return mining.anchored_starts(works(s, d), 3, 2).select("work_id", "window_start")


@query("complete_windows", "SELECT work_id, CAST(w AS INTEGER) AS window_start FROM works, range(1990, 2002) r(w) WHERE pub_year BETWEEN w AND w + 2 AND w + 2 <= 2000 AND w >= 1996")
def _(s, d):
    dealt = mining.anchored_starts(works(s, d)).withColumn("window_end", F.col("window_start") + 2)
    return mining.complete_windows(dealt, 2000, 1996).select("work_id", "window_start")


@query("patterns_for_window", P + " SELECT itemset, support_count FROM p WHERE window_start = 1997 AND k >= 2 ORDER BY support_count DESC, itemset LIMIT 30")
def _(s, d):
    return mining.patterns_for_window(mined(s, d), 1997, 2, 30).select("itemset", "support_count")


@query("pattern_snapshot", P + " SELECT window_start, itemset, support_count, CAST(row_number() OVER (PARTITION BY window_start ORDER BY support_count DESC, itemset) AS INTEGER) AS rank FROM p WHERE k >= 2 QUALIFY rank <= 20")
def _(s, d):
    return mining.top_per_window(mined(s, d)).select("window_start", "itemset", "support_count", "rank")


@query("pattern_timeseries", P + """ SELECT i.itemset, w.window_start, round(coalesce(p.support, 0), 9) AS support FROM (SELECT DISTINCT itemset FROM p WHERE k >= 2) i CROSS JOIN (SELECT DISTINCT window_start FROM p) w LEFT JOIN p USING (itemset, window_start)""")
def _(s, d):
    p = mined(s, d)
    return _rounded(mining.timeseries(p, p.filter("k >= 2")))


@query("emerging_patterns", P + CHANGE + " SELECT * FROM chg WHERE change > 0 ORDER BY change DESC, itemset LIMIT 40")
def _(s, d):
    c = mining.split_change(mining.first_last(mined(s, d)), 40, True)
    return c.withColumns({x: F.round(x, 9) for x in ("first_support", "last_support")})


@query("declining_patterns", P + CHANGE + " SELECT * FROM chg WHERE change < 0 ORDER BY change, itemset LIMIT 40")
def _(s, d):
    c = mining.split_change(mining.first_last(mined(s, d)), 40, False)
    return c.withColumns({x: F.round(x, 9) for x in ("first_support", "last_support")})


@query("lifecycles", P + LIFE + " SELECT * FROM life")
def _(s, d):
    return mining.lifecycles(mined(s, d))


@query("born_died", P + LIFE + """, ev AS (SELECT itemset, born AS window_start, 'born' AS event FROM life WHERE born > (SELECT min(born) FROM life) UNION ALL SELECT itemset, died, 'died' FROM life WHERE died IS NOT NULL)
  SELECT * FROM ev WHERE window_start = coalesce((SELECT max(window_start) FROM ev WHERE window_start <= 1998), (SELECT max(window_start) FROM ev))""")
def _(s, d):
    return mining.born_died(mining.lifecycles(mined(s, d)), 1998)


@query("topic_graph", P + """, i AS (SELECT support_count, string_split(itemset, ' | ') AS t FROM p WHERE k >= 2), x AS (SELECT support_count, t, unnest(t) AS a FROM i), y AS (SELECT support_count, a, unnest(t) AS b FROM x)
  SELECT a, b, CAST(sum(support_count) AS BIGINT) AS weight FROM y WHERE a < b GROUP BY ALL""")
def _(s, d):
    return mining.topic_graph(mined(s, d))


@query("topic_nodes", P + " SELECT t AS topic, sum(CASE WHEN k = 1 THEN CAST(support_count AS DOUBLE) ELSE support_count / 4.0 END) AS support FROM (SELECT k, support_count, unnest(string_split(itemset, ' | ')) AS t FROM p) GROUP BY t")
def _(s, d):
    return mining.topic_nodes(mined(s, d))


# -- incremental --------------------------------------------------------------------------------


def _split_state(s, d):
    """All works in two batches."""
    groups = ["window_start", "window_end"]
    b = mining.window_starts(mining.baskets(works(s, d), work_topics(s, d)), Y0, Y1)
    new = F.pmod(F.xxhash64("work_id"), F.lit(10)) == 0
    return groups, mining.multiset(b.filter(~new), groups), mining.multiset(b.filter(new), groups)


@query("incremental_equals_full", patterns_sql(max_len=2) + f" SELECT window_start, window_end, {OUT} FROM p")
def _(s, d):
    groups, old, new = _split_state(s, d)
    before = mining.frequent(old, groups, SUPPORT, 2, 20)
    return _rounded(incremental.update_patterns(before, old, new, groups, SUPPORT, 2, 20))


def _two(s, d):
    return mined(s, d, max_len=2).filter("window_start = 1996"), mined(s, d, max_len=2).filter("window_start = 1998").withColumns({"window_start": F.lit(1996)})


_TWO = patterns_sql(max_len=2) + ", l AS (SELECT itemset, support FROM p WHERE window_start = 1996), r AS (SELECT itemset, support FROM p WHERE window_start = 1998)"


@query("patterns_changed", _TWO + " SELECT 1996 AS window_start, itemset, 'before' AS side FROM l WHERE itemset NOT IN (SELECT itemset FROM r) UNION ALL SELECT 1996, itemset, 'after' FROM r WHERE itemset NOT IN (SELECT itemset FROM l)")
def _(s, d):
    return mining.patterns_changed(*_two(s, d))


@query("compare_patterns", _TWO + """, j AS (SELECT l.support AS l, r.support AS r FROM l FULL JOIN r USING (itemset))
  SELECT count(l) FILTER (r IS NOT NULL) AS common, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, round(avg(abs(l - r)), 9) AS support_mae,
  round(count(l) FILTER (r IS NOT NULL) / count(*), 9) AS jaccard FROM j""")
def _(s, d):
    return mining.compare_patterns(*_two(s, d))


@query("tally_combine", """WITH n AS (SELECT work_id, count(*) AS n FROM wc GROUP BY work_id)
  SELECT country, pub_year, count(*) AS papers, round(sum(CAST(1.0 AS DOUBLE) / n), 4) AS fractional FROM wc JOIN n USING (work_id) JOIN works USING (work_id) GROUP BY ALL""")
def _(s, d):
    half = lambda k: countries.fold(countries.weighted(work_countries(s, d)).join(works(s, d).filter(f"work_id % 2 = {k}").select("work_id", "pub_year"), "work_id"), "country", "pub_year", digits=12)
    return countries.combine(half(0), half(1), ["country", "pub_year"], ["papers", "fractional"], 4)


@query("cube_combine", CUBE_SQL.replace(", 6)", ", 4)") + " SELECT topic_id, country, year, papers, fractional FROM cube")
def _(s, d):
    rows = work_topics(s, d).select("work_id", "topic_id").join(countries.weighted(work_countries(s, d)), "work_id").join(works(s, d).select("work_id", F.col("pub_year").alias("year")), "work_id")
    keys = ["topic_id", "country", "year"]
    half = lambda k: countries.fold(rows.filter(f"work_id % 2 = {k}"), *keys, digits=12)
    return countries.combine(half(0), half(1), keys, ["papers", "fractional"], 4)


@query("sliding_rate_counts", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events""", base=False)
def _(s, d):
    return incremental.sliding_counts(table(s, d, "events"), "user_id", "ts", 3600).select("event_id", "n")


@query("rate_limit")
def _(s, d):
    return incremental.rate_limit(table(s, d, "events"), "user_id", "ts", 86_400, 2)


@query("event_sliding_window", """WITH w AS (SELECT date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS start, event_type, value FROM events, range(0, 3) r(i))
  SELECT strftime(start, '%Y-%m-%d') AS start, strftime(start + INTERVAL 3 DAY, '%Y-%m-%d') AS stop, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""", base=False)
def _(s, d):
    w = incremental.event_windows(table(s, d, "events"))
    return w.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "stop")})


@query("dedup_events", "SELECT user_id FROM events GROUP BY user_id", base=False)
def _(s, d):
    return incremental.dedup_stream(table(s, d, "events"), "user_id", "ts").select("user_id")


# -- country bibliometrics -------------------------------------------------------------------------

_N = "WITH n AS (SELECT work_id, count(*) AS n FROM wc GROUP BY work_id)"
_FRAC = "round(sum(CAST(1.0 AS DOUBLE) / n), 6) AS fractional"


@query("country_year_counts", _N + f" SELECT country, pub_year, count(*) AS papers, {_FRAC} FROM wc JOIN n USING (work_id) JOIN works USING (work_id) GROUP BY ALL")
def _(s, d):
    return countries.country_year_counts(works(s, d), work_countries(s, d))


@query("country_year_rows", "SELECT country, string_agg(pub_year || ':' || c, ',' ORDER BY pub_year) AS by_year FROM (SELECT country, pub_year, count(*) AS c FROM wc JOIN works USING (work_id) GROUP BY ALL) GROUP BY country")
def _(s, d):
    r = countries.year_rows(countries.country_year_counts(works(s, d), work_countries(s, d)))
    return r.select("country", F.array_join(F.transform("by_year", lambda x: F.concat_ws(":", x["pub_year"], x["papers"])), ",").alias("by_year"))


_TY = "SELECT topic, pub_year, count(*) AS papers FROM (SELECT DISTINCT work_id, topic FROM wt WHERE work_id IN (SELECT work_id FROM wc)) JOIN works USING (work_id) GROUP BY ALL"


@query("topic_year_counts", _TY)
def _(s, d):
    return countries.topic_year_counts(works(s, d), work_topics(s, d), work_countries(s, d))


@query("topic_top_countries", _N + f""", t AS (SELECT topic, country, {_FRAC} FROM (SELECT DISTINCT work_id, topic FROM wt) JOIN wc USING (work_id) JOIN n USING (work_id) GROUP BY ALL)
  SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY fractional DESC, country) AS INTEGER) AS rank FROM t QUALIFY rank <= 5""")
def _(s, d):
    return countries.topic_top_countries(work_topics(s, d), work_countries(s, d))


for _mode, _weight in (("full", "CAST(1.0 AS DOUBLE)"), ("per_country", "CAST(1.0 AS DOUBLE) / n"), ("fractional", "CAST(2.0 AS DOUBLE) / (n * (n - 1))")):

    @query(f"collab_{_mode}", _N + f" SELECT a.country AS a, b.country AS b, round(sum({_weight}), 6) AS weight FROM wc a JOIN wc b USING (work_id) JOIN n USING (work_id) WHERE a.country < b.country GROUP BY ALL ORDER BY weight DESC, a, b LIMIT 400")
    def _(s, d, mode=_mode):
        return countries.collaborations(work_countries(s, d), mode, 400)


@query("country_date_counts", _N + f" SELECT country, pub_date, count(*) AS papers, {_FRAC} FROM wc JOIN n USING (work_id) JOIN works USING (work_id) GROUP BY ALL")
def _(s, d):
    return countries.country_date_counts(works(s, d), work_countries(s, d))


@query("topic_country_year", CUBE_SQL + " SELECT * FROM cube")
def _(s, d):
    return cube(s, d)


@query("cube_min_cell", CUBE_SQL + " SELECT * FROM cube WHERE papers >= 5")
def _(s, d):
    return countries.topic_country_year(works(s, d), work_topics(s, d), work_countries(s, d), 5)


_GW = """, gw AS (SELECT e AS cur_end, date_trunc('year', e) AS cur_start, date_trunc('year', e) - INTERVAL 12 MONTH AS prev_start, e - INTERVAL 12 MONTH AS prev_end FROM (SELECT max(CAST(pub_date AS DATE)) AS e FROM works)),
  g AS (SELECT strftime(cur_start, '%Y-%m-%d') AS cur_start, strftime(cur_end, '%Y-%m-%d') AS cur_end, strftime(prev_start, '%Y-%m-%d') AS prev_start, strftime(prev_end, '%Y-%m-%d') AS prev_end FROM gw)"""
_PER = """, per AS (SELECT country, count(*) FILTER (pub_date BETWEEN cur_start AND cur_end) AS cur, count(*) FILTER (pub_date BETWEEN prev_start AND prev_end) AS prev FROM wc JOIN works USING (work_id), g GROUP BY country)"""


@query("growth_window", _N + _GW + " SELECT * FROM g")
def _(s, d):
    return countries.growth_window(works(s, d))


# A window that touches a partial year is hidden, then one with fewer than 30 papers in a period.
_WHY = "CASE WHEN CAST(substr(cur_start, 1, 4) AS INTEGER) IN ({years}) OR CAST(substr(prev_start, 1, 4) AS INTEGER) IN ({years}) THEN 'partial_year' WHEN NOT (cur >= 30 AND prev >= 30{more}) THEN 'too_few_papers' END"


def _growth_sql(years: str) -> str:
    return _N + _GW + _PER + f""", rs AS (SELECT per.*, {_WHY.format(years=years, more="")} AS reason FROM per, g)
  SELECT country, CAST(cur AS DOUBLE) AS cur, CAST(prev AS DOUBLE) AS prev, CASE WHEN reason IS NULL THEN round((cur - prev) * 100.0::DOUBLE / prev, 1) END AS growth_pct, reason FROM rs"""


@query("country_growth", _growth_sql("-1"))
def _(s, d):
    w = works(s, d)
    return countries.country_growth(countries.country_date_counts(w, work_countries(s, d)), countries.growth_window(w))


@query("country_growth_partial", _growth_sql("2000"))
def _(s, d):
    w = works(s, d)
    return countries.country_growth(countries.country_date_counts(w, work_countries(s, d)), countries.growth_window(w), partial_years=(2000,))


@query("country_share", _N + _GW + _PER + f""", tot AS (SELECT count(*) FILTER (pub_date BETWEEN cur_start AND cur_end) AS tc, count(*) FILTER (pub_date BETWEEN prev_start AND prev_end) AS tp FROM works, g WHERE work_id IN (SELECT work_id FROM wc)),
  rs AS (SELECT per.*, tc, tp, {_WHY.format(years="-1", more=" AND tc > 0 AND tp > 0")} AS reason FROM per, g, tot),
  sh AS (SELECT country, CASE WHEN reason IS NULL THEN round(cur * 100.0::DOUBLE / tc, 2) END AS share_pct, CASE WHEN reason IS NULL THEN round(prev * 100.0::DOUBLE / tp, 2) END AS prev_share_pct, reason FROM rs) SELECT *, round(share_pct - prev_share_pct, 2) AS share_change_pp FROM sh""")
def _(s, d):
    w, wc = works(s, d), work_countries(s, d)
    return countries.country_share(countries.country_date_counts(w, wc), countries.date_totals(w, wc), countries.growth_window(w))


@query("cube_year_totals", CUBE_SQL + " SELECT country, year, CAST(sum(papers) AS BIGINT) AS papers, round(sum(fractional), 6) AS fractional FROM cube WHERE upper(country) = '{COUNTRY}' GROUP BY ALL".replace("{COUNTRY}", COUNTRY.upper()))
def _(s, d):
    return countries.cube_year_totals(cube(s, d), f" {COUNTRY.lower()} ")


@query("country_dimension", """WITH c AS (SELECT DISTINCT country AS code FROM wc UNION ALL SELECT ' kenya ' UNION ALL SELECT '' UNION ALL SELECT NULL UNION ALL SELECT 'zz'), k AS (SELECT upper(n_name) AS code, 'The ' || lower(n_name) AS name, upper(substr(n_name, 1, 3)) AS iso3 FROM nation),
  x AS (SELECT c.code AS raw, coalesce(upper(trim(c.code)), '') AS cl FROM c)
  SELECT raw AS code, CASE WHEN cl = '' THEN 'Unknown' ELSE coalesce(name, cl) END AS name, coalesce(iso3, '') AS iso3, CASE WHEN cl = '' THEN 'Unknown' ELSE coalesce(name, cl) || ' (' || cl || ')' END AS label FROM x LEFT JOIN k ON k.code = cl""")
def _(s, d):
    odd = s.createDataFrame([(" kenya ",), ("",), (None,), ("zz",)], "code string")
    known = table(s, d, "nation").select(F.upper("n_name").alias("code"), F.concat(F.lit("The "), F.lower("n_name")).alias("name"), F.upper(F.substring("n_name", 1, 3)).alias("iso3"))
    return countries.country_dimension(work_countries(s, d).select(F.col("country").alias("code")).distinct().union(odd), known)


_LQ = """, tc AS (SELECT topic, country, count(*) AS papers FROM (SELECT DISTINCT work_id, topic FROM wt) JOIN wc USING (work_id) GROUP BY ALL),
  nc AS (SELECT country, count(*) AS n_c FROM wc GROUP BY country), nt AS (SELECT topic, count(*) AS n_t FROM (SELECT DISTINCT work_id, topic FROM wt WHERE work_id IN (SELECT work_id FROM wc)) GROUP BY topic),
  lq AS (SELECT country, topic, papers, round((papers / n_c) / (n_t / (SELECT count(DISTINCT work_id) FROM wc)), 4) AS lq FROM tc JOIN nc USING (country) JOIN nt USING (topic) WHERE papers >= 10)"""


@query("location_quotient", _N + _LQ + " SELECT *, CAST(row_number() OVER (PARTITION BY country ORDER BY lq DESC, papers DESC, topic) AS INTEGER) AS rank FROM lq QUALIFY rank <= 5")
def _(s, d):
    return countries.location_quotient(works(s, d), work_topics(s, d), work_countries(s, d))


@query("country_stats", _N + _GW + _PER + _LQ + """, b AS (SELECT country, count(*) AS papers, round(sum(CAST(1.0 AS DOUBLE) / n), 4) AS fractional FROM wc JOIN n USING (work_id) GROUP BY country),
  t AS (SELECT country, topic AS top_topic FROM lq QUALIFY row_number() OVER (PARTITION BY country ORDER BY lq DESC, papers DESC, topic) = 1)
  SELECT country, papers, fractional, CASE WHEN cur >= 30 AND prev >= 30 THEN round((cur - prev) * 100.0::DOUBLE / prev, 1) END AS growth_pct, top_topic FROM b LEFT JOIN per USING (country) LEFT JOIN t USING (country)""")
def _(s, d):
    return countries.country_stats(works(s, d), work_topics(s, d), work_countries(s, d))


_SHARES = """, ex AS (SELECT *, round({v} * 1000.0::DOUBLE / sum({v}) OVER (), 9) AS x FROM {t}), ba AS (SELECT *, floor(x) AS b, x - floor(x) AS rem FROM ex),
  sh AS (SELECT *, row_number() OVER (ORDER BY rem DESC, {n}) AS rn, 1000 - sum(b) OVER () AS lft FROM ba)"""


@query("percent_shares", "WITH pc AS (SELECT country, count(*) AS papers FROM wc GROUP BY country)" + _SHARES.format(v="papers", t="pc", n="country") + " SELECT country, papers, (b + CASE WHEN rn <= lft THEN 1 ELSE 0 END) / 10.0::DOUBLE AS share FROM sh")
def _(s, d):
    return countries.percent_shares(work_countries(s, d).groupBy("country").agg(F.count("*").alias("papers")), "country", "papers")


_TOP = """WITH rk AS (SELECT country, count(*) AS papers, row_number() OVER (ORDER BY count(*) DESC, country) AS r FROM wc GROUP BY country),
  pc AS (SELECT CASE WHEN r <= 12 THEN country ELSE 'Other' END AS country, CAST(sum(papers) AS BIGINT) AS papers, count(*) AS names FROM rk GROUP BY 1)"""


@query("countries_top_other", _TOP + " SELECT * FROM pc")
def _(s, d):
    return countries.top_other(work_countries(s, d).groupBy("country").agg(F.count("*").alias("papers")), "country", "papers", 12)


@query("country_chart", _TOP + _SHARES.format(v="papers", t="pc", n="country") + " SELECT country, papers, (b + CASE WHEN rn <= lft THEN 1 ELSE 0 END) / 10.0::DOUBLE AS share FROM sh")
def _(s, d):
    return countries.country_chart(work_countries(s, d).groupBy("country").agg(F.count("*").alias("papers")))


# -- trends ------------------------------------------------------------------------------------------


def growth_sql(source: str, key: str, value: str, last: int = 2000, span: int = 3) -> str:
    """CTE gr (key, volume, last, growth) of a table with year."""
    y = [f"y{i}" for i in range(span + 1)]
    sums = ", ".join(f"CAST(coalesce(sum({value}) FILTER (year = {last - span + i}), 0) AS DOUBLE) AS {y[i]}" for i in range(span + 1))
    steps = ", ".join(f"least(2.0, greatest(-1.0, ({y[i + 1]} - {y[i]}) / ({y[i]} + 5)))" for i in range(span))
    return f""", gy AS (SELECT {key}, {sums} FROM {source} WHERE year BETWEEN {last - span} AND {last} GROUP BY {key}), gs AS (SELECT *, list_sort([{steps}]) AS st FROM gy),
  gr AS (SELECT {key}, round({" + ".join(y)}, 6) AS volume, round(y{span}, 6) AS last, round(least(list_sum(st) / {span}, list_median(st)), 6) AS growth FROM gs)"""


_NAMES = ", nm AS (SELECT topic_id, arg_max(topic, (p, topic)) AS topic FROM (SELECT topic_id, topic, sum(papers) AS p FROM cube GROUP BY ALL) GROUP BY topic_id)"
_RANK = " SELECT topic_id, topic, volume, last, growth FROM gr JOIN nm USING (topic_id) WHERE volume >= 20 AND last >= 5 AND growth > 0 ORDER BY growth DESC, volume DESC, topic, topic_id LIMIT 20"


@query("rank_emerging", CUBE_SQL + growth_sql("cube", "topic_id", "fractional") + _NAMES + _RANK)
def _(s, d):
    return trends.rank_emerging(cube(s, d), 2000)


@query("rank_emerging_country", CUBE_SQL + f", own AS (SELECT * FROM cube WHERE country = '{COUNTRY}')" + growth_sql("own", "topic_id", "papers") + _NAMES.replace("FROM cube", "FROM own") + _RANK.replace("volume >= 20 AND last >= 5", "volume >= 2 AND last >= 1"))
def _(s, d):
    return trends.rank_emerging(cube(s, d), 2000, country=COUNTRY, min_total=2, min_last=1)


@query("robust_growth", CUBE_SQL + growth_sql("cube", "topic_id, country", "papers") + " SELECT * FROM gr")
def _(s, d):
    return trends.growth_steps(cube(s, d), ["topic_id", "country"], 1997, 2000, "papers")


@query("pct_rank_avg", """SELECT country, papers, round((rank() OVER (ORDER BY papers) - 1 + (count(*) OVER (PARTITION BY papers) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1), 9) AS pct
  FROM (SELECT country, count(*) // 40 AS papers FROM wc GROUP BY country)""")
def _(s, d):
    return trends.pct_rank_avg(work_countries(s, d).groupBy("country").agg(F.expr("count(*) DIV 40").alias("papers")), "papers", "pct")


GAPS_SQL = f"WITH ty AS (SELECT topic, pub_year AS year, papers FROM ({_TY}))" + growth_sql("ty", "topic", "papers") + """, ok AS (SELECT * FROM gr WHERE volume >= 20 AND last >= 5),
  pr AS (SELECT *, round((rank() OVER (ORDER BY growth) - 1 + (count(*) OVER (PARTITION BY growth) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1), 9) AS pg, round((rank() OVER (ORDER BY volume) - 1 + (count(*) OVER (PARTITION BY volume) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1), 9) AS pv FROM ok),
  yt AS (SELECT year, sum(papers) AS t FROM ty WHERE year BETWEEN 1997 AND 2000 GROUP BY year),
  gp AS MATERIALIZED (SELECT topic, volume, growth, round(pg - pv, 6) AS score, (SELECT count(*) FROM yt WHERE t < 0.5 * (SELECT max(t) FROM yt)) AS thin_years FROM pr WHERE growth >= -0.05 AND round(pg - pv, 6) > 0 ORDER BY score DESC, growth DESC, topic LIMIT 20)"""


def growth_gaps(s, d):
    return trends.find_gaps(countries.topic_year_counts(works(s, d), work_topics(s, d), work_countries(s, d)), 2000, min_growth=-0.05)


@query("find_gaps", GAPS_SQL + " SELECT * FROM gp")
def _(s, d):
    return growth_gaps(s, d)


@query("gap_examples", """WITH t AS (SELECT DISTINCT work_id, topic FROM wt WHERE topic IN ('Brand#1', 'Brand#2', 'Brand#3')), r AS (
  SELECT topic, work_id, pub_date, CAST(row_number() OVER (PARTITION BY topic ORDER BY pub_date DESC, work_id DESC) AS INTEGER) AS rn FROM t JOIN works USING (work_id)) SELECT * FROM r ORDER BY rn, topic LIMIT 8""")
def _(s, d):
    return trends.gap_examples(works(s, d), work_topics(s, d), ["Brand#1", "Brand#2", "Brand#3"], 8)


@query("cluster_emerging_scores", f"WITH ty AS (SELECT topic, pub_year AS year, papers FROM ({_TY}))" + growth_sql("ty", "topic", "papers") + """, pp AS (SELECT work_id, CAST(work_id % 7 - 1 AS INTEGER) AS colour, topic FROM wt),
  pm AS (SELECT work_id, colour, coalesce(max(growth), 0) AS g FROM pp LEFT JOIN gr USING (topic) WHERE colour >= 0 GROUP BY ALL), cm AS (SELECT colour, avg(g) AS m FROM pm GROUP BY colour)
  SELECT colour, CASE WHEN (SELECT max(m) FROM cm) > 0 THEN round(greatest(0.0, least(1.0, m / (SELECT max(m) FROM cm))), 6) ELSE 0.0 END AS score FROM cm""")
def _(s, d):
    g = trends.growth_steps(countries.topic_year_counts(works(s, d), work_topics(s, d), work_countries(s, d)).withColumnRenamed("pub_year", "year"), ["topic"], 1997, 2000, "papers")
    papers = work_topics(s, d).select(F.col("work_id").alias("paper"), (F.col("work_id") % 7 - 1).cast("int").alias("colour"), "topic")
    return trends.cluster_emerging_scores(g, papers)


def _rates(s, d):
    by = works(s, d).groupBy("pub_year", "pub_month").agg(F.count("*").alias("c")).filter("pub_year <> 1997 OR pub_month <> 5")
    return by.select(F.concat_ws("-", "pub_year", F.lpad(F.col("pub_month").cast("string"), 2, "0")).alias("month"), (F.col("c") * 10).alias("population"))


_PUB = "WITH m AS (SELECT pub_year, pub_month, count(*) AS c FROM works GROUP BY ALL), e AS (SELECT *, CASE WHEN NOT (pub_year = 1997 AND pub_month = 5) THEN c * 10 END AS pop FROM m)"


@query("publications_by_year", _PUB + " SELECT y AS bucket, CAST(coalesce(sum(c), 0) AS BIGINT) AS papers, CAST(CASE WHEN count(c) > count(pop) THEN NULL ELSE sum(pop) END AS BIGINT) AS estimate FROM (SELECT CAST(unnest(range((SELECT min(pub_year) FROM works), (SELECT max(pub_year) FROM works) + 1)) AS INTEGER) AS y) LEFT JOIN e ON pub_year = y GROUP BY y")
def _(s, d):
    return trends.publications(works(s, d), _rates(s, d))


@query("publications_by_month", _PUB + " SELECT CAST(y AS INTEGER) AS bucket, CAST(coalesce(sum(c), 0) AS BIGINT) AS papers, CAST(sum(pop) AS BIGINT) AS estimate FROM range(1, 13) r(y) LEFT JOIN e ON pub_month = y AND pub_year = 2001 GROUP BY y")
def _(s, d):
    return trends.publications(works(s, d), _rates(s, d), 2001)


@query("topics_top_other", """WITH c AS (SELECT topic, count(DISTINCT work_id) AS papers FROM wt GROUP BY topic), r AS (SELECT *, row_number() OVER (ORDER BY papers DESC, topic) AS r FROM c)
  SELECT CASE WHEN r <= 6 THEN topic ELSE 'Other' END AS topic, CAST(sum(papers) AS BIGINT) AS papers, count(*) AS names FROM r GROUP BY 1""")
def _(s, d):
    return countries.top_other(work_topics(s, d).groupBy("topic").agg(F.countDistinct("work_id").alias("papers")), "topic", "papers", 6)


@query("rollup_estimate", _PUB + " SELECT pub_year, CAST(CASE WHEN count(*) > count(pop) THEN NULL ELSE sum(pop) END AS BIGINT) AS estimate FROM e GROUP BY pub_year")
def _(s, d):
    w = works(s, d).groupBy("pub_year", "pub_month").agg(F.count("*").alias("c"))
    pop = F.when(~((F.col("pub_year") == 1997) & (F.col("pub_month") == 5)), F.col("c") * 10)
    return w.withColumn("pop", pop).groupBy("pub_year").agg(trends.rollup("pop").alias("estimate"))


_SERIES = "WITH c AS (SELECT pub_year AS year, country AS name, count(*) AS value FROM wc JOIN works USING (work_id) GROUP BY ALL)"


@query("stream_bands", _SERIES + """, x AS (SELECT *, sum(value) OVER (PARTITION BY year ORDER BY name) - sum(value) OVER (PARTITION BY year) / 2.0::DOUBLE AS top FROM c)
  SELECT year, name, round(top - value, 6) AS lo, round(top, 6) AS hi FROM x""")
def _(s, d):
    c = countries.country_year_counts(works(s, d), work_countries(s, d))
    return trends.stream_bands(c.select(F.col("pub_year").alias("year"), F.col("country").alias("name"), F.col("papers").alias("value")))


@query("topic_series", _SERIES + """, r AS (SELECT name, row_number() OVER (ORDER BY sum(value) DESC, name) AS r FROM c GROUP BY name)
  SELECT year, CASE WHEN r <= 8 THEN name ELSE 'Other' END AS name, CAST(sum(value) AS BIGINT) AS value FROM c JOIN r USING (name) GROUP BY ALL""")
def _(s, d):
    c = countries.country_year_counts(works(s, d), work_countries(s, d))
    return trends.series_top_other(c.select(F.col("pub_year").alias("year"), F.col("country").alias("name"), F.col("papers").alias("value")), 8)
