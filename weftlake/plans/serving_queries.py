"""Queries of the serving layer's operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.operators import mining, serving, trends
from weftlake.plans.catalog import query
from weftlake.plans.mining_queries import GAPS_SQL, LIFE, P, growth_gaps, mined, patterns_sql
from weftlake.sources.adapters import table, vectors, work_topics, works

# -- topic lists and gap feeds: brands as topics -----------------------------------------------------

ALLOW, DENY = [f"Brand#{i}" for i in range(1, 18)], ["Brand#4", "Brand#9"]
_IN = f"IN ({', '.join(repr(x) for x in ALLOW if x not in DENY)})"


def _lists(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return tuple(s.createDataFrame([(x,) for x in names], "topic string") for names in (ALLOW, DENY))


@query("allowed_topics", f"SELECT DISTINCT work_id, topic FROM wt WHERE topic {_IN}")
def _(s, d):
    return serving.allowed(work_topics(s, d).select("work_id", "topic").distinct(), "topic", *_lists(s))


@query("allowed_baskets", f"SELECT work_id, string_agg(topic, ' | ' ORDER BY topic) AS items FROM (SELECT DISTINCT work_id, topic FROM wt) GROUP BY work_id HAVING bool_and(topic {_IN})")
def _(s, d):
    baskets = work_topics(s, d).groupBy("work_id").agg(F.array_sort(F.collect_set("topic")).alias("items"))
    return serving.all_allowed(baskets, "work_id", "items", *_lists(s)).select("work_id", F.array_join("items", " | ").alias("items"))


@query("serving_gaps", GAPS_SQL + f" SELECT topic, score, growth FROM gp WHERE topic {_IN} ORDER BY score DESC, growth DESC, topic LIMIT 5")
def _(s, d):
    return serving.serving_gaps(growth_gaps(s, d), *_lists(s), limit=5).select("topic", "score", "growth")


# Pairs of topics that occur together least, scored by how seldom, stand for semantic gaps.
_FEED = GAPS_SQL + """, tp AS (SELECT DISTINCT work_id, topic FROM wt), pc AS (SELECT x.topic AS a, y.topic AS b, count(*) AS n FROM tp x JOIN tp y USING (work_id) WHERE x.topic < y.topic GROUP BY ALL),
  sg AS (SELECT [a, b] AS items, round(1.0::DOUBLE / n, 6) AS score, CASE WHEN n % 2 = 0 THEN 1997 ELSE 1996 END AS window_start FROM pc),
  fd AS (SELECT 'growth' AS kind, [topic] AS items, score, growth, 1997 AS window_start FROM gp UNION ALL
    SELECT * FROM (SELECT 'semantic', items, score, NULL::DOUBLE, window_start FROM sg WHERE window_start = 1997 ORDER BY score DESC, array_to_string(items, ' ') LIMIT 10))"""


def _feed(s, d):
    t = work_topics(s, d).select("work_id", "topic").distinct()
    pairs = t.withColumnRenamed("topic", "a").join(t.withColumnRenamed("topic", "b"), "work_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    semantic = pairs.select(F.array("a", "b").alias("items"), F.round(1.0 / F.col("n"), 6).alias("score"), F.when(F.col("n") % 2 == 0, 1997).otherwise(1996).alias("window_start"))
    return serving.merge_gaps(growth_gaps(s, d).withColumn("window_start", F.lit(1997)), semantic, 1997)


@query("gap_feed", _FEED + " SELECT kind, array_to_string(items, ' ') AS items, score, growth, window_start FROM fd ORDER BY score DESC, kind, growth DESC NULLS LAST, items")
def _(s, d):
    return _feed(s, d).withColumn("items", F.array_join("items", " "))


@query("gap_patterns", _FEED + """, e AS (SELECT topic, work_id FROM (SELECT topic, work_id, row_number() OVER (PARTITION BY topic ORDER BY pub_date DESC, work_id DESC) AS rn FROM tp JOIN works USING (work_id) WHERE topic IN ('Brand#1', 'Brand#2', 'Brand#3')) ORDER BY rn, topic LIMIT 8), x AS (SELECT array_to_string(items, ' | ') AS gap, items, unnest(items) AS topic FROM fd),
  g AS (SELECT gap, string_agg(DISTINCT work_id, ' ' ORDER BY work_id) AS ex FROM x JOIN e USING (topic) GROUP BY gap)
  SELECT array_to_string(items, ' | ') AS items, score AS support, kind, window_start, coalesce(ex, '') AS examples, CASE WHEN growth IS NOT NULL AND len(items) = 1 THEN items[1] || ' grows' END AS explanation FROM fd LEFT JOIN g ON gap = array_to_string(items, ' | ')""")
def _(s, d):
    examples = trends.gap_examples(works(s, d), work_topics(s, d), ["Brand#1", "Brand#2", "Brand#3"], 8).select("topic", "work_id")
    out = serving.gap_patterns(_feed(s, d), examples, F.concat(F.get("items", 0), F.lit(" grows")))
    return out.withColumns({"items": F.array_join("items", " | "), "examples": F.array_join(F.col("examples").cast("array<string>"), " ")})


# -- shares, territories, months ------------------------------------------------------------------------


@query("period_shares", """WITH x AS (SELECT topic AS name, CAST(pub_year AS VARCHAR) AS key, count(DISTINCT work_id) AS value FROM wt JOIN works USING (work_id) GROUP BY ALL), pt AS (SELECT *, CASE WHEN name = 'Brand#5' THEN 12.5::DOUBLE END AS share FROM x),
  sm AS (SELECT CAST(pub_year AS VARCHAR) AS key, count(*) AS sampled FROM works WHERE pub_year < 1999 GROUP BY 1), co AS (SELECT key, sum(value) AS c FROM pt WHERE share IS NULL GROUP BY key)
  SELECT name, key, round(coalesce(share, CASE WHEN coalesce(sampled, c, 0) > 0 THEN value * 100.0::DOUBLE / coalesce(sampled, c) ELSE 0.0 END), 6) AS share FROM pt LEFT JOIN sm USING (key) LEFT JOIN co USING (key)""")
def _(s, d):
    w = works(s, d).select("work_id", F.col("pub_year").cast("string").alias("key"))
    points = work_topics(s, d).select("work_id", F.col("topic").alias("name")).distinct().join(w, "work_id").groupBy("name", "key").agg(F.count("*").alias("value"))
    sampled = w.filter("key < '1999'").groupBy("key").agg(F.count("*").alias("sampled"))
    return serving.period_shares(points.withColumn("share", F.when(F.col("name") == "Brand#5", 12.5)), sampled)


@query("territories", f"SELECT n_name, upper(substr(n_name, 1, 2)) IN ({', '.join(repr(c) for c in serving.TERRITORIES)}) AS territory FROM nation", base=False)
def _(s, d):
    return table(s, d, "nation").select("n_name", serving.is_territory(F.lower(F.substring("n_name", 1, 2))).alias("territory"))


@query("month_ticks", "SELECT DISTINCT substr(pub_date, 1, 7) AS key, strftime(CAST(pub_date AS DATE), '%b') AS tick FROM works")
def _(s, d):
    key = F.substring("pub_date", 1, 7)
    return works(s, d).select(key.alias("key"), serving.tick(key).alias("tick")).distinct()


@query("half_even_rounding", "SELECT p_partkey, round_even(p_size / 8.0::DOUBLE, 2) AS eighth FROM part", base=False)
def _(s, d):
    return table(s, d, "part").select("p_partkey", serving.half_even(F.col("p_size") / 8.0, 2).alias("eighth"))


# -- JSON metadata --------------------------------------------------------------------------------------


def _meta(s, d):
    """events as papers' metadata: some lack the date, some have a list."""
    e = table(s, d, "events").select("event_id", "props", "event_type")
    more = F.when(F.col("event_type") == "click", F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "publication_date": "1999-05-05", "topics": ["a", "b\\"c"]}'))).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("id"), more.alias("meta"))


_META = """WITH mt AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN left(props, length(props) - 1) || ', "publication_date": "1999-05-05", "topics": ["a", "b\\"c"]}' ELSE props END AS meta FROM events)"""


@query("json_kinds", _META + """ SELECT id, CASE json_type(meta, '$.k') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE CASE WHEN json_type(meta, '$.k') IS NOT NULL THEN 'number' END END AS k,
  CASE json_type(meta, '$.topics') WHEN 'ARRAY' THEN 'array' END AS topics, CASE json_type(meta, '$.publication_date') WHEN 'VARCHAR' THEN 'string' END AS date FROM mt""", base=False)
def _(s, d):
    return _meta(s, d).select("id", serving.json_kind("meta", "$.k").alias("k"), serving.json_kind("meta", "$.topics").alias("topics"), serving.json_kind("meta", "$.publication_date").alias("date"))


@query("json_items", _META + """ SELECT id, CAST(ord AS INTEGER) AS ord, json_extract_string(meta, '$.topics[' || (ord - 1) || ']') AS item FROM mt, range(1, 3) r(ord) WHERE json_array_length(meta, '$.topics') >= ord""", base=False)
def _(s, d):
    return serving.json_items(_meta(s, d), "meta", "$.topics").select("id", "ord", "item")


@query("backfill_dates", _META + """ SELECT id, CASE WHEN json_type(meta, '$.publication_date') IS NOT NULL THEN json_extract_string(meta, '$.publication_date') WHEN id % 3 = 0 THEN '2001-01-0' || id % 10 END AS date, json_extract_string(meta, '$.k') AS k,
  TRUE AS known FROM mt""", base=False)
def _(s, d):
    m = _meta(s, d)
    known = m.filter("id % 3 = 0").select("id", F.concat(F.lit("2001-01-0"), (F.col("id") % 10).cast("string")).alias("value"))
    out = serving.backfill(m, known, "meta", "publication_date")
    return out.select("id", F.get_json_object("meta", "$.publication_date").alias("date"), F.get_json_object("meta", "$.k").alias("k"), F.array_contains(F.json_object_keys("meta"), "publication_date").alias("known"))


@query("papers_of_metadata", _META + """ SELECT json_extract_string(meta, '$.k') AS id, '' AS title, coalesce(array_to_string(CAST(json_extract(meta, '$.topics') AS VARCHAR[]), ' '), '') AS topics, json_extract_string(meta, '$.publication_date') AS date, len(json_keys(meta)) AS members FROM mt""", base=False)
def _(s, d):
    renamed = _meta(s, d).select(F.regexp_replace("meta", '"k"', '"work_id"').alias("meta"))
    p = serving.paper_of(renamed, "meta", ("work_id", "title", "topics"))
    date = F.get_json_object(F.concat(F.lit("["), F.element_at("extra", "publication_date"), F.lit("]")), "$[0]")
    return p.select("id", "title", F.array_join("topics", " ").alias("topics"), date.alias("date"), (F.lit(1) + F.size("extra") + F.when(F.size("topics") > 0, 1).otherwise(0)).cast("long").alias("members"))


# -- the raw corpus -----------------------------------------------------------------------------------------

_LABELS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'none' WHEN '2-HIGH' THEN 'unknown' WHEN '3-MEDIUM' THEN 'S3 ' || o_orderstatus WHEN '4-NOT SPECIFIED' THEN o_orderstatus ELSE 'S5' END"


def _first_topics(s, d):
    """Orders with a list of topics: none, one without a subfield's parts, and whole ones."""
    name, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    sub = F.struct(F.when(name.rlike("^3"), "https://x/S3").when(name.rlike("^5"), "https://x/S5").alias("id"), F.when(name.rlike("^[34]"), status).alias("display_name"))
    one = F.array(F.struct(sub.alias("subfield")))
    return table(s, d, "orders").select("o_orderkey", F.when(name.rlike("^1"), F.slice(one, 1, 0)).otherwise(one).alias("topics"))


@query("subfield_labels", f"SELECT o_orderkey, {_LABELS} AS label, CASE WHEN o_orderpriority LIKE '3%' THEN 'S3' WHEN o_orderpriority LIKE '5%' THEN 'S5' ELSE '' END AS id FROM orders", base=False)
def _(s, d):
    return _first_topics(s, d).select("o_orderkey", serving.subfield_label("topics").alias("label"), serving.first_subfield("topics").alias("id"))


@query("corpus_check", """WITH x AS (SELECT CASE WHEN o_orderkey >= (SELECT min(k) FROM (SELECT o_orderkey AS k FROM orders ORDER BY k DESC LIMIT 500)) THEN 'recent' ELSE 'original' END AS part, CAST(o_totalprice AS BIGINT) % 40 AS cited_by FROM orders)
  SELECT part, count(*) AS rows, round(avg(CASE WHEN cited_by >= 20 THEN 1.0 ELSE 0.0 END), 6) AS cited_20, round(avg(CASE WHEN cited_by >= 10 THEN 1.0 ELSE 0.0 END), 6) AS cited_10, round(avg(CASE WHEN cited_by = 0 THEN 1.0 ELSE 0.0 END), 6) AS uncited, min(cited_by) AS least FROM x GROUP BY part""", base=False)
def _(s, d):
    # A cast to a whole number rounds halves to even in the SQL.
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("line"), (F.rint("o_totalprice").cast("long") % 40).alias("cited_by"))
    return serving.corpus_check(rows, 500)


@query("monthly_sample", """WITH m AS (SELECT work_id AS id, substr(pub_date, 1, 7) AS month FROM works), h AS (SELECT * FROM m WHERE md5('held:' || id) < '2'), q AS (SELECT month, greatest(0, 12 - coalesce(got, 0)) AS need FROM (SELECT DISTINCT month FROM m) LEFT JOIN (SELECT month, count(*) AS got FROM h GROUP BY month) USING (month))
  SELECT id, month, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('42:' || id), id) AS rn FROM m WHERE id NOT IN (SELECT id FROM h)) JOIN q USING (month) WHERE rn <= need""")
def _(s, d):
    m = works(s, d).select(F.col("work_id").alias("id"), F.substring("pub_date", 1, 7).alias("month"))
    held = m.filter(F.md5(F.concat(F.lit("held:"), F.col("id").cast("string"))) < "2")
    return serving.monthly_sample(m, m.select("month").distinct().withColumn("quota", F.lit(12)), held)


# -- stored vectors --------------------------------------------------------------------------------------------


@query("stored_models", "SELECT coalesce(CASE label % 3 WHEN 0 THEN 'hash-v1' WHEN 1 THEN 'm@main' END, '<null: legacy, unknown model>') AS model, count(*) AS n FROM embeddings GROUP BY 1", base=False)
def _(s, d):
    m = vectors(s, d).select(F.when(F.col("label") % 3 == 0, serving.model_label("hash")).when(F.col("label") % 3 == 1, serving.model_label("m")).alias("model"))
    return serving.stored_models(m)


@query("vector_scan", "SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings ORDER BY vec_id", base=False)
def _(s, d):
    return serving.vector_scan(vectors(s, d)).select("id", F.round(F.get("vector", 0).cast("double"), 6).alias("first"))


@query("existing_ids", "SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)", base=False)
def _(s, d):
    return serving.existing_ids(vectors(s, d), table(s, d, "documents").select(F.col("doc_id").alias("id")))


@query("search_hits", "SELECT p_partkey AS id, p_name AS title, round_even(p_retailprice / 7.0::DOUBLE, 4) AS score, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS topics, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) ELSE 0 END AS cited_by FROM part", base=False)
def _(s, d):
    p = table(s, d, "part")
    meta = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.array("p_brand")).alias("topics"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long")).alias("cited_by"))
    found = p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 7.0).alias("score"))
    return serving.hits(found, meta).withColumn("topics", F.array_join("topics", " "))


# -- assignment policies ------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _papers(s, d):
    """embeddings as papers; a third of them has no topic."""
    v = vectors(s, d)
    some = F.when(F.col("id") % 3 > 0, F.array(F.concat(F.lit("t"), F.col("label").cast("string")))).otherwise(F.array().cast("array<string>"))
    return v.select("id", "vector", some.alias("topics"), (1990 + F.col("id") % 7).cast("int").alias("pub_year"))


@query("assign_full", f"""WITH l AS (SELECT 't' || label AS t, embedding FROM embeddings WHERE vec_id % 3 > 0), px AS (SELECT t, i AS pos, round(sum(CAST(embedding[i] AS DOUBLE)), 9) AS x FROM l, range(1, 65) r(i) GROUP BY ALL), nr AS (SELECT t, sqrt(sum(x * x)) AS n FROM px GROUP BY t),
  ce AS MATERIALIZED (SELECT t, list(x / n ORDER BY pos) AS c FROM px JOIN nr USING (t) GROUP BY t), sm AS (SELECT vec_id, t, round({_DOT.format(a="e.embedding", b="ce.c")}, 6) AS sim FROM embeddings e, ce WHERE vec_id % 3 = 0),
  be AS (SELECT vec_id, t FROM sm WHERE sim >= 0.1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, t) = 1) SELECT vec_id AS id, CASE WHEN vec_id % 3 > 0 THEN 't' || label ELSE coalesce(t, '') END AS topic FROM embeddings LEFT JOIN be USING (vec_id)""", base=False)
def _(s, d):
    return serving.assign_full(_papers(s, d), 1, 0.1).select("id", F.array_join("topics", " ").alias("topic"))


@query("topic_drift")
def _(s, d):
    p = _papers(s, d)
    return serving.drift(p, serving.assign_online(p, 0.1), serving.assign_full(p, 1, 0.1))


# -- layouts and runs ------------------------------------------------------------------------------------------------


@query("disc_layout", """SELECT n_nationkey AS id, round(6.0 * sqrt((n_nationkey + 0.5) / 25) * cos(n_nationkey * (pi() * (3 - sqrt(5)))), 6) AS x, round(((n_nationkey * 7919) % 13 / 13.0::DOUBLE - 0.5) * 1.6, 6) AS y,
  round(6.0 * sqrt((n_nationkey + 0.5) / 25) * sin(n_nationkey * (pi() * (3 - sqrt(5)))), 6) AS z FROM nation""", base=False)
def _(s, d):
    return serving.disc_layout(table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("i")))


@query("spring_layout")
def _(s, d):
    t = work_topics(s, d).select("work_id", "topic").distinct()
    edges = t.withColumnRenamed("topic", "a").join(t.withColumnRenamed("topic", "b"), "work_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("papers"))
    return serving.spring_layout(edges)


@query("graph_colours", "SELECT vec_id AS id, CASE WHEN label < 3 THEN label + 20 WHEN label = 9 THEN -1 ELSE label END AS colour FROM embeddings", base=False)
def _(s, d):
    v = vectors(s, d).select("id", F.when(F.col("label") == 9, "none").otherwise(F.col("label").cast("string")).alias("cluster_id"), F.when(F.col("label") < 3, F.col("label") + 20).alias("colour"))
    return serving.ensure_colours(v).select("id", "colour")


@query("run_log", patterns_sql(max_len=2) + """, b AS (SELECT itemset FROM p WHERE window_start = 1996), a AS (SELECT itemset FROM p WHERE window_start = 1998), y AS (SELECT unnest([1996, 1997]) AS w)
  SELECT '2001-02-03' AS run_date, (SELECT count(*) FROM works WHERE pub_year IN (1996, 1997)) AS new_papers,
    (SELECT count(*) FROM (SELECT itemset FROM (SELECT itemset FROM a UNION ALL SELECT itemset FROM b) GROUP BY itemset HAVING count(*) = 1)) AS patterns_changed, (SELECT string_agg(w, ' ' ORDER BY w) FROM y) AS windows_updated""")
def _(s, d):
    p = mined(s, d, max_len=2)
    same = {"window_start": F.lit(1996)}
    new = works(s, d).filter("pub_year IN (1996, 1997)").select("work_id", F.col("pub_year").alias("window_start"))
    out = serving.run_log(p.filter("window_start = 1996"), p.filter("window_start = 1998").withColumns(same), new, "2001-02-03")
    return out.withColumn("windows_updated", F.array_join(F.col("windows_updated").cast("array<string>"), " "))


@query("alive_patterns", P + LIFE + " SELECT itemset FROM life WHERE born <= 1997 AND (died IS NULL OR died > 1997)")
def _(s, d):
    return serving.alive(mining.lifecycles(mined(s, d)), 1997).select("itemset")


@query("publications_with_rates", """WITH m AS (SELECT pub_year, substr(pub_date, 1, 7) AS month, count(*) AS papers FROM works GROUP BY ALL), r AS (SELECT DISTINCT month, 1000 + CAST(right(month, 2) AS INTEGER) AS population FROM m WHERE right(month, 2) <> '05' OR pub_year > 1998)
  SELECT CAST(pub_year AS INTEGER) AS bucket, CAST(sum(papers) AS BIGINT) AS papers, CASE WHEN count(*) = count(population) THEN CAST(sum(population) AS BIGINT) END AS estimate FROM m LEFT JOIN r USING (month) GROUP BY pub_year""")
def _(s, d):
    w = works(s, d)
    month = F.substring("pub_date", 1, 7)
    rates = w.filter("pub_month <> 5 OR pub_year > 1998").select(month.alias("month"), (1000 + F.col("pub_month")).cast("long").alias("population")).distinct()
    return trends.publications(w, rates)
