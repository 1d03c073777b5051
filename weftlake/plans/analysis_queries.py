"""Queries of the graph, vector, text, evaluation and sampling operators, with their SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftlake.operators import evaluation, graph, relational, sampling, text, vectors
from weftlake.plans.catalog import query
from weftlake.plans.relational_queries import _edges_sql
from weftlake.session import cut
from weftlake.sources.adapters import SQL, authors, table, work_authors, work_countries, work_parts, work_topics, works
from weftlake.sources.adapters import vectors as embedded

# -- graphs: parts as authors, the work's year as the year -------------------------------------

SPLIT, HORIZON = 1997, 2
_FC = """WITH pa AS (SELECT DISTINCT l_orderkey AS work_id, l_partkey AS author_id FROM lineitem), sz AS (SELECT work_id FROM pa GROUP BY work_id HAVING count(*) BETWEEN 2 AND 25),
  fc AS MATERIALIZED (SELECT x.author_id AS a, y.author_id AS b, min(pub_year) AS first_year FROM pa x JOIN pa y USING (work_id) JOIN works USING (work_id) WHERE x.author_id < y.author_id AND work_id IN (SELECT work_id FROM sz) GROUP BY ALL)"""
_SPLIT = _FC + f""", tr AS MATERIALIZED (SELECT a, b FROM fc WHERE first_year <= {SPLIT}), nb AS MATERIALIZED (SELECT a AS v, b AS w FROM tr UNION ALL SELECT b, a FROM tr), dg AS MATERIALIZED (SELECT v, count(*) AS degree FROM nb GROUP BY v),
  ps AS MATERIALIZED (SELECT a, b FROM fc WHERE first_year > {SPLIT} AND first_year <= {SPLIT + HORIZON} AND a IN (SELECT v FROM dg WHERE degree >= 2) AND b IN (SELECT v FROM dg WHERE degree >= 2))"""
_HEUR = _SPLIT + """, cm AS (SELECT ps.a, ps.b, count(*) AS cn, sum(CASE WHEN d.degree > 1 THEN 1.0::DOUBLE / ln(d.degree) ELSE 0.0 END) AS aa FROM ps JOIN nb x ON x.v = ps.a JOIN nb y ON y.v = ps.b AND y.w = x.w JOIN dg d ON d.v = x.w GROUP BY ALL),
  tp AS MATERIALIZED (SELECT author_id, list(DISTINCT topic) AS t FROM pa JOIN wt USING (work_id) WHERE work_id IN (SELECT work_id FROM works WHERE pub_year <= %d) GROUP BY author_id),
  he AS MATERIALIZED (SELECT ps.a, ps.b, coalesce(cn, 0) AS cn, round(CAST(coalesce(cn, 0) AS DOUBLE) / (da.degree + db.degree - coalesce(cn, 0)), 6) AS jaccard, round(coalesce(aa, 0.0), 6) AS adamic_adar, da.degree * db.degree AS pref_attach,
    round(coalesce(CAST(len(list_intersect(ta.t, tb.t)) AS DOUBLE) / len(list_distinct(list_concat(ta.t, tb.t))), 0.0), 6) AS topic_jaccard
  FROM ps LEFT JOIN cm USING (a, b) JOIN dg da ON da.v = ps.a JOIN dg db ON db.v = ps.b LEFT JOIN tp ta ON ta.author_id = ps.a LEFT JOIN tp tb ON tb.author_id = ps.b)""" % SPLIT


def _first(s, d):
    """Written once: splits, degrees and pairs all read it."""
    return cut(graph.first_collaborations(works(s, d), work_parts(s, d)), "first_years")


@query("first_collab_year", _FC + " SELECT * FROM fc")
def _(s, d):
    return graph.first_collaborations(works(s, d), work_parts(s, d))


@query("author_topics", _FC + f" SELECT author_id, string_agg(DISTINCT topic, ' | ' ORDER BY topic) AS topics FROM pa JOIN wt USING (work_id) JOIN works USING (work_id) WHERE pub_year <= {SPLIT} GROUP BY author_id")
def _(s, d):
    t = graph.author_topics(works(s, d), work_parts(s, d), work_topics(s, d), SPLIT)
    return t.select("author_id", F.array_join("topics", " | ").alias("topics"))


@query("temporal_split_pos", _SPLIT + " SELECT a, b FROM ps")
def _(s, d):
    return graph.temporal_split(_first(s, d), SPLIT, HORIZON)[1]


def _heuristics(s, d):
    train, pos = graph.temporal_split(_first(s, d), SPLIT, HORIZON)
    return graph.link_heuristics(train, pos, graph.author_topics(works(s, d), work_parts(s, d), work_topics(s, d), SPLIT))


@query("link_heuristics", _HEUR + " SELECT * FROM he")
def _(s, d):
    return _heuristics(s, d)


@query("link_score", _HEUR + " SELECT a, b, round(2.0 * topic_jaccard + 0.5 * cn + 0.1 * ln(1 + pref_attach), 6) AS score FROM he ORDER BY score DESC, a, b LIMIT 1000")
def _(s, d):
    return graph.top_predictions(graph.link_score(_heuristics(s, d)).select("a", "b", "score"))


@query("temporal_split_neg")
def _(s, d):
    return graph.negative_pairs(_first(s, d), SPLIT, 500)


@query("auc_rank", """WITH x AS (SELECT l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem), b AS (SELECT score, sum(label) AS p, count(*) AS c FROM x GROUP BY score),
  r AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS seen FROM b WINDOW w AS (ORDER BY score DESC))
  SELECT round(sum((c - p) * (tp - p + p / 2.0::DOUBLE)) / (sum(p) * sum(c - p)), 6) AS auc, round(sum(p * (tp / seen)) / sum(p), 6) AS avg_precision FROM r""", base=False)
def _(s, d):
    x = table(s, d, "lineitem").select("l_discount", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    return graph.auc_rank(x, "l_discount", "label")


def _edges(s, d):
    """All pairs with two common papers, written once: each of these operators reads the graph more than once."""
    return cut(relational.coauthor_edges(works(s, d), work_authors(s, d), 1995, 2001, 2, None), "graph")


_E = f"WITH e AS MATERIALIZED ({_edges_sql('', 2, None)})"
_CC = """, RC(v, c) AS (SELECT v, v FROM (SELECT a AS v FROM e UNION SELECT b FROM e) UNION SELECT x.w, RC.c FROM RC JOIN (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e) x ON x.v = RC.v),
  cc AS (SELECT v, min(c) AS component FROM RC GROUP BY v)"""


def _recursive(sql: str) -> str:
    return (SQL.rstrip() + ", " + sql[5:]).replace("WITH ", "WITH RECURSIVE ", 1)


@query("components", _recursive(_E + _CC + " SELECT v, component FROM cc"), base=False)
def _(s, d):
    return graph.components(_edges(s, d))


@query("largest_component", _recursive(_E + _CC + """, lb AS (SELECT e.*, component FROM e JOIN cc ON cc.v = e.a)
  SELECT a, b, papers FROM lb WHERE component = (SELECT component FROM lb GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"""), base=False)
def _(s, d):
    return graph.largest_component(_edges(s, d))


@query("network_degree", _E + """, u AS (SELECT a AS author, papers FROM e UNION ALL SELECT b, papers FROM e)
  SELECT author, count(*) AS degree, CAST(sum(papers) AS BIGINT) AS strength, (SELECT max(country) FROM wa WHERE wa.author = u.author) AS country FROM u GROUP BY author""")
def _(s, d):
    return graph.network_degree(_edges(s, d), authors(s, d))


@query("bfs_distance", _recursive(_E + """, q(v, hops) AS (SELECT (SELECT min(a) FROM e), 0 UNION SELECT x.w, q.hops + 1 FROM q JOIN (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e) x ON x.v = q.v WHERE q.hops < 6)
  SELECT v, min(hops) AS hops FROM q GROUP BY v"""), base=False)
def _(s, d):
    e = _edges(s, d)
    return graph.bfs_distance(e, e.agg(F.min("a")).first()[0], 6)


@query("graph_neighbours", _E + " SELECT DISTINCT CASE WHEN a = (SELECT min(a) FROM e) THEN b ELSE a END AS neighbour FROM e WHERE (SELECT min(a) FROM e) IN (a, b)")
def _(s, d):
    e = _edges(s, d)
    return graph.neighbours(e, e.agg(F.min("a")).first()[0])


@query("random_walk_vectors")
def _(s, d):
    v = graph.node_vectors(graph.random_walks(_edges(s, d)))
    return v.select("v", vector_to_array("vector").alias("vector"))


@query("predicted_pairs", _HEUR + """, sc AS (SELECT a, b, round(2.0 * topic_jaccard + 0.5 * cn + 0.1 * ln(1 + pref_attach), 6) AS score FROM he),
  nm AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS author, p_brand AS country FROM part)
  SELECT x.author AS author_a, x.country AS country_a, y.author AS author_b, y.country AS country_b, score FROM sc JOIN nm x ON x.id = a JOIN nm y ON y.id = b WHERE x.country = 'Brand#3' OR y.country = 'Brand#3' ORDER BY score DESC, author_a, author_b LIMIT 300""")
def _(s, d):
    names = table(s, d, "part").select(F.col("p_partkey").alias("author_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("author"), F.col("p_brand").alias("country"))
    return graph.predicted_pairs(graph.link_score(_heuristics(s, d)).select("a", "b", "score"), names, "Brand#3")


def _metrics_sql(model: str, score: str) -> str:
    return f"""SELECT '{model}' AS model, round(sum((c - p) * (tp - p + p / 2.0::DOUBLE)) / (sum(p) * sum(c - p)), 6) AS auc, round(sum(p * (tp / seen)) / sum(p), 6) AS ap
  FROM (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS seen FROM (SELECT {score} AS score, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p, count(*) AS c FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"""


@query("model_metrics", _metrics_sql("discount", "l_discount") + " UNION ALL " + _metrics_sql("price", "l_extendedprice"), base=False)
def _(s, d):
    x = table(s, d, "lineitem").select("l_discount", "l_extendedprice", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    both = [x.select(F.lit(m).alias("model"), F.col(c).alias("score"), "label") for m, c in (("discount", "l_discount"), ("price", "l_extendedprice"))]
    return graph.model_metrics(both[0].union(both[1]))


# -- vectors --------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_D = _DOT.format(a="q.embedding", b="r.embedding")


@query("vector_topk", f"""SELECT q.vec_id AS query_id, r.vec_id AS id, round({_D}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_D}, 9) DESC, r.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""", base=False)
def _(s, d):
    e = embedded(s, d)
    return vectors.top_k(e.filter("id % 100 = 0"), e, 10).withColumn("score", F.round("score", 6))


@query("related_items", f"""SELECT q.vec_id AS query_id, r.vec_id AS id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_D}, 9) DESC, r.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id QUALIFY rank <= 5""", base=False)
def _(s, d):
    e = embedded(s, d)
    return vectors.top_k(e.filter("id % 100 = 0"), e, 5, drop_self=True).select("query_id", "id", "rank")


@query("vector_search", f"SELECT r.vec_id AS id, round({_D}, 6) AS score FROM embeddings r, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE r.label IN (1, 2, 3) AND round({_D}, 6) >= -0.2 ORDER BY score DESC, id LIMIT 20", base=False)
def _(s, d):
    e = embedded(s, d)
    q = e.filter("id = 0").first()["vector"]
    return vectors.search(q, e, 20, -0.2, F.col("label").isin(1, 2, 3)).select("id", "score")


_CENT = """WITH px AS (SELECT label, i AS pos, round(sum(CAST(embedding[i] AS DOUBLE)), 9) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL), nr AS (SELECT label, sqrt(sum(x * x)) AS n FROM px GROUP BY label),
  ce AS MATERIALIZED (SELECT label, list(x / n ORDER BY pos) AS c, count(*) AS z FROM px JOIN nr USING (label) GROUP BY label), cn AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)"""


@query("topic_centroids", _CENT + " SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(c[pos], 6) AS x FROM ce, range(1, 65) r(pos)", base=False)
def _(s, d):
    return vectors.centroids(embedded(s, d)).select("label", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


_SIM = "round(" + _DOT.format(a="e.embedding", b="ce.c") + ", 6)"


@query("nearest_centroid", _CENT + f""", s AS (SELECT vec_id AS id, ce.label AS topic, {_SIM} AS sim FROM embeddings e, ce)
  SELECT vec_id AS id, coalesce(t, -1) AS cluster FROM embeddings LEFT JOIN (SELECT id, topic AS t FROM s WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, topic) = 1) ON id = vec_id""", base=False)
def _(s, d):
    e = embedded(s, d)
    return vectors.nearest_or_noise(e, vectors.centroids(e), 0.3)


@query("assign_topics", _CENT + f""", s AS (SELECT vec_id AS id, ce.label AS topic, {_SIM} AS sim FROM embeddings e, ce)
  SELECT id, topic, sim, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, topic) AS INTEGER) AS rank FROM s WHERE sim >= 0.05 QUALIFY rank <= 3""", base=False)
def _(s, d):
    e = embedded(s, d)
    return vectors.nearest(e, vectors.centroids(e), 3, 0.05)


@query("knn_links", f"""WITH k AS (SELECT q.vec_id AS a, r.vec_id AS b, round({_D}, 9) AS s FROM embeddings q, embeddings r WHERE q.vec_id <> r.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, r.vec_id) <= 2)
  SELECT least(a, b) AS a, greatest(a, b) AS b, max(round(s, 6)) AS weight FROM k WHERE s > 0 GROUP BY 1, 2 ORDER BY weight DESC, 1, 2 LIMIT 200""", base=False)
def _(s, d):
    return vectors.knn_links(embedded(s, d))


_PAIRS = _CENT + f""", pr AS (SELECT x.label AS a, y.label AS b, round({_DOT.format(a="x.c", b="y.c")}, 6) AS sim, nx.n AS na, ny.n AS nb FROM ce x JOIN ce y ON x.label <> y.label JOIN cn nx ON nx.label = x.label JOIN cn ny ON ny.label = y.label)"""


@query("semantic_gaps", _PAIRS + """, co AS (SELECT 0 AS a, 1 AS b, 5 AS co UNION ALL SELECT 2, 3, 1)
  SELECT a, b, sim, coalesce(co, 0) AS co, round(sim * (1 - coalesce(co, 0) / least(na, nb)) * (0.5 + 0.5 * (least(na, nb) / greatest(na, nb))), 6) AS score FROM pr LEFT JOIN co USING (a, b)
  WHERE a < b AND na >= 20 AND nb >= 20 AND sim >= 0 AND coalesce(co, 0) / least(na, nb) <= 0.2 ORDER BY score DESC, a, b LIMIT 10""", base=False)
def _(s, d):
    e = embedded(s, d)
    counts = e.groupBy("label").agg(F.count("*").alias("n"))
    together = s.createDataFrame([(0, 1, 5), (2, 3, 1)], "a int, b int, co int")
    return vectors.semantic_gaps(vectors.centroids(e), counts, together, min_sim=0.0, min_each=20)


@query("density_gaps", _PAIRS + """, nr2 AS (SELECT * FROM pr WHERE sim >= -1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 3), g AS (SELECT a, na, avg(sim) AS s, avg(nb) AS demand FROM nr2 GROUP BY ALL)
  SELECT a AS topic, round(demand, 6) AS demand, round(s * (demand - na) / demand, 6) AS score FROM g WHERE demand >= 10 AND na <= 1.2 * demand ORDER BY score DESC, topic LIMIT 10""", base=False)
def _(s, d):
    e = embedded(s, d)
    return vectors.density_gaps(vectors.centroids(e), e.groupBy("label").agg(F.count("*").alias("n")), -1.0, 3, 10, 1.2)


@query("cluster_summary", "SELECT label, count(*) AS size, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y, round(avg(CAST(embedding[3] AS DOUBLE)), 6) AS z FROM embeddings GROUP BY label", base=False)
def _(s, d):
    return vectors.cluster_summary(embedded(s, d))


@query("ctfidf_labels", """WITH x AS (SELECT c.country AS cluster, t.topic_id AS term FROM wc c JOIN wt t USING (work_id)), tf AS (SELECT cluster, term, count(*) AS tf FROM x GROUP BY ALL), sz AS (SELECT cluster, sum(tf) AS size FROM tf GROUP BY cluster),
  tt AS (SELECT term, sum(tf) AS total FROM tf GROUP BY term), sc AS (SELECT cluster, term, round(tf / size * ln(1 + (SELECT avg(size) FROM sz) / total), 6) AS score FROM tf JOIN sz USING (cluster) JOIN tt USING (term))
  SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INTEGER) AS rank FROM sc QUALIFY rank <= 3""")
def _(s, d):
    terms = work_countries(s, d).join(work_topics(s, d), "work_id").select(F.col("country").alias("cluster"), F.col("topic_id").alias("term"))
    return vectors.ctfidf(terms, 3)


@query("layout_changed", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 7 = 0", base=False)
def _(s, d):
    e = embedded(s, d)
    placed = e.filter("id % 3 <> 0").withColumn("signature", F.when(F.col("id") % 7 == 0, F.lit("old")).otherwise(vectors.signature("vector")))
    return vectors.changed(e, placed).select("id")


@query("hash_embed", rf"""WITH tk AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '[^\p{{L}}\p{{N}}]', '', 'g') AS token FROM conversations WHERE text IS NOT NULL),
  c AS (SELECT id, CAST(('0x' || right(md5(token), 4))::INTEGER % 512 AS INTEGER) AS pos, count(*) AS c FROM tk WHERE token <> '' GROUP BY ALL), n AS (SELECT id, sqrt(sum(c * c)) AS n FROM c GROUP BY id)
  SELECT id, pos, round(c / n, 6) AS value FROM c JOIN n USING (id)""", base=False)
def _(s, d):
    return vectors.hash_embed(table(s, d, "conversations").filter("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), 512)


_COLOURS = "sc AS (SELECT label AS colour, round(label / 9.0::DOUBLE, 6) AS score FROM (SELECT DISTINCT label FROM embeddings) WHERE label % 2 = 0)"


@query("graph_scores", "WITH " + _COLOURS + " SELECT vec_id AS id, label AS colour, coalesce(score, 0.0) AS emerging_score FROM embeddings LEFT JOIN sc ON label = colour", base=False)
def _(s, d):
    e = embedded(s, d).select("id", F.col("label").alias("colour"))
    scores = e.select("colour").distinct().filter("colour % 2 = 0").withColumn("score", F.round(F.col("colour") / 9.0, 6))
    return vectors.attach_scores(e, scores)


_MODEL = "m AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' END AS model, vec_id AS n FROM embeddings)"


def _labelled(s, d):
    return embedded(s, d).select("id", F.when(F.col("label") % 3 == 0, "new").when(F.col("label") % 3 == 1, "old").alias("model"))


@query("one_model", "WITH " + _MODEL + " SELECT id, model FROM m WHERE model IS NULL OR model = 'new'", base=False)
def _(s, d):
    return vectors.one_model(_labelled(s, d), "new")


@query("to_index", "WITH " + _MODEL + """, h AS (SELECT id FROM m WHERE model IS NULL OR model = 'new')
  SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND doc_id NOT IN (SELECT id FROM h) ORDER BY doc_id LIMIT greatest(0, 5000 - (SELECT count(*) FROM h))""", base=False)
def _(s, d):
    return vectors.to_index(_docs(s, d), vectors.one_model(_labelled(s, d), "new"), "new", 5000)


@query("public_rows", """SELECT vec_id AS id, label - 1 AS cluster, CASE WHEN label >= 1 THEN CASE WHEN label <= 4 THEN 'topic ' || (label - 1) ELSE 'Cluster ' || (label - 1) END END AS label,
  CASE WHEN label < 1 THEN -1 WHEN label <= 3 THEN label + 9 ELSE label - 1 END AS colour FROM embeddings""", base=False)
def _(s, d):
    layout = embedded(s, d).select("id", (F.col("label") - 1).alias("cluster"))
    named = s.createDataFrame([(i, f"topic {i}", i + 10 if i < 3 else None) for i in range(4)], "cluster int, label string, colour int")
    return vectors.public_rows(layout, named)


@query("kmeans")
def _(s, d):
    return vectors.kmeans(embedded(s, d), 8)


@query("pca3")
def _(s, d):
    return vectors.pca3(embedded(s, d))


# -- text --------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP)
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOK = (
    "list_concat(list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN (" + _STOP + ") AND NOT regexp_full_match(w, '[" + text.UNSEGMENTED + "]+')), "
    "flatten(list_transform(regexp_extract_all({t}, '[" + text.UNSEGMENTED + "]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"
)
_OVER = "regexp_matches({t}, '" + text.OVERRIDE.replace("{", "{{").replace("}", "}}") + "')"


def _sentences_sql(t: str) -> str:
    kept = "|".join(text.ABBREVIATIONS)
    held = rf"regexp_replace(regexp_replace({t}, '(?i)\b({kept})\.', '\1' || chr(1), 'g'), '(?i)\b({text.BEFORE_NUMBER})\.({_BLANK}+\d)', '\1' || chr(1) || '\2', 'g')"
    cut = rf"regexp_replace(regexp_replace({held}, '([.!?]){_BLANK}+([{text.OPENING}])', '\1' || chr(2) || '\2', 'g'), '([{text.FULL_STOPS}])', '\1' || chr(2), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda s: regexp_replace(replace(s, chr(1), '.'), '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda s: length(s) > 3)"


def _docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("token_counts", f"""WITH t AS (SELECT doc_id, unnest({_TOK.format(t="text")}) AS token FROM documents WHERE text IS NOT NULL)
  SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY token ORDER BY n DESC, token LIMIT 100""", base=False)
def _(s, d):
    return text.token_counts(_docs(s, d), 100)


_SENTENCES = f"""WITH se AS MATERIALIZED (SELECT doc_id AS id, coalesce(text, '') AS text, coalesce(substr(text, 1, 40), '') AS title, {_sentences_sql("coalesce(text, '')")} AS every FROM documents)"""


@query("sentences", _SENTENCES + " SELECT id, unnest(range(len(every)))::INTEGER AS pos, unnest(every) AS sentence FROM se", base=False)
def _(s, d):
    return _docs(s, d).select("id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


_ASKED = ["license", "this", "work", "licensed", "token", "call"]


@query("best_sentences", _SENTENCES + f""", x AS (SELECT id, len(every) AS n, unnest(range(len(every)))::INTEGER AS pos, unnest(every) AS sentence FROM se), t AS MATERIALIZED (SELECT *, {_TOK.format(t="sentence")} AS t FROM x),
  h AS MATERIALIZED (SELECT id, n, pos, sentence, len(t) AS l, unnest(list_distinct(list_filter(t, lambda w: w IN ({", ".join(f"'{w}'" for w in _ASKED)})))) AS term FROM t), df AS (SELECT id, term, count(*) AS df FROM h GROUP BY ALL),
  sc AS (SELECT id, pos, sentence, round(sum(ln(1 + n / df)) / sqrt(first(l)), 6) AS score FROM h JOIN df USING (id, term) GROUP BY id, pos, sentence)
  SELECT id, pos, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INTEGER) AS rank, CAST(length(sentence) AS INTEGER) AS chars FROM sc QUALIFY rank <= 3""", base=False)
def _(s, d):
    return text.best_sentences(_docs(s, d), _ASKED, 3)


_SUMMARIES = _SENTENCES + f""", k AS (SELECT *, list_filter(every, lambda x: NOT {_OVER.format(t="x")}) AS kept FROM se), ev AS MATERIALIZED (SELECT id, text, title, CASE WHEN len(kept) > 0 THEN kept ELSE every END AS s FROM k),
  pt AS MATERIALIZED (SELECT id, len(s) AS n, unnest(range(len(s)))::INTEGER AS pos, unnest(s) AS sentence FROM ev),
  tf AS MATERIALIZED (SELECT id, token, sum(c) AS c FROM (SELECT id, unnest({_TOK.format(t="text")}) AS token, 1 AS c FROM ev UNION ALL SELECT id, unnest({_TOK.format(t="title")}), 3 FROM ev) GROUP BY ALL),
  tk AS (SELECT id, pos, unnest({_TOK.format(t="sentence")}) AS token FROM pt), sm AS (SELECT id, pos, CAST(sum(coalesce(c, 0)) AS DOUBLE) / sqrt(count(*)) AS x FROM tk LEFT JOIN tf USING (id, token) GROUP BY id, pos),
  rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(coalesce(x, 0.0) * CASE WHEN pos = 0 THEN 1.15::DOUBLE ELSE 1.0 END, 9) DESC, pos) AS r FROM pt LEFT JOIN sm USING (id, pos)),
  su AS (SELECT id, coalesce(y, '') AS summary FROM ev LEFT JOIN (SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS y FROM rk WHERE n <= 3 OR r <= 3 GROUP BY id) USING (id))"""


def _summaries(s, d):
    return text.summarize(_docs(s, d).withColumn("title", F.substring("text", 1, 40)))


@query("summaries", _SUMMARIES + " SELECT id, summary FROM su", base=False)
def _(s, d):
    return _summaries(s, d)


@query("one_line_summaries", _SUMMARIES + f" SELECT id, coalesce(({_sentences_sql('summary')})[1], summary) AS line FROM su WHERE summary <> ''", base=False)
def _(s, d):
    return _summaries(s, d).select("id", text.one_line("summary").alias("line")).filter("line IS NOT NULL")


_CONTENT = "list_distinct(list_filter({t}, lambda w: NOT regexp_full_match(w, '\\p{{Nd}}+')))"


@query("grounded_overlap", f"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nxt FROM conversations),
  e AS (SELECT conv_id, turn, nxt, text, list_filter({_sentences_sql("text")}, lambda x: NOT {_OVER.format(t="x")}) AS kept FROM c WHERE nxt IS NOT NULL AND text IS NOT NULL),
  b AS (SELECT *, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE text END AS body FROM e),
  x AS (SELECT conv_id, turn, nxt, {_CONTENT.format(t=_TOK.format(t="nxt"))} AS w, {_CONTENT.format(t=_TOK.format(t="body"))} AS src, regexp_extract_all(nxt, '[0-9]+(?:\\.[0-9]+)?') AS na, regexp_extract_all(body, '[0-9]+(?:\\.[0-9]+)?') AS ns FROM b)
  SELECT conv_id, turn, NOT {_OVER.format(t="nxt")} AND len(w) > 0 AND len(src) > 0 AND len(list_intersect(w, src)) >= 0.6 * len(w) AND len(list_filter(na, lambda y: NOT list_contains(ns, y))) = 0 AS grounded FROM x""", base=False)
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    c = table(s, d, "conversations").withColumn("nxt", F.lead("text").over(w)).filter("nxt IS NOT NULL AND text IS NOT NULL")
    return c.select("conv_id", "turn", text.grounded(F.col("nxt"), F.col("text")).alias("grounded"))


# -- evaluation: sources are queries, document ids in hash order are rankings, labels are grades ------

_RK = """WITH rk AS (SELECT source AS query_id, doc_id AS work_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 50),
  qr AS (SELECT source AS query_id, doc_id AS work_id, max(quality * 2 + toxic) AS grade FROM documents JOIN labels USING (doc_id) GROUP BY ALL), gr AS (SELECT rk.*, coalesce(grade, 0) AS grade FROM rk LEFT JOIN qr USING (query_id, work_id)),
  nd AS (SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, work_id) AS r FROM qr WHERE grade > 0) WHERE r <= 10 GROUP BY query_id)
    LEFT JOIN (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM gr WHERE rank <= 10 GROUP BY query_id) USING (query_id)),
  re AS (SELECT query_id, round(coalesce(f, 0) / n, 6) AS recall FROM (SELECT query_id, count(*) AS n FROM qr WHERE grade > 0 GROUP BY query_id) LEFT JOIN (SELECT query_id, count(*) AS f FROM gr WHERE rank <= 20 AND grade > 0 GROUP BY query_id) USING (query_id)),
  rr AS (SELECT query_id, coalesce(round(1.0::DOUBLE / r, 6), 0.0) AS rr FROM (SELECT DISTINCT query_id FROM qr WHERE grade > 0) LEFT JOIN (SELECT query_id, min(rank) AS r FROM gr WHERE grade > 0 GROUP BY query_id) USING (query_id))"""


def _rankings(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("work_id"))
    w = Window.partitionBy("query_id").orderBy(F.md5(F.col("work_id").cast("string")), "work_id")
    qrels = docs.join(table(s, d, "labels").withColumnRenamed("doc_id", "work_id"), "work_id").withColumn("relevance", F.col("quality") * 2 + F.col("toxic"))
    return docs.withColumn("rank", F.row_number().over(w)).filter("rank <= 50"), qrels


@query("ndcg_at_10", _RK + " SELECT * FROM nd", base=False)
def _(s, d):
    return evaluation.ndcg(*_rankings(s, d))


@query("recall_at_20", _RK + " SELECT * FROM re", base=False)
def _(s, d):
    return evaluation.recall(*_rankings(s, d))


@query("mrr", _RK + " SELECT * FROM rr", base=False)
def _(s, d):
    return evaluation.reciprocal_rank(*_rankings(s, d))


@query("mean_scores", _RK + " SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr FROM nd JOIN re USING (query_id) JOIN rr USING (query_id)", base=False)
def _(s, d):
    return evaluation.mean_scores(*_rankings(s, d))


@query("grade_relevance", """SELECT p_partkey AS id, CASE WHEN p_partkey IN (1, 2, 3) OR p_brand = 'Brand#2' THEN 2 WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red') THEN 1 ELSE 0 END AS grade FROM part""", base=False)
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("topics"), F.col("p_name").alias("title"))
    return evaluation.grade_relevance(p, ["1", "2", "3"], ["Brand#2"], ["ring", "red"])


# -- sampling ----------------------------------------------------------------------------------------

_MS = "WITH mn AS (SELECT substr(pub_date, 1, 7) AS month, count(*) AS existing FROM works GROUP BY 1)"


@query("month_spine", "SELECT strftime(m, '%Y-%m') AS month, strftime(m, '%Y-%m-%d') AS first_day, strftime(last_day(m), '%Y-%m-%d') AS last_day FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS m)", base=False)
def _(s, d):
    return sampling.month_spine(s, "1995-01", "2001-08")


@query("distribute_total", """WITH w AS (SELECT country, count(*) AS weight FROM wc GROUP BY country), x AS (SELECT *, round(weight * 997.0::DOUBLE / sum(weight) OVER (), 9) AS x FROM w), b AS (SELECT *, floor(x) AS base, x - floor(x) AS rem FROM x)
  SELECT country, weight, CAST(base + CASE WHEN row_number() OVER (ORDER BY rem DESC, country) <= 997 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM b""")
def _(s, d):
    return sampling.distribute(work_countries(s, d).groupBy("country").agg(F.count("*").alias("weight")), "country", "weight", 997)


def _waterfill_sql(target: int) -> str:
    return _MS + f""", lv AS (SELECT max(l) AS l FROM range(0, (SELECT max(existing) FROM mn) + {target} + 1) r(l) WHERE (SELECT sum(greatest(0, l - existing)) FROM mn) <= {target}),
  q AS (SELECT month, existing, greatest(0, l - existing) AS q, row_number() OVER (ORDER BY existing, month) AS rn FROM mn, lv)
  SELECT month, existing, CAST(q + CASE WHEN rn <= {target} - (SELECT sum(q) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q"""


@query("waterfill_quotas", _waterfill_sql(777))
def _(s, d):
    m = works(s, d).groupBy(F.substring("pub_date", 1, 7).alias("month")).agg(F.count("*").alias("existing"))
    return sampling.waterfill(m, 777)


_QUOTA = """WITH sz AS (SELECT country AS cluster, count(*) AS size FROM wc GROUP BY country), g AS (SELECT *, least(size, 20) AS want FROM sz),
  g2 AS (SELECT *, greatest(0, least(want, 600 - coalesce(sum(want) OVER (ORDER BY size DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS got FROM g),
  g3 AS (SELECT *, size - got AS rest, greatest(0, least(600 - sum(got) OVER (), sum(size - got) OVER ())) AS free FROM g2), g4 AS (SELECT *, coalesce(round(rest * free * 1.0::DOUBLE / nullif(sum(rest) OVER (), 0), 9), 0.0) AS x FROM g3),
  g5 AS (SELECT *, floor(x) AS base, x - floor(x) AS rem FROM g4), quotas AS (SELECT cluster, size, CAST(got + base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cluster) <= free - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g5)"""


def _quotas(s, d):
    return sampling.stratified_quotas(work_countries(s, d).groupBy(F.col("country").alias("cluster")).agg(F.count("*").alias("size")), 600, 20)


@query("stratified_quotas", _QUOTA + " SELECT * FROM quotas")
def _(s, d):
    return _quotas(s, d)


@query("stratified_sample", _QUOTA + """, r AS (SELECT work_id AS id, country AS cluster, CAST(row_number() OVER (PARTITION BY country ORDER BY cited_by DESC, pub_year DESC, md5('0:' || work_id), work_id) AS INTEGER) AS rn FROM wc JOIN works USING (work_id))
  SELECT id, cluster, rn FROM r JOIN quotas USING (cluster) WHERE rn <= quota""")
def _(s, d):
    rows = work_countries(s, d).join(works(s, d), "work_id").select(F.col("work_id").alias("id"), F.col("country").alias("cluster"), F.col("cited_by").alias("support"), F.col("pub_year").alias("year"))
    return sampling.stratified_sample(rows, _quotas(s, d))


def _kept_sql() -> str:
    """Of each country's authors a floor of one and a share of 40, by number of papers."""
    return _QUOTA.replace("FROM wc GROUP BY country", "FROM (SELECT DISTINCT author, country FROM wa) GROUP BY country").replace("least(size, 20)", "least(size, 1)").replace("600 ", "40 ")


@query("closed_links", _kept_sql() + """, r AS (SELECT author AS id, country AS cluster, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, md5('0:' || author), author) AS rn FROM wa GROUP BY author, country),
  kp AS MATERIALIZED (SELECT id FROM r JOIN quotas USING (cluster) WHERE rn <= quota)""" + _E.replace("WITH ", ", ", 1) + " SELECT * FROM e WHERE a IN (SELECT id FROM kp) AND b IN (SELECT id FROM kp)")
def _(s, d):
    rows = work_authors(s, d).groupBy(F.col("author").alias("id"), F.col("country").alias("cluster")).agg(F.count("*").alias("support")).withColumn("year", F.lit(0))
    quotas = sampling.stratified_quotas(rows.groupBy("cluster").agg(F.count("*").alias("size")), 40, 1)
    return sampling.closed_links(_edges(s, d), sampling.stratified_sample(rows, quotas))
