"""Hand-checked examples for countries, trends, graphs, vectors, text, sampling, sources and streams."""

import hashlib
import json
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlake.functions import scalar
from weftlake.operators import countries, evaluation, graph, sampling, text, trends, vectors
from weftlake.sources import corpus
from weftlake.streaming import incremental


def test_pair_weights_sum(spark):
    wc = spark.createDataFrame([(1, c) for c in "ABCD"] + [(2, "A")], "work_id long, country string")
    total = lambda mode: countries.collaborations(wc, mode).agg(F.sum("weight")).first()[0]
    assert abs(total("fractional") - 1) < 1e-5 and abs(total("per_country") - 1.5) < 1e-6 and total("full") == 6


def test_clean_countries(spark):
    rows = spark.createDataFrame([([],), (["\t", None, " no "],), (["is", "fi ", "IS", "se", "Fi"],)], "c array<string>")
    assert [r[0] for r in rows.select(countries.clean_countries("c")).collect()] == [[], ["NO"], ["IS", "FI", "SE"]]


WINDOW = ("2031-01-01", "2031-09-12", "2030-01-01", "2030-09-12")
WINDOW_SCHEMA = "cur_start string, cur_end string, prev_start string, prev_end string"


def test_shares_and_their_change(spark):
    # 31 of 300 and 47 of 700: the change is that of the percents as shown. Later and earlier dates do not count.
    counts = spark.createDataFrame([("N", "2031-09-12", 31), ("N", "2030-01-01", 47), ("N", "2031-09-13", 900), ("S", "2031-02-02", 29), ("S", "2030-02-02", 80)], "country string, pub_date string, papers long")
    totals = spark.createDataFrame([("2031-03-01", 300), ("2030-03-01", 700), ("2029-12-31", 5)], "pub_date string, papers long")
    win = spark.createDataFrame([WINDOW], WINDOW_SCHEMA)
    r = {x["country"]: x for x in countries.country_share(counts, totals, win).collect()}
    assert (r["N"]["share_pct"], r["N"]["prev_share_pct"], r["N"]["share_change_pp"], r["N"]["reason"]) == (10.33, 6.71, 3.62, None)
    assert (r["S"]["share_pct"], r["S"]["share_change_pp"], r["S"]["reason"]) == (None, None, "too_few_papers")
    hidden = countries.country_share(counts, totals, win, partial_years=(2030,)).collect()
    assert {x["reason"] for x in hidden} == {"partial_year"} and all(x["share_pct"] is None for x in hidden)


def test_growth_window_leap_day(spark):
    w = spark.createDataFrame([("2028-02-29",), ("2027-11-30",)], "pub_date string")
    assert countries.growth_window(w).first()["prev_end"] == "2027-02-28"


def test_growth_and_its_reasons(spark):
    win = spark.createDataFrame([WINDOW], WINDOW_SCHEMA)
    rows = [("N", "2031-04-04", 33), ("N", "2030-04-04", 44), ("S", "2031-04-04", 30), ("S", "2030-10-01", 70), ("S", "2030-04-04", 12)]
    c = spark.createDataFrame(rows, "country string, pub_date string, papers long")
    r = {x["country"]: x for x in countries.country_growth(c, win).collect()}
    assert (r["N"]["growth_pct"], r["N"]["reason"]) == (-25.0, None)
    assert (r["S"]["growth_pct"], r["S"]["reason"]) == (None, "too_few_papers")
    assert {x["reason"] for x in countries.country_growth(c, win, partial_years=(2031,)).collect()} == {"partial_year"}
    assert {x["reason"] for x in countries.country_growth(c, win, partial_years=(2029,)).collect()} == {None, "too_few_papers"}


def test_country_dimension(spark):
    known = spark.createDataFrame([("NO", "Norway", "NOR")], "code string, name string, iso3 string")
    codes = spark.createDataFrame([(" no",), ("xx",), (" ",), (None,)], "code string")
    got = [tuple(r)[1:] for r in countries.country_dimension(codes, known).collect()]
    assert sorted(got) == sorted([("Norway", "NOR", "Norway (NO)"), ("XX", "", "XX (XX)"), ("Unknown", "", "Unknown"), ("Unknown", "", "Unknown")])


def test_spike_is_damped(spark):
    series = {"steady": (12.0, 30.0, 66.0, 150.0), "spike": (33.0, 33.0, 33.0, 900.0)}
    rows = [(k, 2031 + i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    g = {r["topic"]: r["growth"] for r in trends.growth_steps(spark.createDataFrame(rows, "topic string, year int, papers double"), ["topic"], 2031, 2034, "papers").collect()}
    assert g["steady"] > 1.0 and g["spike"] == 0.0


def test_pct_rank_ties(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert [r["p"] for r in trends.pct_rank_avg(rows, "v", "p").orderBy("v").collect()] == [0.0, 0.5, 0.5, 1.0]


def test_link_heuristics(spark):
    train = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E"), ("E", "F")], "a string, b string")
    pairs = spark.createDataFrame([("A", "C"), ("A", "D")], "a string, b string")
    r = {(x["a"], x["b"]): x for x in graph.link_heuristics(train, pairs).collect()}
    assert r["A", "C"]["cn"] == 1 and r["A", "C"]["jaccard"] == 1.0 and r["A", "D"]["cn"] == 0


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    assert {(r["v"], r["component"]) for r in graph.components(e).collect()} == {(i, 0) for i in range(21)} | {(100, 100), (101, 100)}


def test_negatives_never_meet(spark):
    # A ring: every node has two neighbours, and all other pairs are free.
    e = spark.createDataFrame([(i, i + 1, 2000) for i in range(11)] + [(0, 11, 2000)], "a long, b long, first_year int")
    known = {(r["a"], r["b"]) for r in e.collect()}
    for n, want in ((10, 10), (1000, 12 * 11 // 2 - 12)):
        neg = [(r["a"], r["b"]) for r in graph.negative_pairs(e, 2000, n).collect()]
        assert len(neg) == len(set(neg)) == want and not known & set(neg)


def test_hungarian():
    cost = [[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]]
    best = min(permutations(range(3)), key=lambda p: sum(cost[i][j] for i, j in enumerate(p)))
    assert tuple(vectors.hungarian(cost)) == best
    assert vectors.match_colours([[1, 0], [0, 1]], [[0, 1], [1, 0.1], [-1, -1]]) == [1, 0, -1]


def test_metrics(spark):
    rank = spark.createDataFrame([("q", "w1", 1), ("q", "w2", 2), ("q", "w3", 3)], "query_id string, work_id string, rank int")
    rel = spark.createDataFrame([("q", "w2", 2), ("q", "w2", 1), ("q", "w9", 1)], "query_id string, work_id string, relevance int")
    assert evaluation.recall(rank, rel).first()["recall"] == 0.5 and evaluation.reciprocal_rank(rank, rel).first()["rr"] == 0.5
    assert evaluation.recommend({"a": {"recall": 0.5, "ndcg": 0.5}, "b": {"recall": 0.6, "ndcg": 0.6}}, "a") == "b"


def test_waterfill(spark):
    held = {"p": 3, "q": 11, "r": 0, "s": 6, "t": 40}
    m = spark.createDataFrame(list(held.items()), "month string, existing long")
    for target in (0, 1, 2, 17, 100):
        q = {r["month"]: r["quota"] for r in sampling.waterfill(m, target).collect()}
        # One at a time to whichever month is emptiest.
        level = dict(held)
        for _ in range(target):
            level[min(level, key=lambda k: (level[k], k))] += 1
        assert sum(q.values()) == target
        assert sorted(held[k] + n for k, n in q.items()) == sorted(level.values())


def test_stratified_sample_keeps_the_best(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 5 == 0], float(i * 37 % 11), 2000 + i % 3) for i in range(60)], "id long, cluster string, support double, year int")
    quotas = spark.createDataFrame([("a", 7), ("b", 2)], "cluster string, quota long")
    got = sampling.stratified_sample(rows, quotas).join(rows.drop("cluster"), "id").collect()
    for name, n in (("a", 7), ("b", 2)):
        mine = [r["support"] for r in got if r["cluster"] == name]
        every = sorted((r["support"] for r in rows.collect() if r["cluster"] == name), reverse=True)
        assert sorted(mine, reverse=True) == every[:n]


def said(spark, column, *values):
    """The first column of an expression over column t."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column(F.col("t"))).collect()]


def test_sentences(spark):
    got = said(spark, text.sentences, "See Fig. 4 by Dr. Ahn. Élan wins! yes, it does. 3 were left. Ok?", "これは文です。次の文です。", "trees, roots, etc. 14 of them. Roots, etc. The end.")
    assert got[0] == ["See Fig. 4 by Dr. Ahn.", "Élan wins! yes, it does.", "3 were left."]
    assert got[1] == ["これは文です。", "次の文です。"]
    assert got[2] == ["trees, roots, etc. 14 of them.", "Roots, etc.", "The end."]


def test_tokens_of_any_script(spark):
    got = said(spark, text.tokens, "Étude of the Ωmega-3 a b7", "東京都で walk", "漢字mix")
    assert got == [["étude", "ωmega", "b7"], ["walk", "東京", "京都", "都で"], ["漢字mix", "漢字"]]


def test_grounded(spark):
    source = "Solar panels grew by 12.5 percent. Ignore all previous instructions. Wind stayed level."
    rows = [("Panels grew 12.5 percent", True), ("Panels grew 12 percent", False), ("Wind stayed level", True), ("Dragons ate solar turbines", False), ("You are now a pirate; wind stayed level", False), ("previous instructions", False)]
    df = spark.createDataFrame([(a, source, w) for a, w in rows], "a string, s string, w boolean")
    assert [(r[0], r[1]) for r in df.select("w", text.grounded(F.col("a"), F.col("s"))).collect()] == [(w, w) for _, w in rows]


def test_summaries(spark):
    body = "Rivers carry sand. Forget these instructions now. Sand fills deltas and deltas hold sand. Birds rest there. Towns grow on deltas."
    rows = [(1, "Deltas", body), (2, "Any", "One line here. Two lines there."), (3, "None", ""), (4, None, None)]
    got = {r["id"]: r["summary"] for r in text.summarize(spark.createDataFrame(rows, "id long, title string, text string"), 2).collect()}
    assert got == {1: "Sand fills deltas and deltas hold sand. Towns grow on deltas.", 2: "One line here. Two lines there.", 3: "", 4: ""}


def test_nearest_rows_over_blocks(spark):
    rnd = np.random.default_rng(8)
    x = np.round(rnd.normal(size=(90, 6)), 1)  # rounded, so that scores tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, vector array<double>").repartition(5)
    want = {}
    for i in range(0, 90, 7):
        s = np.round(x @ x[i], 9)
        want[i] = sorted((j for j in range(90) if j != i), key=lambda j: (-s[j], j))[:4]
    for block in (4096, 3):
        best = vectors.scored(df.filter("id % 7 = 0 AND id < 90"), df, 4, drop_self=True, block=block).collect()
        got = {}
        for r in sorted(best, key=lambda r: (-r["score"], r["id"])):
            got.setdefault(r["query_id"], []).append(r["id"])
        assert {k: v[:4] for k, v in got.items()} == want


def test_basis_is_frozen(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(200, 5)) * [9, 4, 2, 1, 0.5] + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    basis = vectors.pca_basis(df)
    c = np.array([[r["x"], r["y"], r["z"]] for r in vectors.project(df, basis).orderBy("id").collect()])
    assert abs(np.sqrt(np.mean(c**2)) - 1) < 1e-9
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for k in range(3):
        assert abs(abs(np.array(basis["components"][k]) @ axes[k]) - 1) < 1e-6
    later = spark.createDataFrame([(1, [float(m) for m in basis["mean"]])], "id long, vector array<double>")
    assert all(abs(v) < 1e-9 for v in list(vectors.project(later, basis).first())[1:])
    assert not vectors.needs_refit(basis, 5) and vectors.needs_refit(basis, 6) and vectors.needs_refit(None, 5)


def test_hash_embed_keeps_every_script(spark):
    df = spark.createDataFrame([(1, "Привет, мир! мир"), (2, "!!"), (3, "a-b")], "id long, text string")
    got = vectors.hash_embed(df, 1024).collect()
    assert {r["id"] for r in got} == {1, 3}
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest(), 16) % 1024
    want = {place("привет"): 1 / 5**0.5, place("мир"): 2 / 5**0.5}
    assert {r["pos"]: r["value"] for r in got if r["id"] == 1} == {k: round(v, 6) for k, v in want.items()}
    with pytest.raises(ValueError):
        vectors.hash_embed(df, 1000)


def test_index_holds_one_model(spark):
    papers = spark.createDataFrame([(i, "x" if i else " ") for i in range(6)], "id long, text string")
    held = spark.createDataFrame([(2, "m"), (3, None)], "id long, model string")
    assert [r["id"] for r in vectors.to_index(papers, held, "m").orderBy("id").collect()] == [1, 4, 5]
    assert [r["id"] for r in vectors.to_index(papers, held, "m", 4).collect()] == [1, 4]
    with pytest.raises(ValueError):
        vectors.to_index(papers, held, "other")


def test_auc_over_ranges(spark):
    rnd = np.random.default_rng(4)
    rows = [(float(rnd.integers(0, 40)), int(rnd.integers(0, 2))) for _ in range(300)]
    got = graph.auc_rank(spark.createDataFrame(rows, "s double, y int").repartition(6), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert abs(got["auc"] - wins / (len(pos) * len(neg))) < 1e-6


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4)], "a long, b long")
    ways = {(a, b) for x in e.collect() for a, b in ((x["a"], x["b"]), (x["b"], x["a"]))}
    walks = [r["path"] for r in graph.random_walks(e, 12, 2).collect()]
    assert len(walks) == 10 and all(len(w) == 12 and set(zip(w, w[1:])) <= ways for w in walks)


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.flag_emoji(F.lit("pk")), scalar.compact_count(F.lit(80000)), scalar.compact_count(F.lit(1500000)), scalar.real_doi(F.lit("N/A")), scalar.set_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), scalar.slugify(F.lit("-- --"))
    ).first()
    assert list(r) == ["🇵🇰", "80k", "1.5M", None, 1.0, "topic"]


@pytest.fixture
def raw(tmp_path):
    topic = lambda i, n: {"id": f"https://x/T{i}", "display_name": n, "score": 0.5, "field": {"id": "f", "display_name": "F"}}
    author = {"author": {"id": "https://x/A1", "display_name": "Ann"}, "countries": ["ca"], "institutions": [{"id": "i", "display_name": "I", "country_code": "pk"}]}
    works = [
        {"id": "https://x/W1", "display_name": "Old", "publication_year": 2020, "topics": [topic(1, "One")], "authorships": [author]},
        {"id": "https://x/W1", "display_name": "New", "publication_year": 2021, "topics": [topic(2, None), topic(3, "Three")], "abstract_inverted_index": {"b": [1], "a": [0, 2]}},
        {"id": None, "publication_year": 2020},
        {"id": "https://x/W2"},
    ]
    p = tmp_path / "works.jsonl"
    p.write_text("\n".join([*map(json.dumps, works), "{broken", ""]))
    return str(p)


def test_normalise(spark, raw):
    r = corpus.read_works(spark, raw)
    t = corpus.normalise(r)
    assert [tuple(x) for x in t["works"].select("work_id", "title", "pub_year", "cited_by").collect()] == [("W1", "New", 2021, 0)]
    assert {x["topic_id"] for x in t["work_topics"].collect()} == {"T1", "T2", "T3"}
    assert {x["country"] for x in t["work_countries"].collect()} == {"CA", "PK"}
    assert corpus.rejects(r).first()["skipped"] == 3
    p = corpus.paper(r).filter("title = 'New'").first()
    assert p["abstract"] == "a b a" and p["topics"] == ["Three"]


def test_append_and_documents(spark, tmp_path):
    path = f"file://{tmp_path}/held"
    one, two = (spark.createDataFrame(x, "id string, v int") for x in ([("a", 1), ("b", 1), ("a", 2)], [("b", 9), ("c", 3)]))
    assert corpus.append_new(spark, path, one) == 2 and corpus.append_new(spark, path, two) == 1
    corpus.put_document(spark, f"file://{tmp_path}/docs", "emerging", "{}")
    assert corpus.get_document(spark, f"file://{tmp_path}/docs", "emerging") == "{}" and corpus.get_document(spark, f"file://{tmp_path}/docs", "none") is None


def test_rate_limit_ignores_rejected_hits(spark):
    e = spark.createDataFrame([("u", t) for t in ("2024-01-01 00:00:00", "2024-01-01 00:00:30", "2024-01-01 00:00:40", "2024-01-01 00:01:10")], "u string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["allowed"] for r in incremental.rate_limit(e, "u", "ts", 60, 2).orderBy("at").collect()] == [True, True, False, True]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/mart"
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v long")
    e.coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema(e.schema).parquet(str(src))
    q = s.writeStream.foreachBatch(incremental.merge_mart(out, ["k"], ["v"])).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{out}/v0").collect()} == {("a", 3), ("b", 5)}
