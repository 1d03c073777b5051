"""Beyond former bounds, by way of the shuffle, on long texts and odd tables."""

import numpy as np
import pytest
from test_llm_operators import SCHEMA, brute_secrets, by_id

import corpus_pipeline
from weftlake.llm import bpe, common, exact_dedup, near_dedup, packing, secrets, sharding

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))


def test_levels_only_get_rows_with_company(spark):
    head = "the same first words of all these texts, more than sixty-four characters of them: "
    texts = ["alone", head + "aa", head + "bb", head + "aa", head + "ccc", "x" * len(head + "aa"), "ab", "cd", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_length, by_prefix = exact_dedup.levels(exact_dedup.text_keys(docs), common.Scratch(spark, "t"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(by_length) == [1, 2, 3, 5, 6, 7, 8]  # 0 and 4 have a length of their own
    assert ids(by_prefix) == [1, 2, 3, 6, 8]  # 5 and 7 share a length, but no prefix
    got = by_id(exact_dedup.exact_dedup(docs))
    assert [i for i in got if got[i]["group_size"] > 1] and {i for i in got if not got[i]["kept"]} == {3, 8}


def test_shuffle_ways_equal_broadcast_ways(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [f"text {'hot' if i % 3 == 0 else rng.integers(0, 40)} " * int(1 + i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    run = lambda: (by_id(exact_dedup.exact_dedup(docs)), sorted(by_id(exact_dedup.drop_copies(docs))), by_id(near_dedup.near_groups(docs)), by_id(secrets.secret_report(docs)))
    first = run()
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common.counted, "__defaults__", (0,))
    monkeypatch.setattr(secrets, "BROADCAST_CANDIDATES", 0)
    assert run() == first


def test_large_buckets_are_met_in_parts(spark, monkeypatch):
    """Many mutually unlinked texts that share bands, with linked ones among them."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(20, 4, replace=False):
            w[5 * p] = f"v{i}p{p}"  # twenty shingles gone of 96: unlinked to the rest
        texts.append(" ".join(w))
    texts += [t.replace("w99", "end") for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    from test_llm_operators import brute_near

    want = [c for _, c in brute_near(texts)]
    assert 100 < len(set(want)) < 190
    for part in (near_dedup.PART, 8):
        monkeypatch.setattr(near_dedup, "PART", part)
        got = by_id(near_dedup.near_groups(df))
        assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_near_recall_on_a_table(spark):
    """Every linked pair of sf0.001, found by counting common shingles, is in one component."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in d.collect())
    from test_llm_operators import brute_near

    got = by_id(near_dedup.near_groups(d))
    assert [got[i]["component_id"] for i, _ in rows] == [rows[c][0] for _, c in brute_near([t for _, t in rows])]


def test_more_trigrams_than_a_long_has_bits(spark):
    rules = secrets.RULES + tuple(secrets.Rule(f"k{i}", f"prefix{i:03d}_[a-z]+key{i}") for i in range(40))
    wanted = {t for r in rules if (q := secrets.trigram_query(r.pattern)) != secrets.ANY for t in secrets.trigrams(q)}
    assert len(wanted) > 100
    texts = ["prefix007_abckey7 prefix008_abckey7", "token = abcdefghijklmnop", "prefix039_zkey39", "", None, "prefix012_"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in secrets.scan_secrets(docs, rules).collect()}
    n = len(secrets.RULES)
    assert got == {0: [n + 7], 1: [0], 2: [n + 39], 3: [], 4: [], 5: []}


def test_index_leaves_only_candidates(spark):
    texts = ["my token: abcdefghijklmnop", "the word tok and ken apart", "AKIA here", "akia there", "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_key long, text string")
    queries = [secrets.trigram_query(r.pattern) for r in secrets.BASE_RULES]
    wanted = sorted({t for q in queries if q != secrets.ANY for t in secrets.trigrams(q)})
    index = secrets.postings(df, wanted)
    held = {wanted[r["trigram"]]: 0 for r in index.collect()}
    assert {"tok", "oke", "ken", "aki", "kia"} <= set(held)
    got = {r["_key"]: r["rules"] for r in secrets.candidates(index, queries, wanted).collect()}
    assert got == {0: [0], 2: [1], 3: [1]}


def test_open_windows_have_no_cap():
    p = packing.SumOfSquares(window=100)
    for i in range(6000):
        p.add(i, b"\0\0\0\0" * 60)  # no two fit into one window
    assert p.count.sum() == 6000 and not p.rows
    p.flush()
    fill = {}
    for _, _, n, _, _, seq, _ in p.rows:
        fill[seq] = fill.get(seq, 0) + n
    assert sum(fill.values()) == 360_000 and sum(f < 100 for f in fill.values()) <= 1


def test_caches_start_anew(monkeypatch):
    words = [f"word{i} " for i in range(400)]
    coder = bpe.TrieBpe(bpe.vocabulary("byte_bpe_50k.json"))
    whole = list(coder.encode_batch(["".join(words), "x" * 300]))
    monkeypatch.setattr(bpe, "CACHED_BYTES", 10)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 4)
    coder.words.clear()
    coder.pairs.clear()
    assert [list(coder.encode_batch([t]))[0] for t in ("".join(words), "x" * 300)] == whole
    assert "x" * 300 not in coder.words
    tok = packing.CachedTokenizer(bpe.vocabulary("word_bpe_49k.json"))
    texts = [" ".join(words), "y" * 200 + " z", "Über-straße 12"]
    whole = list(tok.encode_batch(texts))
    tok.limit(0.0001)
    assert [list(tok.encode_batch([t]))[0] for t in texts] == whole and "y" * 200 not in tok.known


def test_long_texts(spark):
    """A text of 20,000 words, a copy in other white space, and one that lacks a word; windows of 2048."""
    texts = [LONG, LONG.replace(" ", "\n"), LONG.replace("w7919 ", "", 1) + " token = abcdefghijklmnop", "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {i: r["keep_id"] for i, r in by_id(exact_dedup.exact_dedup(docs)).items()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {i: r["component_id"] for i, r in by_id(near_dedup.near_groups(docs)).items()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert [r["n_assign"] for _, r in sorted(by_id(secrets.secret_report(docs)).items())] == [len(brute_secrets(t)) for t in texts]
    fill = {}
    for r in packing.pack(docs.repartition(1)).collect():
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) == 2048 and sum(f < 2048 for f in fill.values()) <= 1


def test_packing_in_many_tasks(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 40)) for i in range(200)], "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, window=64).collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sum(f < 64 for f in fill.values()) <= 4
    assert {r["doc_id"] for r in rows} == set(range(200))


@pytest.mark.parametrize("extra", ["rules", "found", "key", "part", "n_shingles", "_key", "_keep", "trigram", "lower", "held_out", "mark"])
def test_pipeline_with_clashing_columns_and_odd_rows(spark, extra):
    schema = f"{SCHEMA}, `{extra}` string"
    rows = [(1, "The cat sat on the mat with a token = abcdefghijklmnop", "en", "a", True, 1, "z", 54, "e"), (None, "No id but a text", "en", None, None, None, None, 16, None), (2, "Der Hund schläft", None, "b", True, 1, "z", 16, "e"), (3, None, "en", "b", None, None, None, None, "e")]
    docs = spark.createDataFrame([*rows, rows[0]], schema)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns, name
    got = out.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert all("abcdefghijklmnop" not in r["text"] for r in got)


def test_sharding_reads_texts_once(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 9), "s") for i in range(50)], "doc_id long, text string, source string")
    got = sharding.shard_stratified(docs).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [6] * 6 + [7] * 2
