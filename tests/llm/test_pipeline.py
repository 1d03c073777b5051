"""The pipeline's stages on a small table, against the operators' brute-force versions."""

from test_llm_operators import ROWS, SCHEMA, TEXTS, brute_near, brute_secrets

import corpus_pipeline


def test_stages(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    columns, out = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
        if name != "packing":
            assert out.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
    letters = {i for i, t in enumerate(TEXTS) if t and any(c.isalpha() for c in t)}
    assert set(kept["language_id"]) == letters
    norm = {i: " ".join(TEXTS[i].split()) for i in letters}
    assert set(kept["exact_dedup"]) == {i for i in letters if i == min(j for j in letters if norm[j] == norm[i])}
    ids = sorted(kept["exact_dedup"])
    groups = [ids[c] for _, c in brute_near([TEXTS[i] for i in ids])]
    assert set(kept["near_dedup"]) == set(groups)
    assert set(kept["secret_scan"]) == set(kept["near_dedup"])
    assert all(not brute_secrets(t) for t in kept["secret_scan"].values())
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(kept["secret_scan"])


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
