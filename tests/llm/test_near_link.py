"""The near-dedup stage links at 0.8; operator 3 keeps the 0.85 of its contract."""

import pytest

import corpus_pipeline
from weftlake.llm import near_dedup


def planted():
    """Pairs of 104 words whose last k words differ: similarity (100 - k) / (100 + k)."""
    out = []
    for n, k in enumerate([5, 8, 9, 9, 10, 10, 11, 11, 11, 12, 12, 15]):
        words = [f"p{n}w{i}" for i in range(104)]
        out += [" ".join(words), " ".join(words[: 104 - k] + [f"q{n}w{i}" for i in range(k)])]
    chain = [f"c{i}" for i in range(104)]
    for i in range(6):
        chain = chain[10:] + [f"d{i}w{j}" for j in range(10)] if i else chain
        out.append(" ".join(chain))
    return out


def brute(texts, least):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= least * len(a | sets[j]) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return comp


def test_stage_links_at_eighty(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = lambda *a: {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, *a).collect()}
    at80, at85 = brute(texts, 80), brute(texts, 85)
    assert len(set(at80)) < len(set(at85))
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()}
    assert kept == set(at80)
    assert groups((100, 80)) == dict(enumerate(at80))
    assert groups() == dict(enumerate(at85))


def test_links_that_bands_would_miss_are_refused(spark):
    df = spark.createDataFrame([(0, "a b c d e")], "doc_id long, text string")
    for link in ((100, 50), (100, 0), (100, 101)):
        with pytest.raises(ValueError):
            near_dedup.near_groups(df, link)
