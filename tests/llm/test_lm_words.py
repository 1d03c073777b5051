"""Every training word has emissions of its own: the model against Baum-Welch on one full matrix."""

import zlib
from collections import Counter

import numpy as np

from weftlake.llm import lm


def brute_scores(spark, texts, states, rounds):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [lm.tokens_of(t) for t in texts]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    words = sorted({w for t in tokens for w in t})
    code = {w: i for i, w in enumerate(words)}
    c = np.array([counts[w] for w in words])
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    hashes = {bytes(r[0]): r[1] for r in df.selectExpr("word", "xxhash64(word)").collect()}
    weight = (c + 0.5)[:, None] * lm.noise(np.array([hashes[w] for w in words]), states)
    emit = weight / weight[c > 0].sum(axis=0)
    model = lm.Hmm.first(np.zeros(0), states)
    start, move = model.start, model.move
    seqs = [np.array([code[w] for w in t]) for t in tokens]
    train = [s for s, h in zip(seqs, held) if not h]
    for _ in range(rounds):
        sums = np.zeros(emit.shape), np.zeros(move.shape), np.zeros(states)
        lm.expected_counts(lm.Hmm(start, move, emit).arrays(), train, *sums)
        weight = lm.PRIOR * (sums[0].sum(axis=0) + 1)
        emit = (sums[0] + weight * (c + 1)[:, None] / (n + v + 1)) / (sums[0].sum(axis=0) + weight)
        start, move = (sums[2] + 1) / (sums[2] + 1).sum(), (sums[1] + 1) / (sums[1] + 1).sum(axis=1, keepdims=True)
    return lm.forward_log10(lm.Hmm(start, move, emit).arrays(), seqs)


def test_every_word_is_learned(spark):
    # Two topics of words that occur a few times each, more of them than a small head would hold.
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'xy'[i % 2]}{rng.integers(0, 300)}" for _ in range(rng.integers(1, 700))) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_scores(spark, texts, 2, 4)
    for block_words in (lm.BLOCK_WORDS, 40):  # a block a task, and blocks of a few documents
        got = {r["doc_id"]: r["score"] for r in lm.lm_scores(df, states=2, rounds=4, block_words=block_words).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-4, atol=1e-2)
