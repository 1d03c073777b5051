"""Texts are coded and counted in one pass; forward variables are scaled every few steps only."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from test_llm_operators import brute_forward, brute_posteriors

from weftlake.llm import lm

TEXTS = ["", " \t\n", "b", " The  the\x0bTHE\r\n end ", "Été été a b   İ x\x1fy", "b the " * 40]


def test_texts_are_coded_as_tokens_of_does():
    for part in (pa.array(TEXTS), pa.array(["x y", *TEXTS]).slice(1), pa.array(TEXTS, pa.large_string()), pa.array(["", ""])):
        code = lm._Codes({b"seen": 0})
        flat, ends = lm.code_texts(part, code)
        words = {n: w for w, n in code.items()}
        assert [[words[c] for c in a] for a in np.split(flat, ends[:-1])] == [lm.tokens_of(t) for t in part.to_pylist()]


def test_blocks_carry_their_training_counts(spark):
    texts = [TEXTS[i % len(TEXTS)] + f" w{i % 11}" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    rows = lm.coded(df, block_words=6).collect()
    got, blocks = Counter(), [r for r in rows if r["rid"] is None]
    for r in blocks:
        got.update(dict(zip(map(bytes, r["words"]), r["counts"])))
    want = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in lm.tokens_of(t))
    assert +got == want and len(blocks) > 4
    places = [n for r in blocks for n in range(r["block"], r["block"] + len(r["words"]))]
    assert len(set(places)) == len(places)
    of = {r["block"]: [bytes(w) for w in r["words"]] for r in blocks}
    for r in rows:
        if r["rid"] is not None:
            assert [of[r["block"]][c] for c in np.frombuffer(r["codes"], np.int32)] == lm.tokens_of(texts[r["doc_id"]])


def test_improbable_steps_are_scaled_sooner():
    # Words of one state after those of another, states that hardly move: sums fall by far more than FLOOR in STRIDE steps.
    emit = np.array([[0.6, 1e-9], [1e-9, 0.6], [0.4, 0.4]], dtype=np.float32)
    move = np.array([[1 - 1e-6, 1e-6], [1e-6, 1 - 1e-6]], dtype=np.float32)
    params = np.array([0.5, 0.5], dtype=np.float32), move, emit
    rng = np.random.default_rng(2)
    seqs = [np.array([0, 1] * 9), np.array([0, 0, 1, 1, 1, 1]), np.array([2]), rng.integers(0, 3, 21), rng.integers(0, 3, 8)]
    assert np.allclose(lm.forward_log10(params, seqs), [brute_forward(params, s) for s in seqs], rtol=1e-5)
    want = [sum(x) for x in zip(*(brute_posteriors(params, s) for s in seqs))]
    for held in (10_000, 7):
        sums = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
        log = lm.expected_counts(params, seqs, *sums, held=held)
        assert abs(log - sum(brute_forward(params, s) for s in seqs)) < 1e-3
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-4) for a, b in zip(sums, want))
