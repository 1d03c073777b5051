"""Hidden Markov language model scores (operator 8).

1. Every document is coded once by the words of its block, a run of documents of one task with
   at most about BLOCK_WORDS distinct words, and written to the shared folder, with each word's training
   tokens in the block (words and one end a document).
2. The blocks' words are brought together once, which gives each word's count over all training documents.
3. Every word of the training documents has an emission of its own. The expected counts by word and
   state are a distributed table with a row part for each block that holds the word, so what is
   learned grows with the corpus, and memory is bounded by a block. A word's counts sum to its number
   of occurrences, so the table holds its 12-bit shares of that. The documents are bucketed by block
   once, and rounds shuffle the words alone.
4. Baum-Welch: each block runs scaled forward-backward over its whole training documents with its
   words' emissions; of a batch that is too long, only the states at checkpoints are kept and the
   steps between are run again backward. Counts of words that several blocks share are summed by
   ranges of words and dealt back to the blocks; those of the other words stay. The driver
   normalises by state totals only.
5. The scaled forward recursion over whole documents gives the exact log-likelihood.
"""

from __future__ import annotations

import gc
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, array_runs, crc_mod, documents, idle, partitions, text_or_empty
from weftlake.llm.near_dedup import _mixed, words_of

STATES = 12
ROUNDS = 5
#: A block ends with the run of documents (256 or about 2 MB at most) that brings it to so many distinct words or tokens.
BLOCK_WORDS, BLOCK_TOKENS = 400_000, 8_000_000
#: Pairs of a word and a block in a range of words, about.
RANGE_PAIRS = 500_000
#: Tokens whose forward and backward variables are held at a time.
HELD_TOKENS = 500_000
#: Tokens whose emissions are held at a time where documents are scored only.
STEP_ROWS = 200_000
#: Forward variables are brought to sum 1 every so many steps, or sooner than a sum falls below FLOOR.
STRIDE, FLOOR = 8, 1e-16
SEED = 88
#: Chance of staying in a state at the start, and the weight of the corpus' own distribution in each state, as a
#: share of what the state has gathered: words that were never seen keep their part at any size.
STAY, PRIOR = 0.9, 0.5
END = b""


def tokens_of(text: str) -> list[bytes]:
    return [*words_of(text), END]


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def code_texts(texts: pa.Array, code: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all tokens of texts (those of tokens_of), and where each text ends. Distinct words are coded once."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # white space of the contract, letters A-Z
    words = split.flatten().dictionary_encode()
    known = words.dictionary.cast(pa.binary() if pa.types.is_string(words.dictionary.type) else pa.large_binary()).to_numpy(zero_copy_only=False)
    at = words.indices.to_numpy()
    # White space at a text's ends and an empty text give empty words.
    full = np.array([len(w) > 0 for w in known], dtype=bool)[at]
    bounds = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()]
    codes = np.fromiter(map(code.__getitem__, known), dtype=np.int32, count=len(known))[at[full]]
    out = np.full(len(codes) + len(texts), code[END], dtype=np.int32)
    ends = bounds[1:] + np.arange(1, len(texts) + 1)
    word = np.ones(len(out), dtype=bool)
    word[ends - 1] = False
    out[word] = codes
    return out, ends


def coded(docs: DataFrame, train_mod=(7, 2), block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row as codes: rid (its place), doc_id, held_out, block, codes. A row without rid has the block's words in the order of
    their codes, with their training counts. A block's number is that of its first word among the words of all blocks."""
    mod, held = train_mod
    rows = docs.select("doc_id", (crc_mod(mod) == held).alias("held_out"), text_or_empty().alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["rid", "doc_id", "held_out", "block", "codes", "words", "counts"]

    def run(batches):
        rid = block = TaskContext.get().partitionId() << 40
        code = _Codes()
        tokens, ids_type, counts = 0, None, np.zeros(0, dtype=np.int64)

        def dictionary():
            cols = [pa.nulls(1, pa.int64()), pa.nulls(1, ids_type), pa.nulls(1, pa.bool_()), pa.array([block]), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, pa.array([list(code)], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))], names)

        for batch in batches:
            ids_type, n = batch.column("doc_id").type, batch.num_rows
            test = batch.column("held_out").to_numpy(zero_copy_only=False)
            blocks, codes, full = [], [], []
            for lo, texts in array_runs(batch.column("text"), chars=min(2_000_000, 5 * block_words)):
                flat, ends = code_texts(texts, code)
                sizes = np.diff(ends, prepend=0)
                seen = np.bincount(flat[np.repeat(~test[lo : lo + len(texts)], sizes)], minlength=len(code))
                seen[: len(counts)] += counts
                counts = seen
                blocks += [block] * len(texts)
                codes += [a.tobytes() for a in np.split(flat, ends[:-1])]
                tokens += len(flat)
                if len(code) >= block_words or tokens >= BLOCK_TOKENS:
                    full.append(dictionary())
                    block += len(code)
                    code, tokens, counts = _Codes(), 0, np.zeros(0, dtype=np.int64)
            cols = [pa.array(np.arange(rid, rid + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(blocks, pa.int64()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int64()))], names)
            yield from full
            rid += n
        if code:
            yield dictionary()
        code = None
        idle()

    return rows.mapInArrow(run, f"rid long, doc_id {id_kind}, held_out boolean, block long, codes binary, words array<binary>, counts array<long>")


class Hmm:
    """Start, transition and emission probabilities; emission is (classes x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, class_counts: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
        """The corpus' own distribution, shaken differently for each state, and sticky states."""
        rng = np.random.default_rng(seed)
        emit = (class_counts[:, None] + 0.5) * np.exp(rng.normal(0, 0.5, (len(class_counts), states)))
        move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
        np.fill_diagonal(move, STAY if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, (emit / emit.sum(axis=0)))

    def arrays(self) -> tuple:
        return self.start.astype(np.float32), self.move.astype(np.float32), self.emit.astype(np.float32)


def scaled(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple:
    """start, move, emissions that sum to 1 over the states (in place of emit) and the log10 of what they summed to."""
    size = emit @ np.ones(emit.shape[1], dtype=emit.dtype)
    emit /= size[:, None]
    return start, move, emit, np.log10(size, dtype=np.float64)


class _Steps:
    """Codes of sequences (longest first) by time: alive counts those that reach a time, at is each time's
    place, last the place of each sequence's last code."""

    def __init__(self, seqs: list[np.ndarray]):
        sizes = np.array([len(s) for s in seqs])
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        at = np.concatenate([[0], np.cumsum(alive)])
        self.codes = np.empty(at[-1], dtype=np.intp)
        for d, s in enumerate(seqs):
            self.codes[at[: len(s)] + d] = s
        self.last = at[sizes - 1] + np.arange(len(sizes))
        self.alive, self.at, self.total = [*alive.tolist(), 0], at.tolist(), np.zeros(len(seqs))

    def runs(self, rows: int) -> list[tuple[int, int]]:
        """Runs of times of at most so many codes where no single time has more."""
        cuts = [0]
        for t in range(1, len(self.at) - 1):
            if self.at[t + 1] - self.at[cuts[-1]] > rows:
                cuts.append(t)
        return list(zip(cuts, [*cuts[1:], len(self.at) - 1]))

    def forward(self, params: tuple, lo: int, hi: int, before: np.ndarray | None, e: np.ndarray, u: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill e with emissions and u with forward variables of the times lo..hi, so that u is (the row before it,
        moved) * e. Rows are brought to sum 1 every few times, by a factor of both; fewer where FLOOR asks for it.
        The logs of all factors and of the last rows' sums go to total, by sequence. Returns the sum of each
        row that is a sequence's last, and the rows of the time before hi."""
        start, move, emit = params[:3]
        at, base = self.at, self.at[lo]
        np.take(emit, self.codes[base : at[hi]], axis=0, mode="clip", out=e)
        sums, ones = np.empty(len(e), dtype=np.float32), np.ones(len(start), dtype=np.float32)
        t = lo
        while t < hi:
            end = min(t + STRIDE, hi)
            while True:
                a = before
                for s in range(t, end):
                    i, j = at[s] - base, at[s + 1] - base
                    x = u[i:j]
                    if a is None:
                        np.multiply(start, e[i:j], out=x)
                    else:
                        np.dot(a[: j - i], move, out=x)
                        np.multiply(x, e[i:j], out=x)
                    a = x
                c = np.matmul(u[at[t] - base : j], ones, out=sums[at[t] - base : j])
                if end == t + 1 or c.min() >= FLOOR:
                    break
                end = (t + end) // 2
            c = sums[i:j]
            total[: j - i] += np.log10(c, dtype=np.float64)
            a /= c[:, None]
            e[i:j] /= c[:, None]
            c[:] = 1
            before, t = a, end
        ended = sums[self.last[self.alive[hi] : self.alive[lo]] - base]
        total[self.alive[hi] : self.alive[lo]] += np.log10(ended, dtype=np.float64)
        return ended, before


def forward_log10(params: tuple, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion. params: (start, move, emit), or what scaled
    made of them."""
    params = params if len(params) == 4 else scaled(*params[:2], params[2].copy())
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    steps = _Steps([seqs[i] for i in order])
    runs = steps.runs(STEP_ROWS)
    space = np.empty((2, max(steps.at[hi] - steps.at[lo] for lo, hi in runs), len(params[0])), dtype=np.float32)
    before = None
    for lo, hi in runs:
        n = steps.at[hi] - steps.at[lo]
        before = steps.forward(params, lo, hi, before, space[0, :n], space[1, :n], steps.total)[1].copy()
    total = np.empty(len(seqs))
    total[order] = steps.total
    return total + [params[3][s].sum() for s in seqs]


def batches_by_length(seqs: list[np.ndarray], tokens: int) -> list[np.ndarray]:
    """Places of the sequences, longest first, in batches of at most so many tokens where no single one is longer:
    sequences of like length advance together."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    out, lo, held = [], 0, 0
    for i, k in enumerate(order.tolist()):
        if i > lo and held + len(seqs[k]) > tokens:
            out.append(order[lo:i])
            lo, held = i, 0
        held += len(seqs[k])
    return [*out, order[lo:]] if len(order) else []


def add_rows(sums: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> None:
    """sums[codes] += rows, counting repeated codes each."""
    if rows.shape[1] % 2 or not sums.flags.c_contiguous:
        for k in range(rows.shape[1]):
            sums[:, k] += np.bincount(codes, weights=rows[:, k], minlength=len(sums))
        return
    # Two states at a time, as the parts of a complex number, which numpy adds up as fast as one.
    sums = sums.view(np.complex128)
    for lo in range(0, len(codes), 20_000):
        at, two = codes[lo : lo + 20_000], rows[lo : lo + 20_000].view(np.complex64).astype(np.complex128)
        for k in range(two.shape[1]):
            np.add.at(sums[:, k], at, two[:, k])


def expected_counts(params: tuple, seqs: list[np.ndarray], emit_sum: np.ndarray, move_sum: np.ndarray, start_sum: np.ndarray, held: int = HELD_TOKENS, space: np.ndarray | None = None) -> float:
    """Add the expected counts of whole sequences; return their log10 likelihood. Variables of about
    held tokens are in memory (in space, 3 x tokens x states, if it is large enough): of longer runs of steps, only
    those at checkpoints, from which the steps are run again on the way back. params as of forward_log10."""
    params = params if len(params) == 4 else scaled(*params[:2], params[2].copy())
    start, move = params[:2]
    steps = _Steps(sorted(seqs, key=len, reverse=True))
    at, alive, runs = steps.at, steps.alive, steps.runs(held)
    most = max(at[hi] - at[lo] for lo, hi in runs)
    if space is None or space.shape[1] < most:
        space = np.empty((3, most, len(start)), dtype=np.float32)
    entering = [None]
    for lo, hi in runs[:-1]:
        n = at[hi] - at[lo]
        entering.append(steps.forward(params, lo, hi, entering[-1], space[0, :n], space[1, :n], np.zeros(len(seqs)))[1].copy())
    pairs = np.zeros_like(move, dtype=np.float64)
    moved = move.T.copy()
    after = None
    for (lo, hi), before in zip(runs[::-1], entering[::-1]):
        base = at[lo]
        e, u, w = space[:, : at[hi] - base]
        ended, _ = steps.forward(params, lo, hi, before, e, u, steps.total)
        # w times u sums to 1 in every row.
        w[steps.last[alive[hi] : alive[lo]] - base] = (1 / ended)[:, None]
        if after is not None:
            w[at[hi - 1] - base :][: len(after)] = after
        for t in range(hi - 1, lo, -1):
            i, j = at[t] - base, at[t + 1] - base
            h = at[t - 1] - base
            x = e[i:j]
            np.multiply(x, w[i:j], out=x)
            np.dot(x, moved, out=w[h : h + j - i])
        if lo:
            first = at[lo + 1] - base
            e[:first] *= w[:first]
            after = e[:first] @ moved
            pairs += before[:first].T @ e[:first]
        # A row and the same sequence's next: for times with as many sequences, both lie in one piece.
        t = lo + 1
        while t < hi:
            n, end = alive[t], t + 1
            while end < hi and alive[end] == n:
                end += 1
            i, j, h = at[t] - base, at[end] - base, at[t - 1] - base
            pairs += u[h : h + n].T @ e[i : i + n]
            if j > i + n:
                pairs += u[i : j - n].T @ e[i + n : j]
            t = end
        u *= w  # now the posteriors
        if not lo:
            start_sum += u[: at[1]].sum(axis=0)
        add_rows(emit_sum, steps.codes[base : at[hi]], u)
    move_sum += pairs * move
    return float(steps.total.sum() + params[3][steps.codes].sum())


def noise(hashes: np.ndarray, states: int, seed: int = SEED) -> np.ndarray:
    """Factors (words x states) that shake a word's emission at the start, by the word's hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    out = np.empty((len(h), states), dtype=np.float32)
    with np.errstate(over="ignore"):
        for k in range(0, states, 2):
            a = _mixed(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + k + 1))
            b = _mixed(a ^ np.uint64(seed))
            u, v = ((x >> np.uint64(40)).astype(np.float32) / (1 << 24) for x in (a, b))
            far, angle = 0.5 * np.sqrt(-2 * np.log(1 - u)), np.float32(2 * np.pi) * v
            for j, wave in enumerate((np.cos, np.sin)[: states - k]):
                out[:, k + j] = np.exp(far * wave(angle))
    return out


_STATE = "block long, size int, at binary, wid binary, c binary, n binary, q binary, h binary"
_COLUMNS = ["block", "size", "at", "wid", "c", "n", "q", "h"]
_KINDS = {"at": np.int32, "wid": np.int64, "c": np.int64, "n": np.int32, "q": np.uint16, "h": np.int64}
_ROUND = f"range int, {_STATE}, stats array<double>"
#: Steps into which a word's weight is shared out among the states.
STEPS = 4095


def shares(x: np.ndarray) -> np.ndarray:
    """A word's weights over the states as 12-bit shares of their sum, which is a known count."""
    x = x.astype(np.float32, copy=False)
    total = x.sum(axis=1, keepdims=True)
    x = x * (STEPS / np.where(total > 0, total, 1))
    x += np.float32(0.5)
    return x.astype(np.uint16)


def weights(q: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The weights of shares and their sums."""
    whole = q.sum(axis=1, dtype=np.int32)
    return q * (total / np.where(whole > 0, whole, 1)).astype(np.float32)[:, None]


def _small(name: str, a: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: all lowest bytes first, all highest last."""
    a = np.ascontiguousarray(a, dtype=_KINDS[name]).ravel()
    return pa.Codec("zstd", 1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), asbytes=True)


def _whole(name: str, b: bytes, n: int) -> np.ndarray:
    kind = np.dtype(_KINDS[name])
    flat = pa.Codec("zstd", 1).decompress(b, n * kind.itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, dtype=np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def _packed(block, at: np.ndarray, **more: np.ndarray) -> dict:
    """Words of a block as a row, in the order of their codes (at), which are kept as steps."""
    return {"block": block, "size": len(at), "at": _small("at", np.diff(at, prepend=0))} | {k: _small(k, v) for k, v in more.items()}


def first_state(rows: DataFrame, states: int) -> DataFrame:
    """A row for each block: its words' codes (at), ids (wid; -1 where no other block has the word), training counts (c)
    and hashes (h), which give the weights at the start; and stats: the training tokens and distinct training
    words that are counted in this block (a word in the first that has it) and the sums of their weights by state."""
    pairs = rows.filter("rid IS NULL").select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    of_word = Window.partitionBy("word")
    pairs = pairs.select("block", F.col("at").cast("long").alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    pairs = pairs.select(
        "block", "at", F.sum("n").over(of_word).alias("c"), F.min(F.col("block") + F.col("at")).over(of_word).alias("wid"),
        F.count("*").over(of_word).alias("blocks"), F.xxhash64("word").alias("h"),
    )

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("at").to_numpy())
        at, c, wid, blocks, h = (t.column(x).to_numpy()[order] for x in ("at", "c", "wid", "blocks", "h"))
        block = t.column("block")[0].as_py()
        first = (wid == block + at) & (c > 0)
        total = ((c[first] + 0.5)[:, None] * noise(h[first], states)).sum(axis=0)
        row = _packed(block, at, wid=np.where((blocks > 1) & (c > 0), wid, -1), c=c, h=h)
        return pa.Table.from_pylist([row | {"stats": [float(c[first].sum()), float(first.sum()), *total.tolist()]}], _schema(("stats", pa.list_(pa.float64()))))

    return pairs.groupBy("block").applyInArrow(pack, f"{_STATE}, stats array<double>")


def summed(rows: DataFrame, n: int) -> np.ndarray:
    """The sum of all rows' stats, n numbers each."""
    out = np.zeros(n)
    for s in rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # n rows at most
        out[s["i"]] = s["x"]
    return out


def _schema(*more: tuple) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("size", pa.int32()), *[(n, pa.binary()) for n in _KINDS], *more])


def _unpacked(state: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """wid, c and weights of a block's words in the order of their codes."""
    ats, wids, cs, xs = [], [], [], []
    for r in state.select(["size", "at", "wid", "c", "q", "h"]).to_pylist():
        m = r["size"]
        ats.append(np.cumsum(_whole("at", r["at"], m)))
        wids.append(_whole("wid", r["wid"], m))
        cs.append(_whole("c", r["c"], m))
        if r["q"] is None:
            xs.append((cs[-1] + 0.5).astype(np.float32)[:, None] * noise(_whole("h", r["h"], m), states))
        else:
            xs.append(weights(_whole("q", r["q"], m * states).reshape(-1, states), cs[-1]))
    whole = sum(map(len, ats))
    wid, c, x = (np.empty((whole, *part[0].shape[1:]), part[0].dtype) for part in (wids, cs, xs))
    for places, w, n, v in zip(ats, wids, cs, xs):  # every code is in one of the rows
        wid[places], c[places], x[places] = w, n, v
    return wid, c, x


def _emissions(c: np.ndarray, x: np.ndarray, prior: np.ndarray, norm: np.ndarray) -> np.ndarray:
    x = x + (c + 1).astype(np.float32)[:, None] * prior.astype(np.float32)
    x *= (1 / norm).astype(np.float32)
    return x


def _codes_of(column) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.int32) for b in column.to_pylist()]


def baum_welch_round(docs: DataFrame, state: DataFrame, model: Hmm, prior: np.ndarray, norm: np.ndarray, ranges: int) -> DataFrame:
    """Expected counts over all coded training documents: a row for each block and range of shared
    words (with each word's count in the block, n), one (range -1) for its other words and one (range -2)
    for its sums of moves, starts, states and log10 likelihood."""
    k = len(model.start)
    start_p, move_p, _ = model.arrays()

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        wid, c, x = _unpacked(words, k)
        params = scaled(start_p, move_p, _emissions(c, x, prior, norm))
        del x
        emit, move, start, log = np.zeros((len(c), k)), np.zeros((k, k)), np.zeros(k), 0.0
        seqs = [s for s, held in zip(_codes_of(docs.column("codes")), docs.column("held_out").to_pylist()) if not held]
        space = np.empty((3, min(HELD_TOKENS, sum(map(len, seqs))), k), dtype=np.float32)
        for batch in batches_by_length(seqs, HELD_TOKENS):
            log += expected_counts(params, [seqs[i] for i in batch], emit, move, start, space=space)
        del space
        block = docs.column("block")[0].as_py()
        stats = [*move.ravel().tolist(), *start.tolist(), *emit.sum(axis=0).tolist(), log]
        out = [{"range": -2, "block": block, "stats": stats}]
        part = np.where(wid < 0, -1, wid % ranges)
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.diff(part[order], append=np.iinfo(np.int64).max)) + 1
        lo = 0
        for hi in ends.tolist():
            at = order[lo:hi]
            n = np.rint(emit[at].sum(axis=1)).astype(np.int32)
            out.append({"range": int(part[at[0]])} | _packed(block, at, wid=wid[at], c=c[at], n=n, q=shares(emit[at])))
            lo = hi
        return pa.Table.from_pylist(out, pa.schema([("range", pa.int32()), *_schema(("stats", pa.list_(pa.float64())))]))

    docs = docs.select("block", "held_out", "codes")
    return docs.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(run, _ROUND)


def next_state(counted: DataFrame, states: int) -> DataFrame:
    """The blocks' words with their weights, summed over all blocks that share a word."""

    def run(t: pa.Table) -> pa.Table:
        sizes = t.column("size").to_pylist()
        each = lambda name, k=1: [_whole(name, b, k * m) for b, m in zip(t.column(name).to_pylist(), sizes)]
        wid, ns, q = np.concatenate(each("wid")), np.concatenate(each("n")), np.concatenate(each("q", states)).reshape(-1, states)
        order = np.argsort(wid)
        new = np.diff(wid[order], prepend=-1) != 0
        summed = shares(np.add.reduceat(weights(q, ns)[order], np.flatnonzero(new), axis=0))
        total = np.empty_like(q)
        total[order] = summed[np.cumsum(new) - 1]
        at = np.cumsum([0, *sizes])
        qs = [_small("q", total[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
        cols = {n: t.column(n) for n in _COLUMNS} | {"n": pa.nulls(len(t), pa.binary()), "q": pa.array(qs, pa.binary())}
        return pa.table([cols[n] for n in _COLUMNS], _COLUMNS)

    shared = counted.filter("range >= 0").select("range", *_COLUMNS)
    return counted.filter("range = -1").select(*_COLUMNS).union(shared.groupBy("range").applyInArrow(run, _STATE))


class Dealt:
    """Coded documents as a table bucketed by block, in the shared folder: each round's cogroup reads a
    block's documents where they are and shuffles the words alone."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.spark, self.name = rows.sparkSession, f"weftlake_lm_{uuid.uuid4().hex}"
        path = f"{scratch.root}/dealt"
        rows.write.option("path", path).option("compression", "zstd").bucketBy(partitions(self.spark), "block").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        self.rows._weftlake_path = path
        scratch.held[path] = self.rows

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def forward_scores(rows: DataFrame, state: DataFrame, model: Hmm, prior: np.ndarray, norm: np.ndarray) -> DataFrame:
    """rid, n_tokens, n_known, base_log and hmm_log of every coded document."""
    k = len(model.start)
    start_p, move_p, _ = model.arrays()
    names = ["rid", "doc_id", "held_out"]

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        _, c, x = _unpacked(words, k)
        params = scaled(start_p, move_p, _emissions(c, x, prior, norm))
        base, known = np.log10(c + 1.0), c > 0
        codes = _codes_of(docs.column("codes"))
        logs = np.zeros(len(codes))
        for batch in batches_by_length(codes, HELD_TOKENS):
            logs[batch] = forward_log10(params, [codes[i] for i in batch])
        out = [[len(s) for s in codes], [int(known[s].sum()) for s in codes], [float(base[s].sum()) for s in codes], logs]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([*[docs.column(n) for n in names], *[pa.array(v, t) for v, t in zip(out, kinds)]], [*names, "n_tokens", "n_known", "base_log", "hmm_log"])

    docs = rows.select("block", *names, "codes")
    schema = f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_log double, hmm_log double"
    return docs.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(run, schema)


def lm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text
    counts as empty: its only token is the end. Repeated rows are counted and scored each.
    Every word of the training rows has its own emissions; all others are one unknown type, to
    which each state gives the smoothed share, so a state's emissions sum to 1. Documents of any
    length are learned and scored whole. With no training row base and model give the unknown
    type probability 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    raw = scratch.write(coded(docs, block_words=block_words), "coded", compression="zstd")
    pairs = raw.filter("rid IS NULL").agg(F.sum(F.size("words"))).first()[0] or 0
    ranges = 1 + pairs // RANGE_PAIRS

    held = scratch.write(first_state(raw, states), "state")
    n, v, *norm = summed(held, states + 2)
    n, v, norm = int(n), int(v), np.where(np.array(norm) > 0, norm, 1.0)
    model, prior, state = Hmm.first(np.zeros(0), states), np.zeros(states), held.drop("stats")
    dealt = Dealt(raw.filter("rid IS NOT NULL").drop("words", "counts"), scratch)
    rows = dealt.rows
    scratch.drop(raw)
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets the shuffle files of the steps before go
        counted = scratch.write(baum_welch_round(rows, state, model, prior, norm, ranges), "counted")
        scratch.drop(held)
        values = summed(counted.filter("range = -2"), states * states + 2 * states + 1)
        move, start, occupied = values[: states * states].reshape(states, states) + 1.0, values[states * states :][:states] + 1.0, values[states * states + states :][:states]
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), model.emit)
        weight = PRIOR * (occupied + 1)
        prior, norm = weight / (n + v + 1), occupied + weight
        state, held = next_state(counted, states), counted

    scored = forward_scores(rows, state, model, prior, norm)
    out = scratch.result(scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_log") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        F.col("hmm_log").alias("score"),
    ))
    dealt.forget()
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
