"""Near-duplicate groups by b-bit MinHash (operator 3).

1. Sketch, in the scan: the distinct shingles of each text, 128 minima, 32 band keys of four
   minima each, and the signature of the two low bits of every minimum packed in four longs.
2. Texts with the same words are one class; only a class's smallest id goes on.
3. Classes that share a band key are candidates. The bits that two signatures share estimate
   their similarity, corrected for chance agreement of two bits; candidates below the
   threshold less five standard deviations are no link.
   An odd sketch (a parity bit for each of 512 hash values) then rules out pairs that differ in
   more shingles than a link allows, without ever ruling out a link.
4. Remaining candidates are confirmed on their full shingle sets.

Buckets hold no limit. A small bucket gives all its pairs. A large one gives pairs with one
leader (drawn anew in every band), then pairs of those not yet connected with the rest, in
growing draws, until its members are connected or every pair across its components was
looked at. So a group of n near copies costs a few times n pairs, and none is left out. A large
bucket is dealt over parts, each met by the leaders in a task of its own.
A pair of similarity 0.85 shares no band with probability (1 - 0.85^4)^32 < 1e-10, one of 0.8
with (1 - 0.8^4)^32 < 5e-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, counted, documents, drop_ids, idle, join_groups, text_or_empty, text_runs

WORDS = 5
#: Documents are linked if link[0] * intersection >= link[1] * union. LINK is the contract's of
#: operator 3, STAGE_LINK that of stages without a contract.
LINK, STAGE_LINK = (100, 85), (100, 80)
#: Highest probability that a linked pair shares no band; lower links are refused.
MOST_MISSED = 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 2
SIG = HASHES * BITS // 64
#: Longs of the odd sketch: a bit for each of 64 * ODD hash values, the parity of the shingles that fall on it.
ODD = 8
SEED = 1_303
#: A bucket of at most so many classes gives all its pairs at once.
SMALL = 8
#: Members drawn as leaders from those outside a large bucket's main component: FIRST_DRAW, then
#: DRAW_GROWTH times as many each round.
FIRST_DRAW, DRAW_GROWTH = 64, 8
#: Members of a part of a large bucket, about.
PART = 512
CACHED_WORDS = 200_000

SIGNATURE = [*[f"s{i}" for i in range(SIG)], *[f"o{i}" for i in range(ODD)]]

_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS + 1)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, seed=SEED)
        return h


_words = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case: bytes.lower and bytes.split know ASCII alone."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text's words."""
    sizes = [len(w) for w in texts]
    h = np.fromiter((_words[w] for words in texts for w in words), dtype=np.uint64, count=sum(sizes))
    out, at = [], 0
    with np.errstate(over="ignore"):
        n = len(h) - WORDS + 1
        grams = _mixed(sum(h[k : k + n] * _P[WORDS - 1 - k] for k in range(WORDS))) if n > 0 else h[:0]
        for size in sizes:
            if size >= WORDS:
                out.append(np.unique(grams[at : at + size - WORDS + 1]))
            elif size:
                whole = sum(h[at + k : at + k + 1] * _P[k] for k in range(size))
                out.append(_mixed(whole + np.uint64(size)))
            else:
                out.append(h[:0])
            at += size
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and packed signatures (n x SIG) of non-empty sets, as signed longs."""
    n = len(sets)
    minima = np.empty((HASHES, n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        at = 0
        while at < n:
            end, held = at, 0
            while end < n and (end == at or held + len(sets[end]) <= 32_768):
                held += len(sets[end])
                end += 1
            x = np.concatenate(sets[at:end])
            starts = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
            product = np.empty_like(x)
            for k in range(HASHES):
                np.multiply(x, _A[k], out=product)
                minima[k, at:end] = np.minimum.reduceat(product, starts)
            at = end
        keys = np.empty((n, BANDS), dtype=np.uint64)
        for b in range(BANDS):
            key = np.full(n, b + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = _mixed(key + minima[b * ROWS + r] * _MIX[b, r])
            keys[:, b] = key
        low = (minima >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
        sig = np.zeros((n, SIG), dtype=np.uint64)
        per = 64 // BITS
        for k in range(HASHES):
            sig[:, k // per] |= low[k] << np.uint64(BITS * (k % per))
    return keys.view(np.int64), sig.view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches (n x ODD) as signed longs. Two sets' sketches differ in at most as many bits as
    the sets differ in elements, as each such element flips one bit."""
    bits = np.empty((len(sets), 64 * ODD), dtype=np.uint8)
    for i, s in enumerate(sets):
        bits[i] = np.bincount(((s >> np.uint64(40)) % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (a 128-bit digest of the words), bands, s0..s3 and o0..o7 of every row."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches):
        for batch in batches:
            n_shingles, classes, bands, sigs = [], [], [], []
            for _, texts in text_runs(batch):
                words = [words_of(t) for t in texts]
                sets = shingle_sets(words)
                some = [s for s in sets if len(s)]
                found = iter(zip(*sketches(some), odd_sketches(some))) if some else iter(())
                for w, s in zip(words, sets):
                    n_shingles.append(len(s))
                    classes.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None)
                    keys, sig, odd = next(found) if len(s) else (None, [0] * SIG, [0] * ODD)
                    bands.append(keys)
                    sigs.append([*sig, *odd])
            cols = [batch.column("doc_id"), pa.array(n_shingles, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            cols += [pa.array([int(s[i]) for s in sigs], pa.int64()) for i in range(SIG + ODD)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "class", "bands", *SIGNATURE])
        _words.clear()
        idle()

    sig = ", ".join(f"{c} long" for c in SIGNATURE)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, class binary, bands array<long>, {sig}")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted shingle hashes of every row."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in text_runs(batch):
                sets = shingle_sets([words_of(t) for t in texts])
                ends = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "shingles"])
        _words.clear()
        idle()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, shingles array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from the shared low bits: (share of equal minima - 1/2^b) / (1 - 1/2^b)."""
    odd = F.lit(0x5555555555555555)
    differ = None
    for i in range(SIG):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        bits = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        differ = bits if differ is None else differ + bits
    chance = 1.0 / (1 << BITS)
    return ((HASHES - differ) / float(HASHES) - chance) / (1 - chance)


def near_enough(a: str, b: str, link: tuple[int, int] = LINK) -> Column:
    """Whether the odd sketches allow a link. Linked sets differ in at most (n_a + n_b) (1 - J) / (1 + J)
    elements, and the sketches show no more bits than that: a link is never ruled out."""
    differ = None
    for i in range(ODD):
        bits = F.bit_count(F.col(f"{a}.o{i}").bitwiseXOR(F.col(f"{b}.o{i}")))
        differ = bits if differ is None else differ + bits
    return (link[0] + link[1]) * differ <= (link[0] - link[1]) * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles"))


def least_estimate(link: tuple[int, int] = LINK) -> float:
    """The threshold less five standard deviations of the estimate of a pair at the threshold."""
    j, chance = link[1] / link[0], 1.0 / (1 << BITS)
    p = chance + (1 - chance) * j
    return j - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c): the smallest vertex c reachable from each vertex of the edges (a, b).

    Rounds of: the smallest label among a vertex and its neighbours, then the label's own
    label. Each round is a written table; the number of rounds grows with the logarithm of a
    component's length.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("c")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).select(F.col("a").alias("v"), "c", F.lit(None).cast(labels.schema["c"].dataType).alias("old"))
        least = labels.select("v", "c", F.col("c").alias("old")).union(near).groupBy("v").agg(F.min("c").alias("c"), F.max("old").alias("old"))
        own = least.select(F.col("v").alias("c"), F.col("c").alias("c2"))
        new = scratch.write(least.join(own, "c").select("v", F.col("c2").alias("c"), (F.col("c2") != F.col("old")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = new.select("v", "c")
        labels._weftlake_path = new._weftlake_path
        if new.filter("moved").isEmpty():
            scratch.drop(both)
            return labels


def _candidates(alive: DataFrame, round_no: int, link: tuple[int, int], total: int) -> DataFrame:
    """Pairs (a, b, est) of members of a bucket in different components.

    alive: key, part, parts, rep, comp, n_shingles and the signature, total rows. A bucket whose
    members are connected gives none. Leaders meet the members of each part of their bucket in a
    task of its own, and the sketches rule pairs out there.
    """
    # By component first: a bucket's members outside that of its leader are counted without a join.
    draw = F.min(F.struct(F.xxhash64("rep", "key", F.lit(round_no)).alias("h"), F.col("rep"))).alias("first")
    parts = alive.groupBy("key", "comp").agg(F.count("*").alias("c"), draw)
    lead = F.min(F.struct("first.h", "first.rep", "comp", "c")).alias("lead")
    stats = parts.groupBy("key").agg(F.sum("c").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), lead).filter("m > 1 AND lo <> hi")
    stats = stats.select("key", "m", F.col("lead.rep").alias("lead"), F.col("lead.comp").alias("main"), (F.col("m") - F.col("lead.c")).alias("out"))
    chosen = (F.col("m") <= SMALL) | (F.col("rep") == F.col("lead"))
    if round_no:
        draw = FIRST_DRAW * DRAW_GROWTH ** (round_no - 1)
        part = F.pmod(F.xxhash64("rep", "key", F.lit(-round_no)), F.greatest(F.lit(1), F.floor(F.col("out") / draw)))
        chosen = chosen | ((F.col("comp") != F.col("main")) & (part == 0))
    members = join_groups(alive, stats, ["key"], "m", total)
    sig = ["n_shingles", *SIGNATURE]
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    leaders = members.filter(chosen).select("key", every_part, "rep", "comp", *sig).alias("l")
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.comp") != F.col("r.comp"))
    met = met & (estimate("l", "r") >= least_estimate(link)) & near_enough("l", "r", link)
    # The other side of a small bucket's pair is a leader too; it is kept once.
    pairs = leaders.join(members.select("key", "part", "rep", "comp", *sig).alias("r"), met)
    return pairs.select(
        F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"), F.col("r.rep").alias("member"), estimate("l", "r").alias("est")
    )


def near_groups(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_id.

    Documents are linked if link[0] * intersection >= link[1] * union of their shingles.

    docs needs doc_id and text; other columns are ignored, whatever their names. Texts without
    words (null, empty, blank) have n_shingles 0 and are linked with nothing. doc_id is a key:
    repeated rows of a doc_id share its component. A row with a null doc_id is linked with
    nothing: component_id is null and it is kept. Texts of any length give their whole set of
    shingles. An empty table gives an empty result.
    """
    if not 0 < link[1] <= link[0] or (1 - (link[1] / link[0]) ** ROWS) ** BANDS > MOST_MISSED:
        raise ValueError(f"the bands would miss linked pairs at {link[1]}/{link[0]}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "near_dedup")
    sig = SIGNATURE
    sk = scratch.write(sketch(docs), "sketch")
    linked = sk.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = [F.first(c).alias(c) for c in ["bands", "n_shingles", *sig]]
    reps = scratch.write(linked.groupBy("class").agg(F.min("doc_id").alias("rep"), *first), "classes")

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    # Buckets with the same members, as most bands of a group of copies give, count once.
    same = ["m", "x", "y"]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(SEED))).alias("y")).filter("m > 1")
    wanted = scratch.write(buckets.groupBy(*same).agg(F.min("key").alias("key")).select("key", "m"), "wanted")
    # A large bucket is dealt over parts, so that no task meets a whole one.
    parts = F.ceil(F.col("m") / PART).cast("int")
    dealt = join_groups(keyed, wanted, ["key"], "m", BANDS * reps.count()).select("rep", "key", parts.alias("parts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("parts").cast("long")).cast("int"))
    buckets = scratch.write(dealt, "buckets")
    # Signatures join the members of shared buckets only, a small part of all classes.
    members = scratch.write(buckets.join(reps.select("rep", "n_shingles", *sig), "rep"), "members").withColumn("comp", F.col("rep"))
    scratch.drop(buckets)
    scratch.drop(wanted)
    total = members.count()

    taking_part = scratch.write(members.select(F.col("rep").alias("doc_id")).distinct(), "taking_part")
    texts = docs.select("doc_id", "text").join(counted(taking_part), "doc_id", "left_semi")
    sets = scratch.write(full_sets(texts), "sets")

    tested, comp, stage = None, None, 0
    while True:
        alive = members
        if comp is not None:
            alive = members.drop("comp").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        pairs = _candidates(alive, stage, link, total).select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        links = scratch.write(_confirmed(pairs, sets, link), "links")
        tested = pairs if tested is None else tested.union(pairs)
        if not links.isEmpty():
            comp = _joined(comp, links, scratch)
        largest = _largest(members, comp)
        if not largest or stage and FIRST_DRAW * DRAW_GROWTH ** (stage - 1) >= largest:
            break  # connected, or the last draw took every member outside its bucket's main component
        stage += 1

    out = sk.select("doc_id", "n_shingles", "class").join(reps.select("class", "rep"), "class", "left")
    if comp is not None:
        out = out.join(comp, "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast(docs.schema["doc_id"].dataType))
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id")
    return scratch.result(out.select("doc_id", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"), class_id))


def _confirmed(pairs: DataFrame, sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    sized = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"{k}_set"))
    both = pairs.join(sized("a"), "a").join(sized("b"), "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    union = F.size("a_set") + F.size("b_set") - F.col("common")
    return both.filter(link[0] * F.col("common") >= link[1] * union).select("a", "b")


def _joined(comp: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, comp) after more links; classes without a link have no row."""
    if comp is None:
        return components(links, scratch).select(F.col("v").alias("rep"), F.col("c").alias("comp"))
    to = lambda k: comp.select(F.col("rep").alias(k), F.col("comp").alias(f"{k}_c"))
    ends = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
    ends = ends.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"), F.col("a").alias("u"), F.col("b").alias("w"))
    ends = scratch.write(ends, "ends")
    merged = components(ends.select("a", "b"), scratch).select(F.col("v").alias("comp"), F.col("c").alias("to"))
    every = comp.union(ends.select(F.col("u").alias("rep"), F.col("a").alias("comp"))).union(ends.select("w", "b")).distinct()
    return scratch.write(every.join(merged, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "components")


def _largest(members: DataFrame, comp: DataFrame | None) -> int:
    """The most members of a large bucket that still holds more than one component; 0 if there is none."""
    alive = members.select("key", "rep")
    if comp is not None:
        alive = alive.join(comp, "rep", "left").select("key", F.coalesce("comp", "rep").alias("rep"))
    by = alive.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    return by.filter(f"m > {SMALL} AND lo <> hi").agg(F.max("m")).first()[0] or 0


def drop_near_copies(docs: DataFrame, link: tuple[int, int] = STAGE_LINK) -> DataFrame:
    """docs, all columns, with one document of each group of near copies: the one with the smallest doc_id.

    Texts without words (null, empty, blank) and rows with a null doc_id stay, and so do all rows of a
    repeated doc_id that stays. Texts of any length are compared whole. An empty table stays
    empty; no column is added, so names cannot clash.
    """
    return drop_ids(docs, near_groups(docs, link).filter("NOT kept").select("doc_id").distinct())


def op3(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), LINK)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v
), m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v
), k AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE 'doc ' || doc_id END, len(w) > 0) AS class_id FROM w
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept, class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id JOIN k USING (doc_id)
"""
