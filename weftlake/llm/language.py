"""Language identification with hyperdimensional profiles (operator 10).

Each letter has a random vector of +1 and -1 of its own, drawn by a seeded hash of its code
point. An n-gram is bound by permuting its letters' vectors by their place and multiplying
them; a document's vector is the bundle (sum) of its n-grams, a language's prototype the bundle
of its training documents' unit vectors, and a document gets the language of the closest
prototype by cosine.

A run of texts is counted first: its distinct n-grams are bound once, and a matrix product by
blocks of n-grams bundles all its documents. Nothing is kept between runs. Prototypes are
fitted on a bounded, documented sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftlake.llm.common import BROADCAST_IDS, crc_mod, documents, idle, partitions, text_runs

DIM = 512
GRAM = 3
SEED = 20_011
#: The code point that stands for everything but letters.
BLANK = 32
#: The documented bound of the training sample: rows of each language, chosen by a hash.
TRAIN_ROWS = 4000
#: Texts and characters bundled at a time, and n-grams of a block of the matrix product.
RUN_ROWS, RUN_CHARS, BLOCK_GRAMS = 128, 400_000, 4096
#: Largest range of numbers that is ranked by a table (5 bytes each) instead of a sort.
TABLE = 2_000_000
UNKNOWN = "und"


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vectors (n x DIM, +1 and -1) of code points, by a seeded hash of each."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(SEED)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _letters(points: np.ndarray) -> np.ndarray:
    """Which of some distinct code points are letters."""
    return np.fromiter((unicodedata.category(chr(p))[0] == "L" for p in points.tolist()), dtype=bool, count=len(points))


def ranked(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (all below size) in order and each value's place among them."""
    if size > TABLE:
        return np.unique(values, return_inverse=True)
    there = np.zeros(size, dtype=bool)
    there[values] = True
    distinct = np.flatnonzero(there)
    place = np.empty(size, dtype=np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[values].astype(np.int64)


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct code points of the texts (letters and BLANK), the n-grams of all texts in the number
    system of these points, and each text's number of n-grams. Texts are in lower case, with one
    blank before, between and after words."""
    raw = [f" {t.lower()} ".encode("utf-32-le", "replace") for t in texts]
    points = np.frombuffer(b"".join(raw), dtype=np.uint32)
    known, codes = ranked(points, 0x110000)
    letters = _letters(known)
    known = np.concatenate([[BLANK], known[letters]])
    codes = np.where(letters, np.cumsum(letters), 0)[codes]
    grams, sizes, at = [], [], 0
    for r in raw:
        c = codes[at : at + len(r) // 4]
        at += len(r) // 4
        blank = c == 0
        c = c[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
        n = max(0, len(c) - GRAM + 1)
        out = c[:n].astype(np.int64)
        for p in range(1, GRAM):
            out = out * len(known) + c[p : n + p]
        grams.append(out)
        sizes.append(n)
    return known, np.concatenate(grams), np.array(sizes)


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each text, and whether it has a letter."""
    known, grams, sizes = gram_ids(texts)
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    if len(grams):
        letters = letter_vectors(known)
        by_place = [np.roll(letters, GRAM - 1 - p, axis=1) for p in range(GRAM)]
        distinct, which = ranked(grams, len(known) ** GRAM)
        row = np.repeat(np.arange(len(texts)), sizes)
        blocks = -(-len(distinct) // BLOCK_GRAMS)
        order = np.argsort(which // BLOCK_GRAMS, kind="stable") if blocks > 1 else slice(None)
        row, which = row[order], which[order]
        ends = np.searchsorted(which // BLOCK_GRAMS, np.arange(blocks), side="right")
        lo = 0
        for b, hi in enumerate(ends.tolist()):
            rest = distinct[b * BLOCK_GRAMS : (b + 1) * BLOCK_GRAMS]
            width = len(rest)
            vectors = by_place[GRAM - 1][rest % len(known)]
            for p in range(GRAM - 2, -1, -1):
                rest = rest // len(known)
                vectors = vectors * by_place[p][rest % len(known)]
            counts = np.bincount(row[lo:hi] * width + which[lo:hi] - b * BLOCK_GRAMS, minlength=len(texts) * width)
            out += counts.reshape(len(texts), width).astype(np.float32) @ vectors.astype(np.float32)
            lo = hi
    return out, sizes > 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def training_sample(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> DataFrame:
    """Labelled rows outside the held-out quarter, about rows_per_lang of each language at most."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(crc_mod(4) != 2)
    # One row a language reaches the driver, as its prototype does later.
    found = [(r["lang"], float(rows_per_lang) / r["count"]) for r in rows.groupBy("lang").count().collect()]
    per = docs.sparkSession.createDataFrame(found, "lang string, share double")
    per = F.broadcast(per) if len(found) <= BROADCAST_IDS else per
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    return rows.select("doc_id", "lang", "text").join(per, "lang").filter(draw < F.col("share")).select("lang", "text")


def fit(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> dict[str, list[float]]:
    """A unit prototype for each language: sums by task, then by language."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in text_runs(batch, chars=RUN_CHARS, rows=RUN_ROWS):
                for lang, v in zip(langs[at:], _unit(bundles(texts)[0])):
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])
        idle()

    def merged(t: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(b, dtype=np.float64) for b in t.column("v").to_pylist())
        return pa.table({"lang": t.column("lang")[:1], "v": pa.array([(v / max(np.linalg.norm(v), 1e-9)).tobytes()], pa.binary())})

    sample = training_sample(docs, rows_per_lang)
    parts = sample.repartition(partitions(docs.sparkSession)).mapInArrow(sums, "lang string, v binary")
    # One vector of DIM numbers a language reaches the driver.
    found = parts.groupBy("lang").applyInArrow(merged, "lang string, v binary").collect()
    return {r["lang"]: np.frombuffer(r["v"], dtype=np.float64).tolist() for r in sorted(found, key=lambda r: r["lang"])}


def predictor(prototypes: dict[str, list[float]]):
    """A column function: text -> struct<lang, score>. `und` and 0 for a null text, one without
    a letter, or without any prototype. The score is the cosine, negative values as 0; of
    languages with the same cosine the first in alphabetical order is given."""
    langs = np.array(list(prototypes), dtype=object)
    table = np.array(list(prototypes.values()), dtype=np.float32).reshape(len(langs), DIM)
    schema = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])

    @F.arrow_udf(schema)
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            lang = np.full(len(column), UNKNOWN, dtype=object)
            score = np.zeros(len(column))
            batch = pa.RecordBatch.from_arrays([column.fill_null("")], ["text"])
            for at, texts in text_runs(batch, chars=RUN_CHARS, rows=RUN_ROWS) if len(langs) else ():
                vectors, letters = bundles(texts)
                cosine = _unit(vectors) @ table.T
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
                lang[at : at + len(texts)] = np.where(letters, langs[best], UNKNOWN)
                score[at : at + len(texts)] = np.where(letters, top, 0.0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])
        idle()

    return predict


def identify(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    docs needs doc_id, text and lang; other columns are ignored, whatever their names. lang
    serves training alone, never a prediction; every value of it is learned. A null or empty
    text, or one without a letter, is `und` with score 0. Repeated rows get the same answer;
    of languages with equal cosines the alphabetically first is given. Texts of any length
    are read whole. An empty table gives an empty result, one without a label `und` alone.
    """
    predict = predictor(fit(docs, rows_per_lang))
    rows = docs.select("doc_id", (crc_mod(4) == 2).alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_known(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> DataFrame:
    """docs, same columns and rows, without the documents whose language cannot be told: null and
    empty texts and those without a letter (all, where no row has a label). Repeated rows stay or go
    together, texts of any length are read whole, and no column is added, so none can clash."""
    predict = predictor(fit(docs, rows_per_lang))
    return docs.filter(predict("text")["lang"] != UNKNOWN)


def op10(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
