"""Quality rules, line first (operator 7), DataFrame functions only.

Each line is judged on its own: lines without any sentence mark, navigation lines and
boilerplate lines are removed, and a document fails if the removed lines held more than half
of its characters. The base statistics of the whole text stand beside that verdict. All of it
is array expressions over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import SPACE, SPACE_CHARS, documents, text_or_empty

#: Phrases of page furniture, looked up in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled", "lorem ipsum",
    "privacy policy", "subscribe to our newsletter", "terms of service", "terms of use", "use of cookies",
)
#: A line of at most four words that starts with one of these and ends no sentence is navigation.
NAVIGATION = (
    "about us", "back to top", "click here", "contact us", "home", "log in", "login", "main menu", "menu",
    "next page", "previous page", "read more", "register", "search", "share this", "sign in", "sign up", "skip to",
)
#: A line of so many words or more should hold a sentence mark.
LEAST_WORDS = 3
SENTENCE_MARK = r"[.!?,;:…。！？\"»”]"
#: Removed characters over all characters, above which a document fails.
MAX_LOST = 0.5
GRAM = 5


def line_fails(line: Column) -> Column:
    """Whether a line that has a word is removed."""
    low = F.lower(F.trim(line))
    n = F.size(F.filter(F.split(low, SPACE), lambda w: w != ""))
    no_mark = (n >= LEAST_WORDS) & ~line.rlike(SENTENCE_MARK)
    navigation = (n <= 4) & ~line.rlike(r"[.!?…]\s*$") & low.rlike(r"^\W*(" + "|".join(NAVIGATION) + r")\b")
    bars = (F.length(line) - F.length(F.translate(line, "|›»", ""))) >= 3
    return no_mark | navigation | bars | low.rlike("|".join(BOILERPLATE))


def quality(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the base statistics, base_failed, line statistics and kept.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text
    counts as empty: no words, so base_failed. Repeated rows are judged each. Lines without a
    word are neither judged nor counted as lost. A text of any length is judged whole.
    """
    df = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0).alias("lines"),
    )
    n = F.size("words")
    gram = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(GRAM)])
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), n - GRAM), gram)).otherwise(F.array().cast("array<bigint>")).alias("grams"),
        F.size("lines").alias("n_lines"),
        F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)).alias("line_chars"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("good"),
    )
    # A window is repeated if it equals a neighbour in the sorted windows; most texts have none.
    tagged = F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    )
    df = df.withColumn("tagged", tagged)
    same = lambda t, j: F.coalesce(F.get("tagged", j)["g"] == t["g"], F.lit(False))
    starts = F.transform(F.filter("tagged", lambda t, j: same(t, j - 1) | same(t, j + 1)), lambda t: t["i"])
    df = df.withColumn("starts", F.array_sort(starts))
    # Each repeated window covers its five words, or as many as stand before the next one.
    cover = F.aggregate(
        "starts",
        F.struct(F.lit(-GRAM).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("at"), (a["n"] + F.least(F.lit(GRAM), s - a["at"])).alias("n")),
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(cover["n"]))
    good_chars = F.aggregate("good", F.lit(0), lambda a, x: a + F.length(x))
    df = df.withColumn("lost_chars", F.col("line_chars") - good_chars)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("lost_chars") <= MAX_LOST * F.col("line_chars"))).alias("kept"),
        "n_lines",
        (F.col("n_lines") - F.size("good")).alias("n_removed_lines"),
        "lost_chars",
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


_W = r"[\x20\x09-\x0D]"
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), c AS (
  SELECT doc_id, CAST(sum(least(5, i - prev)) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5) AS prev FROM r) GROUP BY doc_id
), l AS (SELECT doc_id, unnest(lines) AS line FROM d
), j AS (
  SELECT doc_id, length(line) AS chars,
    (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LEAST_WORDS} AND NOT regexp_matches(line, '[.!?,;:…。！？"»”]'))
    OR (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= 4 AND NOT regexp_matches(line, '[.!?…]\s*$')
        AND regexp_matches(lower(trim(line)), '^\W*({"|".join(NAVIGATION)})\b'))
    OR length(line) - length(translate(line, '|›»', '')) >= 3
    OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS fails
  FROM l
), k AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (fails) AS INTEGER) AS n_removed_lines,
         CAST(coalesce(sum(chars) FILTER (fails), 0) AS INTEGER) AS lost_chars, sum(chars) AS line_chars
  FROM j GROUP BY doc_id
), s AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{_W}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost_chars, 0) AS lost_chars,
         coalesce(line_chars, 0) AS line_chars
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= {MAX_LOST} * line_chars AS kept,
       n_lines, n_removed_lines, lost_chars
FROM s
"""
