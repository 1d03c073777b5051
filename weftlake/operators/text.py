"""Extractive text operators."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry no content.
STOP = (
    "a an the and or of to in on for with by from at as is are was were be been being this that these those it its we our they their which who whom what when "
    "where how than then also not no but into over under such can may might will would should could has have had do does did using use used based via between "
    "among more most less both each other there here i you he she"
).split()
#: Abbreviations that keep their full stop, and the one that keeps it before a number.
ABBREVIATIONS = ("Fig", "Figs", "Dr", "Mr", "Mrs", "Ms", "Prof", "Eq", "vs", "al", r"e\.g", r"i\.e")
BEFORE_NUMBER = "etc"
#: The characters that may open a sentence, full stops of scripts without blanks, and these scripts.
OPENING = "0-9A-ZÀ-ÖØ-Þ"
FULL_STOPS = "。！？"
UNSEGMENTED = r"぀-ヿ㐀-鿿가-힯"
#: Fixed value: a sentence that tells a model to ignore its instructions.
OVERRIDE = r"(?is)\b(?:ignore|disregard|forget)\b.{0,80}\b(?:instruction|instructions|prompt|prompts)\b|\byou are now\b|\bnew instructions\b"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits of any script, without stop words and single characters, then the
    two-character windows of scripts written without blanks (whose whole words are left out)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP) & ~w.rlike(f"^[{UNSEGMENTED}]+$"))
    return F.concat(words, cjk_bigrams(text))


def cjk_bigrams(text: str | Column) -> Column:
    """Two-character windows of runs of scripts written without blanks."""
    runs = F.regexp_extract_all(text, F.lit(f"[{UNSEGMENTED}]{{2,}}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))


def token_counts(docs: DataFrame, top: int) -> DataFrame:
    """Documents and occurrences of each token, the most frequent first."""
    t = docs.select("id", F.explode(tokens("text")).alias("token"))
    return t.groupBy("token", "id").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "token").limit(top)


def sentences(text: str | Column) -> Column:
    """Sentences of more than three characters. A stop mark ends one where white space and a capital or a
    digit follow, full stops of scripts without blanks always do; abbreviations keep theirs."""
    kept = "|".join(ABBREVIATIONS)
    held = F.regexp_replace(text, rf"(?iU)\b({kept}|{BEFORE_NUMBER}(?=\.\s+\d))\.", "$1\x01")
    parts = F.split(held, rf"(?U)(?<=[.!?])\s+(?=[{OPENING}])|(?<=[{FULL_STOPS}])")
    return F.filter(F.transform(parts, lambda s: _trimmed(F.replace(s, F.lit("\x01"), F.lit(".")))), lambda s: F.length(s) > 3)


def overrides(text: str | Column) -> Column:
    """Whether a text tells a model to ignore its instructions."""
    return F.regexp_like(text, F.lit(OVERRIDE))


def best_sentences(docs: DataFrame, query: list[str], top: int) -> DataFrame:
    """BM25-lite: each sentence scores the sum of log(1 + N / df) over the query's terms in it, over the root of
    its number of tokens; N counts all sentences of the document, df those with the term. The best of each document."""
    s = docs.select("id", sentences("text").alias("s")).select("id", F.size("s").alias("n"), F.posexplode("s").alias("pos", "sentence")).withColumn("t", tokens("sentence"))
    asked = F.array(*[F.lit(q) for q in dict.fromkeys(query)])
    hit = s.select("id", "n", "pos", "sentence", F.size("t").alias("len"), F.explode(F.array_intersect(asked, "t")).alias("term"))
    df = hit.groupBy("id", "term").agg(F.count("*").alias("df"))
    score = F.round(F.sum(F.log(1 + F.col("n") / F.col("df"))) / F.sqrt(F.first("len")), 6)
    rows = hit.join(df, ["id", "term"]).groupBy("id", "pos", "sentence").agg(score.alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("id", "pos", "score", "rank", F.length("sentence").alias("chars"))


def summarize(docs: DataFrame, n: int = 3) -> DataFrame:
    """Extractive summary (id, summary) of (id, title, text): sentences by the summed frequency of their tokens in the
    text, each title token counting three more, over the root of their number of tokens; the first one
    times 1.15; the n best in original order, all where there are no more. Overrides are left out where
    other sentences are left; a text without a sentence gives an empty summary. A document is scored
    in its own row: nothing is shuffled."""
    split = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("title", F.lit("")).alias("title")).withColumn("every", sentences("text"))
    kept = split.withColumn("kept", F.filter("every", lambda s: ~overrides(s)))
    kept = kept.withColumn("s", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("every")))
    prepared = kept.select("id", "s", F.transform("s", tokens).alias("t"), tokens("text").alias("all"), tokens("title").alias("title"))

    def chosen(parts, toks, every, title) -> str:
        if len(parts) <= n:
            return " ".join(parts)
        weight = Counter(every)
        for t in title:
            weight[t] += 3
        score = [round(sum(weight[w] for w in t) / max(len(t), 1) ** 0.5 * (1 if i else 1.15), 9) for i, t in enumerate(toks)]
        best = sorted(range(len(parts)), key=lambda i: (-score[i], i))[:n]
        return " ".join(parts[i] for i in sorted(best))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "summary": [chosen(*x) for x in zip(pdf["s"], pdf["t"], pdf["all"], pdf["title"])]})

    return prepared.mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, summary string")


def grounded(answer: Column, source: Column, least: float = 0.6) -> Column:
    """Whether an answer is grounded: it is no override, at least 60% of its content words and all its numbers
    (decimals whole) are in the source, of which overrides are no evidence."""
    kept = F.filter(sentences(source), lambda s: ~overrides(s))
    body = F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(source)
    content = lambda c: F.array_distinct(F.filter(tokens(c), lambda w: ~w.rlike(r"^\p{Nd}+$")))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    got, have = content(answer), content(body)
    enough = (F.size(got) > 0) & (F.size(have) > 0) & (F.size(F.array_intersect(got, have)) >= least * F.size(got))
    return ~overrides(answer) & enough & (F.size(F.array_except(numbers(answer), numbers(body))) == 0)


def one_line(summary: str | Column) -> Column:
    """The first sentence of a summary, the summary itself where it has none; null for an empty one."""
    s = F.col(summary) if isinstance(summary, str) else summary
    return F.when(s != "", F.coalesce(F.get(sentences(s), 0), s))


def last_turns(turns: DataFrame, n: int = 2, width: int = 1000) -> DataFrame:
    """The last n turns of each conversation, each cut to width characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    rows = turns.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return rows.select("conv_id", "turn", "role", F.substring("text", 1, width).alias("text"), "rank")
