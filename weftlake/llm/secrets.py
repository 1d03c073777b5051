"""Secret scans driven by a trigram index (operator 4), DataFrame functions only.

Each rule's regular expression is parsed on the driver into a Boolean query over the trigrams
that any match must hold: literals in sequence are ANDed, alternatives ORed, optional or
repeated classes demand nothing. One pass of the texts builds the inverted index of the
queries' trigrams: postings (trigram, document), written to the shared folder. The lists are
merged by document, where each rule's query intersects and unites them; a rule's regex
then runs only on the documents that its query leaves. Rules without a mandatory trigram scan
every text. Lists are merged map-side first, as all postings of a document come from one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, counted, documents, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


#: Fixed by the contract: the three base rules, in the order that breaks ties. A run of hex
#: digits is matched whole, so the least length can stand in the pattern.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Published formats that the method adds: PEM private key headers and Slack tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)
RULES = BASE_RULES + MORE_RULES

ANY = ("any",)
#: A set of candidates (their ids and rules, about 80 bytes each) is broadcast up to so many, else joined by a shuffle.
BROADCAST_CANDIDATES = 250_000


def _all(parts: list) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query that each match of pattern satisfies: ("tri", x), ("and", ...),
    ("or", ...) or ("any",) if no trigram is mandatory. Trigrams are in lower case."""

    def of(items) -> tuple:
        found, run = [], ""

        def end() -> None:
            nonlocal run
            found.extend(("tri", run[i : i + 3]) for i in range(len(run) - 2))
            run = ""

        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            end()
            if op is sre.SUBPATTERN:
                found.append(of(arg[3]))
            elif op is sre.BRANCH:
                choices = [of(x) for x in arg[1]]
                found.append(ANY if ANY in choices else ("or", *choices))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        end()
        return _all(found)

    return of(_parser.parse(pattern))


def trigrams(query: tuple) -> list[str]:
    return [query[1]] if query[0] == "tri" else [t for part in query[1:] for t in trigrams(part)]


def _holds(query: tuple, number: dict[str, int]) -> Column:
    """Whether a document's merged postings satisfy a query."""
    if query[0] == "tri":
        return F.array_contains("trigrams", F.lit(number[query[1]]))
    out = _holds(query[1], number)
    for part in query[2:]:
        out = (out & _holds(part, number)) if query[0] == "and" else (out | _holds(part, number))
    return out


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: (trigram, _key), trigram being its number in wanted, for each of them that a text holds.
    docs: _key and text."""
    lower = docs.select("_key", F.lower("text").alias("lower"))
    there = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    return lower.select(F.explode(there).alias("trigram"), "_key")


def candidates(index: DataFrame, queries: list[tuple], wanted: list[str]) -> DataFrame:
    """_key and the numbers of the rules whose queries the document's postings satisfy, where there are any."""
    number = {t: i for i, t in enumerate(wanted)}
    merged = index.groupBy("_key").agg(F.collect_set("trigram").alias("trigrams"))
    rules = F.array_compact(F.array(*[F.when(_holds(q, number), F.lit(k)) for k, q in enumerate(queries) if q != ANY]))
    return merged.select("_key", rules.alias("rules")).filter(F.size("rules") > 0)


def _spans(order: int, hits: str, values: str, gaps: str, least: int) -> Column:
    """The kept matches as (start, order, end). The gaps between matches give the places."""

    def step(acc, i):
        start = acc["at"] + F.length(F.col(gaps)[i])
        end = start + F.length(F.col(hits)[i])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        kept = F.when(F.length(F.col(values)[i]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    some = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), zero, step)["out"]
    return F.when(F.size(hits) > 0, some).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: str = "doc_id", key: str = "doc_id") -> DataFrame:
    """One row per input row: the column `keep`, text and `found`, the spans in order of start, then rule.

    docs needs text, keep and key, by which the index knows a document; other columns are ignored,
    whatever their names. Rows that share a key, or have none, are candidates together. A null or
    empty text has no span. Places count code points, ends are exclusive. Repeated rows are
    scanned each. Texts of any length are scanned whole. An empty table gives an empty result.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = list(dict.fromkeys(t for q in queries if q != ANY for t in trigrams(q)))
    df = docs.select(F.col(keep).alias("_keep"), F.col(key).alias("_key"), text_or_empty().alias("text"))
    if wanted:
        scratch = Scratch(docs.sparkSession, "secrets")
        index = scratch.write(postings(df.select("_key", "text"), wanted), "postings")
        found = scratch.result(candidates(index, queries, wanted))
        found = counted(found.select(F.col("_key").alias("_found"), "rules"), BROADCAST_CANDIDATES)
        df = df.join(found, F.col("_key").eqNullSafe(F.col("_found")), "left")
    else:
        df = df.withColumn("rules", F.lit(None).cast("array<int>"))
    df = df.select(F.col("_keep").alias(keep), "text", "rules")
    chosen = [F.lit(True) if q == ANY else F.coalesce(F.array_contains("rules", F.lit(k)), F.lit(False)) for k, q in enumerate(queries)]
    none = F.array().cast("array<string>")
    pattern = [("(?i)" if r.ignore_case else "") + r.pattern for r in rules]
    df = df.withColumns({f"h{k}": F.when(c, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, (c, p) in enumerate(zip(chosen, pattern))})
    more = {}
    for k, (r, p) in enumerate(zip(rules, pattern)):
        more[f"g{k}"] = F.when(F.size(f"h{k}") > 0, F.split("text", p, -1)).otherwise(none)
        if r.group:
            more[f"v{k}"] = F.when(F.size(f"h{k}") > 0, F.regexp_extract_all("text", F.lit(p), F.lit(r.group))).otherwise(none)
    df = df.withColumns(more)
    found = [_spans(k, f"h{k}", f"v{k}" if r.group else f"h{k}", f"g{k}", r.least) for k, r in enumerate(rules)]
    return df.select(keep, "text", F.array_sort(F.concat(*found)).alias("found"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans, one row per input row; odd input as `scan_secrets` has it."""
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE_RULES))
    return scan_secrets(docs, rules).select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(_joined(base, rules), 256).alias("base_sha256"),
        _joined(F.col("found"), rules).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs, same columns, with every span of the text replaced by mark; overlapping spans become one.

    docs needs doc_id and text. n_chars, where it is a column, is brought up to date. Rows without a
    span, with a null or an empty text are unchanged; repeated rows are changed alike, texts of any length
    whole. The input's columns travel in one struct, so their names cannot clash with inner ones.
    An empty table stays empty.
    """
    cols = docs.columns
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_w_row"))
    scanned = scan_secrets(rows, rules, "_w_row", "_w_row.doc_id")

    def step(acc, s):
        new = s["start"] >= acc["at"]
        piece = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(new, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walk = F.aggregate("found", zero, step)
    scanned = scanned.withColumn("_w_walk", F.when(F.size("found") > 0, walk))
    rest = F.substring(F.col("text"), F.col("_w_walk.at") + 1, F.length("text"))
    clean = F.concat(F.array_join("_w_walk.out", mark), F.lit(mark), rest)
    clean = F.when(F.col("_w_walk").isNull(), F.col("_w_row.text")).otherwise(clean)
    scanned = scanned.withColumn("_w_clean", clean)
    out = {c: F.col(f"_w_row.`{c}`") for c in cols} | {"text": F.col("_w_clean")}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.col("_w_walk").isNull(), out["n_chars"]).otherwise(F.length("_w_clean").cast(docs.schema["n_chars"].dataType))
    return scanned.select(*[out[c].alias(c) for c in cols])


def op4(spark, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def _sql_kind(k: int, r: Rule) -> str:
    pattern = (("(?i)" if r.ignore_case else "") + r.pattern).replace("'", "''")
    return f"""
  SELECT doc_id, {k} AS kind, '{r.kind}' AS name,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS start,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS stop
  FROM (
    SELECT doc_id, h, v, g, unnest(range(1, len(h) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, regexp_extract_all(text, '{pattern}', {r.group}) AS v,
             string_split_regex(text, '{pattern}') AS g
      FROM documents WHERE text IS NOT NULL)
  ) WHERE length(v[i]) >= {r.least}"""


OP4_SQL = f"""
WITH spans AS ({" UNION ALL ".join(_sql_kind(k, r) for k, r in enumerate(RULES))}
), s AS (SELECT *, name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS t FROM spans)
SELECT doc_id,
       count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (kind < {len(BASE_RULES)}), '')) AS base_sha256,
       coalesce(string_agg(t, ',' ORDER BY start, kind), '') AS spans
FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id
"""
