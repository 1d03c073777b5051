"""Pattern mining: frequent itemsets and rules over sliding windows in one plan.

A miner's groups (windows, or countries and windows) are ordinary columns, so all groups are
mined by the same joins and no driver loop runs over them. The miner goes level by level, to
any length: a basket's frequent sets are extended by its later items, after a semi-join with the
candidates, whose every part is frequent. Each level's patterns are written once and reused
by the next level and by whatever reads the result. Baskets are reduced to distinct baskets of a
year (and country) with a weight before they are dealt over windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.session import counted, cut

SEP = " | "


def itemset(*items: str | Column) -> Column:
    return F.concat_ws(SEP, *items)


def filter_topics(work_topics: DataFrame, min_score: float = 0.0, field: str | None = None, exclude: list[str] = ()) -> DataFrame:
    """The miner's constraints, applied before baskets are built. As with NOT IN, a null
    topic is not kept when topics are excluded, and a null score never passes."""
    out = work_topics.filter(F.col("score") >= min_score)
    if field is not None:
        out = out.filter(F.col("field") == field)
    return out.filter(~F.col("topic").isin(list(exclude))) if exclude else out


def baskets(works: DataFrame, work_topics: DataFrame, include: str | None = None) -> DataFrame:
    """work_id, pub_year and the sorted distinct topics of works with two topic rows or more.

    The size rule counts rows before names are made distinct; include applies after it.
    """
    b = work_topics.groupBy("work_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("topic")).alias("items")).filter("n >= 2")
    if include is not None:
        b = b.filter(F.array_contains("items", include))
    return b.join(works.select("work_id", "pub_year"), "work_id").select("work_id", "pub_year", "items")


def window_starts(rows: DataFrame, lo: int, hi: int, width: int = 3, step: int = 1) -> DataFrame:
    """Each row once for each window [start, start + width) of lo..hi that holds its year."""
    first = F.greatest(F.lit(lo), F.col("pub_year") - (width - 1))
    first = first + F.pmod(F.lit(lo) - first, F.lit(step))
    last = F.least(F.col("pub_year"), F.lit(hi - width + 1))
    starts = F.when(first <= last, F.sequence(first, last, F.lit(step)))
    return rows.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + (width - 1))


def anchored_starts(rows: DataFrame, width: int = 3, step: int = 1) -> DataFrame:
    """Starts anchored to multiples of step: the first is year - width + 1, raised to a multiple."""
    first = F.col("pub_year") - (width - 1)
    first = first + F.pmod(-first, F.lit(step))
    return rows.withColumn("window_start", F.explode(F.when(first <= F.col("pub_year"), F.sequence(first, F.col("pub_year"), F.lit(step)))))


def complete_windows(dealt: DataFrame, run_year: int | None = None, min_year: int | None = None) -> DataFrame:
    """Without windows that end after the run's year or start before the corpus does: they hold partial data."""
    out = dealt if run_year is None else dealt.filter(F.col("window_end") <= run_year)
    return out if min_year is None else out.filter(F.col("window_start") >= min_year)


def multiset(grouped: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct baskets of each group with their number; the state of the incremental miner."""
    return grouped.groupBy(*groups, "items").agg(F.count("*").alias("weight"))


class Windows:
    """How baskets counted by year (beside the other group columns) make up windows."""

    def __init__(self, lo: int, hi: int, width: int, step: int, others: list[str] = ()):
        self.span, self.base, self.groups = (lo, hi, width, step), [*others, "pub_year"], [*others, "window_start", "window_end"]

    def deal(self, rows: DataFrame) -> DataFrame:
        return window_starts(rows, *self.span).drop("pub_year")

    def years(self, rows: DataFrame, *cols: str) -> DataFrame:
        """Of rows by window, cols by each year of the window, once."""
        return rows.withColumn("pub_year", F.explode(F.sequence("window_start", "window_end"))).select(*self.base, *cols).distinct()


def frequent(weighted: DataFrame, groups: list[str], min_support: float, max_len: int | None = 3, min_baskets: int = 1, min_count: int = 1, windows: Windows | None = None) -> DataFrame:
    """Groups, itemset, k, support_count, n_tx, support of all frequent sets of up to max_len items
    (None: of any length).

    weighted has the group columns, items (distinct, sorted) and weight. A set is frequent from
    max(min_count, ceil(min_support * n_tx)) baskets; groups under min_baskets are skipped. With windows,
    weighted is by year: a basket is taken apart once, and only counts are dealt over the windows that
    hold its year. The result reads written tables, one a level.
    """
    if max_len is not None and max_len < 1:
        raise ValueError("max_len must be at least 1")
    base = windows.base if windows else groups
    dealt = windows.deal if windows else lambda rows: rows
    by_base = windows.years if windows else lambda rows, *cols: rows.select(*groups, *cols)
    weighted = cut(weighted.select(*base, "items", "weight"), "weighted")
    n = dealt(weighted.groupBy(*base).agg(F.sum("weight").alias("n_tx"))).groupBy(*groups).agg(F.sum("n_tx").alias("n_tx"))
    n = n.filter(F.col("n_tx") >= min_baskets).withColumn("least", F.greatest(F.lit(min_count), F.ceil(F.round(F.lit(min_support) * F.col("n_tx"), 9))).cast("long"))
    n = counted(cut(n, "groups"))

    def level(sets: DataFrame, k: int) -> DataFrame:
        """The frequent ones of occurrences (base, prefix, last, weight), written."""
        counts = sets.groupBy(*base, "prefix", "last").agg(F.sum("weight").alias("support_count"))
        if windows:
            counts = dealt(counts).groupBy(*groups, "prefix", "last").agg(F.sum("support_count").alias("support_count"))
        counts = counts.join(n, groups) if groups else counts.crossJoin(n)  # without groups n is one row
        return cut(counts.filter(F.col("support_count") >= F.col("least")).select(*groups, "prefix", "last", itemset("prefix", "last").alias("itemset"), F.lit(k).alias("k"), "support_count", "n_tx"), f"level{k}")

    one = level(weighted.select(*base, F.lit(None).cast("string").alias("prefix"), F.explode("items").alias("last"), "weight"), 1)
    levels = [one]
    if max_len is None or max_len >= 2:
        # The frequent items of each distinct basket; one with fewer than two is done with.
        good = cut(by_base(one, "last").groupBy(*base).agg(F.collect_set("last").alias("good")), "good")
        held = weighted.join(counted(good), base) if base else weighted.crossJoin(F.broadcast(good))  # one row without groups
        held = held.withColumn("items", F.array_sort(F.array_intersect("items", "good"))).drop("good").filter(F.size("items") >= 2)
        held = held.groupBy(*base, "items").agg(F.sum("weight").alias("weight"))
        held = held if max_len == 2 else cut(held, "baskets")
        ends = F.transform("items", lambda x, i: F.struct(x.alias("itemset"), F.slice("items", i + 2, F.size("items")).alias("rest")))
        sets = held.select(*base, F.inline(ends), "weight")
    on = [*base, "prefix", "last"]
    while max_len is None or len(levels) < max_len:
        k = len(levels) + 1
        last = F.transform("rest", lambda x, i: F.struct(x.alias("last"), F.slice("rest", i + 2, F.size("rest")).alias("rest")))
        grown = sets.filter(F.size("rest") > 0).select(*base, F.col("itemset").alias("prefix"), F.inline(last), "weight")
        if k > 2:
            grown = grown.join(counted(cut(by_base(candidates(levels[-1], groups, k), "prefix", "last"), f"candidates{k}")), on, "left_semi")
        found = level(grown, k)
        if found.isEmpty():
            break
        levels.append(found)
        if len(levels) != max_len:
            sets = grown.join(counted(cut(by_base(found, "prefix", "last"), f"found{k}")), on, "left_semi")
            sets = sets.select(*base, itemset("prefix", "last").alias("itemset"), "rest", "weight")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select(*groups, "itemset", "k", "support_count", "n_tx", (F.col("support_count") / F.col("n_tx")).alias("support"))


def candidates(level: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Sets of k items (groups, prefix, last) whose every part of k - 1 items is in the level."""
    left = level.select(*groups, F.col("prefix").alias("p"), F.col("last").alias("x"), F.col("itemset").alias("prefix"))
    right = level.select(*groups, F.col("prefix").alias("p"), "last")
    joined = left.join(right, [*groups, "p"]).filter("x < last").select(*groups, "prefix", "last")
    items = F.concat(F.split("prefix", r" \| "), F.array("last"))
    # Without its last or last but one item it is one of the two that were joined.
    parts = F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: F.array_join(F.concat(F.slice(items, F.lit(1), i - 1), F.slice(items, i + 1, F.lit(k))), SEP))
    known = level.select(*groups, F.col("itemset").alias("part"))
    whole = joined.withColumn("part", F.explode(parts)).join(known, [*groups, "part"], "left_semi")
    return whole.groupBy(*groups, "prefix", "last").agg(F.count("*").alias("c")).filter(F.col("c") == k - 2).drop("c")


def association_rules(patterns: DataFrame, groups: list[str], min_confidence: float = 0.5, keep_unknown: bool = False) -> DataFrame:
    """Rules with one item as consequent. A rule whose antecedent isn't a pattern is
    dropped, and one whose consequent isn't, too, unless keep_unknown: then its lift is null."""
    items = F.split("itemset", r" \| ")
    many = patterns.filter("k >= 2").select(*groups, "itemset", "support", "support_count", items.alias("items"), F.explode(items).alias("consequent"))
    rest = F.array_join(F.array_remove("items", F.col("consequent")), SEP)
    r = many.select(*groups, rest.alias("antecedent"), "consequent", F.col("support").alias("support"), "support_count")
    of = lambda name, s, c: patterns.select(*groups, F.col("itemset").alias(name), F.col("support").alias(s), F.col("support_count").alias(c))
    r = r.join(of("antecedent", "s_a", "c_a"), [*groups, "antecedent"])
    r = r.join(of("consequent", "s_c", "c_c").drop("c_c"), [*groups, "consequent"], "left" if keep_unknown else "inner")
    confidence = F.col("support_count") / F.col("c_a")
    return r.filter(confidence >= min_confidence).select(*groups, "antecedent", "consequent", "support", confidence.alias("confidence"), (confidence / F.col("s_c")).alias("lift"))


def mine_windows(works: DataFrame, work_topics: DataFrame, lo: int, hi: int, width: int = 3, step: int = 1, min_support: float = 0.02, max_len: int | None = 3, min_baskets: int = 20, include: str | None = None) -> DataFrame:
    """The sliding-window miner: every window's patterns, in one plan."""
    windows = Windows(lo, hi, width, step)
    by_year = multiset(baskets(works, work_topics, include), windows.base)
    return frequent(by_year, windows.groups, min_support, max_len, min_baskets, windows=windows)


def mine_countries(works: DataFrame, work_topics: DataFrame, work_countries: DataFrame, lo: int, hi: int, min_papers: int = 300, min_window: int = 50, width: int = 3, step: int = 1, min_support: float = 0.01, min_count: int = 5, max_len: int | None = 3) -> DataFrame:
    """The same with country in every key, for countries with min_papers papers."""
    b = baskets(works, work_topics)
    big = cut(work_countries.groupBy("country").agg(F.count("*").alias("n")).filter(F.col("n") >= min_papers).select("country"), "countries")
    b = b.join(work_countries.join(counted(big), "country", "left_semi"), "work_id")
    windows = Windows(lo, hi, width, step, ["country"])
    return frequent(multiset(b, windows.base), windows.groups, min_support, max_len, min_window, min_count, windows)


# -- reports on stored patterns ---------------------------------------------------------------


def first_last(patterns: DataFrame) -> DataFrame:
    """Support in a pattern's first and last window and the change. min_by and max_by
    in one aggregate replace the self-join of two row numbers."""
    out = patterns.groupBy("itemset", "k").agg(
        F.min("window_start").alias("first_window"),
        F.max("window_start").alias("last_window"),
        F.min_by("support", "window_start").alias("first_support"),
        F.max_by("support", "window_start").alias("last_support"),
    )
    return out.filter("first_window < last_window").withColumn("change", F.round(F.col("last_support") - F.col("first_support"), 6))


def split_change(changes: DataFrame, top: int, rising: bool) -> DataFrame:
    """The strongest strictly positive (or negative) changes; zero is in neither."""
    c = F.col("change")
    return changes.filter(c > 0 if rising else c < 0).orderBy(c.desc() if rising else c.asc(), "itemset").limit(top)


def patterns_for_window(patterns: DataFrame, start: int, min_k: int, top: int) -> DataFrame:
    """A window's patterns by support, ties by itemset."""
    return patterns.filter((F.col("window_start") == start) & (F.col("k") >= min_k)).orderBy(F.desc("support_count"), "itemset").limit(top)


def top_per_window(patterns: DataFrame, min_k: int = 2, top: int = 20) -> DataFrame:
    """The snapshot: the strongest patterns of each window."""
    w = Window.partitionBy("window_start").orderBy(F.desc("support_count"), "itemset")
    return patterns.filter(F.col("k") >= min_k).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def top_rules(rules: DataFrame, min_lift: float, top: int) -> DataFrame:
    """L02."""
    return rules.filter(F.col("lift") >= min_lift).orderBy(F.desc("lift"), "antecedent", "consequent").limit(top)


def timeseries(patterns: DataFrame, itemsets: DataFrame) -> DataFrame:
    """Support of the given itemsets in every window, zero where it wasn't a pattern."""
    windows = patterns.select("window_start").distinct()
    grid = itemsets.select("itemset").distinct().crossJoin(F.broadcast(windows))  # windows: one row a year at most
    return grid.join(patterns.select("itemset", "window_start", "support"), ["itemset", "window_start"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def lifecycles(patterns: DataFrame) -> DataFrame:
    """Born in the first window, died in the window after the last (null: still there)."""
    starts = patterns.select("window_start").distinct()
    after = starts.withColumn("next", F.lead("window_start").over(Window.orderBy("window_start")))  # one row a window
    life = patterns.groupBy("itemset", "k").agg(F.min("window_start").alias("born"), F.max("window_start").alias("last"), F.count("*").alias("windows"))
    return life.join(F.broadcast(after), life["last"] == after["window_start"]).select("itemset", "k", "born", F.col("next").alias("died"), "windows")


def born_died(life: DataFrame, year: int) -> DataFrame:
    """Patterns born or died in the latest window at or before year that has a change; the
    first window's patterns are never born."""
    first = life.agg(F.min("born").alias("first"))
    born = life.join(F.broadcast(first)).filter("born > first").select("itemset", F.col("born").alias("window_start"), F.lit("born").alias("event"))
    died = life.filter("died IS NOT NULL").select("itemset", F.col("died").alias("window_start"), F.lit("died").alias("event"))
    events = born.union(died)
    at = events.filter(F.col("window_start") <= year).agg(F.max("window_start").alias("at"))
    newest = events.agg(F.max("window_start").alias("newest"))
    pick = at.crossJoin(newest).select(F.coalesce("at", "newest").alias("at"))
    return events.join(F.broadcast(pick), F.col("window_start") == F.col("at")).select("itemset", "window_start", "event")


def topic_graph(patterns: DataFrame) -> DataFrame:
    """Links between the topics of multi-topic patterns, weighted by their summed support."""
    items = F.split("itemset", r" \| ")
    pair = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return patterns.filter("k >= 2").withColumn("items", items).select(F.explode(pair).alias("p"), "support_count").groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("support_count").alias("weight"))


def topic_nodes(patterns: DataFrame) -> DataFrame:
    """Node support: single patterns in full, a quarter of each larger one."""
    part = F.when(F.col("k") == 1, F.col("support_count").cast("double")).otherwise(F.col("support_count") / 4.0)
    return patterns.select(F.explode(F.split("itemset", r" \| ")).alias("topic"), part.alias("s")).groupBy("topic").agg(F.sum("s").alias("support"))


# -- comparing miners -------------------------------------------------------------------------


def patterns_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The symmetric difference of two pattern sets by window and itemset."""
    key = ["window_start", "itemset"]
    gone = before.select(*key).join(after.select(*key), key, "left_anti").withColumn("side", F.lit("before"))
    return gone.union(after.select(*key).join(before.select(*key), key, "left_anti").withColumn("side", F.lit("after")))


def compare_patterns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Jaccard of two pattern sets, mean absolute support difference on the common ones, and
    the sizes of the rest. Two empty sets are equal (1), one empty set shares nothing (0)."""
    key = ["window_start", "itemset"]
    l, r = left.select(*key, F.col("support").alias("l")), right.select(*key, F.col("support").alias("r"))
    j = l.join(r, key, "full").agg(
        F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("common"),
        F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"),
        F.round(F.avg(F.abs(F.col("l") - F.col("r"))), 9).alias("support_mae"),
    )
    every = F.col("common") + F.col("only_left") + F.col("only_right")
    return j.withColumn("jaccard", F.when(every == 0, 1.0).otherwise(F.round(F.col("common") / every, 9)))


def mllib_itemsets(baskets_: DataFrame, min_support: float, max_len: int = 3) -> DataFrame:
    """M01-M03 by MLlib's distributed FP-growth, for one window: itemset, k, support_count."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(baskets_.select("items"))
    sets = model.freqItemsets.filter(F.size("items") <= max_len)
    return sets.select(F.array_join(F.array_sort("items"), SEP).alias("itemset"), F.size("items").alias("k"), F.col("freq").alias("support_count"))
