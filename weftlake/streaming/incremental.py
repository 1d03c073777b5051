"""Incremental and streaming forms of the additive operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.operators import mining


def merge_multisets(held: DataFrame, new: DataFrame, groups: list[str]) -> DataFrame:
    """The additive state of the miner."""
    return held.unionByName(new).groupBy(*groups, "items").agg(F.sum("weight").alias("weight"))


def touched(held: DataFrame, new: DataFrame, groups: list[str]) -> DataFrame:
    """Windows that a batch touches; only these are mined again."""
    return held.join(F.broadcast(new.select(*groups).distinct()), groups, "left_semi")


def update_patterns(patterns: DataFrame, held: DataFrame, new: DataFrame, groups: list[str], min_support: float, max_len: int | None = 3, min_baskets: int = 20) -> DataFrame:
    """Patterns after a batch: untouched windows keep theirs, touched ones are mined from the merged
    multiset. Equal to mining everything at once."""
    state = merge_multisets(held, new, groups)
    fresh = mining.frequent(touched(state, new, groups), groups, min_support, max_len, min_baskets)
    kept = patterns.join(F.broadcast(new.select(*groups).distinct()), groups, "left_anti")
    return kept.unionByName(fresh)


def sliding_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events of a key in the last `seconds`, the current one included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(w))


def limited(hits: pd.DataFrame, window: float, most: int, held: list[float]) -> tuple[list[bool], list[float]]:
    """X07, exactly: a hit is let through if fewer than `most` accepted hits are within the window before it;
    rejected ones are not recorded. Returns the decisions and the accepted times still in the window."""
    ok = []
    for t in hits:
        held = [h for h in held if h > t - window]
        ok.append(len(held) < most)
        if ok[-1]:
            held.append(t)
    return ok, held


def rate_limit(events: DataFrame, key: str, ts: str, window: float, most: int) -> DataFrame:
    """X07 as a stateful operator, for streams and batches of events: key, ts, allowed. The state of a key is
    its accepted times within the window: at most `most` numbers; it is dropped when the key stays away for a
    window. Decisions of one key depend on those before, so a batch decides a key in one task."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def step(key_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        hits = sorted(x for pdf in batches for x in pdf["at"])
        ok, held = limited(hits, window * 1e6, most, held)
        state.update((held,))
        state.setTimeoutDuration(max(1, int(window * 1000)))  # an idle key's hits have left the window
        yield pd.DataFrame({"key": key_[0], "at": hits, "allowed": ok})

    if events.isStreaming:
        return rows.groupBy("key").applyInPandasWithState(step, "key string, at long, allowed boolean", "held array<double>", "append", "ProcessingTimeTimeout")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = sorted(pdf["at"])
        return pd.DataFrame({"key": pdf["key"].iloc[0], "at": hits, "allowed": limited(hits, window * 1e6, most, [])[0]})

    return rows.groupBy("key").applyInPandas(whole, "key string, at long, allowed boolean")


def event_windows(events: DataFrame, width: str = "3 days", step: str = "1 day", late: str = "7 days") -> DataFrame:
    """Distinct users and events by sliding event-time window; on a stream, late rows within the
    watermark still count."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    w = e.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "total")


def dedup_stream(rows: DataFrame, key: str, ts: str, late: str = "30 days") -> DataFrame:
    """A record seen again within the look-back is dropped."""
    if not rows.isStreaming:
        return rows.dropDuplicates([key])
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def merge_mart(path: str, keys: list[str], values: list[str]):
    """A foreachBatch function that adds a batch's aggregate to a Parquet mart. Each batch is a
    new version folder named by its id, so a batch that runs again overwrites its own version and
    the totals stay right; the checkpoint advances only after the write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
        if batch_id:
            held = spark.read.parquet(f"{path}/v{batch_id - 1}")
            new = held.unionByName(new).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
        new.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write
