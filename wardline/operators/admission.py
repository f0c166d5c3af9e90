"""Admission control over request rows: route guard, size caps, rate limits, concurrency, latency levels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS, LIMIT = 60_000, 60


def log_rate_limit(requests: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """requests (request_id, key, ms) with in_window and allowed, by the log that also records rejected requests.

    Requests of one key in the same millisecond are one entry of the log; a later one of them already sees it. The log
    holds what is younger than the window, so a request is allowed while fewer than limit entries came before it.
    """
    distinct = requests.select("key", "ms").distinct()
    w = Window.partitionBy("key").orderBy("ms").rangeBetween(-(window_ms - 1), -1)
    before = distinct.withColumn("before", F.count("*").over(w))
    first = F.row_number().over(Window.partitionBy("key", "ms").orderBy("request_id"))
    seen = requests.join(before, ["key", "ms"]).withColumn("in_window", F.col("before") + (first > 1).cast("int"))
    return seen.select("request_id", "key", "ms", "in_window", (F.col("in_window") < limit).alias("allowed"))


def accepting_rate_limit(requests: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """request_id, key, ms, allowed by the limit that records accepted requests only.

    Acceptance depends on earlier acceptances, so a key's requests are walked in order; the walk keeps at most `limit`
    times and streams through the key's rows in batches.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept, at = object(), [], 0
        for b in batches:
            allowed = []
            for k, ms in zip(b["key"], b["ms"]):
                if k != key:
                    key, kept, at = k, [], 0
                while at < len(kept) and kept[at] <= ms - window_ms:
                    at += 1
                ok = len(kept) - at < limit
                if ok:
                    kept.append(ms)
                if at > 10_000:
                    kept, at = kept[at:], 0
                allowed.append(ok)
            yield b.assign(allowed=allowed)[["request_id", "key", "ms", "allowed"]]

    ordered = requests.select("request_id", "key", "ms").repartition("key").sortWithinPartitions("key", "ms", "request_id")
    return ordered.mapInPandas(walk, "request_id long, key long, ms long, allowed boolean")


def concurrency(intervals: DataFrame, cap: int) -> DataFrame:
    """intervals (request_id, start_ms, end_ms) with running: how many that began earlier are still open, and over_cap."""
    ends = intervals.select(F.explode(F.array(F.struct(F.col("start_ms").alias("ms"), F.lit(1).alias("step"), "request_id"), F.struct(F.col("end_ms").alias("ms"), F.lit(-1).alias("step"), "request_id"))).alias("e")).select("e.*")
    hours = ends.withColumn("hour", F.floor(F.col("ms") / 3_600_000))
    totals = hours.groupBy("hour").agg(F.sum("step").alias("net"))
    carried = totals.withColumn("carried", F.sum("net").over(Window.orderBy("hour")) - F.col("net")).drop("net")  # one row per hour
    local = F.sum("step").over(Window.partitionBy("hour").orderBy("ms", "step", "request_id").rowsBetween(Window.unboundedPreceding, 0))
    open_ = hours.withColumn("local", local).join(F.broadcast(carried), "hour").where("step = 1")
    return open_.select("request_id", (F.col("local") + F.col("carried") - 1).alias("running"), (F.col("local") + F.col("carried") - 1 >= cap).alias("over_cap"))


def log_level(status: Column) -> Column:
    """ERROR from status 500, WARNING from 400, else INFO."""
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")
