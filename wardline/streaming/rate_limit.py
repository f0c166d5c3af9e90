"""The rate limit and the scoring of requests as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.functions.features import with_features
from wardline.functions.rules import scored
from wardline.operators.admission import LIMIT, WINDOW_MS


def limited(requests: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS, lateness: str = "1 minute") -> DataFrame:
    """A stream of requests (request_id, key, ts) with allowed, by the limit that records accepted requests only.

    The state of a key is the times of its accepted requests within the window, at most `limit`; it is dropped when the
    watermark has passed them."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        out = []
        for ms in (rows["ts"].astype("int64") // 1_000).astype("int64") // 1_000 if rows["ts"].dtype == "datetime64[us]" else rows["ts"].astype("int64") // 1_000_000:
            kept = [k for k in kept if k > ms - window_ms]
            out.append(len(kept) < limit)
            if out[-1]:
                kept.append(int(ms))
        state.update((kept,))
        state.setTimeoutTimestamp(max(max([*kept, 0]) + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": rows["request_id"], "key": key[0], "allowed": out})

    keyed = requests.withWatermark("ts", lateness).groupBy("key")
    return keyed.applyInPandasWithState(judge, "request_id long, key long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def score_stream(requests: DataFrame, probability: str, path: str, checkpoint: str) -> StreamingQuery:
    """Scores a stream of texts batch by batch and appends the results to a table; a batch seen twice is written once."""

    def write(batch: DataFrame, number: int) -> None:
        out = scored(with_features(batch), probability).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
