"""Streams of requests: windowed rates with late data, and throttle state by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(requests: DataFrame, window: str = "1 hour", late: str = "1 day", key: str = "user_id", ts: str = "ts", ok: str = "ok", value: str = "value") -> DataFrame:
    """Requests, errors and mean value of each key and window; for streams and tables alike. Rows that
    come more than ``late`` after newer ones are dropped from a stream."""
    rows = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if requests.isStreaming else rows
    out = rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("requests"), F.count_if(~F.col(ok)).alias("errors"), F.avg(value).alias("mean_value"))
    return out.select(F.col("w.start").alias("start"), key, "requests", "errors", "mean_value")


def throttle(requests: DataFrame, interval: float, delay: float = 2.0, key: str = "user_id", ts: str = "ts", ok: str = "ok", idle: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``key, ts, start, errors_in_row``: when each request of a stream may start, given that those of a
    key keep an interval and that errors in a row back off. State is kept by key, and forgotten once
    newer rows show that the key has been idle for that long; rows over ``late`` older than others are
    dropped. The rows of a key in a micro-batch are taken in order of time."""
    schema = f"{key} long, ts timestamp, start timestamp, errors_in_row int"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free, errors = state.get if state.exists else (float("-inf"), 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "ok"], kind="stable", ignore_index=True)
        starts, runs = [], []
        for t, fine in zip(rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["ok"]):
            start = max(t, free)
            errors = 0 if fine else errors + 1
            free = start + (min(60.0, delay * 2 ** (errors - 1)) if errors > 1 else interval)
            starts.append(start)
            runs.append(errors)
        state.update((float(free), int(errors)))
        state.setTimeoutTimestamp(max(int(starts[-1] * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: k[0], "ts": rows["ts"], "start": pd.Series(np.round(np.array(starts) * 1e6).astype("int64").astype("datetime64[us]")), "errors_in_row": pd.Series(runs, dtype="int32")})

    rows = requests.select(key, F.col(ts).cast("timestamp").alias("ts"), F.col(ok).alias("ok"))
    rows = rows.withWatermark("ts", late) if requests.isStreaming else rows
    return rows.groupBy(key).applyInPandasWithState(work, schema, "free double, errors int", "append", GroupStateTimeout.EventTimeTimeout)
