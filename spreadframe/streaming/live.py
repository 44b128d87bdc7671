"""Live counterparts of the cascade queries on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adoption_counts(events: DataFrame, late: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """``event_type, start, n``: first adoptions of a user in each tumbling window; later than ``late`` is dropped.

    ``events`` is a stream (or a table) of ``ts, user_id, event_type``.
    """
    first = events.withWatermark("ts", late).withColumn("w", F.window("ts", step))
    once = first.dropDuplicates(["event_type", "user_id", "w"])
    return once.groupBy("event_type", "w").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "20 minutes") -> DataFrame:
    """``user_id, start, end, n``: bursts of a user's events."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STATE = "seen long, last double, ratio double"
FORECAST = "cascade_id string, observed long, predicted double"


def running_forecast(adoptions: DataFrame, late: str = "1 hour") -> DataFrame:
    """``cascade_id, observed, predicted``: the branching forecast of each cascade, updated with every batch.

    Keyed state holds the size so far, the last batch's new adopters and the running ratio;
    a cascade without events for ``late`` is forgotten.
    """

    forget_ms = int(pd.Timedelta(late).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = float(sum(len(b) for b in batches))
        seen, last, ratio = state.get if state.exists else (0, 0.0, 0.0)
        r = new / last if last else ratio
        ratio = (ratio + r) / 2 if ratio else r
        state.update((int(seen + new), new, ratio))
        state.setTimeoutDuration(forget_ms)
        size = seen + new
        yield pd.DataFrame({"cascade_id": [key[0]], "observed": [int(size)], "predicted": [size + new * ratio / (1 - ratio) if ratio < 1 else None]}).astype({"predicted": "float64"})

    return adoptions.groupBy("cascade_id").applyInPandasWithState(update, FORECAST, STATE, "update", "ProcessingTimeTimeout")
