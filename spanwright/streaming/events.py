"""Stateful operators over unbounded events, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(events: DataFrame, key: str, ts: str, within: str, value: str) -> DataFrame:
    """Per key and window of event time the last value; what comes after the watermark is stale and dropped."""
    seen = events.withWatermark(ts, within)
    return seen.groupBy(F.window(ts, within).alias("w"), key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias("at")).select(key, F.col("w.start").alias("start"), value, "at")


def throttled(events: DataFrame, key: str, ts: str, limit: int = 10, width: str = "15 minutes", late: str = "1 minute") -> DataFrame:
    """Attempts of each key in fixed windows, and how many of them lie beyond the limit."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("attempts"))
    return counted.select(key, F.col("w.start").alias("start"), "attempts", F.greatest(F.lit(0), F.col("attempts") - limit).cast("long").alias("blocked"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    position, last = state.get if state.exists else (-1, None)
    for day in sorted({d for b in batches for d in b["day"]}):
        if last is None or day > last:  # a clock that runs back never advances
            position, last = position + 1, day
    state.update((position, last))
    yield pd.DataFrame({"key": [key[0]], "position": [position], "last_day": [last]})


def daily_position(events: DataFrame, key: str, ts: str, zone: str = "UTC") -> DataFrame:
    """(key, position, last_day): how often each key moved on, once for each later calendar day on which it was seen."""
    day = F.date_format(F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)), "yyyy-MM-dd")
    rows = events.select(F.col(key).cast("string").alias("key"), day.alias("day"))
    return rows.groupBy("key").applyInPandasWithState(_advance, "key string, position long, last_day string", "position long, last_day string", "update", GroupStateTimeout.NoTimeout)
