"""Mergeable bar states: bars of any width from states of shorter ones, in any order and number of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a state holds besides its keys. Times say which open is first and which close is last.
STATE = ("open", "open_time", "high", "low", "close", "close_time", "volume", "amount", "bar_count")


def state_of(bars: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(keys, STATE) of single bars (keys, ``time``, open, high, low, close, volume, amount)."""
    at = F.col(time)
    values = {"open_time": at, "close_time": at, "volume": F.col("volume").cast("double"), "bar_count": F.lit(1).cast("long")}
    return bars.select(*keys, *[values.get(name, F.col(name)).alias(name) for name in STATE])


def merge_states(states: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """One state per ``keys`` of the states given: fixed-width buffers, combined on the map side."""
    return states.groupBy(*keys).agg(
        F.min_by("open", "open_time").alias("open"), F.min("open_time").alias("open_time"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "close_time").alias("close"), F.max("close_time").alias("close_time"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.sum("bar_count").alias("bar_count"),
    )
