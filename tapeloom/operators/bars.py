"""Bars: completeness, placeholders for missing days, rollups and price adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio
from tapeloom.operators.series import day_edges, series_window

PRICES = ("open", "high", "low", "close")


def completeness(bars: DataFrame, codes: DataFrame, days: Column, key: str = "code", day: str = "trade_date", value: str = "close") -> DataFrame:
    """Per code: expected and actual bar counts, first and last day, missing days, completeness.

    ``days`` is the array of expected days (or times). Only rows with a value count as covered. A code without rows keeps
    a line. Days are collected as a set per code, so a group is bounded by the calendar.
    """
    covered = F.collect_set(F.when(F.col(value).isNotNull(), F.col(day)))
    stats = bars.groupBy(key).agg(
        F.count("*").alias("row_count"), F.min(day).alias("first_trade_time"), F.max(day).alias("last_trade_time"), covered.alias("_days")
    )
    seen = F.coalesce(F.col("_days"), F.array_except(days, days))
    missing = F.array_except(days, seen)
    joined = codes.select(key).distinct().join(stats, key, "left")
    return joined.select(
        key,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.size(days).cast("long").alias("expected_bar_count"),
        F.size(F.array_intersect(days, seen)).cast("long").alias("actual_bar_count"),
        "first_trade_time",
        "last_trade_time",
        missing.alias("missing_trade_dates"),
        F.size(missing).cast("long").alias("missing_count"),
        (F.size(missing) == 0).alias("complete"),
    )


def fill_suspended(bars: DataFrame, days: Column, key: str = "code", day: str = "trade_date") -> DataFrame:
    """Add a suspended placeholder for every expected day after a known bar that has no row of its own.

    Prices are the previous close, volume and amount zero; there is none before the first close. Bars on days outside
    ``days`` stay as they are; the next close after them is theirs.
    Each bar is expanded by the days up to the next bar: one window over the bars that exist, no grid.
    """
    window = series_window([key], day)
    close = F.last("close", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    # Positions of expected days: the first after this bar and the first not before the next one.
    spread = bars.withColumn("_last", close).withColumn("_following", F.lead(day).over(window))
    edges = day_edges(days, bars.sparkSession)
    here = edges.select(F.col("trade_date").alias(day), F.col("after").alias("_from"))
    there = edges.select(F.col("trade_date").alias("_following"), F.col("not_before").alias("_to"))
    spread = spread.join(here, day, "left").join(there, "_following", "left")

    def outside(name: str) -> Column:
        return F.when(F.col(name) > F.array_max(days), F.size(days)).otherwise(F.lit(0))

    first = F.coalesce("_from", outside(day))
    stop = F.when(F.col("_following").isNull(), F.size(days)).otherwise(F.coalesce("_to", outside("_following")))
    gap = F.when(F.col("_last").isNotNull() & (stop > first), F.slice(days, first + 1, stop - first)).otherwise(F.array().cast("array<date>"))
    rows = spread.withColumn("_day", F.explode(F.concat(F.array(F.col(day)), gap)))
    added = F.col("_day") != F.col(day)

    def value(name: str) -> Column:
        if name == day:
            return F.col("_day")
        if name in PRICES:
            return F.when(added, F.col("_last")).otherwise(F.col(name))
        if name in ("volume", "amount"):
            return F.when(added, F.lit(0.0)).otherwise(F.col(name))
        if name == "is_suspended":
            return added | F.coalesce(F.col(name), F.lit(False))
        if name in (key, "market", "is_st"):
            return F.col(name)
        return F.when(~added, F.col(name))

    columns = [value(name).alias(name) for name in bars.columns]
    if "is_suspended" not in bars.columns:
        columns.append(added.alias("is_suspended"))
    return rows.select(*columns)


def _aggregate(bars: DataFrame, keys: Sequence[str], bucket: str, time: str) -> DataFrame:
    """OHLCV of the rows in each bucket: map-side combined, one shuffle on (keys, bucket)."""
    first = "open" if "open" in bars.columns else "close"
    parts = [
        F.min_by(first, time).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", time).alias("close"),
        F.sum(F.col("volume").cast("double")).alias("volume"), F.sum("amount").alias("amount"),
        F.max(time).alias("trade_time"), F.count("*").alias("bar_count"),
    ]
    return bars.groupBy(*keys, bucket).agg(*parts)


def rollup_days(bars: DataFrame, freq: str, keys: Sequence[str] = ("code",), day: str = "trade_date") -> DataFrame:
    """Weekly (Monday label) or monthly bars; trade_time is the last trading day inside."""
    unit = {"1w": "week", "1mo": "month"}[freq]
    return _aggregate(bars.withColumn("bucket", F.date_trunc(unit, day).cast("date")), keys, "bucket", day)


def rollup_minutes(
    bars: DataFrame, minutes: int, keys: Sequence[str] = ("code",), time: str = "bar_time", sessions: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Intraday bars labelled by their end minute.

    With ``sessions`` (open, close) the buckets start at each session's open, the first bar ends one minute
    after it, and rows outside all sessions are left out; without, buckets start at midnight.
    """
    minute = (F.hour(time) * 60 + F.minute(time)).cast("int")
    if sessions:
        anchor = F.lit(None).cast("int")
        for start, end in sessions:
            opens, closes = (int(text[:2]) * 60 + int(text[3:]) for text in (start, end))
            anchor = F.when((minute > opens) & (minute <= closes), F.lit(opens)).otherwise(anchor)
        inside = bars.withColumn("_anchor", anchor).where(F.col("_anchor").isNotNull())
        index = (minute - F.col("_anchor") - 1) / minutes
        end_minute = F.col("_anchor") + (F.floor(index) + 1) * minutes
    else:
        inside = bars.withColumn("_anchor", F.lit(0))
        end_minute = (F.floor(minute / minutes) + 1) * minutes
    midnight = F.date_trunc("day", time).cast("timestamp_ntz")
    bucket = midnight + F.make_dt_interval(mins=end_minute.cast("int"))
    return _aggregate(inside.withColumn("bucket", bucket), keys, "bucket", time)


def adjust_prices(
    bars: DataFrame, mode: str = "none", base_date=None, keys: Sequence[str] = ("code",), day: str = "trade_date", columns: Sequence[str] = PRICES
) -> DataFrame:
    """hfq multiplies prices by the factor; qfq also divides by the entity's latest factor (or that of base_date).

    A stored ``pre_close`` takes the factor of the row before (its own in the first row), and stored ``change`` and
    ``pct_chg`` follow from the adjusted prices. The latest factor is a map-side combined aggregate joined back, so a
    long series is never gathered.
    """
    present = [name for name in columns if name in bars.columns]
    if mode == "none":
        return bars
    kept = bars.columns
    if "pre_close" in kept:
        before = F.coalesce(F.lag("adj_factor").over(series_window(keys, day)), F.col("adj_factor"))
        bars = bars.withColumn("_pre_close", F.col("pre_close") * before / F.col("adj_factor"))
        present.append("_pre_close")

    def finished(adjusted: DataFrame) -> DataFrame:
        if "pre_close" in kept:
            adjusted = adjusted.withColumn("pre_close", F.col("_pre_close"))
            change = F.col("close") - F.col("pre_close")
            stored = {"change": change, "pct_chg": ratio(change, F.col("pre_close")) * 100}
            adjusted = adjusted.withColumns({name: value for name, value in stored.items() if name in kept})
        return adjusted.select(*kept)

    if mode == "hfq":
        return finished(bars.withColumns({name: F.col(name) * F.col("adj_factor") for name in present}))
    known = bars.where(F.col("adj_factor").isNotNull())
    if base_date is not None:
        known = known.where(F.col(day) <= F.lit(base_date))
    base = known.groupBy(*keys).agg(F.max_by("adj_factor", day).alias("_base"))
    joined = bars.join(base, list(keys), "left")
    return finished(joined.withColumns({name: ratio(F.col(name) * F.col("adj_factor"), F.col("_base")) for name in present}))
