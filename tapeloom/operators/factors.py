"""Strategy factor window: moving averages, mean volume, guarded ratios and the price-band state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio
from tapeloom.operators.indicators import rolling
from tapeloom.operators.series import series_window

TEN_THOUSAND = 10000.0


def mean_volume(df: DataFrame, keys: Sequence[str], time: str, days: int = 5, value: str = "volume_shares") -> DataFrame:
    frame = series_window(keys, time).rowsBetween(1 - days, 0)
    return df.withColumn(f"mean_volume_{days}d_shares", F.avg(value).over(frame))


def price_band_state(close: Column, upper: Column, lower: Column) -> Column:
    """Where the close stands against the day's limits; empty when a limit is unknown."""
    return (
        F.when(close.isNull() | upper.isNull() | lower.isNull(), "")
        .when(close >= upper, "upper")
        .when(close <= lower, "lower")
        .otherwise("inside")
    )


def strategy_window(df: DataFrame, keys: Sequence[str] = ("code",), time: str = "trade_date") -> DataFrame:
    """Add ma10/20/40, the 5-day mean volume, both ratios and the band state to daily factor rows.

    Shares and market value are in units of ten thousand; a null or zero denominator gives null.
    """
    window = series_window(keys, time)
    work = mean_volume(df, keys, time).withColumns({f"ma{n}": rolling(F.avg, "close", window, n) for n in (10, 20, 40)})
    return work.withColumns(
        {
            "active_buy_amount_proportion_all": ratio(F.col("active_buy_amount"), F.col("float_market_cap") * TEN_THOUSAND),
            "mean_volume_5d_to_free_float_shares": ratio(F.col("mean_volume_5d_shares"), F.col("free_float_shares") * TEN_THOUSAND),
            "price_band_state": price_band_state(F.col("close"), F.col("upper_limit"), F.col("lower_limit")),
        }
    )
