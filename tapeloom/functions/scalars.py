"""Scalar helpers.

Spark 4 runs in ANSI mode: division by zero and bad casts raise, so ratios go through ``ratio``
and text parsing through the ``try_`` functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where the denominator is null or zero."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~not_finite(value), value)


def not_finite(value: Column) -> Column:
    """True for NaN and both infinities, null for null."""
    return F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def invalid_number(value: Column) -> Column:
    """True for null, NaN and infinities."""
    return value.isNull() | not_finite(value)


def to_double(value: Column) -> Column:
    """Text to double, null where it does not parse."""
    return value.try_cast("double")


def to_day(value: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD`` text to a date, null for anything else."""
    return F.coalesce(
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date")),
        F.when(
            value.rlike(r"^\d{8}$"),
            F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)).try_cast("date"),
        ),
    )


def code_list(value: Column) -> Column:
    """CSV text to an array of trimmed, non-empty, distinct codes in first-seen order."""
    parts = F.transform(F.split(value, ","), lambda part: F.trim(part))
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def blank(value: Column) -> Column:
    """True for null or the empty string."""
    return F.coalesce(value, F.lit("")) == ""


def garbled_name(value: Column) -> Column:
    """Null, empty or holding a replacement question mark."""
    return blank(value) | value.contains("?")


def hour_minute(value: Column) -> Column:
    """``HH:MM`` of a timestamp."""
    return F.date_format(value, "HH:mm")


def local_time(utc: Column, zone: str = "Asia/Shanghai") -> Column:
    """Zone-less UTC timestamp shown on the wall clock of ``zone``, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def differs(stored: Column, recomputed: Column, relative: float = 0.0, absolute: float = 0.0) -> Column:
    """Tolerance compare: |stored - recomputed| > max(absolute, relative * |recomputed|)."""
    return F.abs(stored - recomputed) > F.greatest(F.lit(absolute), F.abs(recomputed) * F.lit(relative))


# Exchange and code-prefix rule, as given by the market-data contract.
# SHSE: first digit 5 or 6, or prefix 900
# BJSE: first digit 4 or 8, or prefix 920
# SZSE: first digit none of 4, 5, 6, 8, 9
def valid_market_code(market: Column, code: Column) -> Column:
    first, prefix = F.substring(code, 1, 1), F.substring(code, 1, 3)
    return (
        ((market == "SHSE") & (first.isin("5", "6") | (prefix == "900")))
        | ((market == "BJSE") & (first.isin("4", "8") | (prefix == "920")))
        | ((market == "SZSE") & ~first.isin("4", "5", "6", "8", "9"))
    )
