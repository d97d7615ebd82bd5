"""Request validation and row predicates of quote queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed values of each request option; the first one is the default.
OPTIONS = {
    "freq": ("1d", "tick", "1m", "5m", "15m", "30m", "60m", "1w", "1mo"),
    "concept_freq": ("1d", "1m", "5m", "15m", "30m", "60m", "1w", "1mo"),
    "index_freq": ("1d", "1w", "1mo"),
    "adjust": ("none", "qfq", "hfq"),
    "report_type": ("income_statement", "balance_sheet", "cash_flow_statement"),
    "view": ("main",),
    "scope": ("concept",),
    "rank_type": ("change_pct", "turnover_rate", "net_inflow"),
    "limit_type": ("limit_up", "limit_down", "opened_limit"),
    "exchange": ("SSE", "SZSE", "BSE", "HKEX"),
    "meta_detail": ("summary", "full"),
    "sort_by": ("announcement_time", "crawl_time"),
}


def option(name: str, value: str = "") -> str:
    """Value of a request option, its default when empty, an error when unknown."""
    allowed = OPTIONS[name]
    actual = value or allowed[0]
    if actual not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}: {actual}")
    return actual


def clamp_limit(limit: int | None, maximum: int | None = None) -> int | None:
    """The rows to return: None is all of them. ``maximum`` is a service's own bound, none unless it is given."""
    if limit is None:
        return maximum
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return limit if maximum is None else min(limit, maximum)


def codes_of(code: str = "", codes: str = "", required: bool = True) -> list[str]:
    """Union of ``code`` and the CSV ``codes``: trimmed, without blanks, first-seen order."""
    parts = [part.strip() for part in [code, *codes.split(",")]]
    wanted = list(dict.fromkeys(part for part in parts if part))
    if required and not wanted:
        raise ValueError("give code or codes")
    return wanted


def etf_codes_of(ts_codes: str) -> list[str]:
    """Full ETF codes such as ``510300.SH``; a code without exchange suffix is refused."""
    wanted = codes_of(codes=ts_codes, required=False)
    for code in wanted:
        number, _, suffix = code.partition(".")
        if not number.isdigit() or suffix.upper() not in ("SH", "SZ"):
            raise ValueError(f"ETF code needs an exchange suffix: {code}")
    return list(dict.fromkeys(code.upper() for code in wanted))


def parse_day(text: str | dt.date) -> dt.date | None:
    """``YYYY-MM-DD`` or ``YYYYMMDD`` to a date; empty text to None; anything else is an error."""
    if isinstance(text, dt.date):
        return text
    if not text:
        return None
    return dt.datetime.strptime(text, "%Y%m%d" if len(text) == 8 else "%Y-%m-%d").date()


def keep_entities(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """Rows of the given entities. The list is part of the request; it reaches the scan, whatever its length."""
    return df.where(F.col(column).isin(codes))


def in_days(column: str, trade_date: str = "", start_date: str = "", end_date: str = "") -> Column:
    """Point date if given, else the closed range; compared as dates so that partitions are pruned."""
    point, start, end = parse_day(trade_date), parse_day(start_date), parse_day(end_date)
    if point:
        return F.col(column) == F.lit(point)
    condition = F.lit(True)
    if start:
        condition = condition & (F.col(column) >= F.lit(start))
    if end:
        condition = condition & (F.col(column) <= F.lit(end))
    return condition


def in_times(column: str, start_time: str = "", end_time: str = "") -> Column:
    """Closed range on a timestamp column."""
    condition = F.lit(True)
    if start_time:
        condition = condition & (F.col(column) >= F.lit(start_time).cast("timestamp_ntz"))
    if end_time:
        condition = condition & (F.col(column) <= F.lit(end_time).cast("timestamp_ntz"))
    return condition


def valid_on(day: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Interval row in force on ``day``; both ends count, a null end is open."""
    return (F.col(valid_from) <= day) & (F.col(valid_to).isNull() | (F.col(valid_to) >= day))


def overlaps(start: str, end: str, valid_from: str = "start_date", valid_to: str = "end_date") -> Column:
    """Interval rows touching [start, end]; an empty bound is open."""
    first, last = parse_day(start), parse_day(end)
    condition = F.lit(True)
    if last:
        condition = condition & (F.col(valid_from) <= F.lit(last))
    if first:
        condition = condition & (F.col(valid_to).isNull() | (F.col(valid_to) >= F.lit(first)))
    return condition


def recent(column: str | None, as_of: str | dt.date, days: int = 90) -> Column:
    """[as_of - days, as_of); tables without a time column are not restricted."""
    if not column:
        return F.lit(True)
    day = parse_day(as_of)
    return (F.col(column) >= F.lit(day - dt.timedelta(days=days))) & (F.col(column) < F.lit(day))


def catalog_filter(
    df: DataFrame,
    name: str = "",
    name_column: str = "name",
    include_delisted: bool = True,
    delist_column: str = "delist_date",
    **equals: object,
) -> DataFrame:
    """Keyword on the name plus equality filters; empty filters are skipped."""
    if name:
        df = df.where(F.col(name_column).contains(name))
    for column, value in equals.items():
        if value not in (None, ""):
            df = df.where(F.col(column) == F.lit(value))
    if not include_delisted:
        df = df.where(F.col(delist_column).isNull())
    return df
