"""Quote query: one request to items, per-code completeness and a summary row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio
from tapeloom.operators.bars import adjust_prices, completeness, fill_suspended, rollup_days, rollup_minutes
from tapeloom.operators.bits import bit_counts, day_bits, expected_bits, missing_bits, missing_times
from tapeloom.operators.lookback import FIRST_DAYS, rows_before
from tapeloom.operators.predicates import in_days, in_times, keep_entities, option, parse_day
from tapeloom.operators.selection import cut_counts, drop_flagged_entities, drop_flagged_rows, last_n, page, pick_fields
from tapeloom.operators.series import open_days, previous_change, series_window

# Fields of quote items.
STOCK_QUOTE_FIELDS = (
    "code", "trade_time", "freq", "open", "high", "low", "close", "pre_close", "change", "pct_chg", "volume", "amount", "adjust", "is_suspended", "is_st",
)
CONCEPT_QUOTE_FIELDS = ("concept_id", "concept_name", "trade_time", "freq", "open", "high", "low", "close", "pre_close", "change", "pct_chg", "volume", "amount")
INDEX_QUOTE_FIELDS = ("index_code", "trade_time", "freq", "open", "high", "low", "close", "pre_close", "change", "pct_chg", "volume", "amount")
DAY_FREQS = ("1d", "1w", "1mo")
SESSIONS = (("09:30", "11:30"), ("13:00", "15:00"))


@dataclass(frozen=True)
class QuoteRequest:
    codes: Sequence[str]
    freq: str = "1d"
    trade_date: str = ""
    start_date: str = ""
    end_date: str = ""
    start_time: str = ""
    end_time: str = ""
    count: int | None = None
    adjust: str = "none"
    fields: str = ""
    limit: int | None = None
    skip_suspended: bool = True
    skip_st: bool = False
    fill_missing: bool = False
    meta_detail: str = "full"


@dataclass(frozen=True)
class QuoteResult:
    """Lazy frames: items, one row per code, one summary row."""

    items: DataFrame
    codes: DataFrame
    meta: DataFrame


def _requested(table: DataFrame, request: QuoteRequest, key: str, time: str) -> DataFrame:
    rows = keep_entities(table, key, list(request.codes)).where(in_days(time, request.trade_date, request.start_date, request.end_date))
    return rows.where(in_times(time, request.start_time, request.end_time)) if request.start_time or request.end_time else rows


#: Days of the first look back for a list of codes: their rows are few, so one step is cheaper than several.
LISTED_FIRST_DAYS = 512


def _before_window(table: DataFrame, rows: DataFrame, first_day: str, skip_suspended: bool, first_days: int = FIRST_DAYS) -> DataFrame | None:
    """(code, _earlier): the close on the last day before the window of each code of ``rows``; none where the window has no start."""
    first = parse_day(first_day)
    if first is None:
        return None
    if skip_suspended and "is_suspended" in table.columns:
        table = drop_flagged_rows(table)
    return rows_before(table.select("code", "trade_date", "close"), rows, ["code"], first, first_days=first_days).select("code", F.col("close").alias("_earlier"))


def window_change(rows: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """``previous_change`` of a window whose first rows take the close before the window."""
    changed = previous_change(rows, ["code"], "trade_date")
    if earlier is None:
        return changed
    first = F.row_number().over(series_window(["code"], "trade_date")) == 1
    marked = changed.withColumn("_first", first).join(earlier, "code", "left")
    pre_close = F.when(F.col("_first"), F.col("_earlier")).otherwise(F.col("pre_close"))
    change = F.col("close") - F.col("pre_close")
    return marked.withColumn("pre_close", pre_close).withColumns({"change": change, "pct_chg": ratio(change, F.col("pre_close")) * 100}).drop("_first", "_earlier")


def day_quotes(table: DataFrame, calendar: DataFrame, request: QuoteRequest, exchange: str = "SSE") -> QuoteResult:
    """Daily, weekly or monthly stock quotes from daily bars.

    Order: entity and date filter, adjustment, placeholders, whole-entity ST exclusion, suspended rows, rollup,
    last N, cut, projection. Completeness is measured on the covered rows before any exclusion.
    """
    freq, mode = option("freq", request.freq), option("adjust", request.adjust)
    # The latest factor and the row before the window are those of the whole series, not of the window.
    base = adjust_prices(keep_entities(table, "code", list(request.codes)), mode)
    requested = base.where(in_days("trade_date", request.trade_date, request.start_date, request.end_date))
    first = parse_day(request.trade_date or request.start_date)
    last = parse_day(request.trade_date or request.end_date)
    days = open_days(calendar, exchange, None if first is None else F.lit(first), None if last is None else F.lit(last))
    wanted = table.sparkSession.createDataFrame([(code,) for code in request.codes], "code string")

    covered = requested
    if request.fill_missing:
        covered = fill_suspended(requested, days)
    kept = covered
    if request.skip_st:
        kept = drop_flagged_entities(kept, ["code"])
    if request.skip_suspended:
        kept = drop_flagged_rows(kept)
    bars = window_change(kept, _before_window(base, requested, request.trade_date or request.start_date, request.skip_suspended, LISTED_FIRST_DAYS)) if "pre_close" not in kept.columns else kept
    if freq == "1d":
        shaped = bars.withColumn("trade_time", F.col("trade_date"))
    else:
        rolled = rollup_days(bars, freq)
        shaped = previous_change(rolled, ["code"], "trade_time").withColumns({"is_suspended": F.lit(False), "is_st": F.lit(False)})
    shaped = shaped.withColumns({"freq": F.lit(freq), "adjust": F.lit(mode)})
    if "open" not in shaped.columns:
        shaped = shaped.withColumn("open", F.lit(None).cast("double"))
    trimmed = last_n(shaped, ["code"], "trade_time", request.count)
    cut = page(trimmed, ["trade_time", "code"], request.limit or None)
    coverage = completeness(covered, wanted, days).drop("row_count", "first_trade_time", "last_trade_time", "complete")
    codes, meta = _meta(coverage, trimmed, cut, request)
    return QuoteResult(pick_fields(cut, request.fields, STOCK_QUOTE_FIELDS), detailed(codes, request.meta_detail), meta)


def _meta(coverage: DataFrame, trimmed: DataFrame, cut: DataFrame, request: QuoteRequest, key: str = "code") -> tuple[DataFrame, DataFrame]:
    """Per code, its coverage with what was returned of it; and the summary row."""
    returned = cut.groupBy(key).agg(
        F.count("*").alias("row_count"), F.min("trade_time").alias("first_trade_time"), F.max("trade_time").alias("last_trade_time")
    )
    available = trimmed.groupBy(key).agg(F.count("*").alias("_available"))
    joined = coverage.join(returned, key, "left").join(available, key, "left").fillna(0, ["row_count", "_available"])
    truncated = F.col("row_count") < F.col("_available")
    codes = joined.withColumn("truncated", truncated).withColumn(
        "complete", (F.col("missing_count") == 0) & ~F.col("truncated") & (F.col("_available") > 0)
    ).drop("_available")
    meta = cut_counts(trimmed, request.limit).withColumn("complete", codes.agg(F.coalesce(F.bool_and("complete"), F.lit(True))).scalar())
    return codes, meta


def minute_quotes(table: DataFrame, calendar: DataFrame, request: QuoteRequest, key: str = "code", fields: Sequence[str] = STOCK_QUOTE_FIELDS, exchange: str = "SSE", sessions=SESSIONS) -> QuoteResult:
    """Intraday quotes from one-minute bars; no placeholder, ST or adjustment rule applies.

    A code is complete if it has every bar of the sessions of the requested open days; ``missing_trade_times`` counts are
    per code, and with ``meta_detail="full"`` the missing bar ends are listed (at most days x bars of a day).
    """
    freq, minutes = option(_freq_option(key), request.freq), int(request.freq.rstrip("m"))
    if request.adjust != "none":
        raise ValueError("intraday quotes are not adjusted")
    trimmed = minute_bars(table, request, key, sessions)
    trimmed = trimmed.withColumns({"freq": F.lit(freq), "adjust": F.lit("none")})
    for name in fields:
        if name not in trimmed.columns:
            trimmed = trimmed.withColumn(name, F.lit(None).cast("string" if name == "concept_name" else "boolean" if name.startswith("is_") else "double"))
    cut = page(trimmed, ["trade_time", key], request.limit or None)
    first, last = (parse_day(request.trade_date or day) for day in (request.start_date, request.end_date))
    days = open_days(calendar, exchange, None if first is None else F.lit(first), None if last is None else F.lit(last))
    wanted = table.sparkSession.createDataFrame([(code,) for code in request.codes], f"{key} string")
    ends, full = session_ends(minutes, sessions), option("meta_detail", request.meta_detail) == "full"
    expected = expected_bits(expected_times(days, ends, table.sparkSession).where(in_times("end", request.start_time, request.end_time)), "end", ends)
    bits = day_bits(trimmed.where(F.col("close").isNotNull()), [key], "trade_time", ends)
    coverage = bit_counts(bits, wanted, expected, key)
    if full:
        listed = missing_times(missing_bits(bits, wanted, expected, key), key, ends)
        coverage = coverage.join(listed, key, "left").withColumn("missing_trade_times", F.coalesce("missing_trade_times", F.array().cast("array<timestamp_ntz>")))
    codes, meta = _meta(coverage, trimmed, cut, request, key)
    return QuoteResult(pick_fields(cut, request.fields, fields), codes, meta)


def expected_times(days, ends: Sequence[int], spark) -> DataFrame:
    """(end): the bar ends of the expected days, an array."""
    midnights = spark.range(1).select(F.explode(days).alias("d"))
    return midnights.select(F.explode(F.array(*[F.col("d").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(m)) for m in ends])).alias("end"))


def _freq_option(key: str) -> str:
    return "freq" if key == "code" else "concept_freq"


def session_ends(minutes: int, sessions=SESSIONS) -> list[int]:
    """Minutes after midnight at which a day's bars end."""
    spans = [[int(text[:2]) * 60 + int(text[3:]) for text in span] for span in sessions]
    return [opens + minutes * (k + 1) for opens, closes in spans for k in range(-(-(closes - opens) // minutes))]


def detailed(codes: DataFrame, meta_detail: str) -> DataFrame:
    """Per-code completeness; ``summary`` (the default) has counts only, ``full`` the missing days too."""
    return codes if option("meta_detail", meta_detail) == "full" else codes.drop("missing_trade_dates")


def minute_bars(table: DataFrame, request: QuoteRequest, key: str = "code", sessions=SESSIONS) -> DataFrame:
    """Bars of one or more minutes with ``trade_time``, the last N of each code."""
    minutes = int(request.freq.rstrip("m"))
    rows = keep_entities(table, key, list(request.codes))
    start, end = parse_day(request.trade_date or request.start_date), parse_day(request.trade_date or request.end_date)
    # Bounds on the time column itself, so that statistics and partitions can prune.
    if start:
        rows = rows.where(F.col("bar_time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col("bar_time") < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))
    rows = rows.where(in_times("bar_time", request.start_time, request.end_time))
    bars = rows.withColumn("trade_time", F.col("bar_time")) if minutes == 1 else rollup_minutes(rows, minutes, (key,), sessions=sessions).withColumn("trade_time", F.col("bucket"))
    return last_n(bars, [key], "trade_time", request.count)


def tick_quotes(table: DataFrame, request: QuoteRequest) -> QuoteResult:
    """Ticks in time order; days and times bound ``trade_time`` itself. There is no expected number of ticks."""
    rows = keep_entities(table, "code", list(request.codes)).where(in_times("trade_time", request.start_time, request.end_time))
    start, end = parse_day(request.trade_date or request.start_date), parse_day(request.trade_date or request.end_date)
    if start:
        rows = rows.where(F.col("trade_time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col("trade_time") < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))
    trimmed = last_n(rows, ["code"], "trade_time", request.count).withColumns({"freq": F.lit("tick"), "adjust": F.lit("none")})
    for name in STOCK_QUOTE_FIELDS:
        if name not in trimmed.columns:
            trimmed = trimmed.withColumn(name, F.lit(None).cast("boolean" if name.startswith("is_") else "double"))
    cut = page(trimmed, ["trade_time", "code"], request.limit or None)
    codes = cut.groupBy("code").agg(F.count("*").alias("row_count"), F.min("trade_time").alias("first_trade_time"), F.max("trade_time").alias("last_trade_time"))
    return QuoteResult(pick_fields(cut, request.fields, STOCK_QUOTE_FIELDS), codes, cut_counts(trimmed, request.limit))


def simple_quotes(table: DataFrame, request: QuoteRequest, key: str, fields: Sequence[str], freq_option: str) -> DataFrame:
    """Concept or index quotes of daily or longer frequency: entity, date, last N, cut, projection."""
    freq = option(freq_option, request.freq)
    if freq not in DAY_FREQS:
        raise ValueError(f"{freq} quotes need minute bars")
    rows = _requested(table, request, key, "trade_date") if request.codes else table.where(in_days("trade_date", request.trade_date, request.start_date, request.end_date))
    if freq in ("1w", "1mo"):
        rows = previous_change(rollup_days(rows, freq, (key,)), [key], "trade_time")
    else:
        rows = rows.withColumn("trade_time", F.col("trade_date"))
    rows = last_n(rows, [key], "trade_time", request.count).withColumn("freq", F.lit(freq))
    for name in fields:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string" if name == "concept_name" else "double"))
    cut = page(rows, ["trade_time", key], request.limit or None)
    return pick_fields(cut, request.fields, fields)


def daily_snapshot(
    table: DataFrame, trade_date: str, skip_suspended: bool = True, skip_st: bool = False, limit: int | None = None, offset: int = 0, fields: str = "", look_back_days: int | None = None
) -> DataFrame:
    """All stocks on one day, with the change against the previous existing day of each; no rows if the day is absent.

    The previous row may be of any age and is looked for in steps of 32, 64 … days; ``look_back_days`` ends the search.
    """
    day = parse_day(trade_date)
    today = table.where(F.col("trade_date") == F.lit(day))
    oldest = None if look_back_days is None else day - dt.timedelta(days=look_back_days)
    before = rows_before(table.select("code", "trade_date", "close"), today, ["code"], day, oldest=oldest).select("code", F.col("close").alias("_before"))
    today = today.drop("pre_close", "change", "pct_chg").join(before, "code", "left")
    change = F.col("close") - F.col("_before")
    rows = today.withColumns(
        {
            "pre_close": F.col("_before"), "change": change, "pct_chg": change / F.nullif(F.col("_before"), F.lit(0.0)) * 100,
            "trade_time": F.col("trade_date"), "freq": F.lit("1d"), "adjust": F.lit("none"),
        }
    )
    if skip_st:
        rows = rows.where(~F.coalesce(F.col("is_st"), F.lit(False)))
    if skip_suspended:
        rows = drop_flagged_rows(rows)
    for name in ("open", "high", "low"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    return pick_fields(page(rows, ["trade_time", "code"], limit, offset), fields, STOCK_QUOTE_FIELDS)


def local_window(
    table: DataFrame, start_date: str, end_date: str, skip_suspended: bool = True, skip_st: bool = False, limit: int | None = None, offset: int = 0, fields: str = ""
) -> DataFrame:
    """All stocks in a date range: ST entities out, then suspended rows, then the page by (trade_time, code)."""
    rows = table.where(in_days("trade_date", "", start_date, end_date))
    if skip_st:
        rows = drop_flagged_entities(rows, ["code"])
    if skip_suspended:
        rows = drop_flagged_rows(rows)
    if "pre_close" not in rows.columns:
        rows = window_change(rows, _before_window(table, rows, start_date, skip_suspended))
    rows = rows.withColumns({"trade_time": F.col("trade_date"), "freq": F.lit("1d"), "adjust": F.lit("none")})
    for name in ("open", "high", "low"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    return pick_fields(page(rows, ["trade_time", "code"], limit, offset), fields, STOCK_QUOTE_FIELDS)
