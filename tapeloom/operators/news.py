"""News events: filters, order, optional sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.merge import nest_children
from tapeloom.operators.predicates import clamp_limit, option, parse_day
from tapeloom.operators.selection import page


def news_events(
    events: DataFrame,
    trade_date: str,
    announcement_date: str = "",
    crawl_date: str = "",
    stock_code: str = "",
    event_type: str = "",
    min_importance_score: int | None = None,
    sort_by: str = "announcement_time",
    limit: int | None = None,
    offset: int = 0,
    sources: DataFrame | None = None,
    include_content_text: bool = False,
) -> DataFrame:
    """Events of one trading day, newest first by the chosen time.

    Filters reach the scan; sources are nested only for the events of the page.
    """
    day = parse_day(trade_date)
    if day is None:
        raise ValueError("trade_date is required")
    rows = events.where(F.col("trade_date") == F.lit(day))
    for column, text in (("announcement_time", announcement_date), ("crawl_time", crawl_date)):
        if text:
            rows = rows.where(F.col(column).cast("date") == F.lit(parse_day(text)))
    if stock_code:
        rows = rows.where(F.array_contains("related_stock_codes", stock_code))
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    if min_importance_score is not None:
        rows = rows.where(F.col("importance_score") >= min_importance_score)
    if not include_content_text and "content_text" in rows.columns:
        rows = rows.drop("content_text")
    order = [F.col(option("sort_by", sort_by)).desc(), F.col("importance_score").desc(), F.col("event_id").desc()]
    chosen = page(rows, order, clamp_limit(limit), offset)
    if sources is None:
        return chosen
    return nest_children(chosen, sources, "event_id", "source_record_id", "sources").orderBy(*order)  # a join keeps no order


def news_lag(events: DataFrame) -> DataFrame:
    """Per trading day: events, events crawled after their announcement, mean and largest lag in seconds."""
    lag = F.col("crawl_time").cast("timestamp").cast("double") - F.col("announcement_time").cast("timestamp").cast("double")
    return events.groupBy("trade_date").agg(
        F.count("*").alias("event_count"), F.count_if(lag > 0).alias("late_count"), F.avg(lag).alias("mean_lag_seconds"), F.max(lag).alias("max_lag_seconds")
    )
