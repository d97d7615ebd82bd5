"""Series operators: calendar positions, gaps, lagged changes, and segmentation of long series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio


def series_window(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def previous_change(df: DataFrame, keys: Sequence[str], time: str, value: str = "close") -> DataFrame:
    """pre_close, change and pct_chg (percent) against the previous existing row."""
    previous = F.lag(value).over(series_window(keys, time))
    return df.withColumn("pre_close", previous).withColumn("change", F.col(value) - F.col("pre_close")).withColumn(
        "pct_chg", ratio(F.col("change"), F.col("pre_close")) * 100
    )


def count_change(df: DataFrame, keys: Sequence[str], time: str, value: str = "holder_count") -> DataFrame:
    """change_count and change_pct against the row before; a null row makes the next change null too."""
    previous = F.lag(value).over(series_window(keys, time))
    change = F.col(value) - F.col("_previous")
    return (
        df.withColumn("_previous", previous)
        .withColumn("change_count", change)
        .withColumn("change_pct", ratio(change.cast("double"), F.col("_previous").cast("double")) * 100)
        .drop("_previous")
    )


def open_days(calendar: DataFrame, exchange: str = "SSE", start: Column | None = None, end: Column | None = None) -> Column:
    """Sorted array of the exchange's open days in [start, end], as an uncorrelated scalar subquery.

    Its length is bounded by the days of the range. Grids are built by exploding it, without a cross join.
    """
    days = calendar.where((F.col("exchange") == exchange) & F.col("is_open"))
    if start is not None:
        days = days.where(F.col("trade_date") >= start)
    if end is not None:
        days = days.where(F.col("trade_date") <= end)
    return F.coalesce(days.agg(F.array_sort(F.collect_set("trade_date"))).scalar(), F.array().cast("array<date>"))


def latest_days(df: DataFrame, count: int, until: Column | None = None, day: str = "trade_date") -> DataFrame:
    """The latest ``count`` distinct days, newest first."""
    dates = df.select(day) if until is None else df.select(day).where(F.col(day) <= until)
    return dates.distinct().orderBy(F.col(day).desc()).limit(count)


def day_positions(days: Column, spark) -> DataFrame:
    """(trade_date, position) of a day array, position counted from 0."""
    return spark.range(1).select(F.posexplode(days).alias("position", "trade_date"))


def day_edges(days: Column, spark) -> DataFrame:
    """(trade_date, not_before, after) for every date from the first to the last of a day array: the positions of the
    first day not before it and of the first day after it. At most one row per date of the span."""
    until = F.coalesce(F.date_sub(F.get(days, F.col("position") + 1), 1), F.col("_open"))
    spans = day_positions(days, spark).withColumnRenamed("trade_date", "_open")
    dates = spans.select("position", "_open", F.explode(F.sequence(F.col("_open"), until)).alias("trade_date"))
    after = F.col("position") + 1
    return dates.select("trade_date", F.when(F.col("trade_date") == F.col("_open"), F.col("position")).otherwise(after).alias("not_before"), after.alias("after"))


def missing_ranges(present: DataFrame, entities: DataFrame, days: Column, key: str, day: str = "trade_date") -> DataFrame:
    """Ranges of consecutive expected days without a row, per entity: (key, start_date, end_date, day_count).

    Works on the gaps between present days, so its size follows the rows that exist and not the missing ones.
    Rows on days outside ``days`` are ignored; an entity without rows misses the whole range.
    """
    positions = day_positions(days, present.sparkSession).withColumnRenamed("trade_date", day)
    seen = present.select(key, day).distinct().join(positions, day).select(key, "position")
    window = series_window([key], "position")
    end = F.size(days) - 1
    rows = entities.select(key).distinct().join(seen, key, "left").select(
        key, "position", F.lag("position", 1, -1).over(window).alias("_before"), F.lead("position").over(window).alias("_after")
    )

    def gap(start: Column, stop: Column) -> Column:
        return F.when(start <= stop, F.struct(start.alias("from"), stop.alias("to")))

    before = gap(F.col("_before") + 1, F.coalesce(F.col("position") - 1, end))
    after = gap(F.col("position") + 1, F.when(F.col("_after").isNull(), end))
    gaps = rows.select(key, F.explode(F.array_compact(F.array(before, after))).alias("_gap"))
    first, last = F.col("_gap.from"), F.col("_gap.to")
    return gaps.select(
        key,
        F.element_at(days, first + 1).alias("start_date"),
        F.element_at(days, last + 1).alias("end_date"),
        (last - first + 1).cast("long").alias("day_count"),
    )


def every_code_has(df: DataFrame, codes: DataFrame, key: str, count: int | None) -> DataFrame:
    """One row: does every code have at least ``count`` rows? False when no count is asked for."""
    if not count:
        return df.sparkSession.range(1).select(F.lit(False).alias("enough"))
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    return codes.select(key).distinct().join(counts, key, "left").agg(
        F.coalesce(F.bool_and(F.coalesce(F.col("_rows"), F.lit(0)) >= count), F.lit(True)).alias("enough")
    )


def row_positions(df: DataFrame, keys: Sequence[str], time: str, block: Column) -> DataFrame:
    """Add ``_pos``, the 0-based position of each row in its series, without sorting a whole series in one task.

    ``block`` is a non-decreasing function of ``time`` (a year, a day). Rows are numbered inside each block and
    shifted by the row counts of the earlier blocks; the counts are a small aggregate combined on the map side.
    """
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(time)
    numbered = blocked.withColumn("_row", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, [*keys, "_block"])
        .withColumn("_pos", F.col("_offset") + F.col("_row"))
        .drop("_block", "_offset", "_row")
    )


def cut_segments(df: DataFrame, keys: Sequence[str], time: str, block: Column, rows: int) -> DataFrame:
    """Add ``_pos`` and ``_segment``: pieces of ``rows`` consecutive rows of each series."""
    return row_positions(df, keys, time, block).withColumn("_segment", (F.col("_pos") / rows).cast("long"))


def with_halo(cut: DataFrame, keys: Sequence[str], halo: int, rows: int, compute: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """Run ``compute`` over the pieces of ``cut_segments``, each with the ``halo`` rows before it, which are dropped after.

    Exact for what looks back at most ``halo`` rows, counted with rows whose values are null. ``compute`` gets the frame
    and the partition keys to use.
    """
    if not 0 <= halo <= rows:
        raise ValueError("halo must lie between 0 and rows")
    segment = F.col("_segment")
    copies = F.when(F.col("_pos") % rows >= rows - halo, F.array(segment, segment + 1)).otherwise(F.array(segment))
    pieces = cut.withColumn("_own", segment).withColumn("_segment", F.explode(copies)).withColumn("_halo", F.col("_segment") != F.col("_own"))
    return compute(pieces.drop("_own"), [*keys, "_segment"]).where(~F.col("_halo")).drop("_halo")


def over_segments(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    block: Column,
    halo: int,
    compute: Callable[[DataFrame, Sequence[str]], DataFrame],
    rows: int = 4096,
) -> DataFrame:
    """Run a computation that looks back at most ``halo`` rows over pieces of ``rows`` rows instead of whole series.

    One long series (minute bars of one code, an entity holding a third of the table) spreads over many tasks. What
    carries values over gaps of any length has no such bound: see ``indicators.ewm_mean_by_segment``.
    """
    cut = cut_segments(df, keys, time, block, rows)
    return with_halo(cut, keys, halo, rows, compute).drop("_segment", "_pos")
