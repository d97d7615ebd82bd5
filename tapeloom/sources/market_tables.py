"""Market tables derived from retail tables.

The library works on any bars, calendars and memberships; here they are derived from the given order and event
tables so that queries have data of any size to run on. Money and quantities are summed in cents, which makes sums
independent of the row order.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exact_sum(column: str | Column) -> Column:
    """Sum of an amount in whole cents: integers, so the same whatever the order of the rows."""
    value = F.col(column) if isinstance(column, str) else column
    return F.sum(F.floor(value * 100 + 0.5)) / F.lit(100.0)


class MarketTables:
    """Lazy DataFrames over one folder of parquet tables.

    Days and minutes are derived from timestamps, so a condition on them cannot reach the scan. ``between`` puts the
    same window on the stored column.
    """

    def __init__(self, spark: SparkSession, folder: str, first: dt.date | None = None, last: dt.date | None = None):
        self.spark = spark
        self.folder = folder
        self.first, self.last = first, last

    def between(self, first: str, last: str) -> MarketTables:
        """The tables with trades and events of the days from ``first`` to ``last`` only; orders and references stay whole."""
        return MarketTables(self.spark, self.folder, dt.date.fromisoformat(first), dt.date.fromisoformat(last))

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        time = {"lineitem": "l_shipdate", "events": "ts"}.get(name)
        if time and self.first:
            start, end = (dt.datetime.combine(day, dt.time()) for day in (self.first, self.last + dt.timedelta(days=1)))
            df = df.where((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))
        return df

    @cached_property
    def trades(self) -> DataFrame:
        """lineitem with the instrument columns of part."""
        line = self.raw("lineitem").select(
            F.col("l_partkey").alias("p_partkey"),
            F.col("l_shipdate").cast("date").alias("trade_date"),
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        )
        return line.join(self.raw("part").select("p_partkey", "p_brand", "p_type"), "p_partkey")

    def _bars(self, code: str) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        sums = self.trades.groupBy(F.col(code).alias("code"), "trade_date").agg(
            F.min(price).alias("low"), F.max(price).alias("high"),
            exact_sum("l_quantity").alias("volume"), exact_sum("l_extendedprice").alias("amount"),
        )
        return sums.select("code", "trade_date", "low", "high", (F.col("amount") / F.col("volume")).alias("close"), "volume", "amount")

    @cached_property
    def calendar(self) -> DataFrame:
        return self.raw("orders").select(
            F.lit("SSE").alias("exchange"), F.col("o_orderdate").cast("date").alias("trade_date"), F.lit(True).alias("is_open")
        ).distinct()

    @cached_property
    def bars_daily(self) -> DataFrame:
        return self._bars("p_type")

    @cached_property
    def bars_sparse(self) -> DataFrame:
        return self._bars("p_brand")

    @cached_property
    def stock_ref(self) -> DataFrame:
        """One stock per (brand, type), numbered in that order: within each brand, after the pairs of earlier brands.

        Only the brands' sizes, one narrow row each, are ordered together.
        """
        pairs = self.raw("part").select("p_brand", "p_type").distinct()
        earlier = F.coalesce(F.sum("size").over(Window.orderBy("p_brand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = pairs.groupBy("p_brand").agg(F.count("*").alias("size")).select("p_brand", earlier.alias("_before"))
        n = F.col("n")
        own = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type"))
        numbered = pairs.withColumn("_own", own).join(offsets, "p_brand").withColumn("n", F.col("_own") + F.col("_before"))
        digit = F.when(n % 47 == 0, "7").when(n % 3 == 0, "6").when(n % 3 == 1, "0").otherwise("8")
        return numbered.select(
            F.when(n % 3 == 0, "SHSE").when(n % 3 == 1, "SZSE").otherwise("BJSE").alias("market"),
            F.concat(digit, F.lpad(n.cast("string"), 5, "0")).alias("code"),
            "p_brand", "p_type",
            F.col("p_type").alias("listing_board"),
            F.when(n % 41 == 0, "").otherwise(F.col("p_type")).alias("board_type"),
            F.lit("1995-01-01").cast("date").alias("listed_date"),
            F.when(n % 25 == 0, F.lit("2001-06-30").cast("date")).alias("delisted_date"),
        )

    @cached_property
    def stock_daily(self) -> DataFrame:
        """Weekly-spaced bars per stock with suspension and ST flags, reduced before meeting the catalogue."""
        flag_suspended = F.max(((F.col("l_quantity") == 1) & (F.col("l_tax") == 0)).cast("int")) == 1
        flag_st = F.max(((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.10) & (F.col("l_tax") == 0.08)).cast("int")) == 1
        reduced = self.trades.groupBy("p_brand", "p_type", F.date_trunc("week", "trade_date").cast("date").alias("trade_date")).agg(
            exact_sum("l_quantity").alias("volume"), exact_sum("l_extendedprice").alias("amount"),
            flag_suspended.alias("is_suspended"), flag_st.alias("is_st"),
        )
        return reduced.join(self.stock_ref.select("market", "code", "p_brand", "p_type"), ["p_brand", "p_type"]).select(
            "market", "code", "trade_date", (F.col("amount") / F.col("volume")).alias("close"), "volume", "amount", "is_suspended", "is_st"
        )

    @cached_property
    def membership(self) -> DataFrame:
        number = F.substring("code", 2, 5).cast("int")
        return self.stock_ref.select(
            F.col("p_type").alias("concept_id"), F.col("market").alias("stock_market"), F.col("code").alias("stock_code"),
            F.col("listed_date").alias("valid_from"), F.when(number % 10 == 0, F.lit("2000-12-31").cast("date")).alias("valid_to"),
        )

    @cached_property
    def concept_daily(self) -> DataFrame:
        """Concept amounts summed from their members, with a seeded excess for one concept."""
        live = self.stock_daily.where(~F.col("is_suspended") & ~F.col("is_st"))
        members = self.membership
        joined = live.join(
            members,
            (members.stock_market == live.market) & (members.stock_code == live.code) & (members.valid_from <= live.trade_date)
            & (members.valid_to.isNull() | (members.valid_to >= live.trade_date)),
        )
        amounts = joined.groupBy("concept_id", "trade_date").agg(exact_sum("amount").alias("amount"))
        return amounts.withColumn("amount", F.col("amount") + F.when(F.col("concept_id") == "PROMO", 100.0).otherwise(0.0))

    @cached_property
    def bars_minute(self) -> DataFrame:
        return self.raw("events").groupBy(
            F.col("event_type").alias("code"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bar_time")
        ).agg(
            F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume"), exact_sum("value").alias("amount"),
        )

    @cached_property
    def holder_counts(self) -> DataFrame:
        """Distinct customers per nation and month."""
        placed = self.raw("orders").select(
            F.col("o_custkey").alias("c_custkey"), F.date_trunc("month", "o_orderdate").cast("date").alias("trade_date")
        ).distinct()
        homes = self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("code"))
        return placed.join(homes, "c_custkey").groupBy("code", "trade_date").agg(F.count("*").alias("holder_count"))

    @cached_property
    def news(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("ts").cast("date").alias("trade_date"), F.col("ts").alias("announcement_time"), "event_type",
            (F.floor(F.col("value") / 100) + 1).cast("int").alias("importance_score"), F.col("user_id").alias("stock_code"),
        )
