"""Minute and day bars kept as mergeable states; corrections redo the days they touch and no others."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.bar_states import STATE, merge_states, state_of
from tapeloom.sources.commits import Commits
from tapeloom.sources.scratch import written

LEVELS = ("1m", "1d")


class BarStore:
    """States of one minute and of one day below ``root``, by day; longer bars merge day states when they are read.

    ``apply`` takes minute bars, new or corrected: their days are written anew on both levels, below the number of the
    run, and a commit names the run that counts for each day. A reader sees one commit's days whole; a run that dies
    leaves no trace but its folder.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("code",), time: str = "bar_time"):
        self.spark, self.root, self.keys, self.time = spark, root.rstrip("/"), list(keys), time
        self.commits = Commits(spark, self.root)

    def days(self) -> DataFrame:
        """(day, run): the run whose rows count for each day."""
        latest = self.commits.latest()
        return self.spark.read.schema("day date, run string").parquet(f"{self.root}/days/{latest[1]['run']}") if latest else self.spark.createDataFrame([], "day date, run string")

    def _level(self, level: str, days: DataFrame) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{level}")
        named = days.select(F.col("day").alias("_day"), F.col("run").alias("_run"))  # one row per day of the calendar
        return rows.join(named, (rows["day"] == named["_day"]) & (rows["run"].cast("string") == named["_run"]), "left_semi").drop("run")

    def apply(self, bars: DataFrame) -> list:
        """Takes minute bars (keys, time, open, high, low, close, volume, amount), unique per key and time; returns their days."""
        run = f"r{uuid.uuid4().hex}"
        fresh = written(state_of(bars, self.keys, self.time).withColumn("day", F.col("open_time").cast("date")), "bar-states")
        touched = [row.day for row in fresh.select("day").distinct().collect()]  # days of one delivery
        if not touched:
            return []
        known = self.days()
        if self.commits.latest() is not None:
            held = self._level("1m", known.where(F.col("day").isin(touched))).where(F.col("day").isin(touched))
            fresh = fresh.unionByName(held.join(fresh.select(*self.keys, "open_time"), [*self.keys, "open_time"], "left_anti").select(*fresh.columns))
        self._write(fresh, "1m", run)
        minutes = self.spark.read.parquet(f"{self.root}/1m/run={run}")
        self._write(merge_states(minutes, [*self.keys, "day"]), "1d", run)
        days = known.where(~F.col("day").isin(touched)).unionByName(fresh.select("day").distinct().withColumn("run", F.lit(run)))
        days.coalesce(1).write.parquet(f"{self.root}/days/{run}")
        self.commits.add({"run": run})
        return sorted(touched)

    def _write(self, states: DataFrame, level: str, run: str) -> None:
        rows = states.withColumn("run", F.lit(run)).hint("rebalance", "day")
        rows.write.mode("append").partitionBy("run", "day").parquet(f"{self.root}/{level}")

    def bars(self, freq: str) -> DataFrame:
        """(keys, trade_time, open, high, low, close, volume, amount, bar_count) at 1m, 1d, 1w (by Monday's week) or 1mo.

        ``trade_time`` is the minute, the day, or the last day with bars of the week or month.
        """
        if freq == "1m":
            return self._level("1m", self.days()).withColumn("trade_time", F.col("open_time")).select(*self._shown())
        daily = self._level("1d", self.days())
        if freq == "1d":
            return daily.withColumn("trade_time", F.col("day")).select(*self._shown())
        unit = {"1w": "week", "1mo": "month"}[freq]
        longer = merge_states(daily.withColumn("_bucket", F.date_trunc(unit, "day")), [*self.keys, "_bucket"])
        return longer.withColumn("trade_time", F.col("close_time").cast("date")).select(*self._shown())

    def _shown(self) -> list[str]:
        return [*self.keys, "trade_time", *[name for name in STATE if not name.endswith("_time")]]
