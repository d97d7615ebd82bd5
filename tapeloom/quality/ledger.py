"""Incremental duplicate-key check: stored key hashes per day, and exact confirmation of what they hit."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.commits import Commits
from tapeloom.sources.scratch import written

#: Days named as literals in a condition, so that folders of other days are not opened; more are joined.
LITERAL_DAYS = 1_000


class KeyLedger:
    """What is known of the keys of a table, below ``folder``: rows and key hashes of each day, and duplicate keys.

    ``update`` counts the rows per day, which takes no column of a table stored by day, and hashes the keys of those days
    only whose count has changed. Their distinct hashes meet the stored ones of all days: Spark broadcasts them while
    they are few, so stored hashes are scanned and not shuffled. A hash with several places is confirmed by the keys
    themselves, in the days that hold it. Each update is one commit; one that dies leaves the last as it was. A day
    rewritten with as many rows as before is not noticed: name it in ``again``.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], day: str = "trade_date"):
        self.spark, self.folder, self.keys, self.day = spark, folder.rstrip("/"), list(keys), day
        self.commits = Commits(spark, self.folder)

    def _run(self) -> str | None:
        found = self.commits.latest()
        return found and found[1]["run"]

    def days(self) -> DataFrame:
        """(day, n, run): rows per day, and the run whose hashes of the day count."""
        run, schema = self._run(), "day date, n long, run string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/days/{run}") if run else self.spark.createDataFrame([], schema)

    def duplicates(self, table: DataFrame) -> DataFrame:
        """(keys, copies) of all keys that stand more than once, as of the last update."""
        run, schema = self._run(), table.select(*self.keys, F.lit(0).cast("long").alias("copies")).schema
        return self.spark.read.schema(schema).parquet(f"{self.folder}/duplicates/{run}") if run else self.spark.createDataFrame([], schema)

    def update(self, table: DataFrame, again: Sequence[dt.date] = ()) -> DataFrame:
        """Looks at the days that have changed; returns ``duplicates``."""
        counts = table.groupBy(F.col(self.day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        known = self.days().select(F.col("day").alias("_day"), F.col("n").alias("_n"), F.col("run").alias("_run"))
        changed = ~F.col("n").eqNullSafe(F.col("_n")) | F.coalesce(F.coalesce("day", "_day").isin(list(again)), F.lit(False))
        state = written(counts.join(known, counts["day"].eqNullSafe(known["_day"]), "full_outer").withColumn("changed", changed), "ledger-days")
        if self._run() and state.where("changed").isEmpty():
            return self.duplicates(table)
        first, run = self._run() is None, uuid.uuid4().hex
        now = state.where("n is not null")
        new_days = now.where("changed").select("day")
        fresh = self._of_days(table, new_days).select(F.xxhash64(*self.keys).alias("h"), F.col(self.day).alias("day"), F.lit(run).alias("run"))
        fresh.write.mode("append").partitionBy("run", "day").parquet(f"{self.folder}/hashes")
        now.select("day", "n", F.when(F.col("changed"), F.lit(run)).otherwise(F.col("_run")).alias("run")).write.parquet(f"{self.folder}/days/{run}")

        held = self._hashes(self.spark.read.parquet(f"{self.folder}/days/{run}"))
        met = held if first else held.join(held.where(F.col("run") == run).select("h").distinct(), "h")
        several = met.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        before = self.duplicates(table).select(F.xxhash64(*self.keys).alias("h"))
        suspects = written(several.union(before).distinct(), "ledger-suspects")
        places = written(held.join(suspects, "h", "left_semi").select("day").distinct(), "ledger-places")
        rows = self._of_days(table, places).select(*self.keys, F.xxhash64(*self.keys).alias("h")).join(suspects, "h", "left_semi")
        rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").write.parquet(f"{self.folder}/duplicates/{run}")
        self.commits.add({"run": run})
        return self.duplicates(table)

    def _hashes(self, days: DataFrame) -> DataFrame:
        """(h, day, run) that count: of each day, those of the run named in ``days``."""
        stored = self.spark.read.schema("h long, run string, day date").parquet(f"{self.folder}/hashes")
        named = days.select(F.col("day").alias("_day"), F.col("run").alias("_run"))
        return stored.join(named, (stored["run"] == named["_run"]) & stored["day"].eqNullSafe(named["_day"]), "left_semi")

    def _of_days(self, table: DataFrame, days: DataFrame) -> DataFrame:
        """The table's rows of the days: by literals where they are few, which prunes folders, else by a join."""
        few = [row[0] for row in days.limit(LITERAL_DAYS + 1).collect()]
        if len(few) > LITERAL_DAYS:
            named = days.select(F.col("day").alias("_day"))
            return table.join(named, table[self.day].eqNullSafe(named["_day"]), "left_semi")
        wanted = F.col(self.day).isin([day for day in few if day is not None])
        return table.where(wanted | F.col(self.day).isNull() if None in few else wanted)
