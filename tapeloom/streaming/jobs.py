"""Streaming jobs: live bars, idempotent upserts, minute-gap audit, news lag.

Every job takes a streaming DataFrame and a folder on shared storage for its output and checkpoint, so that a lost
driver or executor resumes where it was.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom.operators.bits import WORD, slot_of
from tapeloom.quality.checks import session_days, session_issues
from tapeloom.sources.commits import Commits


def read_events(spark: SparkSession, folder: str, schema, time: str = "ts", files: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet event files as a stream; the event time becomes a zoned timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def live_bars(ticks: DataFrame, width: str = "1 minute", delay: str = "10 minutes", key: str = "code", time: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """Ticks to OHLCV bars per key and window. State is one row per open window and key, whatever the tick rate."""
    windowed = ticks.withWatermark(time, delay).groupBy(F.window(time, width), key)
    bars = windowed.agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.count("*").alias("volume"), F.sum(value).alias("amount"),
    )
    return bars.select(key, F.col("window.start").alias("bar_time"), F.col("window.end").alias("bar_end"), "open", "high", "low", "close", "volume", "amount")


def coarser_bars(bars: DataFrame, width: str, key: str = "code") -> DataFrame:
    """Longer bars from a stream of finished shorter ones (``live_bars``, or this): each level keeps its own open windows.

    Levels are chained through their stored bars, so ticks are aggregated once whatever the number of widths, and each
    level resumes by itself. Finished bars are never late; a window closes when a bar that begins at its end has come.
    """
    windowed = bars.withWatermark("bar_time", "0 seconds").groupBy(F.window("bar_time", width), key)
    longer = windowed.agg(
        F.min_by("open", "bar_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_time").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )
    return longer.select(key, F.col("window.start").alias("bar_time"), F.col("window.end").alias("bar_end"), "open", "high", "low", "close", "volume", "amount")


def chain_bars(spark: SparkSession, folder: str, checkpoint: str, widths: Sequence[str]) -> None:
    """Runs the levels above ``folder``/<first width> one after the other, each from the stored bars of the one before."""
    for finer, width in zip(widths, widths[1:]):
        path = f"{folder}/{finer.replace(' ', '-')}"
        bars = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        append_to(coarser_bars(bars, width), f"{folder}/{width.replace(' ', '-')}", f"{checkpoint}/{width.replace(' ', '-')}").awaitTermination()


def session_audit(bars: DataFrame, ends: Sequence[int], key: str = "code") -> DataFrame:
    """(key, trade_date, minute_count, missing_count, first_minute, last_minute) of each day, once its close has passed.

    ``bars`` are finished minute bars labelled by ``bar_time``, ``ends`` the session's labels in minutes after midnight. An
    open day's state is one bit per label, and it goes when a bar after the close has come. Days without any session
    minute of a key have no row; minutes outside the session only move the clock.
    """
    close, words = ends[-1] + 1, -(-len(ends) // WORD)
    timed = bars.withWatermark("bar_time", "0 seconds").withColumn("_slot", slot_of(F.col("bar_time"), ends)).where("_slot is not null")
    day = F.window("bar_time", "1 day", "1 day", f"{close} minutes")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_slot") % WORD)
    sets = [F.bit_or(F.when(F.floor(F.col("_slot") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(words)]
    days = timed.groupBy(day, key).agg(*sets, F.min("bar_time").alias("_first"), F.max("bar_time").alias("_last"))
    held = reduce(lambda a, b: a + b, [F.bit_count(f"_w{w}") for w in range(words)]).cast("long")
    return days.select(
        key, F.col("window.end").cast("date").alias("trade_date"), held.alias("minute_count"), (F.lit(len(ends)) - held).cast("long").alias("missing_count"),
        F.date_format("_first", "HH:mm").alias("first_minute"), F.date_format("_last", "HH:mm").alias("last_minute"),
    )


def with_sources(events: DataFrame, sources: DataFrame, keys: Sequence[str], time: str, source_time: str, within: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Every event with each source of its keys from its time on until ``within`` after it; events without one, with nulls.

    Both are streams that may come out of order by ``delay``. Pairs come when the later half has come; an event without
    a source comes once none can come any more. State holds what may still be met. Columns: the events', then the
    sources' without the keys.
    """
    left, right = events.withWatermark(time, delay), sources.withWatermark(source_time, delay)
    rest = [c for c in sources.columns if c not in keys]
    right = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *rest)
    met = (F.col(source_time) >= F.col(time)) & (F.col(source_time) <= F.col(time) + F.expr(f"interval {within}"))
    for k in keys:
        met = met & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(right, met, "leftOuter").select(*events.columns, *rest)


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to parquet (exactly once through the file sink's log); drains what is available."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(stream: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of a key; state is kept for the watermark delay only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


STORED_DAY = "stored_day"


def upsert_into(path: str, keys: Sequence[str], order: str = "", time: str = "") -> Callable[[DataFrame, int], None]:
    """Batch handler: store each batch as a version; replaying a batch overwrites its own version.

    With ``time`` (one of the keys) versions are kept per day, so that readers of some days prune the others.

    With ``order`` a batch may hold several rows of a key and the one highest in ``order`` is kept. Nothing is
    read back while writing, so the handler is idempotent and its cost follows the batch, not the table.
    ``read_upserts`` gives the current rows and ``compact_upserts`` folds versions together.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if order:
            values = [name for name in batch.columns if name not in keys]
            rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row")).select(*keys, "_row.*")
        parts = ["batch_id"]
        if time:
            rows, parts = rows.withColumn(STORED_DAY, F.col(time).cast("date")), [STORED_DAY, "batch_id"]
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    return handle


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], days: Sequence[dt.date] | None = None) -> DataFrame:
    """Latest version of every key: one map-side combined aggregation, no window. Folded days are read from their fold.

    ``days`` of a store kept per day limits the read to their partitions.
    """
    folds = _folds(spark, path)
    beside = f"{path.rstrip('/')}__folded"
    # all versions may have been deleted after a fold; its files tell the columns then
    rows = spark.read.schema(spark.read.parquet(f"{beside}/{next(iter(folds.values()))['folder']}").schema).parquet(path) if folds else spark.read.parquet(path)
    if folds:
        upto = spark.createDataFrame([(dt.date.fromisoformat(day), fold["batch"]) for day, fold in folds.items()], f"{STORED_DAY} date, _upto long")
        rows = rows.join(upto, STORED_DAY, "left").where(F.col("_upto").isNull() | (F.col("batch_id") > F.col("_upto"))).select(*rows.columns)
        for folder, own in _by_folder(folds, days).items():  # each fold holds the newest rows of its days
            folded = spark.read.parquet(f"{beside}/{folder}").where(F.col(STORED_DAY).isin(own))
            rows = rows.unionByName(folded.select(*rows.columns))
    if days is not None:
        rows = rows.where(F.col(STORED_DAY).isin(list(days)))
    values = [name for name in rows.columns if name not in (*keys, "batch_id", STORED_DAY)]
    if not values:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row")).select(*keys, "_row.*")


def compact_upserts(spark: SparkSession, path: str, into: str, keys: Sequence[str], partition_by: str) -> None:
    """Write the current rows as a table partitioned by ``partition_by``."""
    read_upserts(spark, path, keys).hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(into)


def _folds(spark: SparkSession, path: str) -> dict[str, dict]:
    """Folded days of an upsert store: the newest batch of a fold and its folder, by day."""
    latest = Commits(spark, f"{path.rstrip('/')}__folded").latest()
    return latest[1]["days"] if latest else {}


def _by_folder(folds: dict[str, dict], days: Sequence[dt.date] | None) -> dict[str, list[dt.date]]:
    out: dict[str, list[dt.date]] = {}
    for text, fold in folds.items():
        day = dt.date.fromisoformat(text)
        if days is None or day in days:
            out.setdefault(fold["folder"], []).append(day)
    return out


def fold_versions(spark: SparkSession, path: str, keys: Sequence[str], days: Sequence[dt.date]) -> None:
    """Puts one version, the newest rows, in the place of all versions of some days of a store kept per day.

    The fold is written beside the store and takes effect by a commit; no file that a reader may be reading is replaced
    or deleted. Batches that come meanwhile are newer than the fold and stay in force. ``delete_folded`` frees the room.
    """
    newest = spark.read.parquet(path).where(F.col(STORED_DAY).isin(list(days))).groupBy(STORED_DAY).agg(F.max("batch_id").alias("batch_id"))
    batches = {row[STORED_DAY]: row.batch_id for row in newest.collect()}  # a row per day
    if not batches:
        return
    upto = spark.createDataFrame(list(batches.items()), f"{STORED_DAY} date, batch_id long")
    folded = read_upserts(spark, path, keys, list(batches))
    time = next(name for name, kind in folded.dtypes if name in keys and kind.startswith(("timestamp", "date")))
    folder = uuid.uuid4().hex
    rows = folded.withColumn(STORED_DAY, F.col(time).cast("date")).join(upto, STORED_DAY)
    rows.hint("rebalance", STORED_DAY).write.partitionBy(STORED_DAY).parquet(f"{path.rstrip('/')}__folded/{folder}")
    held = _folds(spark, path)
    Commits(spark, f"{path.rstrip('/')}__folded").add({"days": {**held, **{day.isoformat(): {"batch": batch, "folder": folder} for day, batch in batches.items()}}})


def delete_folded(spark: SparkSession, path: str) -> None:
    """Deletes the versions that folds have replaced; for a time when no reader that began before the fold is left."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for day, fold in _folds(spark, path).items():
        folder = hadoop(f"{path.rstrip('/')}/{STORED_DAY}={day}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for version in files.listStatus(folder) if files.exists(folder) else []:
            name = version.getPath().getName()
            if name.startswith("batch_id=") and int(name.split("=")[1]) <= fold["batch"]:
                files.delete(version.getPath(), True)
    spark.catalog.refreshByPath(path)


def audit_gaps(
    path: str, stored_bars: Callable[[list[dt.date]], DataFrame], days, expected_minutes: int = 240, min_row_ratio: float = 0.95, time: str = "bar_time"
) -> Callable[[DataFrame, int], None]:
    """Batch handler: session issues of the days a batch touches, judged on all bars stored for them.

    ``stored_bars`` reads the bars of the days it is given, after the batch has been stored; ``days`` is the array of
    expected days, which bounds those given. The cost of a batch follows the days it touches and not the store. Each
    batch writes a version of its days, and the latest version of a day is the one in force.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        expected = batch.sparkSession.range(1).select(F.explode(days).alias("d"))
        dates = [row.d for row in batch.select(F.col(time).cast("date").alias("d")).join(expected, "d").distinct().collect()]
        touched = F.array(*map(F.lit, dates)).cast("array<date>")
        issues = session_issues(session_days(stored_bars(dates), time, touched), expected_minutes, min_row_ratio)
        issues.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return handle


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Days whose latest audit found an issue."""
    return read_upserts(spark, path, ["trade_date"]).where(F.col("issue").isNotNull())


def lag_by_hour(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Per crawl hour: events, late events (crawled after their announcement) and the largest lag in seconds."""
    lag = F.col("crawl_time").cast("double") - F.col("announcement_time").cast("timestamp").cast("double")
    hours = events.withWatermark("crawl_time", delay).groupBy(F.window("crawl_time", "1 hour"))
    counted = hours.agg(F.count("*").alias("event_count"), F.count_if(lag > 0).alias("late_count"), F.max(lag).alias("max_lag_seconds"))
    return counted.select(F.col("window.start").alias("crawl_hour"), "event_count", "late_count", "max_lag_seconds")
