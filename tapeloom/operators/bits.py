"""Completeness of intraday series by bit sets: one long per code, day and 64 of the day's bar ends.

A bar sets the bit of its end; sets are combined with ``bit_or``, on the map side too, so a group holds one long however
many rows it has, and sets of different stretches of time or sources combine in any order. Expected bar ends are sets
too, at most a few per day of the calendar, and what is missing is one word without another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64
DAY_MINUTES = 24 * 60


def slot_of(time: Column, ends: Sequence[int]) -> Column:
    """Which of the day's bar ends (minutes after midnight, ascending) a time is; null if none."""
    table = [None] * DAY_MINUTES
    for slot, minute in enumerate(ends):
        table[minute] = slot
    at = F.get(F.array(*[F.lit(x).cast("int") for x in table]), F.hour(time) * 60 + F.minute(time))
    return F.when(time == F.date_trunc("minute", time), at)


def day_bits(rows: DataFrame, keys: Sequence[str], time: str, ends: Sequence[int]) -> DataFrame:
    """(keys, day, word, bits): bit s % 64 of word s // 64 is set if there is a row at the day's bar end s.

    Rows at other times are passed over.
    """
    marked = rows.select(*keys, F.col(time).cast("date").alias("day"), slot_of(F.col(time), ends).alias("_slot")).where("_slot is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_slot") % WORD)
    return marked.groupBy(*keys, "day", F.floor(F.col("_slot") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def expected_bits(times: DataFrame, time: str, ends: Sequence[int]) -> DataFrame:
    """(day, word, mask) of expected times, as ``day_bits``: as many rows as the calendar has days, times the words of a day."""
    return day_bits(times, [], time, ends).withColumnRenamed("bits", "mask")


def missing_bits(bits: DataFrame, entities: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, day, word, mask, nth, missing) of every expected word of which an entity lacks a bit; ``nth`` counts the days."""
    listed = expected.agg(F.collect_list(F.struct("day", "word", "mask")).alias("words"), F.array_sort(F.collect_set("day")).alias("days"))
    nth = F.transform("words", lambda x: F.struct(x["day"].alias("day"), x["word"].alias("word"), x["mask"].alias("mask"), F.array_position("days", x["day"]).alias("nth")))
    entries = listed.select(nth).scalar()
    grid = entities.select(key).distinct().select(key, F.explode(entries).alias("_e")).select(key, "_e.*")
    held = grid.join(bits, [key, "day", "word"], "left")
    missing = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))
    return held.select(key, "day", "word", "mask", "nth", missing.alias("missing")).where("missing <> 0")


def _places(bits: str) -> Column:
    """The set bits of a word, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col(bits), i) == 1)


def _end(slot: Column, ends: Sequence[int]) -> Column:
    """The bar end of a slot of ``day``."""
    minute = F.get(F.array(*[F.lit(m) for m in ends]), slot)
    return F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)


def bit_counts(bits: DataFrame, entities: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, expected_bar_count, actual_bar_count, missing_count) of every entity; no array grows with the time covered."""
    total = F.coalesce(expected.agg(F.sum(F.bit_count("mask"))).scalar(), F.lit(0)).cast("long")
    met = bits.join(expected, ["day", "word"]).groupBy(key).agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("mask")))).alias("_met"))
    actual = F.coalesce("_met", F.lit(0)).cast("long")
    return entities.select(key).distinct().join(met, key, "left").select(key, total.alias("expected_bar_count"), actual.alias("actual_bar_count"), (total - actual).alias("missing_count"))


def missing_times(missing: DataFrame, key: str, ends: Sequence[int], into: str = "missing_trade_times") -> DataFrame:
    """(key, ``into``): all missing bar ends of an entity as a sorted array, as long as what is missing."""
    own = F.transform(_places("missing"), lambda i: _end(F.col("word") * WORD + i, ends))
    listed = missing.select(key, F.struct("day", "word", own.alias("times")).alias("_x")).groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    return listed.select(key, F.flatten(F.transform("_x", lambda x: x["times"])).alias(into))


def missing_bar_ranges(missing: DataFrame, key: str, ends: Sequence[int]) -> DataFrame:
    """(key, start_time, end_time, bar_count): ranges of consecutive bar ends of the expected days that are all missing.

    A word that is missing whole is one piece, a bit of any other is one; pieces that follow one another are joined, so
    the work follows the words with something missing and not the bar ends.
    """
    whole = F.col("missing") == F.col("mask")
    first, last = F.when(whole, F.array_min(_places("mask"))), F.when(whole, F.array_max(_places("mask")))
    bit = F.explode(F.when(whole, F.array(F.lit(0))).otherwise(_places("missing")))
    pieces = missing.select("*", first.alias("_first"), last.alias("_last"), bit.alias("_i"))
    low, high = (F.col("word") * WORD + F.coalesce(edge, "_i") for edge in ("_first", "_last"))
    before = (F.col("nth") - 1) * len(ends)
    pieces = pieces.select(key, (before + low).alias("_low"), (before + high + 1).alias("_high"), _end(low, ends).alias("_start"), _end(high, ends).alias("_stop"))
    order = Window.partitionBy(key).orderBy("_low")
    fresh = (F.col("_low") != F.lag("_high", 1, -1).over(order)).cast("int")
    islands = pieces.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
    return islands.groupBy(key, "_island").agg(F.min("_start").alias("start_time"), F.max("_stop").alias("end_time"), F.sum(F.col("_high") - F.col("_low")).alias("bar_count")).drop("_island")
