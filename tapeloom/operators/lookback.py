"""Latest rows before a day, without reading all history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.sources.scratch import written

#: Days of the first look back; each further one takes twice as many, before those.
FIRST_DAYS = 32
#: Steps after which the table is asked for its first day, which opens all older files where days are folders.
ASK_AFTER = 4
#: Keys still short of rows that are named as literals, so that statistics of the files can prune; more are joined.
LITERAL_KEYS = 500


def rows_before(
    table: DataFrame, wanted: DataFrame, keys: Sequence[str], day: dt.date, count: int = 1, time: str = "trade_date", first_days: int = FIRST_DAYS, oldest: dt.date | None = None
) -> DataFrame:
    """The latest ``count`` rows of each wanted key before ``day``, of any age (not before ``oldest``, if given).

    Looks 32 days back, then 64 days before those, then 128 …, each time only for keys that still lack rows, until none
    does or the table has no older day. A table stored by day is so read as far back as its keys need, in
    logarithmically many steps; the condition on ``time`` is a literal range. ``time`` is a date; of rows of
    one key and day, any come first. A key that is null has no rows. Each step runs when the call is made and leaves at most ``count`` rows per key in
    the shared folder.
    """
    short = wanted.select(*keys).dropna().distinct().withColumn("_need", F.lit(count))
    floor, newest, days, found, start = oldest or dt.date.min, day, first_days, [], None
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc()))
    while True:
        low = dt.date.fromordinal(max(newest.toordinal() - days, floor.toordinal()))
        window = table.where((F.col(time) >= F.lit(low)) & (F.col(time) < F.lit(newest)))
        if found:
            window = _named(window, short, keys)
        latest = window.withColumn("_rank", rank).where(F.col("_rank") <= count)
        # keys without rows stay, so that one table tells both the rows and what is still missing
        step = written(short.join(latest, list(keys), "left").where("_rank is null or _rank <= _need"), "look-back")
        found.append(step.where("_rank is not null").select(*table.columns))
        short = step.groupBy(*keys).agg((F.max("_need") - F.count("_rank")).cast("int").alias("_need")).where("_need > 0")
        if low <= floor or short.isEmpty():
            break
        if len(found) == ASK_AFTER:
            start = table.where(F.col(time) < F.lit(low)).agg(F.min(time)).first()[0] or day
        if start is not None and start >= low:
            break
        newest, days = low, 2 * days
    return reduce(DataFrame.unionByName, found)


def _named(rows: DataFrame, short: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the keys that still lack some: by literals where they are few, else by a join."""
    few = short.select(*keys).limit(LITERAL_KEYS + 1).collect()
    if len(few) > LITERAL_KEYS:
        return rows.join(short.select(*keys), list(keys), "left_semi")
    for key in keys:
        rows = rows.where(F.col(key).isin([row[key] for row in few]))
    return rows
