"""As-of joins of two large sides: the latest report is carried from block to block of time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.selection import last_n

BLOCK_DAYS = 32


def day_blocks(time: Column, days: int = BLOCK_DAYS) -> Column:
    """Numbers of aligned blocks of ``days`` days; whatever does not decrease with time may stand for it."""
    return F.floor(F.unix_date(time.cast("date")) / days)


def as_of_blocks(facts: DataFrame, reports: DataFrame, keys: Sequence[str], time: str, announced: str, block: Callable[[Column], Column] = day_blocks, tie: Sequence[str] = ()) -> DataFrame:
    """Each fact with the latest report of its key announced at or before ``time``; facts without one keep nulls.

    Facts and reports are sorted together inside (key, block), so a key that holds a third of both spreads over its
    blocks. What a block starts with is the last report of the blocks before it: one row per (key, block) is ordered
    along a key, no more. Of reports of one key and time, the greatest by ``tie`` counts; any, if they are alike in it.
    A null key or time meets no report. Columns: those of ``facts``, then those of ``reports`` without the keys.
    """
    kept, given = facts.columns, [c for c in reports.columns if c not in keys]
    own = F.struct(*[F.col(c) for c in given])
    known = reports.dropna(subset=[*keys, announced]).select(*keys, F.col(announced).alias("_at"), block(F.col(announced)).alias("_block"), own.alias("_report"))
    rows = facts.select(*keys, F.col(time).alias("_at"), block(F.col(time)).alias("_block"), F.struct(*[F.col(c) for c in kept]).alias("_fact"))
    best = known.withColumn("_order", F.struct("_at", *[F.col(f"_report.{c}") for c in tie]))
    last = last_n(best, [*keys, "_block"], "_order", 1).select(*keys, "_block", "_report")
    none = F.lit(None).cast(known.schema["_report"].dataType)
    asked = rows.select(*keys, "_block").distinct().where(_known([*keys, "_block"])).select("*", none.alias("_report"), F.lit(0).alias("_told"))
    steps = asked.unionByName(last.withColumn("_told", F.lit(1)))  # a block asks before it tells
    before = F.last("_report", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block", "_told").rowsBetween(Window.unboundedPreceding, -1))
    carried = steps.withColumn("_report", before).where((F.col("_told") == 0) & F.col("_report").isNotNull())

    def side(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        columns = {"_at": F.col("_at"), "_report": none, "_fact": F.lit(None).cast(rows.schema["_fact"].dataType), **given}
        return df.select(*keys, "_block", F.lit(kind).alias("_kind"), *[x.alias(name) for name, x in columns.items()])

    report = F.col("_report")
    when = rows.schema["_at"].dataType
    together = reduce(DataFrame.unionByName, [
        side(carried, 0, _at=F.lit(None).cast(when), _report=report), side(known, 1, _at=F.col("_at").cast(when), _report=report), side(rows, 2, _fact=F.col("_fact")),
    ])
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col("_kind") != 0, "_at", "_kind", *[F.col(f"_report.{c}") for c in tie]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = together.withColumn("_found", F.last("_report", ignorenulls=True).over(inside)).where("_kind = 2")
    whole = _known([*keys, "_at"])
    return found.select(*[F.col(f"_fact.`{c}`").alias(c) for c in kept], *[F.when(whole, F.col(f"_found.`{c}`")).alias(c) for c in given])


def _known(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
