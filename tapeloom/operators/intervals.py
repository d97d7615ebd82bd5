"""Validity joins by dyadic covers: intervals of any length in logarithmically many pieces, met by equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days are numbered from 1850 on; 2^17 of them reach to 2208. Earlier and later days count as the first and the last.
LEVELS, ORIGIN = 17, "1850-01-01"


def _number(day: Column) -> Column:
    number = F.least(F.greatest(F.datediff(day, F.lit(ORIGIN).cast("date")), F.lit(0)), F.lit((1 << LEVELS) - 1))
    return F.when(day.isNotNull(), number)


def dyadic_cover(first: Column, last: Column) -> Column:
    """Aligned ranges (level, prefix) that hold exactly the days from ``first`` to ``last``: at most two per level.

    A range of level k has 2^k days; a day d lies in it if d >> k is its prefix. A null end is open.
    """
    low, high = _number(first), F.coalesce(_number(last), F.lit((1 << LEVELS) - 1)) + 1
    out = []
    for k in range(LEVELS + 1):
        left, right = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high, k)  # whole ranges of the level inside
        odd = left.bitwiseAND(F.lit(1))
        out.append(F.when((left < right) & (odd == 1), F.struct(F.lit(k).alias("level"), left.alias("prefix"))))
        out.append(F.when((left + odd < right) & (right.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("level"), (right - 1).alias("prefix"))))
    return F.array_compact(F.array(*out))


def cover_join(facts: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str, valid_from: str = "valid_from", valid_to: str = "valid_to", how: str = "inner") -> DataFrame:
    """Each fact with the interval rows of its key in force on its day (both ends count, a null end is open).

    Every interval becomes its dyadic cover and every different (key, day) its ranges of the levels that occur, so both
    meet by equality on (key, level, prefix): no interval is copied per day or year however long it is, and a key with
    very many intervals or days spreads over the prefixes. Facts of one key and day are looked up once and joined back.
    ``how`` is inner or left. Columns are those of ``interval_join``.
    """
    rest = [c for c in intervals.columns if c not in keys]
    pieces = intervals.where(F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_to) >= F.col(valid_from))))
    pieces = pieces.select(*keys, F.struct(*rest).alias("_row"), F.explode(dyadic_cover(F.col(valid_from), F.col(valid_to))).alias("_piece"))
    pieces = pieces.select(*keys, "_row", F.col("_piece.level").alias("_level"), F.col("_piece.prefix").alias("_prefix"))
    levels = F.coalesce(pieces.agg(F.collect_set("_level")).scalar(), F.array().cast("array<int>"))
    days = facts.select(*keys, F.col(day).alias("_day")).distinct()
    asked = days.withColumn("_n", _number(F.col("_day"))).select(*keys, "_day", "_n", F.explode(levels).alias("_level"))
    asked = asked.withColumn("_prefix", F.call_function("shiftright", "_n", "_level")).drop("_n")
    met = asked.join(pieces, [*keys, "_level", "_prefix"])
    inside = (F.col("_day") >= F.col(f"_row.{valid_from}")) & (F.col(f"_row.{valid_to}").isNull() | (F.col("_day") <= F.col(f"_row.{valid_to}")))
    met = met.where(inside).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_day", "_row")  # days beyond the numbered ones share its ends
    same = F.col(day) == F.col("_day")
    for k in keys:
        same = same & (facts[k] == F.col(f"_k_{k}"))
    joined = facts.join(met, same, how)
    return joined.select(*[facts[c] for c in facts.columns], *[F.col(f"_row.{c}").alias(c) for c in rest])
