"""Joins and merges: priority merge, fill from later sources, point-in-time and interval joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Types whose aggregation buffers Spark updates in place.
FIXED_WIDTH = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _stack(sources: Sequence[DataFrame]) -> DataFrame:
    ranked = [source.withColumn("_source", F.lit(rank)) for rank, source in enumerate(sources)]
    return reduce(lambda left, right: left.unionByName(right), ranked)


def priority_merge(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Merge same-shaped sources by key, earlier sources first.

    A value is taken from the first source where it is neither null nor ``''``; if no source has one,
    the first source's own value stays. Keys known to any source are kept. One shuffle on the keys,
    combined on the map side, whatever the number of sources.
    """
    types = dict(sources[0].dtypes)

    def pick(name: str) -> Column:
        value = F.col(name)
        if types[name] != "string":
            return F.min_by(value, F.when(value.isNotNull(), F.col("_source"))).alias(name)
        blank = F.when(F.min_by(value.isNotNull(), F.col("_source")), "")  # the first source's own value, where none is usable
        return F.coalesce(F.min_by(value, F.when(value != "", F.col("_source"))), blank).alias(name)

    values = [name for name in sources[0].columns if name not in keys]
    return _stack(sources).groupBy(*keys).agg(*(pick(name) for name in values)).select(*sources[0].columns)


def fill_missing_only(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Whole rows from the first source having the key; later sources only fill absent keys."""
    values = [name for name in sources[0].columns if name not in keys]
    types = dict(sources[0].dtypes)
    rank = F.col("_source")
    if all(types[name] in FIXED_WIDTH for name in values):  # buffers of fixed width: hashed and not sorted, on the map side too
        return _stack(sources).groupBy(*keys).agg(*[F.min_by(name, rank).alias(name) for name in values], F.min(rank).alias("source_rank"))
    row = F.struct(*values, rank.alias("source_rank"))
    merged = _stack(sources).groupBy(*keys).agg(F.min_by(row, rank).alias("_row"))
    return merged.select(*keys, "_row.*")


def pit_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge of two fact sources per report; the announcement date is part of the keys.

    Columns known to both are coalesced, left first.
    """
    shared = [name for name in left.columns if name in right.columns and name not in keys]
    other = right.select(*keys, *(F.col(name).alias(f"_r_{name}") if name in shared else F.col(name) for name in right.columns if name not in keys))
    joined = left.join(other, list(keys), "full_outer")
    for name in shared:
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.col(f"_r_{name}"))).drop(f"_r_{name}")
    return joined


def interval_join(
    facts: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    day: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    how: str = "inner",
    horizon: Column | None = None,
) -> DataFrame:
    """Attach to each fact the interval rows of its key in force on its day (both ends inclusive).

    With ``horizon`` (latest day of the facts) every interval is copied to the calendar years it covers and
    the join runs on key and year: a hot key spreads over its years and a fact meets only the intervals of
    that year. Without it the join is on the key alone.
    """
    in_force = (F.col(day) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(day) <= F.col("_to")))
    right = intervals.withColumnRenamed(valid_from, "_from").withColumnRenamed(valid_to, "_to")
    on = list(keys)
    left = facts
    if horizon is not None:
        last = F.year(F.least(F.col("_to"), horizon))
        right = right.where(F.col("_from") <= horizon).where(F.year("_from") <= last)
        right = right.withColumn("_year", F.explode(F.sequence(F.year("_from"), last)))
        left = left.withColumn("_year", F.year(day))
        on = [*on, "_year"]
    renamed = right.select(*(F.col(name).alias(f"_k_{name}") if name in on else F.col(name) for name in right.columns))
    condition = reduce(lambda a, b: a & b, [F.col(name) == F.col(f"_k_{name}") for name in on]) & in_force
    joined = left.join(renamed, condition, how)
    return joined.drop(*(f"_k_{name}" for name in on), "_year").withColumnRenamed("_from", valid_from).withColumnRenamed("_to", valid_to)


def as_of_latest(
    facts: DataFrame,
    reports: DataFrame,
    keys: Sequence[str],
    day: str,
    announced: str,
    horizon: Column | None = None,
) -> DataFrame:
    """Latest report of the key announced on or before the fact's day; facts without one keep nulls.

    Reports become validity intervals (until the day before the next announcement), which is a window over
    the small side only; the large side then needs one equi join that AQE can split on a hot key.
    Reports must be unique per (keys, announced).
    """
    window = Window.partitionBy(*keys).orderBy(announced)
    spans = reports.withColumn("_until", F.date_sub(F.lead(announced).over(window), 1))
    return interval_join(facts, spans, keys, day, announced, "_until", "left", horizon).drop("_until")


def nest_children(parents: DataFrame, children: DataFrame, key: str, order: str, into: str, most: int | None = None) -> DataFrame:
    """Attach the child rows of each parent as an array of structs ordered by ``order``.

    Children of other parents are dropped before they are gathered. An array is one value of a row; where a parent may
    have any number of children, ``most`` bounds it to the first ones and adds ``<into>_total``, their whole number. The
    rest is read as rows, from ``children`` itself.
    """
    fields = [order, *(name for name in children.columns if name not in (key, order))]
    own = children.join(parents.select(key), key, "left_semi")
    if most is None:
        nested = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(into))
        return parents.join(nested, key, "left")
    totals = own.groupBy(key).agg(F.count(F.lit(1)).alias(f"{into}_total"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*fields))
    first = own.withColumn("_rank", rank).where(F.col("_rank") <= most)
    nested = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(into))
    return parents.join(nested, key, "left").join(totals, key, "left").fillna(0, [f"{into}_total"])


def absent_rows(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without an actual row."""
    return expected.join(actual.select(*keys), list(keys), "left_anti")
