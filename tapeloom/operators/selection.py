"""Row selection: last-N, cuts, paging, whole-entity exclusion, first-per-key, projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import finite
from tapeloom.sources.scratch import new_folder

#: Offset from which on a page is taken from range partitions; below it, so many rows may pass through one task.
DEEP = 100_000


def last_n(df: DataFrame, keys: Sequence[str], time: str, count: int | None) -> DataFrame:
    """Latest ``count`` rows per entity; None or 0 keeps all.

    Spark turns the rank filter into a per-partition group limit before the shuffle, so a hot entity
    sends at most ``count`` rows per map task.
    """
    if not count:
        return df
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key in an explicit order (``dropDuplicates`` has none)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def page(df: DataFrame, order: Sequence[str | Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Ordered page; the order must be total for a repeatable page. Offsets from ``DEEP`` on go by :class:`Pages`."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    if offset >= DEEP:
        return Pages(df, order).page(limit, offset)
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


class Pages:
    """The pages of an ordered set: sorted once into range partitions, of which a page reads only those that hold it.

    The partitions' row counts, one number each, tell where an offset falls; nothing but the partitions of a page is
    sorted or passed on for it, at any depth. The sorted rows stay in the shared folder, so further pages cost their own
    rows only. The order must be total for repeatable pages; rows alike in it keep the place they were written at.
    """

    def __init__(self, df: DataFrame, order: Sequence[str | Column], partitions: int | None = None):
        spark = df.sparkSession
        n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
        path = new_folder(spark, "pages")
        ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
        ranged.write.partitionBy("_part").parquet(path)
        self.order, self.columns = list(order), df.columns
        self.table = spark.read.schema(ranged.schema).parquet(path)
        self.counts = sorted((row["_part"], row["n"]) for row in self.table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())

    def holding(self, limit: int | None, offset: int) -> tuple[list[int], int]:
        """Partitions that hold the page, and how many of their rows come before it."""
        chosen, seen, skipped = [], 0, 0
        for part, n in self.counts:
            if seen + n > offset and (limit is None or seen < offset + limit):
                if not chosen:
                    skipped = offset - seen
                chosen.append(part)
            seen += n
        return chosen, skipped

    def page(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        if offset < 0:
            raise ValueError("offset must not be negative")
        chosen, skipped = self.holding(limit, offset)
        rows = self.table.where(F.col("_part").isin(chosen)).orderBy("_part", *self.order).select(*self.columns)
        rows = rows.offset(skipped) if skipped else rows
        return rows if limit is None else rows.limit(limit)


def cut_counts(df: DataFrame, limit: int | None) -> DataFrame:
    """One row (total_rows, returned_rows, truncated) for a result cut at ``limit``."""
    total = F.col("total_rows")
    returned = total if limit is None else F.least(total, F.lit(limit).cast("long"))
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows", returned.alias("returned_rows"), (returned < total).alias("truncated")
    )


def drop_flagged_entities(df: DataFrame, keys: Sequence[str], flag: str = "is_st") -> DataFrame:
    """Drop every row of an entity with at least one flagged row in ``df`` (the requested window).

    One pass over ``df``: the flag's maximum per entity, in the partitioning that series operators need too.
    """
    flagged = F.max(F.coalesce(F.col(flag), F.lit(False))).over(Window.partitionBy(*keys))
    return df.withColumn("_flagged", flagged).where(~F.col("_flagged")).drop("_flagged")


def drop_flagged_rows(df: DataFrame, flag: str = "is_suspended") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def pick_fields(df: DataFrame, fields: str, allowed: Sequence[str]) -> DataFrame:
    """CSV field list to a projection; empty keeps all allowed fields, an unknown field is an error."""
    wanted = [field.strip() for field in fields.split(",") if field.strip()]
    unknown = [field for field in wanted if field not in allowed]
    if unknown:
        raise ValueError(f"unsupported fields: {', '.join(unknown)}")
    return df.select(*(wanted or allowed))


def finite_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every double and float column, nested ones included."""
    return df.select(*(_finite_as(F.col(f"`{field.name}`"), field.dataType).alias(field.name) for field in df.schema.fields))


def _finite_as(value: Column, kind) -> Column:
    name = kind.typeName()
    if name in ("double", "float"):
        return finite(value)
    if name == "array":
        return F.transform(value, lambda item: _finite_as(item, kind.elementType))
    if name == "struct":
        parts = (_finite_as(value.getField(field.name), field.dataType).alias(field.name) for field in kind.fields)
        return F.when(value.isNotNull(), F.struct(*parts))
    return value
