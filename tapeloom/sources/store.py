"""Reading and writing market tables and quality results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tapeloom.operators.merge import fill_missing_only
from tapeloom.quality.checks import CHECK_SCHEMA, Checks, Rule
from tapeloom.sources.commits import Commits

RULE_FIELDS = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("check_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("expected_value", T.StringType()),
        T.StructField("provider_earliest_date", T.StringType()),
        T.StructField("expected_minutes", T.IntegerType()),
        T.StructField("lookback_days", T.IntegerType()),
        T.StructField("min_row_ratio", T.DoubleType()),
        T.StructField("required_objects", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.ArrayType(T.StringType())),
        T.StructField("index_code", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("reference_keys", T.ArrayType(T.StringType())),
        T.StructField("max_idle_days", T.IntegerType()),
        T.StructField("max_members", T.IntegerType()),
        T.StructField("member_lookback_days", T.IntegerType()),
    ]
)
PROFILE_FIELDS = T.StructType(
    [
        *(T.StructField(name, T.StringType()) for name in ("group", "logic_scope", "reference_data", "pass_rule", "empty_result_rule", "unhealthy_rule")),
        T.StructField("reference_objects", T.ArrayType(T.StringType())),
        T.StructField("checks", T.ArrayType(RULE_FIELDS)),
    ]
)
PROFILE_FILE = T.StructType([T.StructField("capabilities", T.MapType(T.StringType(), PROFILE_FIELDS))])
UNGROUPED = "未分组"


class MarketStore:
    """Named market tables below one root folder, parquet partitioned by date, or given as DataFrames or functions making them."""

    def __init__(self, spark: SparkSession, root: str = "", tables: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.given = dict(tables or {})

    def path(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def table(self, name: str) -> DataFrame:
        if name not in self.given:
            return self.spark.read.parquet(self.path(name))
        given = self.given[name]
        return given() if callable(given) else given

    def find(self, name: str) -> DataFrame | None:
        """The table, or None where it does not exist."""
        if name not in self.given and not self.root:
            return None
        try:
            return self.table(name)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def columns(self, name: str) -> list[str]:
        df = self.find(name)
        return [] if df is None else df.columns

    def write(self, name: str, df: DataFrame, partition_by: str = "", sort_by: Sequence[str] = ()) -> None:
        """Overwrite the partitions present in ``df`` and leave the others.

        Rows are brought together per partition value but in several files, so that a hot day does not
        fall to one task: AQE splits skewed rebalanced partitions.
        """
        if partition_by:
            df = df.hint("rebalance", partition_by)
        if sort_by:
            df = df.sortWithinPartitions(*([partition_by] if partition_by else []), *sort_by)
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))

    def write_checked(self, name: str, df: DataFrame, checks: Checks, rules: Sequence[Rule], partition_by: str = "", sort_by: Sequence[str] = ()) -> DataFrame:
        """``write``, and the row rules' check rows of what was written, observed on the way and not by another scan."""
        watched, rows = checks.watch(df, name, rules)
        self.write(name, watched, partition_by, sort_by)
        return rows()

    def fill_and_write_back(self, name: str, later_sources: Sequence[DataFrame], keys: Sequence[str], partition_by: str) -> DataFrame:
        """Store first: keys the table lacks are taken from later sources, written back, and the whole returned.

        Of the table only the keys are read, and only in the partitions that the sources have rows for (all of them if
        the partition is no part of the key); partitions that gain rows get a file more, none is rewritten. What the
        sources offer is computed once, into a folder of its own. A run whose driver died while appending is completed
        by calling again: keys that are there are not taken twice.
        """
        stored = self.table(name)
        columns = stored.columns
        staging = f"{self.path(name)}__offered"
        fill_missing_only([source.select(*columns) for source in later_sources], keys).select(*columns).write.mode("overwrite").parquet(staging)
        offered = self.spark.read.schema(stored.schema).parquet(staging)
        held = stored.select(*dict.fromkeys([*keys, partition_by]))
        if partition_by in keys:
            held = held.join(offered.select(partition_by).distinct(), partition_by, "left_semi")
        gained = offered.join(held.select(*keys).distinct(), list(keys), "left_anti").hint("rebalance", partition_by)
        gained.sortWithinPartitions(partition_by, *[key for key in keys if key != partition_by]).write.mode("append").partitionBy(partition_by).parquet(self.path(name))
        self.spark.catalog.refreshByPath(self.path(name))
        return self.spark.read.parquet(self.path(name)).select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """Table of a relational store, read in parallel ranges of ``column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper)
    return reader.option("numPartitions", partitions).load()


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Capability profiles from a JSON file: one row per capability; a missing file gives no rows."""
    try:
        payload = spark.read.schema(PROFILE_FILE).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        payload = spark.createDataFrame([], PROFILE_FILE)
    rows = payload.select(F.explode("capabilities").alias("capability_id", "profile"))
    return rows.where(F.col("profile").isNotNull()).select("capability_id", "profile.*").withColumn("group", F.coalesce("group", F.lit(UNGROUPED)))


def profile_rules(profiles: DataFrame) -> DataFrame:
    """One row per configured check, in file order."""
    return profiles.select("capability_id", "group", F.posexplode("checks").alias("position", "rule"))


def rules_of(profiles: DataFrame) -> list[tuple[str, Rule]]:
    """(capability, rule) pairs for planning. Rules are configuration and small by nature."""
    pairs = []
    for row in profile_rules(profiles).orderBy("capability_id", "position").collect():
        values = {name: tuple(value) if isinstance(value, list) else value for name, value in row.rule.asDict().items() if value not in (None, "", 0)}
        pairs.append((row.capability_id, Rule(**values)))
    return pairs


def availability(spark: SparkSession, tables: Mapping[str, tuple[DataFrame | None, str]]) -> DataFrame:
    """(name, table_exists, row_count, min_value, max_value) per table; ``tables`` maps name to (table, column)."""
    rows = []
    for name, (df, column) in tables.items():
        if df is None:
            continue
        rows.append(
            df.agg(F.count("*").alias("row_count"), F.min(column).cast("string").alias("min_value"), F.max(column).cast("string").alias("max_value")).select(
                F.lit(name).alias("name"), F.lit(True).alias("table_exists"), "row_count", "min_value", "max_value"
            )
        )
    absent = [(name, False, 0, "", "") for name, (df, _) in tables.items() if df is None]
    schema = "name string, table_exists boolean, row_count long, min_value string, max_value string"
    rows.append(spark.createDataFrame(absent, schema))
    return reduce(DataFrame.unionByName, rows)


def _footer_aggregates(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row (row_count, min_value, max_value) of a parquet table, planned so that its files' footers answer it."""
    session = spark.newSession()  # the settings are this reader's own
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path).agg(F.count("*").alias("row_count"), F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def stored_availability(spark: SparkSession, tables: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``availability`` of parquet tables by path: name to (path, column).

    Counts, minima and maxima of integer, floating and date columns come from the footers and no row is read; where the
    reader cannot do that (texts, a column that is a folder), the column is scanned.
    """
    rows = []
    for name, (path, column) in tables.items():
        try:
            found = _footer_aggregates(spark, path, column).first()
            texts = ["" if value is None else str(value) for value in found[1:]]
            rows.append((name, True, found.row_count or 0, *texts))  # no file has a count: no rows
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            rows.append((name, False, 0, "", ""))
    return spark.createDataFrame(rows, "name string, table_exists boolean, row_count long, min_value string, max_value string")


def write_result(checks: DataFrame, root: str, run_id: str) -> str:
    """Write the check rows of a run to a folder of its own, then commit it as the latest.

    A commit is a file created once that names the folder; nothing a reader may be reading is replaced or deleted.
    """
    folder = f"run={run_id}-{uuid.uuid4().hex}"
    checks.write.parquet(f"{root.rstrip('/')}/{folder}")
    Commits(checks.sparkSession, root).add({"run": run_id, "folder": folder})
    return f"{root.rstrip('/')}/{folder}"


def read_result(spark: SparkSession, root: str) -> DataFrame:
    """Check rows of the latest committed run; no rows where there is none or it cannot be read."""
    latest = Commits(spark, root).latest()
    try:
        if latest is not None:
            return spark.read.parquet(f"{root.rstrip('/')}/{latest[1]['folder']}")
    except AnalysisException:
        pass
    return spark.createDataFrame([], CHECK_SCHEMA)
