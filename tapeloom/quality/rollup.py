"""Status rollups from checks to capabilities, groups and the whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity of each status; a status not listed counts as unknown.
SEVERITY = {"healthy": 0, "not_applicable": 0, "unknown": 1, "warning": 2, "unhealthy": 3}


def severity(status: Column) -> Column:
    pairs = [F.lit(part) for item in SEVERITY.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(1))


def worst(status: str) -> Column:
    """Aggregate: the status of highest severity (equal severities: the alphabetically last)."""
    return F.max(F.struct(severity(F.col(status)), F.col(status).alias("s"))).getField("s")


def capability_status(checks: DataFrame, by: str = "capability_id") -> DataFrame:
    """unhealthy if any check is, warning if any is warning or unknown, else healthy."""
    status = F.col("status")
    return checks.groupBy(by).agg(
        F.when(F.bool_or(status == "unhealthy"), "unhealthy").when(F.bool_or(status.isin("warning", "unknown")), "warning").otherwise("healthy").alias("status")
    )


def _summary() -> list[Column]:
    counts = {name: F.count_if(F.col("status") == name) for name in ("healthy", "warning", "unhealthy")}
    overall = F.when(counts["unhealthy"] > 0, "unhealthy").when(counts["warning"] > 0, "warning").otherwise("healthy")
    return [overall.alias("overall"), F.count("*").alias("total"), *(column.alias(name) for name, column in counts.items())]


def group_summary(capabilities: DataFrame, group: str = "group") -> DataFrame:
    """Per group: overall status and counts."""
    return capabilities.groupBy(group).agg(*_summary()).withColumnRenamed("overall", "status")


def overall_summary(capabilities: DataFrame) -> DataFrame:
    return capabilities.agg(*_summary()).withColumnRenamed("overall", "status")
