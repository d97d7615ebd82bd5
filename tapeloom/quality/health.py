"""A whole data-quality run: profiles, checks per capability, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.quality.checks import Checks, Rule
from tapeloom.quality.rollup import capability_status, group_summary, overall_summary, worst

UNREGISTERED = Rule("logic_rule_registered")


def run_health(checks: Checks, capabilities: Sequence[str], groups: DataFrame, rules: Sequence[tuple[str, Rule]]) -> dict[str, DataFrame]:
    """Result tables of one run: checks, capabilities, groups, summary.

    A rule used by several capabilities is computed once. ``groups`` maps capability_id to group; a listed
    capability without rules fails the registration check.
    """
    named = [(capability, checks.named(rule)) for capability, rule in rules]
    listed = set(capabilities)
    without = sorted(listed - {capability for capability, _ in named})
    named += [(capability, checks.named(UNREGISTERED)) for capability in without]
    used = [(capability, rule.check_id) for capability, rule in named if capability in listed]
    contract = {rule.check_id for _, rule in named if rule.type == "market_data_contract"}
    results = checks.run([rule for _, rule in named])
    owners = checks.spark.createDataFrame(sorted(set(used)), "capability_id string, rule_id string")
    # A contract gives one row per metric, named after its rule.
    rule_id = F.col("check_id")
    for name in sorted(contract):
        rule_id = F.when(F.col("check_id").startswith(f"{name}:"), F.lit(name)).otherwise(rule_id)
    detail = owners.join(results.withColumn("rule_id", rule_id), "rule_id", "left").fillna("unknown", ["status"]).drop("rule_id")
    status = capability_status(detail).join(groups.select("capability_id", "group"), "capability_id", "left").fillna("未分组", ["group"])
    overall = overall_summary(status)
    total = overall.select("status").unionByName(status.select("status")).agg(worst("status").alias("status"))
    return {"checks": detail, "capabilities": status, "groups": group_summary(status).orderBy("group"), "summary": overall, "status": total}
