"""Shape of the physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

from tapeloom.operators.indicators import technical
from tapeloom.operators.selection import last_n
from tapeloom.plans.catalog import run
from tapeloom.plans.queries import QUERIES
from tapeloom.sources.market_tables import MarketTables

EAGER = ("io4_result_round_trip", "io5_fill_write_back", "s1_stream_bars", "s2_upsert", "s3_gap_audit", "s4_news_lag", "h_contract_metrics", "a15_metrics_long", "c20_contract_rules", "io3_profiles_run")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(EAGER)))
def test_no_cartesian_product_or_global_window(name, spark, folder):
    plan = plan_of(run(name, spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if " Window [" in line or "- Window [" in line:
            # The fixture's running total over brand sizes, a row per brand, is the one window without a partition.
            assert "sum(size#" in line or not re.search(r"windowspecdefinition\([a-z_]+#\d+L? (ASC|DESC)", line), line


def test_indicators_share_one_shuffle(spark, folder):
    plan = plan_of(technical(MarketTables(spark, folder).bars_daily))
    assert len(re.findall(r"Exchange hashpartitioning\(code", plan)) == 1
    assert len(re.findall(r"Sort \[code", plan)) == 1


def test_last_n_limits_groups_before_the_shuffle(spark, folder):
    bars = MarketTables(spark, folder).bars_minute
    assert "WindowGroupLimit" in plan_of(last_n(bars, ["code"], "bar_time", 3))


def test_scan_is_pruned_and_filtered(spark, folder):
    plan = plan_of(run("io1_fact_scan", spark, folder))
    assert "GreaterThanOrEqual(l_shipdate" in plan
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>", plan)


@pytest.mark.parametrize(("name", "column"), [
    ("q03_range", "l_shipdate"), ("q03_point", "l_shipdate"), ("q04_times", "ts"), ("q20_recent", "l_shipdate"), ("t1_range_view", "l_shipdate"), ("t2_snapshot_view", "l_shipdate"),
    ("t8_quotes_5m", "ts"), ("n1_news", "ts"), ("c07_closed_days", "l_shipdate"), ("c13_ohlc", "l_shipdate"), ("c16_coverage", "l_shipdate"),
])
def test_date_window_reaches_the_scan(name, column, spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(run(name, spark, folder))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual({column}" in plan and f"LessThan({column}" in plan


def test_excluding_entities_reads_the_input_once(spark, folder):
    plan = plan_of(run("q07_exclude_entity", spark, folder))
    assert plan.count("FileScan") <= 6
