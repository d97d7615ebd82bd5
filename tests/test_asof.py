"""As-of joins by blocks against a plain look at all reports."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.asof import as_of_blocks, day_blocks
from tapeloom.operators.merge import as_of_latest

START = dt.datetime(2020, 1, 1)


def sides(seed):
    draw = random.Random(seed)
    when = lambda: START + dt.timedelta(minutes=draw.randrange(0, 900 * 1440, 360))
    facts = [(draw.choice(["a", "b", "c", None]), draw.randrange(2), when() if draw.random() < 0.95 else None, k) for k in range(400)]
    reports = [(draw.choice(["a", "b", "d", None]), draw.randrange(2), when() if draw.random() < 0.95 else None, k, None if k % 9 == 0 else f"r{k}") for k in range(250)]
    return facts, reports


@pytest.mark.parametrize("seed, days", [(1, 32), (2, 1), (3, 5000)])
def test_rows_equal_a_plain_search(spark, seed, days):
    facts, reports = sides(seed)
    left = spark.createDataFrame(facts + facts[:5], "code string, side int, at timestamp_ntz, `id` int").repartition(3)
    right = spark.createDataFrame(reports, "code string, side int, announced timestamp_ntz, `id` int, text string").withColumnRenamed("id", "report_id").repartition(3)
    got = as_of_blocks(left, right, ["code", "side"], "at", "announced", lambda time: day_blocks(time, days), tie=["report_id"])
    assert got.columns == ["code", "side", "at", "id", "announced", "report_id", "text"]
    expected = []
    for code, side, at, k in facts + facts[:5]:
        found = [r for r in reports if code is not None and at is not None and r[2] is not None and r[:2] == (code, side) and r[2] <= at]
        best = max(found, key=lambda r: (r[2], r[3]), default=(None,) * 5)
        expected.append((code, side, at, k, *best[2:]))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_equals_the_join_by_validity(spark):
    days = spark.range(300).selectExpr("concat('k', id % 4) as code", "date_add(date'2020-01-01', cast(id * 7 % 900 as int)) as trade_date", "id as n")
    reports = spark.range(60).selectExpr("concat('k', id % 3) as code", "date_add(date'2020-02-01', cast(id * 13 as int)) as announced", "id * 10 as profit")
    one, two = as_of_blocks(days, reports, ["code"], "trade_date", "announced"), as_of_latest(days, reports, ["code"], "trade_date", "announced")
    names = ["code", "trade_date", "n", "announced", "profit"]
    assert sorted(map(repr, map(tuple, one.select(names).collect()))) == sorted(map(repr, map(tuple, two.select(names).collect())))


def test_a_hot_key_spreads_over_its_blocks(spark):
    """A third of all facts and reports under one key: no task has more than a small part of them."""
    facts = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 1000)) as code", "timestampadd(HOUR, cast(id % 24000 as int), timestamp_ntz'2020-01-01 00:00:00') as at", "id")
    reports = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 1000)) as code", "timestampadd(HOUR, cast(id * 7 % 24000 as int), timestamp_ntz'2020-01-01 00:00:00') as announced", "id as report")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = as_of_blocks(facts, reports, ["code"], "at", "announced", tie=["report"])
        shares = [r.n for r in joined.where("code = 'hot'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(shares) == 10_000 and len(shares) >= 6 and max(shares) < 3_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_sides(spark):
    facts, reports = sides(4)
    left = spark.createDataFrame(facts, "code string, side int, at timestamp_ntz, `id` int")
    right = spark.createDataFrame(reports, "code string, side int, announced timestamp_ntz, report_id int, text string")
    assert as_of_blocks(left.limit(0), right, ["code"], "at", "announced").count() == 0
    alone = as_of_blocks(left, right.limit(0), ["code", "side"], "at", "announced")
    assert alone.count() == 400 and alone.where("report_id is not null").count() == 0
