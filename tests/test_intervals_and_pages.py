"""Dyadic covers and pages of range partitions against plain versions."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import intervals, selection
from tapeloom.operators.intervals import LEVELS, cover_join, dyadic_cover
from tapeloom.operators.merge import interval_join

BASE = dt.date(1850, 1, 1)


def test_a_cover_holds_exactly_the_days_of_its_interval(spark):
    draw = random.Random(1)
    spans = [(a, a + n) for a, n in ((draw.randrange(1 << LEVELS), draw.choice([0, 1, 2, 5, 30, 365, 4000])) for _ in range(300)) if a + n < 1 << LEVELS]
    spans += [(0, (1 << LEVELS) - 1), (0, 0), (7, 8), (1, (1 << LEVELS) - 2), (4096, 8191)]
    rows = [(k, BASE + dt.timedelta(days=a), BASE + dt.timedelta(days=b)) for k, (a, b) in enumerate(spans)]
    got = spark.createDataFrame(rows, "k int, a date, b date").select("k", dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
    for k, cover in got:
        pieces = sorted((p.prefix << p.level, (p.prefix + 1 << p.level) - 1) for p in cover)
        assert pieces[0][0] == spans[k][0] and pieces[-1][1] == spans[k][1] and all(x[1] + 1 == y[0] for x, y in zip(pieces, pieces[1:]))
        assert len(cover) <= 2 * (spans[k][1] - spans[k][0] + 1).bit_length()
    assert spark.range(1).select(dyadic_cover(F.lit("1990-01-01").cast("date"), F.lit(None).cast("date")).alias("c")).first().c[-1].level >= 15


def random_sides(seed):
    draw = random.Random(seed)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=draw.randrange(9000))
    facts = [(draw.choice(["a", "b", "c", None]), draw.randrange(2), draw.choice([day(), day(), day(), None, dt.date(1700, 1, 1), dt.date(2500, 1, 1)]), k) for k in range(300)]
    spans = []
    for k in range(80):
        first = day()
        spans.append((draw.choice(["a", "b", "d", None]), draw.randrange(2), draw.choice([first, first, None, dt.date(1600, 1, 1)]), draw.choice([None, first + dt.timedelta(days=draw.choice([-3, 0, 1, 40, 3000])), dt.date(2600, 1, 1)]), k))
    return facts, spans


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("seed", [1, 2])
def test_the_join_equals_a_plain_search(spark, seed, how):
    facts, spans = random_sides(seed)
    left = spark.createDataFrame(facts + facts[:9], "code string, side int, at date, id int").repartition(3)
    right = spark.createDataFrame(spans, "code string, side int, valid_from date, valid_to date, span int").repartition(3)
    got = cover_join(left, right, ["code", "side"], "at", how=how)
    assert got.columns == ["code", "side", "at", "id", "valid_from", "valid_to", "span"]
    expected = []
    for f in facts + facts[:9]:
        met = [s[2:] for s in spans if f[0] is not None and f[2] is not None and s[:2] == f[:2] and s[2] is not None and s[2] <= f[2] and (s[3] is None or f[2] <= s[3])]
        expected += [(*f, *m) for m in met] or ([(*f, None, None, None)] if how == "left" else [])
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert rows == sorted(map(repr, expected))
    assert rows == sorted(map(repr, map(tuple, interval_join(left, right, ["code", "side"], "at", how=how).select(got.columns).collect())))


def test_open_intervals_are_not_copied_per_year(spark):
    """A thousand open intervals of one hot key: some twenty pieces each, spread over levels and prefixes."""
    spans = spark.range(1000).selectExpr("'hot' as code", "date_add(date'1995-01-01', cast(id as int)) as valid_from", "cast(null as date) as valid_to", "id")
    pieces = spans.select(F.explode(dyadic_cover(F.col("valid_from"), F.col("valid_to"))).alias("p"))
    assert pieces.count() <= 1000 * (LEVELS + 1) and pieces.select("p.*").distinct().count() > 500


def test_empty_sides(spark):
    facts, spans = random_sides(3)
    left = spark.createDataFrame(facts, "code string, side int, at date, id int")
    right = spark.createDataFrame(spans, "code string, side int, valid_from date, valid_to date, span int")
    assert cover_join(left.limit(0), right, ["code", "side"], "at").count() == 0
    assert cover_join(left, right.limit(0), ["code", "side"], "at").count() == 0
    assert cover_join(left, right.limit(0), ["code", "side"], "at", how="left").count() == 300


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(0, 400_000, 1, 6).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("price"), F.when(F.col("id") % 50 != 0, F.col("id") % 97).alias("group"), "id")


def test_pages_equal_slices_of_the_sorted_rows(spark, many):
    order = [F.col("price").desc(), F.col("group").asc_nulls_last(), F.col("id")]
    everything = [r.id for r in many.orderBy(*order).select("id").collect()]
    pages = selection.Pages(many, order, partitions=16)
    assert sum(n for _, n in pages.counts) == 400_000
    for limit, offset in ((10, 0), (500, 123_456), (7, 399_999), (1000, 399_500), (25, 400_000), (1, 500_000), (60_000, 170_000)):
        rows = pages.page(limit, offset)
        assert rows.columns == many.columns and [r.id for r in rows.collect()] == everything[offset : offset + limit]
    assert [r.id for r in pages.page(None, 399_990).collect()] == everything[399_990:]
    assert [r.id for r in selection.page(many, order, 40, 300_000).collect()] == everything[300_000:300_040]
    with pytest.raises(ValueError):
        pages.page(1, -1)


def test_a_deep_page_reads_the_partitions_that_hold_it(spark, many):
    pages = selection.Pages(many, ["id"], partitions=16)
    chosen, skipped = pages.holding(100, 333_333)
    assert len(chosen) <= 2 and skipped < max(n for _, n in pages.counts)
    plan = pages.page(100, 333_333)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan.replace("isnotnull(_part), ", "") or "_part" in plan.split("PartitionFilters")[1].split("]")[0]
    one_value = selection.Pages(many.withColumn("price", F.lit(1.0)), ["price", "id"], partitions=16)
    assert max(n for _, n in one_value.counts) < 100_000  # a leading value that all rows share does not fill one partition


def test_no_rows(spark, many):
    assert selection.Pages(many.limit(0), ["id"]).page(10, 5).count() == 0
