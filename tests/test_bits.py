"""Bit sets of intraday series against plain sets of times."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bits
from tapeloom.operators.predicates import in_times
from tapeloom.plans.quotes import QuoteRequest, expected_times, minute_quotes, session_ends

DAYS = [dt.date(2024, 1, d) for d in (2, 3, 5, 8)]


def times(minutes, start=None, stop=None):
    every = [dt.datetime.combine(d, dt.time()) + dt.timedelta(minutes=m) for d in DAYS for m in session_ends(minutes)]
    return [x for x in every if (start is None or x >= start) and (stop is None or x <= stop)]


def ranges(expected, present):
    out, run = [], []
    for x in expected + [None]:
        if x is not None and x not in present:
            run.append(x)
        elif run:
            out.append((run[0], run[-1], len(run)))
            run = []
    return out


@pytest.mark.parametrize("minutes, start, stop", [(1, None, None), (5, None, None), (1, dt.datetime(2024, 1, 2, 10, 33), dt.datetime(2024, 1, 8, 14, 7)), (30, dt.datetime(2024, 1, 3), None)])
def test_counts_times_and_ranges_equal_plain_sets(spark, minutes, start, stop):
    draw, expected = random.Random(minutes), times(minutes, start, stop)
    present = {"all": set(expected), "none": set(), "half": set(draw.sample(expected, len(expected) // 2)), "most": set(draw.sample(expected, len(expected) - 3)), "hole": set(expected[: len(expected) // 3]) | set(expected[-2:])}
    rows = [(code, x) for code, some in present.items() for x in some]
    rows += rows[::7] + [("all", dt.datetime(2024, 1, 2, 12, 15)), ("none", dt.datetime(2024, 1, 2, 10, 0, 30)), ("none", dt.datetime(2024, 1, 4, 10, 0)), ("other", dt.datetime(2024, 1, 2, 10, 0)), ("half", None)]
    bars, codes = spark.createDataFrame(rows, "code string, at timestamp_ntz").repartition(5), spark.createDataFrame([(c,) for c in [*present, "half"]], "code string")
    ends = session_ends(minutes)
    days = F.array(*[F.lit(d) for d in DAYS])
    texts = [x.isoformat(sep=" ") if x else "" for x in (start, stop)]
    wanted = bits.expected_bits(expected_times(days, ends, spark).where(in_times("end", *texts)), "end", ends)
    held = bits.day_bits(bars, ["code"], "at", ends)
    counts = {r.code: (r.expected_bar_count, r.actual_bar_count, r.missing_count) for r in bits.bit_counts(held, codes, wanted, "code").collect()}
    assert counts == {c: (len(expected), len(p), len(expected) - len(p)) for c, p in present.items()}
    missing = bits.missing_bits(held, codes, wanted, "code")
    listed = {r.code: r.missing_trade_times for r in bits.missing_times(missing, "code", ends).collect()}
    assert listed == {c: [x for x in expected if x not in p] for c, p in present.items() if len(p) < len(expected)}
    got = {}
    for r in bits.missing_bar_ranges(missing, "code", ends).orderBy("start_time").collect():
        got.setdefault(r.code, []).append((r.start_time, r.end_time, r.bar_count))
    assert got == {c: ranges(expected, p) for c, p in present.items() if len(p) < len(expected)}


def test_sets_of_parts_combine_to_the_set_of_all(spark):
    ends, rows = session_ends(1), [("a", x) for x in times(1)[::3]]
    whole = spark.createDataFrame(rows, "code string, at timestamp_ntz")
    parts = bits.day_bits(whole.where("minute(at) < 20"), ["code"], "at", ends).unionByName(bits.day_bits(whole.where("minute(at) > 10"), ["code"], "at", ends))
    merged = parts.groupBy("code", "day", "word").agg(F.bit_or("bits").alias("bits"))
    assert sorted(merged.collect()) == sorted(bits.day_bits(whole, ["code"], "at", ends).collect())


def test_a_group_holds_one_long_however_many_rows(spark):
    """Ten years of minutes of one code: the aggregate is a plain hash aggregate with longs, on the map side too."""
    rows = spark.range(0, 2500 * 240, 1, 8).selectExpr("'a' as code", "timestampadd(MINUTE, cast(571 + id % 120 as int), timestampadd(DAY, cast(id div 240 as int), timestamp_ntz'2014-01-01 00:00:00')) as at")
    held = bits.day_bits(rows, ["code"], "at", session_ends(1))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "ObjectHash" not in plan and "Sort" not in plan and "partial_bit_or" in plan
    assert held.count() == 2500 * 2 and held.agg(F.sum(F.bit_count("bits"))).first()[0] == 2500 * 120


def test_no_days_and_no_codes(spark):
    table = spark.createDataFrame([("a", dt.datetime(2024, 1, 2, 9, 31), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "code string, bar_time timestamp_ntz, open double, high double, low double, close double, volume double, amount double")
    calendar = spark.createDataFrame([], "exchange string, trade_date date, is_open boolean")
    row = minute_quotes(table, calendar, QuoteRequest(codes=["a", "b"], freq="1m")).codes.orderBy("code").collect()
    assert [(r.code, r.expected_bar_count, r.actual_bar_count, r.missing_count, r.missing_trade_times, r.complete) for r in row] == [("a", 0, 0, 0, [], True), ("b", 0, 0, 0, [], False)]
