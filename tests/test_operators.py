from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalars as S
from tapeloom.operators import bars, factors, merge, predicates as P, selection, series
from tapeloom.operators.news import news_events


def day(n: int, month: int = 1) -> dt.date:
    return dt.date(2024, month, n)


def calendar(spark, days, exchange="SSE"):
    return spark.createDataFrame([(exchange, d, True) for d in days], "exchange string, trade_date date, is_open boolean")


def test_codes_are_trimmed_and_distinct():
    assert P.codes_of(" a ", "b,,a , c") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        P.codes_of("", " , ")
    assert P.codes_of("", "", required=False) == []


def test_options_and_limits():
    assert P.option("freq") == "1d" and P.option("adjust", "qfq") == "qfq"
    with pytest.raises(ValueError):
        P.option("freq", "2d")
    assert P.clamp_limit(None) is None and P.clamp_limit(999999) == 999999 and P.clamp_limit(999999, 5000) == 5000
    with pytest.raises(ValueError):
        P.clamp_limit(0)
    assert P.etf_codes_of("510300.sh,159915.SZ,510300.SH") == ["510300.SH", "159915.SZ"]
    with pytest.raises(ValueError):
        P.etf_codes_of("510300")


def test_days_are_parsed():
    assert P.parse_day("20240131") == P.parse_day("2024-01-31") == day(31)
    assert P.parse_day("") is None
    with pytest.raises(ValueError):
        P.parse_day("2024/01/31")


def test_many_codes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "code string, v int")
    kept = P.keep_entities(df, "code", ["a", "c", "z", *map(str, range(3000))])
    assert sorted(row.code for row in kept.collect()) == ["a", "c"]


def test_intervals_include_both_ends(spark):
    df = spark.createDataFrame([(1, day(1), day(5)), (2, day(6), None)], "id int, valid_from date, valid_to date")
    on = lambda d: [row.id for row in df.where(P.valid_on(F.lit(d))).collect()]
    assert on(day(5)) == [1] and on(day(6)) == [2] and on(day(1)) == [1] and on(dt.date(2023, 12, 31)) == []
    touching = lambda a, b: [row.id for row in df.where(P.overlaps(a, b, "valid_from", "valid_to")).collect()]
    assert touching("2024-01-05", "2024-01-06") == [1, 2] and touching("", "2024-01-05") == [1] and touching("2024-02-01", "") == [2]


def test_unknown_fields_are_named(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert selection.pick_fields(df, "", ("a", "b")).columns == ["a", "b"]
    assert selection.pick_fields(df, " b ", ("a", "b")).columns == ["b"]
    with pytest.raises(ValueError, match="zz"):
        selection.pick_fields(df, "a,zz", ("a", "b"))


def test_non_finite_values_become_null_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, [1.0, -inf], (inf, 2), None)], "a double, b array<double>, c struct<x: double, y: int>, d struct<x: double>")
    row = selection.finite_doubles(df).first()
    assert row.a is None and row.b == [1.0, None] and row.c.x is None and row.c.y == 2 and row.d is None


def test_last_n_keeps_all_for_none_or_zero(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)], "code string, t int")
    assert selection.last_n(df, ["code"], "t", None).count() == selection.last_n(df, ["code"], "t", 0).count() == 5
    assert sorted(row.t for row in selection.last_n(df, ["code"], "t", 2).collect()) == [3, 4]


def test_an_entity_with_one_flag_is_dropped_whole(spark):
    df = spark.createDataFrame([("a", False), ("a", True), ("b", False), ("b", None)], "code string, is_st boolean")
    assert {row.code for row in selection.drop_flagged_entities(df, ["code"]).collect()} == {"b"}


def test_priority_merge_fills_nulls_and_blanks(spark):
    schema = "k string, a int, b string"
    high = spark.createDataFrame([("k1", None, "x"), ("k2", 1, ""), ("k4", None, "")], schema)
    low = spark.createDataFrame([("k1", 9, "y"), ("k2", 2, "z"), ("k3", 3, "w"), ("k4", None, None)], schema)
    rows = {row.k: (row.a, row.b) for row in merge.priority_merge([high, low], ["k"]).collect()}
    assert rows == {"k1": (9, "x"), "k2": (1, "z"), "k3": (3, "w"), "k4": (None, "")}


def test_later_sources_fill_absent_keys_only(spark):
    sources = [spark.createDataFrame(rows, "k int, v string") for rows in ([(1, None)], [(1, "b"), (2, "b")], [(2, "c"), (3, "c")])]
    rows = {row.k: (row.v, row.source_rank) for row in merge.fill_missing_only(sources, ["k"]).collect()}
    assert rows == {1: (None, 0), 2: ("b", 1), 3: ("c", 2)}


def test_as_of_takes_the_latest_announced(spark):
    facts = spark.createDataFrame([("a", day(n)) for n in (1, 5, 9, 30)] + [("b", day(5))], "code string, trade_date date")
    reports = spark.createDataFrame([("a", day(5), 1.0), ("a", day(10), 2.0)], "code string, announced date, v double")
    for horizon in (None, F.lit(day(31))):
        result = merge.as_of_latest(facts, reports, ["code"], "trade_date", "announced", horizon)
        assert sorted(((r.code, r.trade_date.day, r.v) for r in result.collect()), key=str) == sorted([("a", 1, None), ("a", 5, 1.0), ("a", 9, 1.0), ("a", 30, 2.0), ("b", 5, None)], key=str)


def test_interval_join_by_year_equals_plain_on_a_hot_key(spark):
    """One key holds most facts and many short intervals across years."""
    facts = spark.range(3000).select(F.when(F.col("id") % 5 > 0, "hot").otherwise("cold").alias("k"), F.date_add(F.lit(dt.date(2019, 12, 1)), (F.col("id") % 900).cast("int")).alias("d"))
    spans = spark.range(60).select(
        F.lit("hot").alias("k"), F.col("id").alias("span"), F.date_add(F.lit(dt.date(2019, 11, 1)), (F.col("id") * 17).cast("int")).alias("valid_from"),
        F.when(F.col("id") % 7 > 0, F.date_add(F.lit(dt.date(2019, 11, 1)), (F.col("id") * 17 + 40).cast("int"))).alias("valid_to"),
    )
    plain = merge.interval_join(facts, spans, ["k"], "d")
    by_year = merge.interval_join(facts, spans, ["k"], "d", horizon=F.lit(dt.date(2022, 12, 31)))
    assert by_year.exceptAll(plain.select(*by_year.columns)).count() == 0
    assert by_year.count() == plain.count() > 3000


def test_missing_ranges(spark):
    days = [day(n) for n in range(1, 7)]
    present = spark.createDataFrame([("x", day(2)), ("x", day(5)), ("y", day(6)), ("y", day(6)), ("x", dt.date(2023, 1, 1))] + [("full", d) for d in days], "code string, trade_date date")
    entities = spark.createDataFrame([("x",), ("y",), ("none",), ("full",)], "code string")
    rows = series.missing_ranges(present, entities, series.open_days(calendar(spark, days)), "code").collect()
    found = sorted((r.code, r.start_date.day, r.end_date.day, r.day_count) for r in rows)
    assert found == [("none", 1, 6, 6), ("x", 1, 1, 1), ("x", 3, 4, 2), ("x", 6, 6, 1), ("y", 1, 5, 5)]


def test_count_change_resets_on_null(spark):
    df = spark.createDataFrame([("a", day(i + 1), v) for i, v in enumerate([100, None, 120, 0, 5])], "code string, trade_date date, holder_count int")
    rows = series.count_change(df, ["code"], "trade_date").orderBy("trade_date").collect()
    assert [r.change_count for r in rows] == [None, None, None, -120, 5]
    assert [r.change_pct for r in rows] == [None, None, None, -100.0, None]


def test_every_code_has(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "code string")
    codes = spark.createDataFrame([("a",), ("b",)], "code string")
    answer = lambda n: series.every_code_has(df, codes, "code", n).first().enough
    assert answer(1) is True and answer(2) is False and answer(None) is False and answer(0) is False


def test_completeness_counts_closes_on_open_days(spark):
    days = [day(n) for n in (2, 3, 4)]
    rows = [("a", day(2), 1.0), ("a", day(3), None), ("a", day(1), 1.0), ("b", day(2), 1.0), ("b", day(3), 1.0), ("b", day(4), 1.0)]
    df = spark.createDataFrame(rows, "code string, trade_date date, close double")
    codes = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    found = {r.code: (r.row_count, r.actual_bar_count, r.complete, [d.day for d in r.missing_trade_dates]) for r in bars.completeness(df, codes, series.open_days(calendar(spark, days))).collect()}
    assert found == {"a": (3, 1, False, [3, 4]), "b": (3, 3, True, []), "c": (0, 0, False, [2, 3, 4])}


def test_placeholders_carry_the_last_close(spark):
    days = [day(n) for n in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame([("a", day(2), 9.0, 7.0, 5.0), ("a", day(4), None, None, 2.0)], "code string, trade_date date, high double, close double, volume double")
    rows = bars.fill_suspended(df, series.open_days(calendar(spark, days))).orderBy("trade_date").collect()
    assert [(r.trade_date.day, r.high, r.close, r.volume, r.is_suspended) for r in rows] == [
        (2, 9.0, 7.0, 5.0, False), (3, 7.0, 7.0, 0.0, True), (4, None, None, 2.0, False), (5, 7.0, 7.0, 0.0, True),
    ]


def test_minute_buckets_follow_the_sessions(spark):
    times = ["09:31", "10:30", "10:31", "11:30", "13:01", "15:00", "12:00", "09:30"]
    df = spark.createDataFrame([("a", dt.datetime.fromisoformat(f"2024-01-02 {t}"), 1.0, 1.0, 1.0, 1.0, 1.0) for t in times], "code string, bar_time timestamp_ntz, high double, low double, close double, volume double, amount double")
    rolled = bars.rollup_minutes(df, 60, sessions=(("09:30", "11:30"), ("13:00", "15:00"))).orderBy("bucket").collect()
    assert [(r.bucket.strftime("%H:%M"), r.bar_count) for r in rolled] == [("10:30", 2), ("11:30", 2), ("14:00", 1), ("15:00", 1)]


def test_adjusted_prices(spark):
    df = spark.createDataFrame([("a", day(1), 10.0, 1.0), ("a", day(2), 6.0, 2.0), ("a", day(3), 5.0, None)], "code string, trade_date date, close double, adj_factor double")
    closes = lambda *args: [r.close for r in bars.adjust_prices(df, *args).orderBy("trade_date").collect()]
    assert closes("none") == [10.0, 6.0, 5.0]
    assert closes("hfq") == [10.0, 12.0, None]
    assert closes("qfq") == [5.0, 6.0, None]
    assert closes("qfq", day(1)) == [10.0, 12.0, None]


def test_strategy_ratios_guard_zero_and_band_state(spark):
    df = spark.createDataFrame(
        [("a", day(1), 10.0, 100.0, 0.0, None, 10.0, 10.0, 8.0), ("a", day(2), 8.0, 300.0, 2.0, 1.0, 10.0, 11.0, 8.0), ("a", day(3), 9.0, 200.0, 2.0, 1.0, 10.0, None, 8.0)],
        "code string, trade_date date, close double, volume_shares double, float_market_cap double, free_float_shares double, active_buy_amount double, upper_limit double, lower_limit double",
    )
    rows = factors.strategy_window(df).orderBy("trade_date").collect()
    assert [r.mean_volume_5d_shares for r in rows] == [100.0, 200.0, 200.0]
    assert [r.active_buy_amount_proportion_all for r in rows] == [None, 0.0005, 0.0005]
    assert [r.mean_volume_5d_to_free_float_shares for r in rows] == [None, 0.02, 0.02]
    assert [r.price_band_state for r in rows] == ["upper", "lower", ""]
    assert [r.ma10 for r in rows] == [None] * 3


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("2024-01-31", " a, b,,a", "1e3"), ("20240131", "", "x"), ("2024-13-01", ",", None)], "d string, codes string, n string")
    rows = df.select(S.to_day(F.col("d")).alias("d"), S.code_list(F.col("codes")).alias("c"), S.to_double(F.col("n")).alias("n")).collect()
    assert [r.d for r in rows] == [day(31), day(31), None]
    assert [r.c for r in rows] == [["a", "b"], [], []]
    assert [r.n for r in rows] == [1000.0, None, None]
    codes = spark.createDataFrame([("SHSE", "900001"), ("SHSE", "000001"), ("BJSE", "920001"), ("SZSE", "300001"), ("SZSE", "800001"), ("XX", "600000")], "m string, c string")
    assert [r.v for r in codes.select(S.valid_market_code(F.col("m"), F.col("c")).alias("v")).collect()] == [True, False, True, True, False, False]


def test_news_nests_sources_of_the_page(spark):
    at = lambda h: dt.datetime(2024, 1, 2, h)
    events = spark.createDataFrame(
        [(1, day(2), at(9), at(10), "n", 3, ["600000"], "text"), (2, day(2), at(11), at(9), "n", 5, [], "text"), (3, day(3), at(9), at(9), "n", 5, ["600000"], "text")],
        "event_id long, trade_date date, announcement_time timestamp_ntz, crawl_time timestamp_ntz, event_type string, importance_score int, related_stock_codes array<string>, content_text string",
    )
    sources = spark.createDataFrame([(1, "b", "s2"), (1, "a", "s1"), (3, "c", "s3")], "event_id long, source_record_id string, source_name string")
    rows = news_events(events, "2024-01-02", sources=sources).orderBy("event_id").collect()
    assert [r.event_id for r in rows] == [1, 2] and "content_text" not in rows[0]
    assert [s.source_record_id for s in rows[0].sources] == ["a", "b"] and rows[1].sources is None
    assert [r.event_id for r in news_events(events, "2024-01-02", sort_by="crawl_time").collect()] == [1, 2]
    assert [r.event_id for r in news_events(events, "2024-01-02", stock_code="600000", include_content_text=True).collect()] == [1]
    with pytest.raises(ValueError):
        news_events(events, "")


def test_fixed_width_fills_are_hashed_and_not_sorted(spark):
    one = spark.createDataFrame([("a", 1, None, True), ("b", 2, 2.0, None)], "k string, i int, x double, f boolean")
    two = spark.createDataFrame([("a", 9, 9.0, False), ("c", 3, 3.0, False)], "k string, i int, x double, f boolean")
    filled = merge.fill_missing_only([one, two], ["k"])
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2
    assert sorted(map(tuple, filled.collect())) == [("a", 1, None, True, 0), ("b", 2, 2.0, None, 0), ("c", 3, 3.0, False, 1)]
    numbers = merge.priority_merge([one, two], ["k"])
    assert "SortAggregate" not in numbers._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, numbers.collect())) == [("a", 1, 9.0, True), ("b", 2, 2.0, None), ("c", 3, 3.0, False)]


def test_texts_of_a_merge_keep_the_first_source_where_none_is_usable(spark):
    sources = [spark.createDataFrame(rows, "k int, t string") for rows in ([(1, ""), (2, None), (3, "x"), (4, None), (5, "")], [(1, None), (2, ""), (3, "y"), (4, "z"), (5, "w")])]
    assert {r.k: r.t for r in merge.priority_merge(sources, ["k"]).collect()} == {1: "", 2: None, 3: "x", 4: "z", 5: "w"}


def test_nested_children_can_be_bounded(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "event_id string")
    children = spark.range(2000).selectExpr("if(id % 2 = 0, 'a', if(id < 4, 'b', 'x')) as event_id", "lpad(cast(2000 - id as string), 4, '0') as source_record_id", "id as n")
    rows = {r.event_id: r for r in merge.nest_children(parents, children, "event_id", "source_record_id", "sources", most=3).collect()}
    assert [(x.source_record_id, x.n) for x in rows["a"].sources] == [("0002", 1998), ("0004", 1996), ("0006", 1994)] and rows["a"].sources_total == 1000
    assert len(rows["b"].sources) == 2 == rows["b"].sources_total and rows["c"].sources is None and rows["c"].sources_total == 0
    whole = {r.event_id: r for r in merge.nest_children(parents, children, "event_id", "source_record_id", "sources").collect()}
    assert len(whole["a"].sources) == 1000 and whole["a"].sources[:3] == rows["a"].sources
