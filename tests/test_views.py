"""All data views on small tables built from their own column lists."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.plans.quotes import STOCK_QUOTE_FIELDS, QuoteRequest, day_quotes
from tapeloom.plans.views import VIEWS, etf_quote_result, query_view, stock_minute_quotes, stock_quote_result, view_counts
from tapeloom.sources.store import MarketStore

DAYS = [dt.date(2024, 1, n) for n in (2, 3, 4, 5)]
TEXT = {
    "name", "exchange", "market", "list_status", "industry", "area", "view", "scope", "flag_type", "status", "report_type", "classification", "freq", "session", "direction",
    "signal", "adjust", "title", "reason", "tag", "style", "alias", "instrument_type", "type", "level", "parent_code", "category", "publisher", "listing_board", "price_band_state",
}
DEFAULTS = {"view": "main", "scope": "concept", "report_type": "income_statement", "exchange": "SSE"}
TABLES = {
    "fact.stock_daily_1d": "code string, trade_date date, open double, high double, low double, close double, volume double, amount double, is_suspended boolean, is_st boolean, adj_factor double",
    "fact.stock_bar_1m": "code string, bar_time timestamp_ntz, open double, high double, low double, close double, volume double, amount double",
}


def table_for(spark, view):
    """A table with the view's key, time, filter and output columns: two entities over four days."""
    columns = list(dict.fromkeys((view.key, view.time, *view.columns, *view.filters, "valid_from", "valid_to", "start_date", "end_date", "delist_date", "name", "report_period", "announcement_date")))
    base = spark.createDataFrame([(f"E{i}", d) for i in (1, 2) for d in DAYS], "_key string, _day date")

    def value(name):
        if name == view.key:
            return F.col("_key")
        if name in (view.time, "valid_from", "start_date", "trade_date", "report_period", "announcement_date", "announce_date", "trade_time"):
            return F.col("_day")
        if name in ("valid_to", "end_date"):
            return F.date_add("_day", 1)
        if name in ("delist_date",):
            return F.lit(None).cast("date")
        if name == "is_open":
            return F.lit(True)
        if name in ("is_st", "is_suspended"):
            return F.lit(False)
        if name in view.kinds:
            return F.lit(5).cast(view.kinds[name])
        if name in DEFAULTS:
            return F.lit(DEFAULTS[name])
        if name in TEXT or name.endswith(("_code", "_name", "_type", "_date", "_id", "_month", "_time")):
            return F.lit("x")
        return F.lit(1.5)

    return base.select(*(value(name).alias(name) for name in columns))


@pytest.mark.parametrize("name", sorted(name for name, view in VIEWS.items() if not view.derive and view.template != "calendar"))
def test_plain_view(name, spark):
    view = VIEWS[name]
    store = MarketStore(spark, tables={view.table: table_for(spark, view)})
    day = "2024-01-03"
    params, expected = {
        "range": ({"code": "E1", "start_date": "2024-01-03", "end_date": "2024-01-04"}, 2),
        "period": ({"codes": "E1,E2", "report_period": day}, 2),
        "snapshot": ({"trade_date": day}, 2),
        "single": ({"code": "E2"}, 4),
        "catalog": ({"codes": "" if view.key == "code" and "code" not in view.columns else "E1", "limit": 3}, 3),
        "as_of": ({"code": "E1", "trade_date": day}, 2),
        "history": ({"code": "E1", "start_date": "2024-01-04", "end_date": "2024-01-04"}, 2),
    }[view.template]
    rows = query_view(store, name, **params)
    assert rows.count() == expected
    if view.columns:
        assert tuple(rows.columns) == view.columns
        types = dict(rows.dtypes)
        assert all(types[column] == kind for column, kind in view.kinds.items())


def test_unknown_filters_and_missing_dates_are_refused(spark):
    view = VIEWS["stocks.indicators.money_flow.snapshot"]
    store = MarketStore(spark, tables={view.table: table_for(spark, view)})
    with pytest.raises(ValueError):
        query_view(store, view.name, trade_date="")
    with pytest.raises(ValueError, match="colour"):
        query_view(store, view.name, trade_date="2024-01-03", colour="red")
    with pytest.raises(ValueError):
        query_view(MarketStore(spark, tables={"stocks.catalog": table_for(spark, VIEWS["stocks.catalog"])}), "stocks.profile.basic", code=" ")


def bar(code, day, close, suspended=False, st=False, factor=1.0):
    return (code, day, close, close + 1, close - 1, close, 10.0, 100.0, suspended, st, factor)


@pytest.fixture(scope="module")
def store(spark):
    rows = [bar("a", d, 10.0 + i) for i, d in enumerate(DAYS)] + [bar("b", DAYS[0], 5.0), bar("b", DAYS[2], 6.0, suspended=True)]
    rows += [bar("c", d, 7.0, st=d == DAYS[1]) for d in DAYS]
    minutes = [("a", dt.datetime(2024, 1, 2, 9, m), 1.0, 2.0, 0.5, 1.5, 1.0, 1.0) for m in range(31, 41)]
    concept = [("K1", d, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0, 10.0, 100.0) for d in DAYS]
    etf = [("510300.SH", d, 1.0, 1.0, 1.0, None if i == 2 else 1.0, 1.0, 0.0, 0.0, 1.0, 1.0) for i, d in enumerate(DAYS)]
    return MarketStore(
        spark,
        tables={
            "fact.stock_daily_1d": spark.createDataFrame(rows, TABLES["fact.stock_daily_1d"]),
            "fact.stock_bar_1m": spark.createDataFrame(minutes, TABLES["fact.stock_bar_1m"]),
            "ref.trade_calendar": spark.createDataFrame([("SSE", d, True) for d in DAYS] + [("SSE", dt.date(2024, 1, 6), False), ("HKEX", dt.date(2024, 1, 1), True)], "exchange string, trade_date date, is_open boolean"),
            "fact.concept_daily_1d": spark.createDataFrame(concept, "concept_id string, trade_date date, open double, high double, low double, close double, change double, pct_chg double, volume double, amount double"),
            "ref.concept": spark.createDataFrame([("K1", "Bank")], "concept_id string, name string"),
            "fact.etf_daily_1d": spark.createDataFrame(etf, "ts_code string, trade_date date, open double, high double, low double, close double, pre_close double, change double, pct_chg double, volume double, amount double"),
            "stocks.indicators.money_flow": spark.createDataFrame([("a", DAYS[0], "main", 3.0, 1.0, 2.0), ("b", DAYS[0], "main", None, None, None)], "code string, trade_date date, view string, main_inflow double, main_outflow double, net_inflow double"),
        },
    )


def test_quotes_exclude_st_entities_but_keep_their_summary(store):
    result = stock_quote_result(store, codes="a,b,c,zz", start_date="2024-01-02", end_date="2024-01-05", skip_st=True)
    assert {(r.code, r.trade_time.day) for r in result.items.collect()} == {("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 2)}
    codes = {r.code: (r.row_count, r.expected_bar_count, r.actual_bar_count, r.complete) for r in result.codes.collect()}
    assert codes == {"a": (4, 4, 4, True), "b": (1, 4, 2, False), "c": (0, 4, 4, False), "zz": (0, 4, 0, False)}
    meta = result.meta.first()
    assert (meta.total_rows, meta.returned_rows, meta.truncated, meta.complete) == (5, 5, False, False)


def test_quotes_fill_only_when_asked(store):
    options = {"codes": "b", "start_date": "2024-01-02", "end_date": "2024-01-05"}
    filled = stock_quote_result(store, **options, fill_missing=True, skip_suspended=False)
    assert [(r.trade_time.day, r.close, r.is_suspended) for r in filled.items.orderBy("trade_time").collect()] == [(2, 5.0, False), (3, 5.0, True), (4, 6.0, True), (5, 6.0, True)]
    assert filled.codes.first().missing_count == 0
    forced = stock_quote_result(store, **options, fill_missing=True, skip_suspended=True)
    assert [r.trade_time.day for r in forced.items.collect()] == [2]
    plain = stock_quote_result(store, **options, skip_suspended=False)
    assert sorted(r.trade_time.day for r in plain.items.collect()) == [2, 4]


def test_quotes_cut_marks_truncated_codes(store):
    result = stock_quote_result(store, codes="a,c", start_date="2024-01-02", end_date="2024-01-05", limit=5, fields="code,close")
    assert result.items.columns == ["code", "close"] and result.items.count() == 5
    assert {r.code: (r.row_count, r.truncated, r.complete) for r in result.codes.collect()} == {"a": (3, True, False), "c": (2, True, False)}
    assert result.meta.first().truncated is True


def test_latest_bars_and_refused_options(store):
    assert sorted(r.trade_time.day for r in query_view(store, "stocks.quotes", codes="a", count=2).collect()) == [4, 5]
    for wrong in ({"freq": "2d"}, {"adjust": "abc"}, {"fields": "nope"}):
        with pytest.raises(ValueError):
            query_view(store, "stocks.quotes", codes="a", **wrong)
    with pytest.raises(ValueError):
        query_view(store, "stocks.quotes")


def test_weekly_quotes_take_the_last_trading_day(store):
    row = query_view(store, "stocks.quotes", code="a", freq="1w").first()
    assert (row.trade_time, row.open, row.high, row.low, row.close, row.volume) == (DAYS[3], 10.0, 14.0, 9.0, 13.0, 40.0)


def test_snapshot_uses_the_previous_existing_day(store):
    rows = {r.code: r for r in query_view(store, "stocks.quotes.daily_snapshot", trade_date="2024-01-04", skip_suspended=False).collect()}
    assert (rows["b"].pre_close, rows["b"].change, rows["b"].pct_chg) == (5.0, 1.0, 20.0)
    assert rows["a"].pre_close == 11.0
    assert query_view(store, "stocks.quotes.daily_snapshot", trade_date="2024-01-06").count() == 0


def test_local_window_pages_after_filtering(store):
    rows = query_view(store, "stocks.quotes.daily_local_window", start_date="2024-01-02", end_date="2024-01-05", skip_st=True, limit=3, offset=1).collect()
    assert [(r.trade_time.day, r.code) for r in rows] == [(2, "b"), (3, "a"), (4, "a")]


def test_minutes_concepts_indexes(store):
    rows = stock_minute_quotes(store, code="a", freq="5m", trade_date="2024-01-02").orderBy("trade_time").collect()
    assert [(r.trade_time.strftime("%H:%M"), r.volume) for r in rows] == [("09:35", 5.0), ("09:40", 5.0)]
    row = query_view(store, "concepts.quotes", concept_id="K1", trade_date="2024-01-03").first()
    assert (row.concept_name, row.freq, row.close) == ("Bank", "1d", 1.5)
    assert query_view(store, "concepts.quotes.daily_snapshot", trade_date="2024-01-03").count() == 1


def test_money_flow_batch_has_zero_for_missing_detail(store):
    rows = query_view(store, "stocks.indicators.money_flow.batch", codes="a,b,c,zz", trade_date="2024-01-02").collect()
    assert {r.code: r.net_inflow for r in rows} == {"a": 2.0, "b": 0.0, "c": 0.0}


def test_etf_completeness(store):
    items, codes, summary = etf_quote_result(store, "510300.SH", start_date="2024-01-02", end_date="2024-01-05")
    row = codes.first()
    assert items.count() == 4 and (row.expected_bar_count, row.actual_bar_count, row.complete) == (4, 3, False)
    assert [d.day for d in row.missing_trade_dates] == [4] and summary.first().complete is False
    with pytest.raises(ValueError):
        etf_quote_result(store, "510300")


def test_calendar_views(store):
    days = lambda name, **p: [r.trade_date.day for r in query_view(store, f"markets.calendar.trading{name}", **p).orderBy("trade_date").collect()]
    assert days(".previous", trade_date="2024-01-05", n=2) == [3, 4]
    assert days(".next", trade_date="2024-01-03", n=5) == [4, 5]
    assert days(".yearly", start_year=2024, end_year=2024) == [2, 3, 4, 5, 6]
    assert days("", code="SSE", is_open=False) == [6]
    with pytest.raises(ValueError):
        days(".next", exchange="NYSE", trade_date="2024-01-03")


def test_technical_view_window(store):
    full = query_view(store, "stocks.factors.technical", code="a", trade_date="2024-01-05").first()
    parity = query_view(store, "stocks.factors.technical", code="a", trade_date="2024-01-05", parity_window=True).first()
    assert parity.ema12 == 13.0 and full.ema12 < 13.0


def test_first_row_of_a_window_has_the_close_before_it(store):
    before = query_view(store, "stocks.quotes", codes="a", trade_date="2024-01-02").first()
    result = day_quotes(store.table("fact.stock_daily_1d"), store.table("ref.trade_calendar"), QuoteRequest(codes=["a"], trade_date="2024-01-03"))
    row = result.items.first()
    assert (row.pre_close, row.change) == (before.close, row.close - before.close) and before.pre_close is None


def test_meta_detail_and_refused_frequencies(store):
    options = {"codes": "a,b", "start_date": "2024-01-02", "end_date": "2024-01-05"}
    assert "missing_trade_dates" not in stock_quote_result(store, **options, meta_detail="summary").codes.columns
    assert "missing_trade_dates" in stock_quote_result(store, **options, meta_detail="full").codes.columns
    minutes = stock_quote_result(store, code="a", freq="5m", trade_date="2024-01-02")
    row = minutes.codes.first()
    assert (row.expected_bar_count, row.actual_bar_count, row.complete) == (48, 2, False) and len(row.missing_trade_times) == 46
    assert minutes.items.columns == list(STOCK_QUOTE_FIELDS)
    for wrong in ({"freq": "tick"}, {"freq": "5m", "adjust": "qfq"}, {"meta_detail": "all"}):
        with pytest.raises(ValueError):
            stock_quote_result(store, code="a", **wrong)
    with pytest.raises(ValueError):
        query_view(store, "concepts.quotes", concept_id="K1", freq="5m")


def test_a_long_pause_does_not_hide_earlier_bars(spark):
    rows = [("x", dt.date(2023, 1, 1) + dt.timedelta(days=i), 10.0 + i) for i in range(60)] + [("x", dt.date(2024, 3, 1), 99.0)]
    bars = spark.createDataFrame(rows, "code string, trade_date date, close double").withColumns({"volume": F.lit(1.0), "amount": F.lit(1.0), "is_st": F.lit(False), "is_suspended": F.lit(False)})
    store = MarketStore(spark, tables={"fact.stock_daily_1d": bars})
    assert query_view(store, "stocks.quotes.daily_snapshot", trade_date="2024-03-01").first().pre_close == 69.0


def test_limits_are_asked_for(spark):
    catalog = spark.range(700).selectExpr("cast(id as string) as code", "'n' as name", "'SSE' as exchange", "'L' as list_status", "date'2020-01-01' as list_date", "cast(null as date) as delist_date", "'' as market", "'' as industry", "'' as area")
    store = MarketStore(spark, tables={"stocks.catalog": catalog})
    assert query_view(store, "stocks.catalog").count() == 700 and query_view(store, "stocks.catalog", limit=9).count() == 9
    assert tuple(view_counts(store, "stocks.catalog", limit=9).first()) == (700, 9, True)
    assert tuple(view_counts(store, "stocks.catalog").first()) == (700, 700, False)


def test_rows_come_in_the_order_of_the_contract(spark):
    """Quotes by time and code, news newest first, with and without a limit, and after names and sources are joined."""
    days = spark.range(60).selectExpr("date_add(date'2024-01-01', cast(id as int)) as trade_date", "id")
    codes = spark.range(30).selectExpr("concat('c', lpad(cast(id as string), 2, '0')) as code")
    bars = days.join(codes, F.lit(True)).selectExpr("code", "trade_date", "1D as open", "2D as high", "0D as low", "cast(id as double) as close", "1D as volume", "1D as amount", "false as is_suspended", "false as is_st").repartition(7)
    concepts = bars.drop("is_suspended", "is_st").withColumnRenamed("code", "concept_id")
    events = spark.range(200).selectExpr("concat('e', id) as event_id", "date'2024-01-02' as trade_date", "timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, cast(id * 37 % 50 as int)) as announcement_time", "cast(id % 3 as int) as importance_score", "'t' as event_type").repartition(7)
    sources = spark.range(400).selectExpr("concat('e', id % 190) as event_id", "concat('r', id) as source_record_id")
    tables = {
        "fact.stock_daily_1d": bars, "fact.concept_daily_1d": concepts, "fact.index_bar_1d": bars.withColumnRenamed("code", "index_code"), "fact.news_event_agent_view": events, "fact.news_event_source": sources,
        "ref.concept": codes.selectExpr("code as concept_id", "concat('name ', code) as name"), "ref.trade_calendar": days.selectExpr("'SSE' as exchange", "trade_date", "true as is_open"),
    }
    store = MarketStore(spark, tables=tables)
    everything = ",".join(f"c{k:02}" for k in range(30))
    held = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions") if spark.conf.get(name, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for limit in (None, 369):
            for view, key, options in (("stocks.quotes", "code", {"codes": everything}), ("concepts.quotes", "concept_id", {"concept_ids": everything}), ("indexes.quotes", "index_code", {"index_codes": everything})):
                rows = query_view(store, view, **options, **({"limit": limit} if limit else {})).collect()
                order = [(r.trade_time, r[key]) for r in rows]
                assert order == sorted(order) and len(order) == (limit or 1800), view
            for nested in (False, True):
                rows = query_view(store, "markets.events.news", trade_date="2024-01-02", include_sources=nested, **({"limit": 150} if limit else {})).collect()
                order = [(r.announcement_time, r.importance_score, r.event_id) for r in rows]
                assert order == sorted(order, reverse=True) and len(order) == (150 if limit else 200)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name, value in held.items():
            spark.conf.set(name, value)
