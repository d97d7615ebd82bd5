"""Registered queries: data views, news, quality checks, the market-data contract, streaming jobs."""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.news import news_events, news_lag
from tapeloom.operators.series import previous_change
from tapeloom.plans.catalog import query, round_columns, rounded
from tapeloom.plans.quotes import QuoteRequest, minute_quotes, session_ends
from tapeloom.plans.series_queries import pit_sources, stock_changes, strategy_rows, with_factor
from tapeloom.plans.views import etf_quote_result, query_view, stock_quote_result, view_counts
from tapeloom.quality.checks import CONTRACT_TABLES, Checks, Rule, completed_days, session_days, session_issues
from tapeloom.quality.contract import compare_expectations, contract_metrics, weighted_pct
from tapeloom.quality.health import run_health
from tapeloom.session import shared_folder
from tapeloom.sources.bar_store import BarStore
from tapeloom.sources.market_tables import MarketTables, exact_sum
from tapeloom.sources.scratch import new_folder, written
from tapeloom.sources.store import MarketStore, read_profiles, read_result, rules_of, write_result
from tapeloom.streaming import jobs

# -- tables the views read ---------------------------------------------------------------------------------------


def quote_bars(t: MarketTables) -> DataFrame:
    """Bars per brand with an open price, suspension and ST flags and an adjustment factor."""
    number = F.col("volume").cast("long")
    flagged = t.bars_sparse.withColumns(
        {
            "open": (F.col("low") + F.col("high")) / 2,
            "is_suspended": number % 31 == 0,
            "is_st": (F.col("code") == "Brand#4") & (F.year("trade_date") == 1998) & (number % 2 == 0),
        }
    )
    return with_factor(flagged)


def money_flow(t: MarketTables) -> DataFrame:
    """Flows per brand and day; no row where neither side traded."""
    sides = t.trades.where(F.col("l_returnflag") != "N").groupBy(F.col("p_brand").alias("code"), "trade_date").agg(
        exact_sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).otherwise(0)).alias("main_inflow"),
        exact_sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0)).alias("main_outflow"),
    )
    return sides.withColumns({"view": F.lit("main"), "net_inflow": F.col("main_inflow") - F.col("main_outflow")})


def top_holders(t: MarketTables) -> DataFrame:
    """Ten largest customers per nation and quarter."""
    homes = t.raw("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code"), "c_name")
    placed = t.raw("orders").select(F.col("o_custkey").alias("c_custkey"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("report_period"), "o_totalprice")
    sums = placed.groupBy("c_custkey", "report_period").agg(exact_sum("o_totalprice").alias("holding_volume")).join(homes, "c_custkey")
    order = Window.partitionBy("code", "report_period").orderBy(F.col("holding_volume").desc(), "c_custkey")
    ranked = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10)
    return ranked.select("code", "report_period", "rank", F.col("c_name").alias("shareholder_name"), "holding_volume", F.lit(None).cast("double").alias("holding_ratio"), F.lit(None).cast("double").alias("change_volume"))


def news_rows(t: MarketTables) -> DataFrame:
    """Events as news: announced up to an hour before or after the crawl, with related codes."""
    shift = F.col("event_id") % 121 - 60
    return t.news.select(
        "event_id", "trade_date", "announcement_time", (F.col("announcement_time") + F.make_dt_interval(mins=shift.cast("int"))).alias("crawl_time"), "event_type", "importance_score",
        F.array(F.col("stock_code").cast("string"), (F.col("stock_code") + 1).cast("string")).alias("related_stock_codes"),
    )


def etf_code(brand) -> F.Column:
    return F.concat(F.lit("5100"), F.lpad(F.substring_index(brand, "#", -1), 2, "0"), F.lit(".SH"))


def stock_catalog(t: MarketTables) -> DataFrame:
    return t.stock_ref.select(
        "code", F.concat_ws(" ", "p_brand", "p_type").alias("name"), F.when(F.col("market") == "SHSE", "SSE").when(F.col("market") == "SZSE", "SZSE").otherwise("BSE").alias("exchange"), "market",
        F.when(F.col("delisted_date").isNull(), "L").otherwise("D").alias("list_status"), F.col("listed_date").alias("list_date"), F.col("delisted_date").alias("delist_date"),
        F.col("listing_board").alias("industry"), F.lit("").alias("area"),
    )


def market_store(t: MarketTables) -> MarketStore:
    def changed(key: str) -> DataFrame:
        priced = t.bars_daily.withColumn("open", (F.col("low") + F.col("high")) / 2)
        return previous_change(priced, ["code"], "trade_date").withColumnRenamed("code", key)

    def etfs() -> DataFrame:
        coded = t.bars_sparse.withColumns({"ts_code": etf_code(F.col("code")), "open": (F.col("low") + F.col("high")) / 2})
        return previous_change(coded, ["ts_code"], "trade_date")

    def factors() -> DataFrame:
        constants = {
            "listing_board": F.lit(""), "dividend_yield_pct": F.lit(None).cast("double"), "circulating_shares": F.col("free_float_shares"),
            "is_st": F.lit(False), "is_suspended": F.lit(False),
        }
        return strategy_rows(t).withColumns(constants)

    return MarketStore(
        t.spark,
        tables={
            "fact.stock_daily_1d": lambda: quote_bars(t),
            "fact.stock_bar_1m": lambda: t.bars_minute,
            "fact.etf_daily_1d": etfs,
            "fact.concept_daily_1d": lambda: changed("concept_id"),
            "fact.index_bar_1d": lambda: changed("index_code"),
            "ref.trade_calendar": lambda: t.calendar,
            "ref.concept_stock_membership": lambda: t.membership,
            "ref.concept": lambda: t.raw("part").select(F.col("p_type").alias("concept_id"), F.lower("p_type").alias("name")).distinct(),
            "stocks.catalog": lambda: stock_catalog(t),
            "stocks.indicators.money_flow": lambda: money_flow(t),
            "stocks.ownership.shareholders.count": lambda: t.holder_counts.withColumns({"code": F.col("code").cast("string"), "avg_holding": F.lit(None).cast("double")}),
            "stocks.ownership.shareholders.top10": lambda: top_holders(t),
            "stocks.factors.strategy_window": factors,
            "stocks.finance.pit.indicators": lambda: pit_sources(t)[0],
            "stocks.finance.pit.income": lambda: pit_sources(t)[1],
            "fact.news_event_agent_view": lambda: news_rows(t),
        },
    )


def _day_text(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda day: day.cast("string")), ",")


# -- views -------------------------------------------------------------------------------------------------------


@query("t1_range_view")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t.between("1997-01-01", "1997-06-30")), "stocks.indicators.money_flow", code="Brand#7", start_date="1997-01-01", end_date="1997-06-30", view="main")


@query("t1p_period_view")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t), "stocks.ownership.shareholders.top10", codes="3,7", start_period="1997-01-01", end_period="1998-12-31")
    return rows.select("code", "report_period", "rank", "shareholder_name", "holding_volume")


@query("t2_snapshot_view")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t.between("1997-03-05", "1997-03-05")), "stocks.indicators.money_flow.snapshot", trade_date="1997-03-05")


@query("t2_batch_view")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t.between("2001-03-05", "2001-03-05")), "stocks.indicators.money_flow.batch", codes="Brand#1,Brand#2,Brand#3,Brand#4,Brand#5,Brand#6,Brand#99", trade_date="2001-03-05")


@query("t3_single_view")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "stocks.profile.basic", code="600003").select("code", "name", "exchange", "list_status", "list_date", "delist_date")


@query("t4_catalog_view")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t), "stocks.catalog", name="MEDIUM", exchange="SSE", include_delisted=False, limit=20, offset=1)
    return rows.select("code", "name", "exchange", "list_status", "list_date")


@query("t4_catalog_all")
def _(t: MarketTables) -> DataFrame:
    """Without a limit nothing is cut."""
    return query_view(market_store(t), "stocks.catalog").select("code", "name", "exchange", "list_status", "list_date")


@query("t4_catalog_counts")
def _(t: MarketTables) -> DataFrame:
    return view_counts(market_store(t), "stocks.catalog", limit=7, exchange="SZSE")


@query("t5_members_as_of")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "concepts.members", code="PROMO", trade_date="2001-02-01").select("concept_id", "stock_market", "stock_code", "valid_from")


@query("t6_member_history")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "concepts.members.history", code="SMALL", start_date="2001-01-01", end_date="2001-12-31")


@query("t7_previous_days")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "markets.calendar.trading.previous", trade_date="1998-06-15", n=7)


@query("t7_next_days")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "markets.calendar.trading.next", exchange="SSE", trade_date="1998-06-15", n=7)


@query("t7_yearly")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "markets.calendar.trading.yearly", start_year=1997, end_year=1998)


@query("t7_range")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "markets.calendar.trading", code="SSE", start_date="1997-01-01", end_date="1997-03-31", is_open=True)


MINUTE_OPTIONS = {"codes": "click,view", "freq": "5m", "start_date": "2024-01-05", "end_date": "2024-01-07"}
QUOTE_OPTIONS = {"codes": "Brand#1,Brand#2,Brand#4,Brand#5,Brand#99", "start_date": "1998-01-01", "end_date": "1998-03-31"}


@query("t8_quotes")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "stocks.quotes", **QUOTE_OPTIONS, skip_st=True, fields="code,trade_time,freq,open,close,pre_close,pct_chg,adjust,is_st")


@query("t8_quotes_meta")
def _(t: MarketTables) -> DataFrame:
    codes = stock_quote_result(market_store(t), **QUOTE_OPTIONS, skip_st=True, limit=60).codes
    return codes.withColumn("missing_trade_dates", _day_text("missing_trade_dates")).withColumn("row_count", F.col("row_count").cast("long"))


@query("t8_quotes_summary")
def _(t: MarketTables) -> DataFrame:
    return stock_quote_result(market_store(t), **QUOTE_OPTIONS, skip_st=True, limit=60).meta


@query("t8_quotes_filled")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "stocks.quotes", **QUOTE_OPTIONS, fill_missing=True, skip_suspended=False, fields="code,trade_time,close,volume,is_suspended")


@query("t8_quotes_weekly")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "stocks.quotes", **QUOTE_OPTIONS, freq="1w", adjust="qfq", count=5, fields="code,trade_time,freq,high,close,pre_close,adjust")


@query("t8_quotes_minutes")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t.between("2024-01-05", "2024-01-09")), "stocks.quotes", codes="click,view", freq="15m", start_date="2024-01-05", end_date="2024-01-09", count=20)
    return rows.select("code", "trade_time", "freq", "open", "high", "low", "close")


@query("t8_quotes_5m")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t.between("2024-01-05", "2024-01-07")), "stocks.quotes", **MINUTE_OPTIONS, fields="code,trade_time,freq,open,high,low,close,volume")
    return rows


@query("t8_quotes_5m_meta")
def _(t: MarketTables) -> DataFrame:
    """Completeness of the sessions of three open days, with the missing bar ends as text."""
    narrow = t.between("2024-01-05", "2024-01-07")
    calendar = narrow.news.select(F.lit("SSE").alias("exchange"), "trade_date", F.lit(True).alias("is_open")).distinct()
    codes = minute_quotes(narrow.bars_minute, calendar, QuoteRequest(**{**MINUTE_OPTIONS, "codes": ("click", "view")})).codes
    missing = F.array_join(F.transform("missing_trade_times", lambda x: F.date_format(x, "dd HH:mm")), ",")
    return codes.select("code", "expected_bar_count", "actual_bar_count", "missing_count", "complete", missing.alias("missing_trade_times"))


@query("t8_quotes_adjusted_change")
def _(t: MarketTables) -> DataFrame:
    """Quotes of a table with stored pre_close, change and pct_chg, adjusted."""
    bars = previous_change(quote_bars(t), ["code"], "trade_date")
    store = MarketStore(t.spark, tables={"fact.stock_daily_1d": bars, "ref.trade_calendar": t.calendar})
    return round_columns(query_view(store, "stocks.quotes", **QUOTE_OPTIONS, adjust="qfq", fields="code,trade_time,close,pre_close,change,pct_chg"), ["close", "pre_close", "change", "pct_chg"], 6)


@query("t8_concept_weekly")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "concepts.quotes", concept_ids="PROMO,SMALL", start_date="1999-01-01", end_date="1999-12-31", freq="1w", fields="concept_id,concept_name,trade_time,freq,close,pre_close")


@query("t8_concept_quotes")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t), "concepts.quotes", concept_ids="PROMO,SMALL", start_date="1999-01-01", end_date="1999-02-28")
    return rows.select("concept_id", "concept_name", "trade_time", "close", "pre_close", "amount")


@query("t8_index_quotes")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "indexes.quotes", index_code="PROMO", freq="1mo", fields="index_code,trade_time,freq,open,high,low,close")


@query("e03_daily_snapshot")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "stocks.quotes.daily_snapshot", trade_date="1998-03-04", fields="code,trade_time,freq,open,close,pre_close,change,pct_chg,is_st")


@query("e04_local_window")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t), "stocks.quotes.daily_local_window", start_date="1998-02-01", end_date="1998-04-30", skip_st=True, limit=700, offset=100)
    return rows.select("code", "trade_time", "close", "volume", "is_suspended")


@query("e15_adj_factors")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "stocks.factors.adj", code="Brand#3", start_date="1997-01-01", end_date="1998-12-31", base_date="1998-06-30")


@query("e16_technical_window")
def _(t: MarketTables) -> DataFrame:
    """Indicators of the requested window only, as a query limited to the window computes them."""
    rows = query_view(market_store(t), "stocks.factors.technical", codes="Brand#1,Brand#2", start_date="1998-01-01", end_date="1998-12-31", parity_window=True)
    return round_columns(rows, ["ma5", "ma60", "rsi6", "boll_mid"]).select("code", "trade_date", "ma5", "ma60", "rsi6", "boll_mid")


@query("e17_strategy_window")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t), "stocks.factors.strategy_window", start_date="1998-01-01", end_date="1998-06-30")
    names = ["mean_volume_5d_shares", "ma10", "ma20", "ma40"]
    return round_columns(rows, names).select("trade_date", "code", "active_buy_amount_proportion_all", "price_band_state", *names)


@query("e34_pit_period")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "stocks.finance.pit.raw_period", report_period="1998-04-01")


@query("e51_holder_changes")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t), "stocks.ownership.shareholders.changes", code="7", start_date="1997-01-01", end_date="1999-12-31")
    return round_columns(rows, ["change_pct"])


ETF_OPTIONS = {"ts_codes": "510003.SH,510007.SH,510099.SH", "start_date": "1998-01-01", "end_date": "1998-02-28", "limit": 70}


@query("e60_etf_quotes")
def _(t: MarketTables) -> DataFrame:
    return etf_quote_result(market_store(t), **ETF_OPTIONS)[0].select("ts_code", "trade_date", "open", "close", "volume")


@query("e60_etf_completeness")
def _(t: MarketTables) -> DataFrame:
    meta = etf_quote_result(market_store(t), **ETF_OPTIONS)[1]
    return meta.select("ts_code", "expected_bar_count", "actual_bar_count", "missing_count", "complete", _day_text("missing_trade_dates").alias("missing_trade_dates"))


@query("e62_concept_snapshot")
def _(t: MarketTables) -> DataFrame:
    return query_view(market_store(t), "concepts.quotes.daily_snapshot", trade_date="1999-02-03", fields="concept_id,concept_name,close,pct_chg,amount")


@query("n1_news")
def _(t: MarketTables) -> DataFrame:
    rows = query_view(market_store(t.between("2024-01-05", "2024-01-05")), "markets.events.news", trade_date="2024-01-05", stock_code="8", min_importance_score=1, sort_by="crawl_time", limit=30)
    return rows.select("event_id", "event_type", "announcement_time", "crawl_time", "importance_score", F.array_join("related_stock_codes", ",").alias("related"))


@query("n1_news_counts")
def _(t: MarketTables) -> DataFrame:
    return view_counts(market_store(t.between("2024-01-05", "2024-01-05")), "markets.events.news", limit=25, trade_date="2024-01-05", event_type="click")


@query("n1_news_filtered")
def _(t: MarketTables) -> DataFrame:
    rows = news_events(news_rows(t.between("2024-01-10", "2024-01-10")), "20240110", announcement_date="2024-01-10", crawl_date="2024-01-10", event_type="click", limit=40, offset=5)
    return rows.select("event_id", "event_type", "announcement_time", "importance_score")


# -- quality checks ----------------------------------------------------------------------------------------------

AS_OF = dt.datetime(2000, 7, 1, 16, 0)


def faulty_bars(t: MarketTables) -> DataFrame:
    """Bars with seeded faults: opens above the high, negative volumes, bad inflows, a wrong frequency label."""
    n = F.col("volume").cast("long")
    return t.bars_sparse.select(
        "code", "trade_date", F.when(n % 97 == 0, F.col("high") + 1).otherwise((F.col("low") + F.col("high")) / 2).alias("open"), "high", "low", "close",
        F.when(n % 89 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"), "amount",
        F.when(n % 83 == 0, float("nan")).when(n % 79 == 0, float("inf")).when(n % 73 == 0, F.lit(None)).otherwise(F.col("amount")).alias("inflow"),
        F.when((F.col("code") == "Brand#9") & (n % 71 == 0), "2d").otherwise("1d").alias("freq"),
    )


def checks_over(t: MarketTables, as_of: dt.datetime = AS_OF) -> Checks:
    bars = faulty_bars(t)
    tables = {
        "ref.trade_calendar": t.calendar,
        "fact.bars": bars,
        "fact.thin": bars.where(F.col("code") == "Brand#9"),
        "fact.empty": bars.where(F.col("close") < 0),
        "fact.lines": t.raw("lineitem"),
        "fact.stocks": t.stock_daily,
        "ref.some_stocks": t.stock_ref.where(F.col("p_type") != "SMALL"),
    }
    time = {name: "trade_date" for name in ("fact.bars", "fact.thin", "fact.empty", "fact.stocks")}
    return Checks(t.spark, tables, as_of, time_columns=time, primary_keys={"fact.bars": ("code", "trade_date"), "fact.lines": ("l_orderkey", "l_linenumber")})


RULES = {
    "c05_non_empty": (Rule("table_non_empty", "fact.bars"), Rule("table_non_empty", "fact.empty")),
    "c06_calendar": (Rule("trade_calendar_available"),),
    "c07_closed_days": (Rule("non_trading_day_empty_result", "fact.bars"),),
    "c08_open_days": (Rule("trade_day_missing_data_unhealthy", "fact.thin"),),
    "c09_reference": (Rule("reference_valid", "fact.stocks", "stock_reference_valid", fields=("market", "code"), reference="ref.some_stocks"),),
    "c10_capability_key": (Rule("capability_key_unique_rule", "fact.lines", fields=("l_orderkey", "l_linenumber")),),
    "c11_primary_key": (Rule("primary_key_duplicate_absent", "fact.lines"), Rule("primary_key_duplicate_absent", "fact.bars")),
    "c12_fixed_field": (Rule("fixed_field", "fact.bars", "freq_valid", column="freq", expected_value="1d"),),
    "c13_ohlc": (Rule("ohlc_valid", "fact.bars"),),
    "c14_non_negative": (Rule("non_negative", "fact.bars", column="volume"), Rule("non_negative", "fact.bars", column="amount")),
    "c15_finite": (Rule("money_flow_values_valid", "fact.bars"),),
    "c16_coverage": (Rule("recent_coverage_90d", "fact.thin", "thin_coverage", provider_earliest_date="2000-05-01"), Rule("recent_coverage_90d", "fact.bars", provider_earliest_date="1995-01-01")),
    "c18_continuity": (Rule("calendar_continuity_90d"),),
    "c19_long_empty": (Rule("long_empty", required_objects=("fact.bars", "fact.stocks"), check_id="idle"),),
}


# Rules that look at the 90 days before the run only.
RECENT_RULES = ("c07_closed_days", "c08_open_days", "c12_fixed_field", "c13_ohlc", "c14_non_negative", "c15_finite", "c16_coverage")


def recent_tables(t: MarketTables) -> MarketTables:
    last = AS_OF.date() - dt.timedelta(days=1)
    return t.between((AS_OF.date() - dt.timedelta(days=90)).isoformat(), last.isoformat())


def _register_rules(name: str, rules: tuple[Rule, ...]) -> None:
    query(name)(lambda t: checks_over(recent_tables(t) if name in RECENT_RULES else t).run(rules))


for _name, _rules in RULES.items():
    _register_rules(_name, _rules)


MINUTE_AS_OF = dt.datetime(2024, 1, 31, 16, 0)


def minute_checks(t: MarketTables) -> Checks:
    calendar = t.news.select(F.lit("SSE").alias("exchange"), "trade_date", F.lit(True).alias("is_open")).distinct()
    return Checks(t.spark, {"ref.trade_calendar": calendar, "fact.stock_bar_1m": t.bars_minute}, MINUTE_AS_OF)


@query("c17_minute_session")
def _(t: MarketTables) -> DataFrame:
    return minute_checks(t).run([Rule("recent_minute_session_complete", "fact.stock_bar_1m", lookback_days=10)])


@query("c17_session_days")
def _(t: MarketTables) -> DataFrame:
    checks = minute_checks(t)
    per_day = session_days(t.bars_minute, "bar_time", completed_days(checks, 30))
    return session_issues(per_day, 240, 0.95).withColumn("issue", F.coalesce("issue", F.lit("")))


def _new_folder(t: MarketTables, name: str) -> str:
    return new_folder(t.spark, name)


def stored(t: MarketTables, df: DataFrame) -> DataFrame:
    """The rows written once below the shared folder: the contract reads each fact several times."""
    return written(df, "contract")


_CONTRACTS: dict[tuple, dict[str, DataFrame]] = {}


def contract_tables(t: MarketTables) -> dict[str, DataFrame]:
    """The contract's tables, stored once per application and state of the given files: the contract queries share them."""
    files = sorted(f for name in ("lineitem", "part") for f in t.raw(name).inputFiles())
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    hadoop = t.spark._jsparkSession.sessionState().newHadoopConf()
    state = tuple((f, path(f).getFileSystem(hadoop).getFileStatus(path(f)).getModificationTime()) for f in files)
    key = (t.spark.sparkContext.applicationId, shared_folder(t.spark), state)
    held = _CONTRACTS.get(key)
    if held is None or not all(path(f).getFileSystem(hadoop).exists(path(f)) for f in held["concept_daily"].inputFiles()):
        _CONTRACTS[key] = held = _contract_tables(t)
    return held


def _contract_tables(t: MarketTables) -> dict[str, DataFrame]:
    """With seeded faults: an amount, a change, a name, a duplicate and a missing reference."""
    changed = stored(t, stock_changes(t))
    twice = changed.unionByName(changed.where((F.col("trade_date") == F.lit("1996-01-01").cast("date")) & F.col("is_st")))
    members = t.membership.withColumnsRenamed({"stock_market": "market", "stock_code": "code"})
    live = changed.join(members, ["market", "code"]).where((F.col("valid_from") <= F.col("trade_date")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("trade_date"))))
    usable = ~F.col("is_suspended") & ~F.col("is_st")
    concept = live.groupBy("concept_id", "trade_date").agg(exact_sum(F.when(usable, F.col("amount"))).alias("amount"), weighted_pct(usable).alias("pct_chg"))
    concept = concept.select(
        "concept_id", "trade_date", (F.col("amount") + F.when(F.col("concept_id") == "PROMO", 100.0).otherwise(0.0)).alias("amount"),
        F.when((F.col("concept_id") == "ECONOMY") & (F.month("trade_date") == 11), F.lit(None)).otherwise(F.col("pct_chg") + F.when(F.col("concept_id") == "SMALL", 0.5).otherwise(0.0)).alias("pct_chg"),
    )

    def priced(bars: DataFrame, key: str) -> DataFrame:
        with_open = bars.withColumn("open", (F.col("low") + F.col("high")) / 2)
        return previous_change(with_open, ["code"], "trade_date").withColumnRenamed("code", key)

    types = t.raw("part").select("p_type").distinct()
    return {
        "index_daily": stored(t, priced(t.bars_daily, "index_code")),
        "concept_daily": stored(t, concept),
        "stock_daily": twice,
        "board_daily": stored(t, priced(t.bars_sparse, "board_code")),
        "ref_index": types.where(F.col("p_type") != "LARGE").select(F.col("p_type").alias("index_code"), F.when(F.col("p_type") == "PROMO", "PR?MO").otherwise(F.col("p_type")).alias("index_name")),
        "ref_stock": t.stock_ref.where(F.col("code") != "000007"),
        "ref_concept": types.select(F.col("p_type").alias("concept_id"), F.when(F.col("p_type") == "LARGE", "").otherwise(F.col("p_type")).alias("name")),
        "membership": t.membership,
    }


@query("h_contract_metrics")
def _(t: MarketTables) -> DataFrame:
    """All 31 metrics."""
    return contract_metrics(contract_tables(t), "PROMO")


@query("a15_metrics_long")
def _(t: MarketTables) -> DataFrame:
    compared = compare_expectations(contract_metrics(contract_tables(t), "PROMO"))
    return compared.select("metric", "actual", "expected", "status")


@query("health_run")
def _(t: MarketTables) -> DataFrame:
    """A whole run over two groups of capabilities, rolled up per group."""
    checks = checks_over(t)
    rules = [(("bars" if name in ("c13_ohlc", "c14_non_negative", "c15_finite") else "keys" if name in ("c10_capability_key", "c11_primary_key") else "calendar"), rule)
             for name in ("c06_calendar", "c13_ohlc", "c14_non_negative", "c15_finite", "c10_capability_key", "c11_primary_key") for rule in RULES[name]]
    groups = t.spark.createDataFrame([("bars", "facts"), ("keys", "facts"), ("calendar", "reference"), ("unlisted", "reference")], "capability_id string, group string")
    return run_health(checks, ["bars", "keys", "calendar", "unlisted"], groups, rules)["groups"]


@query("c03_table_exists")
def _(t: MarketTables) -> DataFrame:
    """A table written to a store and one that was not, looked up in the store."""
    store = MarketStore(t.spark, _new_folder(t, "store"))
    store.write("fact.lines", t.trades.groupBy("trade_date").agg(F.count("*").alias("lines")))
    names = ("fact.lines", "fact.nowhere")
    return Checks(t.spark, {name: store.find(name) for name in names}, AS_OF).run([Rule("table_exists", name) for name in names])


@query("c20_contract_rules")
def _(t: MarketTables) -> DataFrame:
    """The contract for two index codes as rules of two capabilities; outcomes counted per capability."""
    short = {name: table for table, name in CONTRACT_TABLES.items()}
    checks = Checks(t.spark, {short[name]: df for name, df in contract_tables(t).items()}, AS_OF)
    rules = [(code.lower(), Rule("market_data_contract", index_code=code)) for code in ("PROMO", "SMALL")]
    groups = t.spark.createDataFrame([("promo", "indexes"), ("small", "indexes")], "capability_id string, group string")
    detail = run_health(checks, ["promo", "small"], groups, rules)["checks"]
    return detail.groupBy("capability_id", "status").agg(F.count("*").alias("checks"))


@query("io3_profiles_run")
def _(t: MarketTables) -> DataFrame:
    """A profile file written, read, run and rolled up: one capability per check family, one without checks."""
    checks = {"bars": [{"type": "ohlc_valid", "object": "fact.bars"}, {"type": "non_negative", "object": "fact.bars", "column": "amount"}], "keys": [{"type": "primary_key_duplicate_absent", "object": "fact.lines"}], "none": []}
    payload = {"capabilities": {name: {"group": "facts", "checks": rules} for name, rules in checks.items()}}
    path = _new_folder(t, "profiles")
    t.spark.createDataFrame([(json.dumps(payload),)], "value string").coalesce(1).write.text(path)
    profiles = read_profiles(t.spark, path)
    names = sorted(row.capability_id for row in profiles.select("capability_id").collect())  # configuration
    return run_health(checks_over(t), names, profiles.select("capability_id", "group"), rules_of(profiles))["capabilities"].select("capability_id", "group", "status")


# -- writing -----------------------------------------------------------------------------------------------------


@query("io4_result_round_trip")
def _(t: MarketTables) -> DataFrame:
    """Check rows of two runs written below the shared folder; the latest is read back."""
    folder, checks = _new_folder(t, "health"), checks_over(t)
    write_result(checks.run(RULES["c06_calendar"]), folder, "first")
    write_result(checks.run(RULES["c13_ohlc"] + RULES["c14_non_negative"]), folder, "second")
    return read_result(t.spark, folder)


@query("io5_fill_write_back")
def _(t: MarketTables) -> DataFrame:
    """Monthly volumes of returned lines stored, months without any filled from the other flags, written back and read."""
    def source(flag: str) -> DataFrame:
        month = F.date_trunc("month", "trade_date").cast("date").alias("month")
        return t.trades.where(F.col("l_returnflag") == flag).groupBy(F.col("p_brand").alias("code"), month).agg(exact_sum("l_quantity").alias("volume"), F.lit(flag).alias("flag"))

    store = MarketStore(t.spark, _new_folder(t, "store"))
    store.write("fact.volumes", source("R"), "month", ["code"])
    return store.fill_and_write_back("fact.volumes", [source("A"), source("N")], ["code", "month"], "month")


@query("q13_stored_levels")
def _(t: MarketTables) -> DataFrame:
    """Daily, weekly and monthly bars merged from stored states; every seventh minute first comes wrong and is corrected."""
    store = BarStore(t.spark, _new_folder(t, "levels"))
    minutes = t.bars_minute
    wrong = F.minute("bar_time") % 7 == 0
    store.apply(minutes.withColumns({name: F.when(wrong, F.col(name) + 1000).otherwise(F.col(name)) for name in ("open", "high", "low", "close", "amount")}))
    store.apply(minutes.where(wrong))
    levels = [store.bars(freq).withColumns({"freq": F.lit(freq), "trade_time": F.col("trade_time").cast("date")}) for freq in ("1d", "1w", "1mo")]
    return round_columns(reduce(DataFrame.unionByName, levels), ["amount"], 2)


@query("c14_observed")
def _(t: MarketTables) -> DataFrame:
    """Row checks observed while a table is written, without reading it again."""
    store, rows = MarketStore(t.spark, _new_folder(t, "observed")), faulty_bars(t)
    return store.write_checked("fact.bars", rows, checks_over(t), RULES["c13_ohlc"] + RULES["c14_non_negative"])


# -- streaming ---------------------------------------------------------------------------------------------------


def _events_stream(t: MarketTables) -> DataFrame:
    return jobs.read_events(t.spark, t.folder, t.raw("events").schema, files="events.parquet").withColumnRenamed("event_type", "code")


@query("s1_stream_bars")
def _(t: MarketTables) -> DataFrame:
    """Bars finished by the watermark, appended by a stream and read back."""
    folder = _new_folder(t, "live-bars")
    jobs.append_to(jobs.live_bars(_events_stream(t), "30 minutes"), f"{folder}/bars", f"{folder}/checkpoint").awaitTermination()
    rows = t.spark.read.parquet(f"{folder}/bars")
    return rows.select("code", *(F.col(name).cast("timestamp_ntz").alias(name) for name in ("bar_time", "bar_end")), "open", "high", "low", "close", "volume", rounded("amount", 2).alias("amount"))


@query("s1_chained_bars")
def _(t: MarketTables) -> DataFrame:
    """Bars of 1, 5, 30 and 60 minutes, each level a stream over the stored bars of the one before."""
    folder, widths = _new_folder(t, "chained-bars"), ("1 minute", "5 minutes", "30 minutes", "60 minutes")
    jobs.append_to(jobs.live_bars(_events_stream(t)), f"{folder}/bars/1-minute", f"{folder}/checkpoint/1-minute").awaitTermination()
    jobs.chain_bars(t.spark, f"{folder}/bars", f"{folder}/checkpoint", widths)
    levels = [t.spark.read.parquet(f"{folder}/bars/{width.replace(' ', '-')}").withColumn("width", F.lit(width)) for width in widths]
    rows = reduce(DataFrame.unionByName, levels)
    return rows.select("width", "code", F.col("bar_time").cast("timestamp_ntz").alias("bar_time"), "open", "high", "low", "close", "volume", rounded("amount", 2).alias("amount"))


@query("s3_session_audit")
def _(t: MarketTables) -> DataFrame:
    """Missing session minutes of each code and day, from a stream of finished minute bars when the day's close has passed."""
    folder = _new_folder(t, "session-audit")
    jobs.append_to(jobs.live_bars(_events_stream(t)), f"{folder}/bars", f"{folder}/checkpoint/bars").awaitTermination()
    bars = t.spark.readStream.schema(t.spark.read.parquet(f"{folder}/bars").schema).parquet(f"{folder}/bars")
    jobs.append_to(jobs.session_audit(bars, session_ends(1)), f"{folder}/days", f"{folder}/checkpoint/days").awaitTermination()
    return t.spark.read.parquet(f"{folder}/days")


@query("s4_sources_joined")
def _(t: MarketTables) -> DataFrame:
    """Purchases with the clicks of the same user in the half hour after, joined while both streams run."""
    folder = _new_folder(t, "sources")
    one, two = (_events_stream(t).where(F.col("code") == kind) for kind in ("purchase", "click"))
    events, sources = one.select("event_id", "user_id", "ts"), two.select("user_id", F.col("ts").alias("source_ts"), F.col("event_id").alias("source_id"))
    jobs.append_to(jobs.with_sources(events, sources, ["user_id"], "ts", "source_ts"), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    rows = t.spark.read.parquet(f"{folder}/rows")
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("ts", "source_ts")})


@query("s2_upsert")
def _(t: MarketTables) -> DataFrame:
    """Bars of all windows, open ones included, upserted by key from a stream in update mode."""
    folder, keys = _new_folder(t, "upserts"), ["code", "bar_time"]
    jobs.for_each_batch(jobs.live_bars(_events_stream(t), "1 hour"), jobs.upsert_into(f"{folder}/bars", keys, time="bar_time"), f"{folder}/checkpoint").awaitTermination()
    rows = jobs.read_upserts(t.spark, f"{folder}/bars", keys)
    return rows.select("code", F.col("bar_time").cast("timestamp_ntz").alias("bar_time"), "open", "close", "volume", rounded("amount", 2).alias("amount"))


@query("s3_gap_audit")
def _(t: MarketTables) -> DataFrame:
    """Minute rows stored per batch, and the session issues of the days each batch touched."""
    folder, keys = _new_folder(t, "audit"), ["code", "bar_time"]
    minutes = _events_stream(t).select("code", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bar_time"))
    store = jobs.upsert_into(f"{folder}/bars", keys, time="bar_time")
    audit = jobs.audit_gaps(f"{folder}/issues", lambda days: jobs.read_upserts(t.spark, f"{folder}/bars", keys, days), completed_days(minute_checks(t), 30))

    def handle(batch: DataFrame, batch_id: int) -> None:
        store(batch.distinct(), batch_id)
        audit(batch, batch_id)

    jobs.for_each_batch(minutes, handle, f"{folder}/checkpoint", "append").awaitTermination()
    return jobs.read_issues(t.spark, f"{folder}/issues").select("trade_date", "minute_count", "first_minute", "last_minute", "issue")


@query("s4_news_lag")
def _(t: MarketTables) -> DataFrame:
    """Late share and largest lag per crawl hour, from a stream."""
    folder = _new_folder(t, "lag")
    shift = F.make_dt_interval(mins=(F.col("event_id") % 121 - 60).cast("int"))
    events = _events_stream(t).withColumn("announcement_time", F.col("ts")).withColumn("crawl_time", F.col("ts") + shift)
    query_ = jobs.append_to(jobs.lag_by_hour(events), f"{folder}/hours", f"{folder}/checkpoint")
    query_.awaitTermination()
    rows = t.spark.read.parquet(f"{folder}/hours")
    return rows.withColumn("crawl_hour", F.col("crawl_hour").cast("timestamp_ntz"))


@query("s4_news_lag_batch")
def _(t: MarketTables) -> DataFrame:
    return round_columns(news_lag(news_rows(t)), ["mean_lag_seconds", "max_lag_seconds"])
