"""Data views: a declarative registry over seven query templates.

A view names the table it reads, its template, key and time columns, equality filters and output columns; the
template does the work. Views whose rows need computation name it in ``derive``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.bars import adjust_prices, completeness
from tapeloom.operators.factors import strategy_window
from tapeloom.operators.indicators import TECHNICAL_FIELDS, technical
from tapeloom.operators.lookback import rows_before
from tapeloom.operators.merge import pit_merge
from tapeloom.operators.news import news_events
from tapeloom.operators.predicates import catalog_filter, clamp_limit, codes_of, etf_codes_of, in_days, keep_entities, option, overlaps, parse_day, valid_on
from tapeloom.operators.selection import cut_counts, finite_doubles, page, pick_fields
from tapeloom.operators.series import count_change, open_days
from tapeloom.plans.quotes import (
    CONCEPT_QUOTE_FIELDS, DAY_FREQS, INDEX_QUOTE_FIELDS, QuoteRequest, STOCK_QUOTE_FIELDS, daily_snapshot, day_quotes, local_window, minute_quotes, simple_quotes, tick_quotes,
)
from tapeloom.sources.store import MarketStore


@dataclass(frozen=True)
class View:
    name: str
    template: str
    table: str
    columns: tuple[str, ...]  # empty: all columns of the table
    key: str = "code"
    time: str = "trade_date"
    filters: tuple[str, ...] = ()
    derive: str = ""
    kinds: dict[str, str] = field(default_factory=dict)


def _cols(text: str) -> tuple[str, ...]:
    return tuple(text.split())


CALENDAR = _cols("exchange trade_date is_open")
INDEX_INFO = _cols("index_code index_name category market publisher list_date status")
STOCK_INFO = _cols("code name exchange market list_status list_date delist_date industry area")
MONEY_FLOW = _cols("code trade_date view main_inflow main_outflow net_inflow")
CONCEPT_MONEY_FLOW = _cols("concept_id trade_date scope inflow outflow net_inflow")
EXPRESS = _cols("code report_period announce_date revenue operating_profit total_profit net_profit eps roe")
FORECAST = _cols("code report_period forecast_type forecast_summary net_profit_min net_profit_max pct_chg_min pct_chg_max")
TOP_HOLDERS = _cols("code report_period rank shareholder_name holding_volume holding_ratio change_volume")
AUCTION = _cols("code trade_date auction_time price volume amount session")
STRATEGY = _cols(
    "trade_date code listing_board close dividend_yield_pct float_market_cap circulating_shares free_float_shares active_buy_amount "
    "active_buy_amount_proportion_all volume_shares mean_volume_5d_shares mean_volume_5d_to_free_float_shares ma10 ma20 ma40 is_st is_suspended "
    "upper_limit lower_limit price_band_state"
)
ETF_BARS = _cols("ts_code trade_date open high low close pre_close change pct_chg volume amount")

# Views and their columns. Templates: quotes, range, period, snapshot, single, catalog, as_of, history,
# calendar. Where no column list is documented, the columns are those of the table.
VIEWS = {
    view.name: view
    for view in (
        View("stocks.quotes", "quotes", "fact.stock_daily_1d", STOCK_QUOTE_FIELDS, derive="stock_quotes"),
        View("stocks.quotes.query", "quotes", "fact.stock_daily_1d", STOCK_QUOTE_FIELDS, derive="stock_quotes"),
        View("stocks.quotes.daily_snapshot", "snapshot", "fact.stock_daily_1d", STOCK_QUOTE_FIELDS, derive="daily_snapshot"),
        View("stocks.quotes.daily_local_window", "range", "fact.stock_daily_1d", STOCK_QUOTE_FIELDS, derive="local_window"),
        View("stocks.catalog", "catalog", "stocks.catalog", STOCK_INFO, filters=("exchange", "list_status")),
        View("stocks.catalog.archive", "catalog", "stocks.catalog.archive", _cols("trade_date code name exchange market list_status industry area"), filters=("trade_date", "code", "industry", "area")),
        View("stocks.profile.basic", "single", "stocks.catalog", STOCK_INFO),
        View("stocks.profile", "single", "stocks.profile", _cols("code company_name full_name chairman manager website employee_count main_business office"), kinds={"employee_count": "int"}),
        View("stocks.profile.name_history", "history", "stocks.profile.name_history", _cols("code name start_date end_date ann_date")),
        View("stocks.profile.managers", "single", "stocks.profile.managers", _cols("code name title gender education begin_date end_date")),
        View("stocks.profile.management_rewards", "range", "stocks.profile.management_rewards", _cols("code ann_date name title reward_amount hold_amount"), time="ann_date"),
        View("stocks.signals.hl", "range", "stocks.signals.hl", _cols("code trade_date first_extreme high_time low_time signal")),
        View("stocks.signals.limit_order_amount", "snapshot", "stocks.signals.limit_order_amount", ()),
        View("stocks.signals.nine_turn", "range", "stocks.signals.nine_turn", _cols("code trade_time freq setup_index countdown_index signal"), time="trade_time", filters=("freq",), kinds={"trade_time": "date", "setup_index": "int", "countdown_index": "int"}),
        View("stocks.factors.adj", "range", "fact.stock_daily_1d", _cols("code trade_date adj_factor"), derive="adj_factors"),
        View("stocks.factors.technical", "range", "fact.stock_daily_1d", TECHNICAL_FIELDS, derive="technical"),
        View("stocks.factors.strategy_window", "range", "stocks.factors.strategy_window", STRATEGY, derive="strategy_window"),
        View("stocks.indicators.money_flow", "range", "stocks.indicators.money_flow", MONEY_FLOW, filters=("view",)),
        View("stocks.indicators.money_flow.batch", "snapshot", "stocks.indicators.money_flow", MONEY_FLOW, filters=("view",), derive="money_flow_batch"),
        View("stocks.indicators.money_flow.snapshot", "snapshot", "stocks.indicators.money_flow", MONEY_FLOW, filters=("view",)),
        View("stocks.indicators.margin.snapshot", "snapshot", "stocks.indicators.margin", ()),
        View("stocks.finance.express.snapshot", "snapshot", "stocks.finance.express", EXPRESS, time="announce_date"),
        View("stocks.finance.forecasts.snapshot", "snapshot", "stocks.finance.forecasts", FORECAST, time="announce_date"),
        View("stocks.indicators.ah_comparisons", "range", "stocks.indicators.ah_comparisons", _cols("code name h_code trade_date a_close h_close premium_ratio")),
        View("stocks.indicators.daily_basic", "range", "stocks.indicators.daily_basic", ()),
        View("stocks.indicators.daily_valuation", "range", "stocks.indicators.daily_valuation", ()),
        View("stocks.indicators.daily_market_value", "range", "stocks.indicators.daily_market_value", ()),
        View("stocks.indicators.risk_flags", "history", "stocks.indicators.risk_flags", _cols("code name flag_type start_date end_date status"), filters=("flag_type", "status")),
        View("stocks.indicators.premarket", "range", "stocks.indicators.premarket", _cols("code trade_date total_share float_share limit_up limit_down")),
        View("stocks.indicators.chip_distribution", "range", "stocks.indicators.chip_distribution", _cols("code trade_date price chip_ratio")),
        View("stocks.indicators.chip_performance", "range", "stocks.indicators.chip_performance", _cols("code trade_date profit_ratio avg_cost cost_70 cost_90")),
        View("stocks.finance.statements", "period", "stocks.finance.statements", _cols("code report_period report_type announce_date revenue operating_profit total_profit net_profit total_assets total_liabilities equity"), time="report_period", filters=("report_type",)),
        View("stocks.finance.indicators", "period", "stocks.finance.indicators", _cols("code report_period roe roa gross_margin net_margin asset_turnover current_ratio debt_to_asset"), time="report_period"),
        View("stocks.finance.pit.raw_period", "period", "stocks.finance.pit.indicators", (), time="report_period", derive="pit_period"),
        View("stocks.finance.audits", "period", "stocks.finance.audits", _cols("code report_period audit_result auditor sign_accountant announce_date"), time="report_period"),
        View("stocks.finance.disclosure_dates", "period", "stocks.finance.disclosure_dates", _cols("code report_period plan_date actual_date change_reason"), time="report_period"),
        View("stocks.finance.express", "period", "stocks.finance.express", EXPRESS, time="report_period"),
        View("stocks.finance.forecasts", "period", "stocks.finance.forecasts", FORECAST, time="report_period"),
        View("stocks.finance.main_business", "period", "stocks.finance.main_business", _cols("code report_period classification segment_name revenue cost profit revenue_ratio"), time="report_period", filters=("classification",)),
        View("stocks.corporate_actions.dividends", "range", "stocks.corporate_actions.dividends", _cols("code announce_date record_date ex_date pay_date cash_dividend_per_share stock_dividend_per_share capital_reserve_per_share"), time="announce_date"),
        View("stocks.corporate_actions.repurchases", "range", "stocks.corporate_actions.repurchases", _cols("code announce_date progress repurchase_volume repurchase_amount highest_price lowest_price"), time="announce_date"),
        View("stocks.corporate_actions.rights_issues", "range", "stocks.corporate_actions.rights_issues", _cols("code announce_date rights_ratio rights_price record_date ex_date"), time="announce_date"),
        View("stocks.corporate_actions.share_changes", "range", "stocks.corporate_actions.share_changes", _cols("code change_date reason total_share float_share restricted_share"), time="change_date"),
        View("stocks.corporate_actions.unlock_schedules", "range", "stocks.corporate_actions.unlock_schedules", _cols("code unlock_date holder_type unlock_volume unlock_ratio share_type"), time="unlock_date"),
        View("stocks.ownership.ccass_holdings", "range", "stocks.ownership.ccass_holdings", _cols("code trade_date participant_count holding_volume holding_ratio"), kinds={"participant_count": "int"}),
        View("stocks.ownership.ccass_holding_details", "range", "stocks.ownership.ccass_holding_details", _cols("code trade_date participant_id participant_name holding_volume holding_ratio")),
        View("stocks.ownership.hk_connect_holdings", "range", "stocks.ownership.hk_connect_holdings", _cols("code trade_date holding_volume holding_ratio change_volume")),
        View("stocks.ownership.pledges.stats", "range", "stocks.ownership.pledges.stats", _cols("code trade_date pledge_volume pledge_ratio unrestricted_pledge_volume")),
        View("stocks.ownership.pledges.details", "history", "stocks.ownership.pledges.details", _cols("code holder_name start_date end_date pledge_volume pledge_ratio status"), filters=("status",)),
        View("stocks.ownership.shareholders.count", "range", "stocks.ownership.shareholders.count", _cols("code trade_date holder_count avg_holding"), kinds={"holder_count": "int"}),
        View("stocks.ownership.shareholders.changes", "range", "stocks.ownership.shareholders.count", _cols("code trade_date holder_count change_count change_pct"), derive="holder_changes", kinds={"holder_count": "int"}),
        View("stocks.ownership.shareholders.top10", "period", "stocks.ownership.shareholders.top10", TOP_HOLDERS, time="report_period", kinds={"rank": "int"}),
        View("stocks.ownership.shareholders.top10_float", "period", "stocks.ownership.shareholders.top10_float", TOP_HOLDERS, time="report_period", kinds={"rank": "int"}),
        View("stocks.research.reports", "range", "stocks.research.reports", _cols("code report_date institution analyst rating target_price title"), time="report_date"),
        View("stocks.research.surveys", "range", "stocks.research.surveys", _cols("code survey_date org_name survey_method topic announcement_date"), time="survey_date"),
        View("stocks.reference.bse_code_mappings", "catalog", "stocks.reference.bse_code_mappings", _cols("old_code new_code effective_date status"), key="new_code", filters=("old_code", "new_code", "status")),
        View("stocks.reference.hk_connect_targets", "catalog", "stocks.reference.hk_connect_targets", _cols("code name direction status effective_date"), filters=("direction", "status", "effective_date")),
        View("stocks.quotes.auctions", "range", "stocks.quotes.auctions", AUCTION, filters=("session",)),
        View("funds.etfs.catalog", "catalog", "ref.etf", _cols("ts_code code market name fund_type management custodian list_date delist_date"), key="ts_code"),
        View("funds.etfs.quotes.daily", "quotes", "fact.etf_daily_1d", ETF_BARS, key="ts_code", derive="etf_quotes"),
        View("concepts.quotes", "quotes", "fact.concept_daily_1d", CONCEPT_QUOTE_FIELDS, key="concept_id", derive="concept_quotes"),
        View("concepts.quotes.daily_snapshot", "snapshot", "fact.concept_daily_1d", CONCEPT_QUOTE_FIELDS, key="concept_id", derive="concept_snapshot"),
        View("concepts.catalog", "catalog", "concepts.catalog", (), key="concept_id", filters=("category", "market", "status")),
        View("concepts.profile", "single", "concepts.catalog", (), key="concept_id"),
        View("concepts.members", "as_of", "ref.concept_stock_membership", (), key="concept_id"),
        View("concepts.members.history", "history", "ref.concept_stock_membership", (), key="concept_id", derive="member_history"),
        View("concepts.indicators.money_flow", "range", "concepts.indicators.money_flow", CONCEPT_MONEY_FLOW, key="concept_id", filters=("scope",)),
        View("concepts.indicators.money_flow.snapshot", "snapshot", "concepts.indicators.money_flow", CONCEPT_MONEY_FLOW, key="concept_id", filters=("scope",)),
        View("concepts.reference.categories", "catalog", "concepts.reference.categories", (), filters=("parent_code", "level")),
        View("concepts.alias.resolve", "as_of", "concepts.alias", (), key="provider_concept_code", filters=("provider", "provider_concept_type", "provider_concept_code")),
        View("concepts.alias.groups", "as_of", "concepts.alias", (), key="concept_id"),
        View("concepts.alias.groups.one", "as_of", "concepts.alias", (), key="concept_id"),
        View("indexes.catalog", "catalog", "indexes.catalog", INDEX_INFO, key="index_code", filters=("category", "market", "publisher", "status")),
        View("indexes.profile", "single", "indexes.catalog", INDEX_INFO, key="index_code"),
        View("indexes.quotes", "quotes", "fact.index_bar_1d", INDEX_QUOTE_FIELDS, key="index_code", derive="index_quotes"),
        View("indexes.members", "range", "indexes.members", _cols("index_code code name weight trade_date"), key="index_code"),
        View("markets.calendar.trading", "range", "ref.trade_calendar", CALENDAR, key="exchange", filters=("is_open",)),
        View("markets.calendar.trading.previous", "calendar", "ref.trade_calendar", CALENDAR, key="exchange"),
        View("markets.calendar.trading.next", "calendar", "ref.trade_calendar", CALENDAR, key="exchange"),
        View("markets.calendar.trading.yearly", "calendar", "ref.trade_calendar", CALENDAR, key="exchange"),
        View("markets.indicators.main_capital_flow", "range", "markets.indicators.main_capital_flow", _cols("trade_date market main_inflow main_outflow net_inflow")),
        View("markets.connect.capital_flow", "range", "markets.connect.capital_flow", _cols("trade_date market buy_amount sell_amount net_amount")),
        View("markets.connect.quotas", "range", "markets.connect.quotas", _cols("trade_date market quota_total quota_balance quota_used"), filters=("type",)),
        View("markets.connect.active_top10", "range", "markets.connect.active_top10", _cols("trade_date market code name rank buy_amount sell_amount net_amount"), filters=("type",), kinds={"rank": "int"}),
        View("markets.events.block_trades", "range", "markets.events.block_trades", _cols("trade_date code name price volume amount buyer seller")),
        View("markets.participants.dragon_tiger", "range", "markets.participants.dragon_tiger", _cols("trade_date code name reason buy_amount sell_amount net_amount")),
        View("markets.participants.dragon_tiger.institutions", "range", "markets.participants.dragon_tiger.institutions", _cols("trade_date code name buy_amount sell_amount net_amount institution_count"), kinds={"institution_count": "int"}),
        View("markets.participants.hot_money", "catalog", "markets.participants.hot_money", _cols("name alias tag style"), key="name", filters=("tag",)),
        View("markets.participants.hot_money.details", "range", "markets.participants.hot_money.details", _cols("trade_date name code stock_name buy_amount sell_amount net_amount"), filters=("name",)),
        View("markets.trading.open_auctions", "snapshot", "stocks.quotes.auctions", AUCTION, filters=("instrument_type",)),
        View("markets.trading.sessions", "single", "markets.trading.sessions", _cols("code session_name start_time end_time timezone")),
        View("markets.events.news", "news", "fact.news_event_agent_view", (), key="event_id", derive="news"),
        View("rankings.research.reports", "range", "rankings.research.reports", _cols("trade_date code name institution rating target_price title")),
        View("rankings.research.broker_monthly_picks", "catalog", "rankings.research.broker_monthly_picks", _cols("trade_month code name institution rank recommend_count rating"), filters=("trade_month",), kinds={"rank": "int", "recommend_count": "int"}),
    )
}


def query_view(store: MarketStore, view_name: str, /, **params) -> DataFrame:
    """Run a view. Parameters: key values (``code``/``codes``), dates, the view's filters, fields, limit, offset."""
    view = VIEWS[view_name]
    df = store.table(view.table)
    if view.derive:
        return DERIVED[view.derive](store, view, df, **params)
    return TEMPLATES[view.template](view, df, **params)


def view_counts(store: MarketStore, view_name: str, /, limit: int | None = None, **params) -> DataFrame:
    """One row (total_rows, returned_rows, truncated): what ``query_view`` has, and what it leaves out at ``limit``."""
    return cut_counts(query_view(store, view_name, **params), limit)


def _entities(view: View, df: DataFrame, /, code: str = "", codes: str = "") -> DataFrame:
    wanted = codes_of(code, codes, required=False)
    return keep_entities(df, view.key, wanted) if wanted else df


def _finish(view: View, df: DataFrame, order: tuple[str, ...], fields: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    columns = view.columns or tuple(df.columns)
    ordered = page(df, [name for name in dict.fromkeys(order) if name in df.columns], limit, offset) if limit or offset else df
    return finite_doubles(pick_fields(ordered, fields, columns))


def _equals(view: View, df: DataFrame, /, filters: dict) -> DataFrame:
    unknown = set(filters) - set(view.filters)
    if unknown:
        raise ValueError(f"{view.name} has no filter {', '.join(sorted(unknown))}")
    return catalog_filter(df, **filters)


def _range(view: View, df: DataFrame, /, code="", codes="", trade_date="", start_date="", end_date="", fields="", limit=None, offset=0, **filters) -> DataFrame:
    rows = _equals(view, _entities(view, df, code, codes), filters).where(in_days(view.time, trade_date, start_date, end_date))
    return _finish(view, rows, (view.time, view.key, *view.columns), fields, limit, offset)


def _period(view: View, df: DataFrame, /, code="", codes="", report_period="", start_period="", end_period="", fields="", limit=None, offset=0, **filters) -> DataFrame:
    return _range(view, df, code, codes, report_period, start_period, end_period, fields, limit, offset, **filters)


def _snapshot(view: View, df: DataFrame, /, trade_date, codes="", fields="", limit=None, offset=0, **filters) -> DataFrame:
    if not trade_date:
        raise ValueError("trade_date is required")
    return _range(view, df, "", codes, trade_date, "", "", fields, limit, offset, **filters)


def _single(view: View, df: DataFrame, /, code="", codes="") -> DataFrame:
    return _finish(view, keep_entities(df, view.key, codes_of(code, codes)), (view.key,))


def _catalog(view: View, df: DataFrame, /, codes="", name="", include_delisted=True, limit=None, offset=0, fields="", **filters) -> DataFrame:
    # Accepted for compatibility, without effect.
    for ignored in {"market", "is_hs"} - set(view.filters):
        filters.pop(ignored, None)
    rows = _equals(view, _entities(view, df, "", codes), filters)
    rows = catalog_filter(rows, name, "name", include_delisted)
    return _finish(view, rows, (view.key, *(view.columns or df.columns)), fields, clamp_limit(limit), offset)


def _as_of(view: View, df: DataFrame, /, code="", trade_date="", **filters) -> DataFrame:
    rows = _equals(view, _entities(view, df, code), filters)
    day = parse_day(trade_date)
    return _finish(view, rows if day is None else rows.where(valid_on(F.lit(day))), (view.key,))


def _history(view: View, df: DataFrame, /, code="", trade_date="", start_date="", end_date="", fields="", limit=None, offset=0, **filters) -> DataFrame:
    first, last = (trade_date, trade_date) if trade_date else (start_date, end_date)
    rows = _equals(view, _entities(view, df, code), filters).where(overlaps(first, last))
    return _finish(view, rows, (view.key, "start_date", *view.columns), fields, limit, offset)


def _calendar(view: View, df: DataFrame, /, exchange="", trade_date="", n=1, start_year=None, end_year=None) -> DataFrame:
    rows = df.where(F.col("exchange") == option("exchange", exchange)).select(*view.columns)
    if view.name.endswith("yearly"):
        return rows.where((F.col("trade_date") >= F.make_date(F.lit(start_year), F.lit(1), F.lit(1))) & (F.col("trade_date") <= F.make_date(F.lit(end_year), F.lit(12), F.lit(31))))
    day = F.lit(parse_day(trade_date))
    if view.name.endswith("previous"):
        nearest = rows.where(F.col("is_open") & (F.col("trade_date") < day)).orderBy(F.col("trade_date").desc()).limit(n)
    else:
        nearest = rows.where(F.col("is_open") & (F.col("trade_date") > day)).orderBy("trade_date").limit(n)
    return nearest.orderBy("trade_date")


TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    "range": _range,
    "period": _period,
    "snapshot": _snapshot,
    "single": _single,
    "catalog": _catalog,
    "as_of": _as_of,
    "history": _history,
    "calendar": _calendar,
}


def _stock_quotes(store: MarketStore, view: View, df: DataFrame, /, code="", codes="", **options) -> DataFrame:
    return stock_quote_result(store, code, codes, **options).items


def stock_quote_result(store: MarketStore, code="", codes="", **options):
    """Items, per-code completeness and summary of a stock quote query: daily or longer from daily bars, minutes from
    one-minute bars, ticks from a table of ticks (code, trade_time, ...), which is an error where there is none."""
    request = QuoteRequest(codes=codes_of(code, codes), **options)
    freq = option("freq", request.freq)
    if freq == "tick":
        return tick_quotes(_needed(store, "fact.stock_tick"), request)
    if freq not in DAY_FREQS:
        return minute_quotes(_needed(store, "fact.stock_bar_1m"), store.table("ref.trade_calendar"), request)
    return day_quotes(store.table("fact.stock_daily_1d"), store.table("ref.trade_calendar"), request)


def _needed(store: MarketStore, name: str) -> DataFrame:
    df = store.find(name)
    if df is None:
        raise ValueError(f"the store has no table {name}")
    return df


def stock_minute_quotes(store: MarketStore, code="", codes="", **options) -> DataFrame:
    return stock_quote_result(store, code, codes, **options).items


def _adj_factors(store, view, df, /, code, start_date="", end_date="", base_date="") -> DataFrame:
    """Stored factors; with a base date, relative to the latest factor on or before it."""
    rows = keep_entities(df, "code", codes_of(code))
    wanted = rows.where(in_days("trade_date", "", start_date, end_date)).select(*view.columns)
    if not base_date:
        return wanted
    base = rows.where(F.col("trade_date") <= F.lit(parse_day(base_date))).groupBy("code").agg(F.max_by("adj_factor", "trade_date").alias("_base"))
    return wanted.join(base, "code", "left").withColumn("adj_factor", F.col("adj_factor") / F.nullif(F.col("_base"), F.lit(0.0))).select(*view.columns)


def _technical(store, view, df, /, code="", codes="", trade_date="", start_date="", end_date="", adjust="", fields="", parity_window=False) -> DataFrame:
    """Indicators on the full history, then the window; ``parity_window`` restricts the input to the window first."""
    mode = option("adjust", adjust)
    rows = adjust_prices(_entities(view, df, code, codes), mode)
    window = in_days("trade_date", trade_date, start_date, end_date)
    result = technical(rows.where(window), mode) if parity_window else technical(rows, mode).where(window)
    return pick_fields(result, fields, TECHNICAL_FIELDS)


def _strategy(store, view, df, /, start_date, end_date, codes="") -> DataFrame:
    """Factors need the 39 rows before the window, of any age: looked for in steps, and for the window's codes only."""
    rows = _entities(view, df, "", codes)
    window = rows.where(in_days("trade_date", "", start_date, end_date))
    rows = window.unionByName(rows_before(rows, window, ["code"], parse_day(start_date), 39))
    result = strategy_window(rows).where(in_days("trade_date", "", start_date, end_date))
    return finite_doubles(result.select(*view.columns)).orderBy("trade_date", "code")


def _money_flow_batch(store, view, df, /, codes, trade_date, **filters) -> DataFrame:
    """One row per wanted code with a bar on the day; the net inflow is 0 where the detail is missing."""
    wanted = codes_of("", codes)
    bars = keep_entities(store.table("fact.stock_daily_1d"), "code", wanted).where(in_days("trade_date", trade_date)).select("code", "trade_date").distinct()
    kind = option("view", filters.get("view", ""))
    flows = df.where(in_days("trade_date", trade_date) & (F.col("view") == kind)).drop("view")
    joined = bars.join(flows, ["code", "trade_date"], "left").withColumn("view", F.lit(kind))
    return joined.withColumn("net_inflow", F.coalesce("net_inflow", F.lit(0.0))).select(*view.columns)


def _pit_period(store, view, df, /, report_period) -> DataFrame:
    income = store.table("stocks.finance.pit.income")
    period = in_days("report_period", report_period)
    return pit_merge(df.where(period), income.where(period), ["code", "report_period", "announcement_date"])


def _holder_changes(store, view, df, /, code="", trade_date="", start_date="", end_date="") -> DataFrame:
    rows = _entities(view, df, code).where(in_days("trade_date", trade_date, start_date, end_date)).select("code", "trade_date", "holder_count")
    return count_change(rows, ["code"], "trade_date").select(*view.columns)


def _etf_quotes(store, view, df, /, ts_codes, trade_date="", start_date="", end_date="", limit=None) -> DataFrame:
    return etf_quote_result(store, ts_codes, trade_date, start_date, end_date, limit)[0]


def etf_quote_result(store: MarketStore, ts_codes: str, trade_date="", start_date="", end_date="", limit: int | None = None):
    """(items, per-code completeness, summary); a cut or a missing day makes the result incomplete."""
    wanted = etf_codes_of(ts_codes)
    if not wanted:
        raise ValueError("give at least one ETF code")
    rows = keep_entities(store.table("fact.etf_daily_1d"), "ts_code", wanted).where(in_days("trade_date", trade_date, start_date, end_date))
    first, last = parse_day(trade_date or start_date), parse_day(trade_date or end_date)
    days = open_days(store.table("ref.trade_calendar"), "SSE", None if first is None else F.lit(first), None if last is None else F.lit(last))
    codes = store.spark.createDataFrame([(code,) for code in wanted], "ts_code string")
    items = rows.select(*ETF_BARS)
    cut = page(items, ["trade_date", "ts_code"], limit or None)
    returned = cut.groupBy("ts_code").agg(F.count("*").alias("_returned"))
    meta = completeness(rows, codes, days, "ts_code").join(returned, "ts_code", "left").withColumn(
        "complete", F.col("complete") & (F.coalesce("_returned", F.lit(0)) == F.col("row_count"))
    ).drop("_returned")
    summary = cut_counts(items, limit).withColumn("complete", meta.agg(F.bool_and("complete")).scalar())
    return cut, meta, summary


def _concept_quotes(store, view, df, /, concept_id="", concept_ids="", **options) -> DataFrame:
    request = QuoteRequest(codes=codes_of(concept_id, concept_ids, required=False), **{**options, "fields": ""})
    if option("concept_freq", request.freq) in DAY_FREQS:
        rows = simple_quotes(df, request, "concept_id", view.columns, "concept_freq")
    else:
        rows = minute_quotes(_needed(store, "fact.concept_bar_1m"), store.table("ref.trade_calendar"), request, "concept_id", view.columns).items
    if "concept_name" not in df.columns:  # names come last: a rollup keeps keys and prices only
        rows = _named_concepts(store, rows.drop("concept_name")).orderBy("trade_time", "concept_id")
    return pick_fields(rows if "concept_name" in rows.columns else rows.withColumn("concept_name", F.lit(None).cast("string")), options.get("fields", ""), view.columns)


def _named_concepts(store: MarketStore, df: DataFrame) -> DataFrame:
    names = store.find("ref.concept")
    if names is None or "concept_name" in df.columns:
        return df
    return df.join(names.select("concept_id", F.col("name").alias("concept_name")), "concept_id", "left")


def _concept_snapshot(store, view, df, /, trade_date, fields="", limit=None, offset=0) -> DataFrame:
    rows = _named_concepts(store, df.where(in_days("trade_date", trade_date)))
    quotes = simple_quotes(rows, QuoteRequest(codes=()), "concept_id", view.columns, "concept_freq")
    return pick_fields(page(quotes, ["trade_time", "concept_id"], limit, offset), fields, view.columns)


def _member_history(store, view, df, /, code="", start_date="", end_date="") -> DataFrame:
    return _entities(view, df, code).where(overlaps(start_date, end_date, "valid_from", "valid_to"))


def _index_quotes(store, view, df, /, index_code="", index_codes="", **options) -> DataFrame:
    return simple_quotes(df, QuoteRequest(codes=codes_of(index_code, index_codes), **options), "index_code", view.columns, "index_freq")


def _news(store, view, df, /, include_sources=False, **options) -> DataFrame:
    return news_events(df, sources=store.table("fact.news_event_source") if include_sources else None, **options)


DERIVED: dict[str, Callable[..., DataFrame]] = {
    "stock_quotes": _stock_quotes,
    "daily_snapshot": lambda store, view, df, /, **options: daily_snapshot(df, **options),
    "local_window": lambda store, view, df, /, **options: local_window(df, **options),
    "adj_factors": _adj_factors,
    "technical": _technical,
    "strategy_window": _strategy,
    "money_flow_batch": _money_flow_batch,
    "pit_period": _pit_period,
    "holder_changes": _holder_changes,
    "etf_quotes": _etf_quotes,
    "concept_quotes": _concept_quotes,
    "concept_snapshot": _concept_snapshot,
    "member_history": _member_history,
    "index_quotes": _index_quotes,
    "news": _news,
}
