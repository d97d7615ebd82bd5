"""Oracle SQL of the view, news, quality and streaming queries."""

from __future__ import annotations

from tapeloom.plans.oracle_tables import with_tables as using
from tapeloom.plans.series_oracles import _FACTOR, _STRATEGY, _gated, _money, _rsi, _sma

ORACLES: dict[str, str] = {}

_QUOTE_BARS = f"""
quote_bars AS (SELECT *, (low + high) / 2 AS open, CAST(volume AS BIGINT) % 31 = 0 AS is_suspended,
  code = 'Brand#4' AND YEAR(trade_date) = 1998 AND CAST(volume AS BIGINT) % 2 = 0 AS is_st, {_FACTOR} AS adj_factor FROM bars_sparse)"""
_FLOWS = f"""
flows AS (SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS trade_date, 'main' AS view, {_money("CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END")} AS main_inflow,
  {_money("CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END")} AS main_outflow FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY 1, 2),
money AS (SELECT *, main_inflow - main_outflow AS net_inflow FROM flows)"""
_WINDOW = "trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'"
_CODES = "code IN ('Brand#1', 'Brand#2', 'Brand#4', 'Brand#5', 'Brand#99')"

ORACLES["t1_range_view"] = f"WITH {_FLOWS} SELECT * FROM money WHERE code = 'Brand#7' AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'"
ORACLES["t1p_period_view"] = f"""
WITH s AS (SELECT o_custkey, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) AS report_period, {_money('o_totalprice')} AS holding_volume FROM orders GROUP BY 1, 2),
r AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, report_period, ROW_NUMBER() OVER (PARTITION BY c_nationkey, report_period ORDER BY holding_volume DESC, o_custkey) AS rank, c_name AS shareholder_name, holding_volume
      FROM s JOIN customer ON c_custkey = o_custkey)
SELECT code, report_period, CAST(rank AS INT) AS rank, shareholder_name, holding_volume FROM r WHERE rank <= 10 AND code IN ('3', '7') AND report_period BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"""
ORACLES["t2_snapshot_view"] = f"WITH {_FLOWS} SELECT * FROM money WHERE trade_date = DATE '1997-03-05'"
ORACLES["t2_batch_view"] = using("bars_sparse", f"""
WITH {_FLOWS} SELECT b.code, b.trade_date, 'main' AS view, m.main_inflow, m.main_outflow, COALESCE(m.net_inflow, 0.0) AS net_inflow
FROM bars_sparse b LEFT JOIN money m ON m.code = b.code AND m.trade_date = b.trade_date
WHERE b.trade_date = DATE '2001-03-05' AND b.code IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#99')""")
_CATALOG = """
catalog AS (SELECT code, p_brand || ' ' || p_type AS name, CASE market WHEN 'SHSE' THEN 'SSE' WHEN 'SZSE' THEN 'SZSE' ELSE 'BSE' END AS exchange,
  CASE WHEN delisted_date IS NULL THEN 'L' ELSE 'D' END AS list_status, listed_date AS list_date, delisted_date AS delist_date FROM stock_ref)"""
ORACLES["t3_single_view"] = using("stock_ref", f"WITH {_CATALOG} SELECT * FROM catalog WHERE code = '600003'")
ORACLES["t4_catalog_view"] = using("stock_ref", f"""
WITH {_CATALOG} SELECT code, name, exchange, list_status, list_date FROM catalog WHERE name LIKE '%MEDIUM%' AND exchange = 'SSE' AND delist_date IS NULL ORDER BY code LIMIT 20 OFFSET 1""")
ORACLES["t4_catalog_counts"] = using("stock_ref", f"""
WITH {_CATALOG} SELECT COUNT(*) AS total_rows, LEAST(COUNT(*), 7) AS returned_rows, COUNT(*) > 7 AS truncated FROM catalog WHERE exchange = 'SZSE'""")
ORACLES["t4_catalog_all"] = using("stock_ref", f"WITH {_CATALOG} SELECT code, name, exchange, list_status, list_date FROM catalog")
ORACLES["t5_members_as_of"] = using("membership", """
SELECT concept_id, stock_market, stock_code, valid_from FROM membership WHERE concept_id = 'PROMO' AND valid_from <= DATE '2001-02-01' AND (valid_to IS NULL OR valid_to >= DATE '2001-02-01')""")
ORACLES["t6_member_history"] = using("membership", "SELECT * FROM membership WHERE concept_id = 'SMALL' AND valid_from <= DATE '2001-12-31' AND (valid_to IS NULL OR valid_to >= DATE '2001-01-01')")
ORACLES["t7_previous_days"] = using("calendar", "SELECT * FROM calendar WHERE trade_date < DATE '1998-06-15' ORDER BY trade_date DESC LIMIT 7")
ORACLES["t7_next_days"] = using("calendar", "SELECT * FROM calendar WHERE trade_date > DATE '1998-06-15' ORDER BY trade_date LIMIT 7")
ORACLES["t7_yearly"] = using("calendar", "SELECT * FROM calendar WHERE YEAR(trade_date) BETWEEN 1997 AND 1998")
ORACLES["t7_range"] = using("calendar", "SELECT * FROM calendar WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' AND is_open")

_KEPT = f"""
req AS (SELECT * FROM quote_bars WHERE {_CODES} AND {_WINDOW}),
kept AS (SELECT * FROM (SELECT *, LAG(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre_close FROM quote_bars WHERE NOT is_suspended) WHERE {_CODES} AND {_WINDOW} AND code NOT IN (SELECT code FROM req WHERE is_st))"""
ORACLES["t8_quotes"] = using("bars_sparse", f"""
WITH {_QUOTE_BARS}, {_KEPT}
SELECT code, trade_date AS trade_time, '1d' AS freq, open, close, pre_close, (close - pre_close) / NULLIF(pre_close, 0) * 100 AS pct_chg, 'none' AS adjust, is_st FROM kept""")
_META = f"""
days AS (SELECT trade_date FROM calendar WHERE {_WINDOW}), codes AS (SELECT UNNEST(['Brand#1', 'Brand#2', 'Brand#4', 'Brand#5', 'Brand#99']) AS code),
grid AS (SELECT c.code, d.trade_date, r.close FROM codes c CROSS JOIN days d LEFT JOIN req r ON r.code = c.code AND r.trade_date = d.trade_date),
cover AS (SELECT code, COUNT(*) AS expected_bar_count, COUNT(close) AS actual_bar_count, COUNT(*) - COUNT(close) AS missing_count,
  COALESCE(STRING_AGG(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date) FILTER (WHERE close IS NULL), '') AS missing_trade_dates FROM grid GROUP BY 1),
cut AS (SELECT * FROM kept ORDER BY trade_date, code LIMIT 60),
own AS (SELECT c.code, (SELECT COUNT(*) FROM kept k WHERE k.code = c.code) AS available, (SELECT COUNT(*) FROM cut k WHERE k.code = c.code) AS row_count,
  (SELECT MIN(trade_date) FROM cut k WHERE k.code = c.code) AS first_trade_time, (SELECT MAX(trade_date) FROM cut k WHERE k.code = c.code) AS last_trade_time FROM codes c),
meta AS (SELECT code, row_count, expected_bar_count, actual_bar_count, missing_count, missing_trade_dates, first_trade_time, last_trade_time, row_count < available AS truncated,
  missing_count = 0 AND row_count = available AND available > 0 AS complete FROM own JOIN cover USING (code))"""
ORACLES["t8_quotes_meta"] = using("calendar bars_sparse", f"WITH {_QUOTE_BARS}, {_KEPT}, {_META} SELECT * FROM meta")
ORACLES["t8_quotes_summary"] = using("calendar bars_sparse", f"""
WITH {_QUOTE_BARS}, {_KEPT}, {_META}
SELECT (SELECT COUNT(*) FROM kept) AS total_rows, LEAST(60, (SELECT COUNT(*) FROM kept)) AS returned_rows, (SELECT COUNT(*) FROM kept) > 60 AS truncated, (SELECT BOOL_AND(complete) FROM meta) AS complete""")
ORACLES["t8_quotes_filled"] = using("calendar bars_sparse", f"""
WITH {_QUOTE_BARS}, days AS (SELECT trade_date FROM calendar WHERE {_WINDOW}), req AS (SELECT * FROM quote_bars WHERE {_CODES} AND {_WINDOW}),
gaps AS (SELECT c.code, trade_date FROM (SELECT DISTINCT code FROM req) c CROSS JOIN days ANTI JOIN req USING (code, trade_date))
SELECT code, trade_date AS trade_time, close, volume, is_suspended FROM req
UNION ALL SELECT g.code, g.trade_date, r.close, 0, TRUE FROM gaps g ASOF JOIN req r ON r.code = g.code AND r.trade_date < g.trade_date""")
ORACLES["t8_quotes_weekly"] = using("bars_sparse", f"""
WITH {_QUOTE_BARS},
q AS (SELECT b.code, b.trade_date, b.is_suspended, b.high * b.adj_factor / f.base AS high, b.close * b.adj_factor / f.base AS close
      FROM quote_bars b JOIN (SELECT code, ARG_MAX(adj_factor, trade_date) AS base FROM quote_bars GROUP BY 1) f USING (code) WHERE {_CODES} AND {_WINDOW}),
w AS (SELECT code, MAX(trade_date) AS trade_time, MAX(high) AS high, ARG_MAX(close, trade_date) AS close FROM q WHERE NOT is_suspended GROUP BY code, DATE_TRUNC('week', trade_date)),
p AS (SELECT *, LAG(close) OVER (PARTITION BY code ORDER BY trade_time) AS pre_close FROM w)
SELECT code, trade_time, '1w' AS freq, high, close, pre_close, 'qfq' AS adjust FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY code ORDER BY trade_time DESC) <= 5""")
ORACLES["t8_quotes_minutes"] = using("bars_minute", """
WITH m AS (SELECT *, HOUR(bar_time) * 60 + MINUTE(bar_time) AS t FROM bars_minute WHERE code IN ('click', 'view') AND bar_time >= TIMESTAMP '2024-01-05' AND bar_time < TIMESTAMP '2024-01-10'),
s AS (SELECT *, CASE WHEN t BETWEEN 571 AND 690 THEN 570 WHEN t BETWEEN 781 AND 900 THEN 780 END AS a FROM m),
b AS (SELECT code, DATE_TRUNC('day', bar_time) + TO_MINUTES(CAST(a + CEIL((t - a) / 15.0) * 15 AS INT)) AS trade_time, ARG_MIN(open, bar_time) AS open, MAX(high) AS high, MIN(low) AS low, ARG_MAX(close, bar_time) AS close
      FROM s WHERE a IS NOT NULL GROUP BY ALL)
SELECT code, trade_time, '15m' AS freq, open, high, low, close FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY code ORDER BY trade_time DESC) <= 20""")
_FIVE = """
m AS (SELECT *, HOUR(bar_time) * 60 + MINUTE(bar_time) AS t FROM bars_minute WHERE code IN ('click', 'view') AND bar_time >= TIMESTAMP '2024-01-05' AND bar_time < TIMESTAMP '2024-01-08'),
five AS (SELECT code, DATE_TRUNC('day', bar_time) + TO_MINUTES(CAST((t + 4) // 5 * 5 AS INT)) AS trade_time, ARG_MIN(open, bar_time) AS open, MAX(high) AS high, MIN(low) AS low, ARG_MAX(close, bar_time) AS close, SUM(volume)::DOUBLE AS volume
  FROM m WHERE t BETWEEN 571 AND 690 OR t BETWEEN 781 AND 900 GROUP BY ALL)"""
ORACLES["t8_quotes_5m"] = using("bars_minute", f"WITH {_FIVE} SELECT code, trade_time, '5m' AS freq, open, high, low, close, volume FROM five")
ORACLES["t8_quotes_5m_meta"] = using("calendar bars_minute", f"""
WITH {_FIVE}, slots AS (SELECT d.trade_date + TO_MINUTES(CAST(s.at AS INT)) AS trade_time
  FROM (SELECT UNNEST([DATE '2024-01-05', DATE '2024-01-06', DATE '2024-01-07']) AS trade_date) d, (SELECT 570 + 5 * k AS at FROM RANGE(1, 25) x(k) UNION ALL SELECT 780 + 5 * k FROM RANGE(1, 25) x(k)) s)
SELECT w.code, COUNT(*) AS expected_bar_count, COUNT(f.code) AS actual_bar_count, COUNT(*) - COUNT(f.code) AS missing_count, COUNT(*) = COUNT(f.code) AND COUNT(*) > 0 AS complete,
  COALESCE(STRING_AGG(STRFTIME(s.trade_time, '%d %H:%M'), ',' ORDER BY s.trade_time) FILTER (WHERE f.code IS NULL), '') AS missing_trade_times
FROM (SELECT UNNEST(['click', 'view']) AS code) w CROSS JOIN slots s LEFT JOIN five f ON f.code = w.code AND f.trade_time = s.trade_time GROUP BY 1""")
ORACLES["t8_quotes_adjusted_change"] = using("bars_sparse", f"""
WITH {_QUOTE_BARS}, c AS (SELECT *, LAG(close) OVER w AS pre, LAG(adj_factor) OVER w AS pre_factor, LAST_VALUE(adj_factor) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM quote_bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
a AS (SELECT *, close * adj_factor / base AS own, pre * COALESCE(pre_factor, adj_factor) / base AS before FROM c WHERE {_CODES} AND {_WINDOW} AND NOT is_suspended)
SELECT code, trade_date AS trade_time, ROUND(own, 6) AS close, ROUND(before, 6) AS pre_close, ROUND(own - before, 6) AS change, ROUND((own - before) / NULLIF(before, 0) * 100, 6) AS pct_chg FROM a""")
ORACLES["t8_concept_weekly"] = using("type_bars", """
WITH w AS (SELECT code, DATE_TRUNC('week', trade_date) AS week, MAX(trade_date) AS trade_time, ARG_MAX(close, trade_date) AS close FROM type_bars WHERE code IN ('PROMO', 'SMALL') AND YEAR(trade_date) = 1999 GROUP BY 1, 2)
SELECT code AS concept_id, LOWER(code) AS concept_name, trade_time, '1w' AS freq, close, LAG(close) OVER (PARTITION BY code ORDER BY week) AS pre_close FROM w""")
ORACLES["t8_concept_quotes"] = using("type_bars", """
SELECT code AS concept_id, LOWER(code) AS concept_name, trade_date AS trade_time, close, pre_close, amount FROM type_bars WHERE code IN ('PROMO', 'SMALL') AND trade_date BETWEEN DATE '1999-01-01' AND DATE '1999-02-28'""")
ORACLES["t8_index_quotes"] = using("type_bars", """
SELECT code AS index_code, MAX(trade_date) AS trade_time, '1mo' AS freq, ARG_MIN(open, trade_date) AS open, MAX(high) AS high, MIN(low) AS low, ARG_MAX(close, trade_date) AS close
FROM type_bars WHERE code = 'PROMO' GROUP BY code, DATE_TRUNC('month', trade_date)""")
ORACLES["e03_daily_snapshot"] = using("bars_sparse", f"""
WITH {_QUOTE_BARS}, p AS (SELECT *, LAG(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre_close FROM quote_bars)
SELECT code, trade_date AS trade_time, '1d' AS freq, open, close, pre_close, close - pre_close AS change, (close - pre_close) / NULLIF(pre_close, 0) * 100 AS pct_chg, is_st
FROM p WHERE trade_date = DATE '1998-03-04' AND NOT is_suspended""")
ORACLES["e04_local_window"] = using("bars_sparse", f"""
WITH {_QUOTE_BARS}, w AS (SELECT * FROM quote_bars WHERE trade_date BETWEEN DATE '1998-02-01' AND DATE '1998-04-30')
SELECT code, trade_date AS trade_time, close, volume, is_suspended FROM w WHERE NOT is_suspended AND code NOT IN (SELECT code FROM w WHERE is_st) ORDER BY trade_date, code LIMIT 700 OFFSET 100""")
ORACLES["e15_adj_factors"] = using("bars_sparse", f"""
WITH {_QUOTE_BARS}
SELECT code, trade_date, adj_factor / (SELECT ARG_MAX(adj_factor, trade_date) FROM quote_bars WHERE code = 'Brand#3' AND trade_date <= DATE '1998-06-30') AS adj_factor
FROM quote_bars WHERE code = 'Brand#3' AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
ORACLES["e16_technical_window"] = using("bars_sparse", f"""
WITH {_QUOTE_BARS}, w AS (SELECT * FROM quote_bars WHERE code IN ('Brand#1', 'Brand#2') AND NOT is_suspended AND YEAR(trade_date) = 1998),
d AS (SELECT *, close - LAG(close) OVER (PARTITION BY code ORDER BY trade_date) AS diff FROM w),
g AS (SELECT *, GREATEST(diff, 0) + 0 * diff AS gain, GREATEST(-diff, 0) + 0 * diff AS loss FROM d)
SELECT code, trade_date, {_sma(5)}, {_sma(60)}, {_rsi(6)}, ROUND({_gated('AVG', 'close', 20)}, 4) AS boll_mid FROM g""")
ORACLES["e17_strategy_window"] = using("bars_sparse", f"""
WITH {_STRATEGY}
SELECT trade_date, code, active_buy_amount_proportion_all, price_band_state, mean_volume_5d_shares, ma10, ma20, ma40 FROM factors WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'""")
ORACLES["e34_pit_period"] = using("reports_f reports_p", """
SELECT code, report_period, announcement_date, f.value AS profit, COALESCE(f.order_count, p.order_count) AS order_count, p.value AS revenue
FROM (SELECT * FROM reports_f WHERE report_period = DATE '1998-04-01') f
FULL OUTER JOIN (SELECT * FROM reports_p WHERE report_period = DATE '1998-04-01') p USING (code, report_period, announcement_date)""")
ORACLES["e51_holder_changes"] = using("holder_counts", """
WITH w AS (SELECT CAST(code AS VARCHAR) AS code, trade_date, holder_count, LAG(holder_count) OVER (ORDER BY trade_date) AS pre FROM holder_counts WHERE code = 7 AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')
SELECT code, trade_date, holder_count, holder_count - pre AS change_count, ROUND((holder_count - pre) / NULLIF(pre, 0)::DOUBLE * 100, 4) AS change_pct FROM w""")
_ETF = """
etf AS (SELECT '5100' || LPAD(SPLIT_PART(code, '#', 2), 2, '0') || '.SH' AS ts_code, trade_date, (low + high) / 2 AS open, close, volume FROM bars_sparse),
req AS (SELECT * FROM etf WHERE ts_code IN ('510003.SH', '510007.SH', '510099.SH') AND trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-02-28')"""
ORACLES["e60_etf_quotes"] = using("bars_sparse", f"WITH {_ETF} SELECT ts_code, trade_date, open, close, volume FROM req ORDER BY trade_date, ts_code LIMIT 70")
ORACLES["e60_etf_completeness"] = using("calendar bars_sparse", f"""
WITH {_ETF}, days AS (SELECT trade_date FROM calendar WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-02-28'), codes AS (SELECT UNNEST(['510003.SH', '510007.SH', '510099.SH']) AS ts_code),
grid AS (SELECT c.ts_code, d.trade_date, r.close FROM codes c CROSS JOIN days d LEFT JOIN req r ON r.ts_code = c.ts_code AND r.trade_date = d.trade_date),
cut AS (SELECT * FROM req ORDER BY trade_date, ts_code LIMIT 70)
SELECT g.ts_code, COUNT(*) AS expected_bar_count, COUNT(close) AS actual_bar_count, COUNT(*) - COUNT(close) AS missing_count,
  COUNT(*) = COUNT(close) AND (SELECT COUNT(*) FROM cut WHERE cut.ts_code = g.ts_code) = (SELECT COUNT(*) FROM req WHERE req.ts_code = g.ts_code) AS complete,
  COALESCE(STRING_AGG(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date) FILTER (WHERE close IS NULL), '') AS missing_trade_dates FROM grid g GROUP BY g.ts_code""")
ORACLES["e62_concept_snapshot"] = using("type_bars", "SELECT code AS concept_id, LOWER(code) AS concept_name, close, pct_chg, amount FROM type_bars WHERE trade_date = DATE '1999-02-03'")
_NEWS = """
n AS (SELECT event_id, trade_date, announcement_time, announcement_time + TO_MINUTES(CAST(event_id % 121 - 60 AS INT)) AS crawl_time, event_type, importance_score, stock_code FROM news)"""
ORACLES["n1_news"] = using("news", f"""
WITH {_NEWS} SELECT event_id, event_type, announcement_time, crawl_time, importance_score, stock_code || ',' || (stock_code + 1) AS related FROM n
WHERE trade_date = DATE '2024-01-05' AND stock_code IN (7, 8) AND importance_score >= 1 ORDER BY crawl_time DESC, importance_score DESC, event_id DESC LIMIT 30""")
ORACLES["n1_news_counts"] = using("news", """
SELECT COUNT(*) AS total_rows, LEAST(COUNT(*), 25) AS returned_rows, COUNT(*) > 25 AS truncated FROM news WHERE trade_date = DATE '2024-01-05' AND event_type = 'click'""")
ORACLES["n1_news_filtered"] = using("news", f"""
WITH {_NEWS} SELECT event_id, event_type, announcement_time, importance_score FROM n WHERE trade_date = DATE '2024-01-10' AND CAST(announcement_time AS DATE) = DATE '2024-01-10'
 AND CAST(crawl_time AS DATE) = DATE '2024-01-10' AND event_type = 'click' ORDER BY announcement_time DESC, importance_score DESC, event_id DESC LIMIT 40 OFFSET 5""")


# -- checks --
def _verdict(check_id: str, title: str, error: str, healthy: str = "正常", status: str = "unhealthy") -> str:
    """Check row of a one-row relation with the number of faults n."""
    label = {"unhealthy": "异常", "warning": "警告"}[status]
    return f"""'{check_id}' AS check_id, '{title}' AS title, CASE WHEN n > 0 THEN '{status}' ELSE 'healthy' END AS status,
  CASE WHEN n > 0 THEN '{label}' ELSE '{healthy}' END AS result_text, CASE WHEN n > 0 THEN {error} ELSE '' END AS error_text"""


_RECENT = "trade_date >= DATE '2000-07-01' - 90 AND trade_date < DATE '2000-07-01'"
ORACLES["c05_non_empty"] = using("bars_sparse", f"""
SELECT {_verdict('table_non_empty:fact.bars', '依赖表 fact.bars 非空', "'表为空'", status='warning')} FROM (SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS n FROM bars_sparse)
UNION ALL SELECT {_verdict('table_non_empty:fact.empty', '依赖表 fact.empty 非空', "'表为空'", status='warning')} FROM (SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS n FROM bars_sparse WHERE close < 0)""")
ORACLES["c06_calendar"] = using("calendar", f"SELECT {_verdict('trade_calendar_available', '交易日历可用', chr(39) + 'none' + chr(39))} FROM (SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS n FROM calendar WHERE {_RECENT})")
ORACLES["c07_closed_days"] = using("calendar bars_sparse", f"""
SELECT {_verdict('non_trading_day_empty_result', '非交易日空结果', "'非交易日存在数据: ' || n || ' 天'", '健康')}
FROM (SELECT COUNT(DISTINCT trade_date) AS n FROM bars_sparse WHERE {_RECENT} AND trade_date NOT IN (SELECT trade_date FROM calendar))""")
ORACLES["c08_open_days"] = using("calendar bars_sparse", f"""
SELECT {_verdict('trade_day_missing_data_unhealthy', '交易日缺失异常', "'交易日缺失数据: ' || n || ' 天'")}
FROM (SELECT COUNT(*) AS n FROM calendar WHERE {_RECENT} AND trade_date NOT IN (SELECT trade_date FROM bars_sparse WHERE code = 'Brand#9'))""")
ORACLES["c09_reference"] = using("stock_daily", f"""
SELECT {_verdict('stock_reference_valid', 'stock 引用有效', "'引用缺失: ' || n || ' 个'", '有效')}
FROM (SELECT COUNT(*) AS n FROM (SELECT DISTINCT market, code FROM stock_daily) s WHERE NOT EXISTS (SELECT 1 FROM stock_ref r WHERE r.p_type <> 'SMALL' AND r.market = s.market AND r.code = s.code))""")
_DUPLICATES = "(SELECT COUNT(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1))"
ORACLES["c10_capability_key"] = f"SELECT {_verdict('capability_key_unique_rule', '同一 l_orderkey/l_linenumber 唯一', chr(39) + '存在主键重复记录' + chr(39))} FROM {_DUPLICATES}"
ORACLES["c11_primary_key"] = using("bars_sparse", f"""
SELECT {_verdict('primary_key_duplicate_absent:fact.lines', 'fact.lines 主键重复', "'存在主键重复记录'", '无')} FROM {_DUPLICATES}
UNION ALL SELECT {_verdict('primary_key_duplicate_absent:fact.bars', 'fact.bars 主键重复', "'存在主键重复记录'", '无')} FROM (SELECT COUNT(*) - COUNT(DISTINCT (code, trade_date)) AS n FROM bars_sparse)""")


def _count_check(check_id: str, title: str, text: str, condition: str) -> str:
    return f"SELECT {_verdict(check_id, title, chr(39) + text + ': ' + chr(39) + ' || n || ' + chr(39) + ' 条' + chr(39))} FROM (SELECT COUNT(*) AS n FROM faulty_bars WHERE {_RECENT} AND ({condition}))"


ORACLES["c12_fixed_field"] = using("faulty_bars", _count_check("freq_valid", "freq_valid 固定为 1d", "freq 不为 1d", "freq IS DISTINCT FROM '1d'"))
_OHLC_CHECK = _count_check("ohlc_valid:fact.bars", "fact.bars OHLC 合法", "OHLC 关系异常", "low > high OR open < low OR open > high OR close < low OR close > high")
_SIGN_CHECKS = " UNION ALL ".join(_count_check(f"non_negative:fact.bars:{c}", f"fact.bars {c} 数值合法", f"{c} 出现负数", f"{c} < 0") for c in ("volume", "amount"))
ORACLES["c13_ohlc"] = using("faulty_bars", _OHLC_CHECK)
ORACLES["c14_non_negative"] = using("faulty_bars", _SIGN_CHECKS)
ORACLES["c15_finite"] = using("faulty_bars", _count_check("money_flow_values_valid", "inflow/outflow/net_inflow 数值合法", "资金流字段出现非法数值", "inflow IS NULL OR NOT ISFINITE(inflow)"))


def _coverage(check_id: str, title: str, earliest: str, condition: str) -> str:
    since = f"trade_date >= GREATEST(DATE '2000-07-01' - 90, DATE '{earliest}') AND trade_date < DATE '2000-07-01'"
    text = f"'provider 起点 {earliest} 后的最近窗口"
    return f"""SELECT '{check_id}' AS check_id, '{title}' AS title, CASE WHEN a = 0 THEN 'unhealthy' WHEN a < e THEN 'warning' ELSE 'healthy' END AS status, CASE WHEN a = 0 THEN '异常' WHEN a < e THEN '警告' ELSE '正常' END AS result_text,
  CASE WHEN a = 0 THEN {text}没有本地覆盖数据' WHEN a < e THEN {text}覆盖 ' || a || '/' || e || ' 个交易日' ELSE '' END AS error_text
FROM (SELECT (SELECT COUNT(*) FROM calendar WHERE {since}) AS e, (SELECT COUNT(DISTINCT trade_date) FROM bars_sparse WHERE {since} AND {condition} AND trade_date IN (SELECT trade_date FROM calendar)) AS a)"""


ORACLES["c16_coverage"] = using("calendar bars_sparse", _coverage("thin_coverage", "fact.thin 最近 90 天覆盖", "2000-05-01", "code = 'Brand#9'") + " UNION ALL " + _coverage("recent_coverage_90d:fact.bars", "fact.bars 最近 90 天覆盖", "1995-01-01", "true"))
ORACLES["c18_continuity"] = using("calendar", f"""
WITH d AS (SELECT CAST(UNNEST(RANGE(DATE '2000-07-01' - 90, DATE '2000-07-01', INTERVAL 1 DAY)) AS DATE) AS day), m AS (SELECT day FROM d WHERE day NOT IN (SELECT trade_date FROM calendar)),
i AS (SELECT day, day - CAST(ROW_NUMBER() OVER (ORDER BY day) AS INT) AS island FROM m)
SELECT {_verdict('calendar_continuity_90d', '交易日历最近 90 天连续覆盖', "'缺少 ' || n || ' 天，' || r || ' 段'")} FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT island) AS r FROM i)""")
ORACLES["c19_long_empty"] = using("bars_sparse stock_daily", f"""
WITH s AS (SELECT 'fact.bars' AS name, MAX(trade_date) AS d FROM bars_sparse UNION ALL SELECT 'fact.stocks', MAX(trade_date) FROM stock_daily)
SELECT {_verdict('idle', '长期无数据检查', "'长期无数据: ' || names")} FROM (SELECT COUNT(*) AS n, STRING_AGG(name, ', ' ORDER BY name) AS names FROM s WHERE DATE '2000-07-01' - d > 30)""")

_SESSION = """
days AS (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events),
perminute AS (SELECT bar_time, CAST(bar_time AS DATE) AS trade_date, COUNT(*) AS n FROM bars_minute
  WHERE HOUR(bar_time) * 60 + MINUTE(bar_time) BETWEEN 571 AND 690 OR HOUR(bar_time) * 60 + MINUTE(bar_time) BETWEEN 781 AND 900 GROUP BY 1, 2),
perday AS (SELECT d.trade_date, COUNT(m.n) AS minute_count, COALESCE(CAST(SUM(m.n) AS BIGINT), 0) AS total_rows, COALESCE(STRFTIME(MIN(bar_time), '%H:%M'), '') AS first_minute, COALESCE(STRFTIME(MAX(bar_time), '%H:%M'), '') AS last_minute,
  COALESCE(MIN(m.n), 0) AS min_rows_per_minute, COALESCE(MAX(m.n), 0) AS max_rows_per_minute FROM days d LEFT JOIN perminute m USING (trade_date) GROUP BY 1),
texts AS (SELECT *, CONCAT_WS('，', CASE WHEN minute_count < 240 THEN '分钟数 ' || minute_count || '/240' END,
    CASE WHEN first_minute <> '09:31' OR last_minute <> '15:00' THEN '首尾分钟 ' || first_minute || '-' || last_minute END,
    CASE WHEN max_rows_per_minute > 0 AND min_rows_per_minute < FLOOR(max_rows_per_minute * 0.95) THEN '每分钟股票数 ' || min_rows_per_minute || '-' || max_rows_per_minute END) AS parts FROM perday),
issues AS (SELECT * EXCLUDE (parts), CASE WHEN minute_count = 0 THEN trade_date || ' 无 1m 数据' WHEN parts <> '' THEN trade_date || ' ' || parts ELSE '' END AS issue FROM texts)"""
ORACLES["c17_session_days"] = using("bars_minute", f"WITH {_SESSION} SELECT * FROM issues")
ORACLES["c17_minute_session"] = using("bars_minute", f"""
WITH {_SESSION}, w AS (SELECT issue FROM issues WHERE trade_date >= DATE '2024-01-21' AND issue <> '')
SELECT 'recent_minute_session_complete:fact.stock_bar_1m' AS check_id, 'fact.stock_bar_1m 最近交易日分钟完整性' AS title, 'warning' AS status, '警告' AS result_text, STRING_AGG(issue, '；' ORDER BY issue DESC) AS error_text FROM w""")

# -- contract --
# Fixture tables as the query seeds them, then one grouped row of metrics per table.
_LIVE = "NOT is_suspended AND NOT is_st"
_PRICED = f"{_LIVE} AND pct_chg IS NOT NULL AND amount > 0"


def _holes(*columns: str) -> str:
    """A row lacks one of the columns."""
    return f"({' OR '.join(f'{c} IS NULL' for c in columns)})"


_CONTRACT = f"""
stock AS (SELECT * FROM stock_changes UNION ALL BY NAME SELECT * FROM stock_changes WHERE is_st AND trade_date = DATE '1996-01-01'),
sums AS (
  SELECT concept_id, trade_date, SUM(CAST(amount AS DECIMAL(18,2))) FILTER ({_LIVE}) AS total, SUM(pct_chg * amount) FILTER ({_PRICED}) / NULLIF(SUM(amount) FILTER ({_PRICED}), 0) AS weighted
  FROM membership JOIN stock_changes ON market = stock_market AND code = stock_code AND trade_date >= valid_from AND trade_date <= COALESCE(valid_to, trade_date) GROUP BY ALL),
concept AS (
  SELECT concept_id, trade_date, CAST(total AS DOUBLE) + IF(concept_id = 'PROMO', 100.0, 0.0) AS amount,
    IF(concept_id = 'ECONOMY' AND MONTH(trade_date) = 11, NULL, weighted + IF(concept_id = 'SMALL', 0.5, 0)) AS pct_chg FROM sums),
ref_stock AS (SELECT * FROM stock_ref WHERE code <> '000007'),
ref_index AS (SELECT p_type AS index_code, MIN(IF(p_type = 'PROMO', 'PR?MO', p_type)) AS index_name FROM part WHERE p_type <> 'LARGE' GROUP BY p_type),
day AS (
  SELECT MIN(newest) AS d FROM (
    SELECT MAX(trade_date) AS newest FROM stock UNION ALL SELECT MAX(trade_date) FROM concept
    UNION ALL SELECT MAX(trade_date) FROM brand_bars UNION ALL SELECT MAX(trade_date) FROM type_bars WHERE code = 'PROMO')),
-- every key of every fact once: copies and newest day by fact
keys AS (
  SELECT fact, COUNT(*) FILTER (n > 1) AS twice, MAX(trade_date) FILTER (trade_date <= d) AS newest
  FROM (SELECT 'concept' AS fact, concept_id AS k, trade_date, COUNT(*) AS n FROM concept GROUP BY ALL
    UNION ALL SELECT 'stock', market || code, trade_date, COUNT(*) FROM stock GROUP BY ALL
    UNION ALL SELECT 'board', board_code, trade_date, COUNT(*) FROM brand_bars GROUP BY ALL
    UNION ALL SELECT 'index', code, trade_date, COUNT(*) FROM type_bars GROUP BY ALL), day GROUP BY fact),
of_keys AS (
  SELECT SUM(twice) FILTER (fact = 'concept') AS global_duplicate_concept_key_count, SUM(twice) FILTER (fact = 'stock') AS global_duplicate_stock_key_count,
    SUM(twice) FILTER (fact = 'board') AS global_duplicate_board_key_count, SUM(twice) FILTER (fact = 'index') AS global_duplicate_index_key_count,
    IF(MIN(newest) = MAX(newest) AND COUNT(newest) = 4, 0, 1) AS global_latest_date_mismatch_count FROM keys),
of_index AS (
  SELECT COUNT(*) FILTER (age <= 6) AS first_stage_index_trade_date_count,
    COUNT(*) FILTER (age <= 6 AND {_holes('open', 'high', 'low', 'close', 'pre_close', 'volume', 'amount', 'pct_chg')}) AS first_stage_index_core_null_count,
    COUNT(*) FILTER (age <= 6 AND LEAST(volume, amount) <= 0) AS first_stage_index_invalid_volume_amount_count,
    COUNT(*) FILTER (trade_date = d AND code NOT IN (SELECT index_code FROM ref_index)) AS global_index_daily_without_ref_count
  FROM (SELECT *, IF(code = 'PROMO' AND trade_date <= d, ROW_NUMBER() OVER (PARTITION BY code, trade_date <= d ORDER BY trade_date DESC), NULL) AS age FROM type_bars, day)),
of_index_names AS (
  SELECT IF(BOOL_OR(index_code = 'PROMO'), 0, 1) AS first_stage_ref_index_missing_count, COUNT(*) FILTER (bad AND index_code = 'PROMO') AS first_stage_ref_index_bad_name_count,
    COUNT(*) FILTER (bad) AS global_ref_index_bad_name_count FROM (SELECT index_code, COALESCE(index_name, '') = '' OR CONTAINS(index_name, '?') AS bad FROM ref_index)),
of_board AS (
  SELECT COUNT(*) FILTER ({_holes('open', 'high', 'low', 'close', 'pre_close', 'change', 'pct_chg', 'amount', 'volume')}) AS global_board_daily_core_null_count FROM brand_bars, day WHERE trade_date = d),
-- each stock's bar of the day and the newest close before it
bars AS (
  SELECT market, code, ANY_VALUE(s) FILTER (WHERE s.trade_date = d) AS o, COUNT(*) FILTER (WHERE s.trade_date = d) AS n, ARG_MAX(s.close, s.trade_date) FILTER (WHERE s.trade_date < d) AS pre
  FROM stock s, day GROUP BY ALL),
listed AS (SELECT market, code, COALESCE(listed_date <= d AND COALESCE(delisted_date, d) >= d, FALSE) AS alive FROM ref_stock, day),
of_stock AS (
  SELECT COUNT(*) FILTER ({_holes('close', 'pre_close', 'pct_chg', 'amount')}) AS global_stock_daily_core_null_count,
    COUNT(*) FILTER (l.code IS NULL) AS global_stock_daily_without_ref_count
  FROM stock s JOIN day ON trade_date = d LEFT JOIN listed l ON l.market = s.market AND l.code = s.code),
of_catalog AS (
  SELECT COUNT(*) FILTER (alive AND COALESCE(n, 0) = 0) AS global_active_stock_without_daily_count FROM listed LEFT JOIN bars USING (market, code)),
of_boards AS (
  SELECT 0 AS global_missing_board_type_column_count, COUNT(*) FILTER (COALESCE(board_type, '') = '') AS global_blank_board_type_count,
    COUNT(*) FILTER (COALESCE(board_type, '') <> COALESCE(listing_board, '')) AS global_board_type_listing_board_mismatch_count FROM ref_stock),
-- concepts: named, with a bar and a member on the day
wanted AS (
  SELECT concept_id, ANY_VALUE(amount) AS amount, ANY_VALUE(pct_chg) AS pct_chg FROM concept JOIN day ON trade_date = d
  WHERE concept_id <> 'LARGE' AND concept_id IN (SELECT concept_id FROM membership, day WHERE d BETWEEN valid_from AND COALESCE(valid_to, d)) GROUP BY 1),
recent AS (SELECT *, DENSE_RANK() OVER (ORDER BY trade_date DESC) AS age FROM concept, day WHERE trade_date <= d),
covered AS (
  SELECT concept_id, COUNT(*) FILTER (age <= 3) AS n3, COUNT(*) FILTER (age <= 8) AS n8, COUNT(*) FILTER (age <= 3 AND (pct_chg IS NULL OR COALESCE(amount, 0) <= 0)) AS bad3,
    COUNT(*) FILTER (age <= 8 AND pct_chg IS NULL) AS null8, COUNT(*) FILTER (age <= 8 AND COALESCE(amount, 0) <= 0) AS bad8 FROM recent SEMI JOIN wanted USING (concept_id) GROUP BY 1),
of_days AS (SELECT LEAST(MAX(age), 3) AS first_stage_concept_trade_date_count, LEAST(MAX(age), 8) AS second_stage_trade_date_count FROM recent),
of_coverage AS (
  SELECT COUNT(*) FILTER (n3 <> 3) AS first_stage_incomplete_concept_count, SUM(bad3) AS first_stage_concept_core_invalid_count, COUNT(*) FILTER (n8 <> 8) AS second_stage_incomplete_concept_count,
    SUM(null8) AS second_stage_null_pct_chg_count, SUM(bad8) AS second_stage_invalid_amount_count FROM covered),
-- members checked per concept
remade AS (
  SELECT w.concept_id, ANY_VALUE(w.amount) AS amount, ANY_VALUE(w.pct_chg) AS pct_chg, COUNT(*) FILTER (COALESCE(n, 0) = 0) AS absent, COUNT(*) FILTER (n > 0 AND pre IS NULL) AS unpriced,
    COUNT(*) FILTER (NOT REGEXP_FULL_MATCH(stock_code, CASE stock_market WHEN 'SHSE' THEN '(5|6|900).*' WHEN 'BJSE' THEN '(4|8|920).*' ELSE '[^45689].*' END)) AS misplaced,
    SUM(o.amount) FILTER (NOT o.is_suspended AND NOT o.is_st AND o.close IS NOT NULL AND pre IS NOT NULL AND o.amount > 0) AS sum_amount,
    SUM(o.pct_chg * o.amount) FILTER (NOT o.is_suspended AND NOT o.is_st AND o.pct_chg IS NOT NULL AND o.amount > 0)
      / NULLIF(SUM(o.amount) FILTER (NOT o.is_suspended AND NOT o.is_st AND o.pct_chg IS NOT NULL AND o.amount > 0), 0) AS mean_pct
  FROM wanted w JOIN day ON TRUE JOIN membership m ON m.concept_id = w.concept_id AND d BETWEEN valid_from AND COALESCE(valid_to, d)
  JOIN listed l ON l.alive AND l.market = stock_market AND l.code = stock_code LEFT JOIN bars b ON b.market = stock_market AND b.code = stock_code GROUP BY 1),
of_members AS (
  SELECT SUM(absent) AS second_stage_missing_member_stock_count, SUM(unpriced) AS second_stage_missing_member_pre_close_count, SUM(misplaced) AS second_stage_invalid_market_code_count,
    COUNT(*) FILTER (COALESCE(ABS(amount - sum_amount) > GREATEST(1.0, ABS(sum_amount) / 1e6), sum_amount IS NULL)) AS second_stage_amount_mismatch_count,
    COUNT(*) FILTER (COALESCE(ABS(pct_chg - mean_pct) > 0.001, mean_pct IS NULL)) AS second_stage_pct_chg_mismatch_count FROM remade),
whole AS (SELECT COLUMNS(*)::BIGINT FROM (SELECT * FROM of_keys, of_index, of_index_names, of_board, of_stock, of_catalog, of_boards, of_days, of_coverage, of_members)),
metrics AS (UNPIVOT (SELECT COALESCE(COLUMNS(*), 0) FROM whole) ON COLUMNS(*) INTO NAME metric VALUE actual)"""
_CONTRACT_TABLES = "stock_changes membership type_bars brand_bars"
ORACLES["h_contract_metrics"] = using(_CONTRACT_TABLES, f"WITH {_CONTRACT} SELECT metric, actual FROM metrics")
ORACLES["a15_metrics_long"] = using(_CONTRACT_TABLES, f"""
WITH {_CONTRACT}, compared AS (
  SELECT metric, actual, CAST(CASE WHEN metric LIKE 'first_stage_index_trade%' THEN 6 WHEN metric LIKE 'first_stage_concept_trade%' THEN 3 WHEN metric LIKE 'second_stage_trade%' THEN 8 ELSE 0 END AS BIGINT) AS expected FROM metrics)
SELECT *, IF(actual = expected, 'healthy', 'unhealthy') AS status FROM compared""")
ORACLES["c03_table_exists"] = """
SELECT 'table_exists:fact.lines' AS check_id, '依赖表 fact.lines' AS title, 'healthy' AS status, '正常' AS result_text, '' AS error_text FROM (SELECT COUNT(*) FROM lineitem)
UNION ALL SELECT 'table_exists:fact.nowhere', '依赖表 fact.nowhere', 'unhealthy', '异常', '表不存在'"""


def _outcomes(index: str) -> str:
    """Outcomes of the contract for one index code, counted."""
    wanted = "CASE WHEN metric LIKE 'first_stage_index_trade%' THEN 6 WHEN metric LIKE 'first_stage_concept_trade%' THEN 3 WHEN metric LIKE 'second_stage_trade%' THEN 8 ELSE 0 END"
    return f"WITH {_CONTRACT} SELECT '{index.lower()}' AS capability_id, IF(actual = {wanted}, 'healthy', 'unhealthy') AS status, COUNT(*) AS checks FROM metrics GROUP BY 1, 2".replace("code = 'PROMO'", f"code = '{index}'")


ORACLES["c20_contract_rules"] = using(_CONTRACT_TABLES, f"SELECT * FROM ({_outcomes('PROMO')}) UNION ALL SELECT * FROM ({_outcomes('SMALL')})")
ORACLES["io3_profiles_run"] = using("faulty_bars", f"""
WITH s AS (SELECT 'bars' AS c, COUNT(*) FILTER (WHERE low > high OR open < low OR open > high OR close < low OR close > high OR amount < 0) AS n FROM faulty_bars WHERE {_RECENT}
UNION ALL SELECT 'keys', n FROM {_DUPLICATES} UNION ALL SELECT 'none', 1)
SELECT c AS capability_id, 'facts' AS "group", IF(n > 0, 'unhealthy', 'healthy') AS status FROM s""")
ORACLES["health_run"] = using("calendar faulty_bars", f"""
WITH s AS (SELECT 'bars' AS c, 'facts' AS g, COUNT(*) FILTER (WHERE low > high OR open < low OR open > high OR close < low OR close > high OR volume < 0 OR amount < 0 OR inflow IS NULL OR NOT ISFINITE(inflow)) AS n FROM faulty_bars WHERE {_RECENT}
UNION ALL SELECT 'keys', 'facts', n FROM {_DUPLICATES} UNION ALL SELECT 'calendar', 'reference', CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END FROM calendar WHERE {_RECENT} UNION ALL SELECT 'unlisted', 'reference', 1)
SELECT g AS "group", CASE WHEN COUNT(*) FILTER (WHERE n > 0) > 0 THEN 'unhealthy' ELSE 'healthy' END AS status, COUNT(*) AS total, COUNT(*) FILTER (WHERE n = 0) AS healthy, CAST(0 AS BIGINT) AS warning, COUNT(*) FILTER (WHERE n > 0) AS unhealthy FROM s GROUP BY 1""")

# -- streaming: the same aggregates in batch; a window counts as finished when the watermark has passed its end --
ORACLES["s1_stream_bars"] = f"""
WITH b AS (SELECT event_type AS code, TIME_BUCKET(INTERVAL 30 MINUTE, ts) AS bar_time, MIN_BY(value, event_id) AS open, MAX(value) AS high, MIN(value) AS low, MAX_BY(value, event_id) AS close, COUNT(*) AS volume, {_money('value')} AS amount FROM events GROUP BY 1, 2)
SELECT code, bar_time, bar_time + INTERVAL 30 MINUTE AS bar_end, open, high, low, close, volume, amount FROM b WHERE bar_time + INTERVAL 30 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"""
_FINISHED = f"""
b1 AS (SELECT event_type AS code, TIME_BUCKET(INTERVAL 1 MINUTE, ts) AS bar_time, MIN_BY(value, event_id) AS open, MAX(value) AS high, MIN(value) AS low, MAX_BY(value, event_id) AS close, COUNT(*) AS volume, {_money('value')} AS amount
  FROM events GROUP BY 1, 2 HAVING TIME_BUCKET(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE)"""


def _coarser(name: str, minutes: int, finer: str) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT code, TIME_BUCKET(INTERVAL {minutes} MINUTE, bar_time) AS bar_time, MIN_BY(open, bar_time) AS open, MAX(high) AS high, MIN(low) AS low, MAX_BY(close, bar_time) AS close, SUM(volume) AS volume, SUM(amount) AS amount
  FROM {finer} GROUP BY 1, TIME_BUCKET(INTERVAL {minutes} MINUTE, bar_time)) WHERE bar_time + INTERVAL {minutes} MINUTE <= (SELECT MAX(bar_time) FROM {finer}))"""


ORACLES["s1_chained_bars"] = f"WITH {_FINISHED}, {_coarser('b5', 5, 'b1')}, {_coarser('b30', 30, 'b5')}, {_coarser('b60', 60, 'b30')} " + " UNION ALL ".join(
    f"SELECT '{width}' AS width, code, bar_time, open, high, low, close, volume::BIGINT AS volume, ROUND(amount, 2) AS amount FROM {name}"
    for name, width in (("b1", "1 minute"), ("b5", "5 minutes"), ("b30", "30 minutes"), ("b60", "60 minutes")))
ORACLES["s3_session_audit"] = f"""
WITH {_FINISHED} SELECT code, CAST(bar_time AS DATE) AS trade_date, COUNT(*) AS minute_count, 240 - COUNT(*) AS missing_count, STRFTIME(MIN(bar_time), '%H:%M') AS first_minute, STRFTIME(MAX(bar_time), '%H:%M') AS last_minute
FROM b1 WHERE HOUR(bar_time) * 60 + MINUTE(bar_time) BETWEEN 571 AND 690 OR HOUR(bar_time) * 60 + MINUTE(bar_time) BETWEEN 781 AND 900
GROUP BY 1, 2 HAVING CAST(bar_time AS DATE) + INTERVAL 901 MINUTE <= (SELECT MAX(bar_time) FROM b1)"""
ORACLES["s4_sources_joined"] = """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS source_ts, event_id AS source_id FROM events WHERE event_type = 'click'),
j AS (SELECT p.*, source_ts, source_id FROM p LEFT JOIN c ON p.user_id = c.user_id AND source_ts >= ts AND source_ts <= ts + INTERVAL 30 MINUTE)
SELECT * FROM j WHERE source_id IS NOT NULL OR ts + INTERVAL 30 MINUTE < LEAST((SELECT MAX(ts) FROM p), (SELECT MAX(source_ts) FROM c)) - INTERVAL 10 MINUTE"""
ORACLES["q13_stored_levels"] = using("bars_minute", " UNION ALL ".join(
    f"SELECT '{freq}' AS freq, code, MAX(CAST(bar_time AS DATE)) AS trade_time, ARG_MIN(open, bar_time) AS open, MAX(high) AS high, MIN(low) AS low, ARG_MAX(close, bar_time) AS close, SUM(volume)::DOUBLE AS volume, ROUND(SUM(amount), 2) AS amount, COUNT(*) AS bar_count FROM bars_minute GROUP BY code, DATE_TRUNC('{unit}', bar_time)"
    for freq, unit in (("1d", "day"), ("1w", "week"), ("1mo", "month"))))
ORACLES["c14_observed"] = using("faulty_bars", f"{_OHLC_CHECK} UNION ALL {_SIGN_CHECKS}".replace(f"WHERE {_RECENT} AND", "WHERE"))
ORACLES["s2_upsert"] = f"""
SELECT event_type AS code, TIME_BUCKET(INTERVAL 1 HOUR, ts) AS bar_time, MIN_BY(value, event_id) AS open, MAX_BY(value, event_id) AS close, COUNT(*) AS volume, {_money('value')} AS amount FROM events GROUP BY 1, 2"""
ORACLES["s3_gap_audit"] = using("bars_minute", f"WITH {_SESSION} SELECT trade_date, minute_count, first_minute, last_minute, issue FROM issues WHERE issue <> ''")
ORACLES["s4_news_lag"] = """
WITH n AS (SELECT ts, ts + TO_MINUTES(CAST(event_id % 121 - 60 AS INT)) AS crawl_time FROM events),
h AS (SELECT TIME_BUCKET(INTERVAL 1 HOUR, crawl_time) AS crawl_hour, COUNT(*) AS event_count, COUNT(*) FILTER (WHERE crawl_time > ts) AS late_count, MAX(EPOCH_US(crawl_time) - EPOCH_US(ts)) / 1e6 AS max_lag_seconds FROM n GROUP BY 1)
SELECT * FROM h WHERE crawl_hour + INTERVAL 1 HOUR <= (SELECT MAX(crawl_time) FROM n) - INTERVAL 1 HOUR"""
ORACLES["s4_news_lag_batch"] = using("news", f"""
WITH {_NEWS} SELECT trade_date, COUNT(*) AS event_count, COUNT(*) FILTER (WHERE crawl_time > announcement_time) AS late_count,
  ROUND(AVG((EPOCH_US(crawl_time) - EPOCH_US(announcement_time)) / 1e6), 4) AS mean_lag_seconds, ROUND(MAX((EPOCH_US(crawl_time) - EPOCH_US(announcement_time)) / 1e6), 4) AS max_lag_seconds FROM n GROUP BY 1""")

ORACLES["io4_result_round_trip"] = using("faulty_bars", f"{_OHLC_CHECK} UNION ALL {_SIGN_CHECKS}")
ORACLES["io5_fill_write_back"] = f"""
WITH s AS (SELECT p_brand AS code, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS month, l_returnflag AS flag, {_money('l_quantity')} AS volume FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A', 'N') GROUP BY 1, 2, 3)
SELECT code, month, volume, flag FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY code, month ORDER BY CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 1"""
