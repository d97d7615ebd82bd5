"""Oracle SQL of the series queries."""

from __future__ import annotations

from tapeloom.plans.oracle_tables import with_tables as using

ORACLES: dict[str, str] = {}


def _money(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


ORACLES["io1_fact_scan"] = f"""
SELECT CAST(l_shipdate AS DATE) AS trade_date, COUNT(*) AS row_count, {_money('l_quantity')} AS volume FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01' GROUP BY 1"""
ORACLES["io2_ref_scan"] = """
SELECT r_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
ORACLES["io3_json_rules"] = """
SELECT event_type, CAST(SUM(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k_total, MAX(CAST(json_extract(props, '$.k') AS INT)) AS k_max FROM events GROUP BY event_type"""
ORACLES["io7_availability"] = """
SELECT 'orders' AS name, true AS table_exists, COUNT(*) AS row_count, CAST(MIN(CAST(o_orderdate AS DATE)) AS VARCHAR) AS min_value, CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS max_value FROM orders
UNION ALL SELECT 'lineitem', true, COUNT(*), CAST(MIN(CAST(l_shipdate AS DATE)) AS VARCHAR), CAST(MAX(CAST(l_shipdate AS DATE)) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'events', true, COUNT(*), CAST(MIN(CAST(ts AS DATE)) AS VARCHAR), CAST(MAX(CAST(ts AS DATE)) AS VARCHAR) FROM events
UNION ALL SELECT 'absent', false, 0, '', ''"""

ORACLES["q01_entities"] = using("bars_sparse", "SELECT code, trade_date, volume FROM bars_sparse WHERE code IN ('Brand#1', 'Brand#3', 'Brand#7')")
ORACLES["q01_entities_semi"] = using("bars_sparse", "SELECT code, COUNT(*) AS n FROM bars_sparse WHERE code IN (SELECT p_brand FROM part WHERE p_size = 50) GROUP BY code")
ORACLES["q02_enum_check"] = "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1"
ORACLES["q03_range"] = using("bars_sparse", "SELECT code, trade_date, volume, amount FROM bars_sparse WHERE trade_date BETWEEN DATE '1997-03-01' AND DATE '1997-04-30'")
ORACLES["q03_point"] = using("bars_sparse", "SELECT code, trade_date, volume, amount FROM bars_sparse WHERE trade_date = DATE '1997-03-05'")
ORACLES["q04_times"] = using("bars_minute", "SELECT code, bar_time, open, close, volume FROM bars_minute WHERE bar_time BETWEEN TIMESTAMP '2024-01-05 09:30:00' AND TIMESTAMP '2024-01-07 15:00:00'")
ORACLES["q05_last_n"] = using("bars_sparse", "SELECT code, trade_date, volume FROM bars_sparse QUALIFY ROW_NUMBER() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 7")
ORACLES["q06_cut"] = using("bars_sparse", "SELECT COUNT(*) AS total_rows, LEAST(COUNT(*), 500) AS returned_rows, COUNT(*) > 500 AS truncated FROM bars_sparse")
ORACLES["q07_exclude_entity"] = using("stock_daily", "SELECT market, code, trade_date, volume FROM stock_daily WHERE (market, code) NOT IN (SELECT (market, code) FROM stock_daily WHERE is_st)")
ORACLES["q08_skip_suspended"] = using("stock_daily", "SELECT market, code, trade_date, volume FROM stock_daily WHERE (market, code) NOT IN (SELECT (market, code) FROM stock_daily WHERE is_st) AND NOT is_suspended")
ORACLES["q09_page"] = using("stock_daily", "SELECT trade_date, code, volume FROM stock_daily ORDER BY trade_date, code LIMIT 250 OFFSET 1000")
ORACLES["io6_columns"] = "SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name FROM information_schema.columns WHERE table_name IN ('lineitem', 'orders', 'part')"
ORACLES["io7_footers"] = """
SELECT 'lineitem' AS name, true AS table_exists, COUNT(*) AS row_count, CAST(MIN(l_orderkey) AS VARCHAR) AS min_value, CAST(MAX(l_orderkey) AS VARCHAR) AS max_value FROM lineitem
UNION ALL SELECT 'orders', true, COUNT(*), CAST(MIN(o_orderkey) AS VARCHAR), CAST(MAX(o_orderkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'customer', true, COUNT(*), CAST(MIN(c_custkey) AS VARCHAR), CAST(MAX(c_custkey) AS VARCHAR) FROM customer
UNION ALL SELECT 'nowhere', false, 0, '', ''"""
ORACLES["q16_clamped_limit"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000"
ORACLES["q09_deep_page"] = """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY ROW_NUMBER() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 - (SELECT 3 * COUNT(*) // 4 FROM lineitem) BETWEEN 0 AND 199"""
ORACLES["q10_project"] = using("bars_sparse", "SELECT code, trade_date, high FROM bars_sparse")
_GRID = """
slots AS (SELECT d + TO_MINUTES(CAST(m AS INT)) AS t0 FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (SELECT 570 + k AS m FROM RANGE(1, 121) x(k) UNION ALL SELECT 780 + k FROM RANGE(1, 121) x(k))),
grid AS (SELECT code, t0, ROW_NUMBER() OVER (PARTITION BY code ORDER BY t0) AS n FROM (SELECT DISTINCT code FROM bars_minute), slots)"""
ORACLES["q11_minute_completeness"] = using("bars_minute", f"""
WITH {_GRID} SELECT g.code, COUNT(*) AS expected_bar_count, COUNT(b.code) AS actual_bar_count, COUNT(*) - COUNT(b.code) AS missing_count
FROM grid g LEFT JOIN bars_minute b ON b.code = g.code AND b.bar_time = g.t0 GROUP BY 1""")
ORACLES["w16_minute_gaps"] = using("bars_minute", f"""
WITH {_GRID}, gone AS (SELECT code, t0, n - ROW_NUMBER() OVER (PARTITION BY code ORDER BY n) AS island FROM grid g WHERE NOT EXISTS (FROM bars_minute b WHERE b.code = g.code AND b.bar_time = g.t0))
SELECT code, MIN(t0) AS start_time, MAX(t0) AS end_time, COUNT(*) AS bar_count FROM gone GROUP BY code, island""")
ORACLES["q11_completeness"] = using("calendar bars_sparse", """
WITH days AS (SELECT trade_date FROM calendar WHERE YEAR(trade_date) = 1997), codes AS (SELECT DISTINCT p_brand AS code FROM part),
grid AS (SELECT c.code, d.trade_date, b.close FROM codes c CROSS JOIN days d LEFT JOIN bars_sparse b ON b.code = c.code AND b.trade_date = d.trade_date),
own AS (SELECT c.code, COUNT(b.trade_date) AS row_count, MIN(b.trade_date) AS first_trade_time, MAX(b.trade_date) AS last_trade_time
        FROM codes c LEFT JOIN bars_sparse b ON b.code = c.code AND YEAR(b.trade_date) = 1997 GROUP BY c.code)
SELECT g.code, ANY_VALUE(row_count) AS row_count, COUNT(*) AS expected_bar_count, COUNT(g.close) AS actual_bar_count, ANY_VALUE(first_trade_time) AS first_trade_time,
  ANY_VALUE(last_trade_time) AS last_trade_time, COALESCE(STRING_AGG(CAST(g.trade_date AS VARCHAR), ',' ORDER BY g.trade_date) FILTER (WHERE g.close IS NULL), '') AS missing_trade_dates,
  COUNT(*) - COUNT(g.close) AS missing_count, COUNT(*) = COUNT(g.close) AS complete
FROM grid g JOIN own USING (code) GROUP BY g.code""")
ORACLES["q12_fill"] = using("calendar bars_sparse", """
WITH gaps AS (SELECT b.code, d.trade_date FROM (SELECT code, MIN(trade_date) AS since FROM bars_sparse GROUP BY 1) b JOIN calendar d ON d.trade_date > b.since
  WHERE NOT EXISTS (SELECT 1 FROM bars_sparse x WHERE x.code = b.code AND x.trade_date = d.trade_date))
SELECT code, trade_date, low, high, close, volume, amount, FALSE AS is_suspended FROM bars_sparse UNION ALL
SELECT g.code, g.trade_date, b.close, b.close, b.close, 0, 0, TRUE FROM gaps g ASOF JOIN bars_sparse b ON b.code = g.code AND b.trade_date < g.trade_date""")
for _freq, _unit in (("weekly", "week"), ("monthly", "month")):
    ORACLES[f"q13_{_freq}"] = using("bars_sparse", f"""
SELECT code, CAST(DATE_TRUNC('{_unit}', trade_date) AS DATE) AS bucket, ARG_MIN(close, trade_date) AS open, MAX(high) AS high, MIN(low) AS low,
  ARG_MAX(close, trade_date) AS close, {_money('volume')} AS volume, {_money('amount')} AS amount, MAX(trade_date) AS trade_time, COUNT(*) AS bar_count
FROM bars_sparse GROUP BY ALL""")
_MINUTE_BARS = """
SELECT code, {bucket} AS bucket, ARG_MIN(open, bar_time) AS open, MAX(high) AS high, MIN(low) AS low, ARG_MAX(close, bar_time) AS close,
  CAST(SUM(volume) AS DOUBLE) AS volume, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount, MAX(bar_time) AS trade_time, COUNT(*) AS bar_count
FROM {source} GROUP BY ALL"""
ORACLES["q14_minutes"] = using("bars_minute", _MINUTE_BARS.format(source="bars_minute", bucket="TIME_BUCKET(INTERVAL 30 MINUTE, bar_time) + INTERVAL 30 MINUTE"))
ORACLES["q14_session"] = using("bars_minute", "WITH m AS (SELECT *, HOUR(bar_time) * 60 + MINUTE(bar_time) AS t FROM bars_minute), s AS (SELECT *, CASE WHEN t BETWEEN 571 AND 690 THEN 570 WHEN t BETWEEN 781 AND 900 THEN 780 END AS a FROM m)" + _MINUTE_BARS.format(
    source="s WHERE a IS NOT NULL", bucket="DATE_TRUNC('day', bar_time) + TO_MINUTES(CAST(a + CEIL((t - a) / 60.0) * 60 AS INT))"))
_FACTOR = "1 + (YEAR(trade_date) - 1995) * 0.05::DOUBLE"
ORACLES["q15_qfq"] = using("bars_daily", f"""
WITH f AS (SELECT *, {_FACTOR} AS factor FROM bars_daily), g AS (SELECT *, LAST_VALUE(factor) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM f)
SELECT code, trade_date, low * factor / base AS low, high * factor / base AS high, close * factor / base AS close FROM g""")
ORACLES["q15_qfq_base"] = using("bars_daily", f"""
WITH f AS (SELECT *, {_FACTOR} AS factor FROM bars_daily)
SELECT code, trade_date, close * factor / (SELECT ARG_MAX(b.factor, b.trade_date) FROM f b WHERE b.code = f.code AND b.trade_date <= DATE '1998-06-30') AS close FROM f""")
ORACLES["q15_hfq"] = using("bars_daily", f"SELECT code, trade_date, close * ({_FACTOR}) AS close FROM bars_daily")
ORACLES["q17_finite"] = """
SELECT l_returnflag, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_tax NOT IN (0, 0.01, 0.02)) AS finite_count,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_tax NOT IN (0, 0.01, 0.02)) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag"""
ORACLES["q18_catalog"] = "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name LIKE '%widget%' AND p_brand = 'Brand#7'"
ORACLES["q18_listed_only"] = using("stock_ref", "SELECT market, code, listing_board FROM stock_ref WHERE market = 'SHSE' AND delisted_date IS NULL")
ORACLES["q19_validity"] = using("membership", "SELECT concept_id, stock_market, stock_code FROM membership WHERE DATE '2001-01-15' BETWEEN valid_from AND COALESCE(valid_to, DATE '9999-12-31')")
ORACLES["q20_recent"] = using("bars_sparse", """
SELECT code, COUNT(*) AS n, MIN(trade_date) AS first_day, MAX(trade_date) AS last_day FROM bars_sparse
WHERE trade_date >= CAST(DATE '2000-07-01' - INTERVAL 90 DAY AS DATE) AND trade_date < DATE '2000-07-01' GROUP BY code""")

ORACLES["j01_target_rows"] = using("concept_daily", """
SELECT market, code, trade_date, volume FROM stock_daily WHERE trade_date = LEAST((SELECT MAX(trade_date) FROM stock_daily), (SELECT MAX(trade_date) FROM concept_daily))""")
ORACLES["j02_concept_members"] = using("concept_daily", """
SELECT c.concept_id, m.member_count, COUNT(*) AS day_count FROM concept_daily c JOIN (SELECT concept_id, COUNT(*) AS member_count FROM membership GROUP BY 1) m USING (concept_id) GROUP BY 1, 2""")
ORACLES["j03_coverage"] = using("bars_sparse", """
WITH days AS (SELECT DISTINCT trade_date FROM bars_sparse ORDER BY 1 DESC LIMIT 8), brands AS (SELECT DISTINCT p_brand AS code FROM part)
SELECT brands.code, COUNT(b.trade_date) AS bar_count FROM brands CROSS JOIN days LEFT JOIN bars_sparse b ON b.code = brands.code AND b.trade_date = days.trade_date GROUP BY 1""")
ORACLES["j04_valid_join"] = using("stock_daily membership", f"""
SELECT m.concept_id, s.trade_date, COUNT(*) AS member_count, {_money('s.volume')} AS volume FROM stock_daily s JOIN membership m ON m.stock_market = s.market AND m.stock_code = s.code
 AND s.trade_date >= m.valid_from AND (m.valid_to IS NULL OR s.trade_date <= m.valid_to) GROUP BY 1, 2""")
ORACLES["j04_valid_join_by_year"] = ORACLES["j04_valid_join_by_cover"] = ORACLES["j04_valid_join"]
ORACLES["j05_anti"] = "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
ORACLES["j06_members_without_bar"] = using("stock_daily membership", """
SELECT m.concept_id, m.stock_market, m.stock_code FROM membership m LEFT JOIN stock_daily s ON s.market = m.stock_market AND s.code = m.stock_code AND s.trade_date = DATE '1997-03-03' AND NOT s.is_suspended
WHERE s.code IS NULL AND m.valid_from <= DATE '1997-03-03' AND (m.valid_to IS NULL OR m.valid_to >= DATE '1997-03-03')""")
ORACLES["j07_tolerance"] = using("concept_daily", f"""
WITH e AS (SELECT m.concept_id, s.trade_date, {_money('s.amount')} AS expected FROM stock_daily s JOIN membership m ON m.stock_market = s.market AND m.stock_code = s.code
 AND m.valid_from <= s.trade_date AND (m.valid_to IS NULL OR m.valid_to >= s.trade_date) WHERE NOT s.is_suspended AND NOT s.is_st GROUP BY 1, 2)
SELECT concept_id, COUNT(*) AS day_count, COUNT(*) FILTER (WHERE ABS(c.amount - e.expected) > GREATEST(1.0, ABS(e.expected) * 0.000001)) AS mismatch_count
FROM concept_daily c JOIN e USING (concept_id, trade_date) GROUP BY 1""")
_GRID = """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events),
grid AS (SELECT trade_date, CAST(trade_date AS TIMESTAMP) + TO_MINUTES(CAST(m AS INT)) AS bar_time FROM days CROSS JOIN (SELECT UNNEST(RANGE(571, 691)) AS m UNION ALL SELECT UNNEST(RANGE(781, 901))) s)"""
ORACLES["j08_grid"] = _GRID + " SELECT trade_date, COUNT(*) AS minute_count, MIN(bar_time) AS first_minute, MAX(bar_time) AS last_minute FROM grid GROUP BY 1"
ORACLES["j09_minute_rows"] = using("bars_minute", _GRID + " SELECT trade_date, g.bar_time, COUNT(b.code) AS row_count FROM grid g LEFT JOIN bars_minute b USING (bar_time) GROUP BY 1, 2")
_SIDE = """SELECT p_brand AS code, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS month, CASE WHEN COUNT(*) % 3 <> 0 THEN CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) END AS volume,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, CASE WHEN COUNT(*) % 2 = 0 THEN '{flag}' ELSE '' END AS note
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = '{flag}' GROUP BY 1, 2"""
ORACLES["j10_merge"] = f"""
WITH r AS ({_SIDE.format(flag='R')}), a AS ({_SIDE.format(flag='A')}), n AS ({_SIDE.format(flag='N')}),
k AS (SELECT code, month FROM r UNION SELECT code, month FROM a UNION SELECT code, month FROM n)
SELECT k.code, k.month, COALESCE(r.volume, a.volume, n.volume) AS volume, COALESCE(r.amount, a.amount, n.amount) AS amount,
  COALESCE(NULLIF(r.note, ''), NULLIF(a.note, ''), NULLIF(n.note, ''), r.note, a.note, n.note) AS note
FROM k LEFT JOIN r ON r.code = k.code AND r.month = k.month LEFT JOIN a ON a.code = k.code AND a.month = k.month LEFT JOIN n ON n.code = k.code AND n.month = k.month"""
ORACLES["j11_left_two_keys"] = using("stock_daily membership", """
SELECT m.concept_id, COUNT(*) AS member_count, COUNT(s.volume) AS with_bar FROM membership m LEFT JOIN stock_daily s ON s.market = m.stock_market AND s.code = m.stock_code AND s.trade_date = DATE '1997-03-03' GROUP BY 1""")
ORACLES["j12_pit_merge"] = using("reports_f reports_p", """
SELECT code, report_period, announcement_date, f.value AS profit, COALESCE(f.order_count, p.order_count) AS order_count, p.value AS revenue
FROM reports_f f FULL OUTER JOIN reports_p p USING (code, report_period, announcement_date)""")
ORACLES["j13_column_exists"] = using("stock_ref", """
SELECT 'board_type' AS column_name, CAST(0 AS BIGINT) AS missing_column, COUNT(*) FILTER (WHERE board_type = '') AS blank_count FROM stock_ref
UNION ALL SELECT 'industry', 1, COUNT(*) FROM stock_ref""")
ORACLES["j14_fill"] = f"""
WITH s AS (SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS trade_date, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source_rank, {_money('l_quantity')} AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A', 'N') GROUP BY 1, 2, 3)
SELECT code, trade_date, volume, CAST(source_rank AS BIGINT) AS source_rank FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY code, trade_date ORDER BY source_rank) = 1"""
ORACLES["j15_sources"] = using("news", """
SELECT e.event_id, e.event_type, COALESCE(STRING_AGG(d.doc_id || ':' || d.source, ',' ORDER BY d.doc_id), '') AS sources
FROM news e LEFT JOIN documents d ON d.doc_id // 3 = e.event_id GROUP BY 1, 2""")
ORACLES["j16_active_members"] = using("membership", """
SELECT m.concept_id, m.stock_market, m.stock_code FROM membership m JOIN stock_ref r ON r.market = m.stock_market AND r.code = m.stock_code
WHERE DATE '2001-09-03' BETWEEN m.valid_from AND COALESCE(m.valid_to, DATE '9999-12-31') AND DATE '2001-09-03' BETWEEN r.listed_date AND COALESCE(r.delisted_date, DATE '9999-12-31')""")
ORACLES["j17_asof"] = using("reports_f", f"""
WITH daily AS (SELECT c_nationkey AS code, CAST(o_orderdate AS DATE) AS trade_date, {_money('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT d.code, d.trade_date, d.total, r.announcement_date, r.report_period, r.value AS profit FROM daily d ASOF LEFT JOIN reports_f r ON d.code = r.code AND d.trade_date >= r.announcement_date""")

ORACLES["j17_asof_blocks"] = """
WITH seen AS (SELECT user_id, ts AS seen_at, MAX(event_id) AS seen_id, ARG_MAX(value, event_id) AS seen_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT b.event_id, b.user_id, b.ts, s.seen_at, s.seen_id, s.seen_value FROM (FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN seen s ON b.user_id = s.user_id AND b.ts >= s.seen_at"""

ORACLES["a01_counts"] = using("membership", "SELECT concept_id, COUNT(*) AS member_count FROM membership GROUP BY 1")
ORACLES["a02_filtered_count"] = using("stock_daily", "SELECT market, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE is_st) AS st_count, COUNT(*) FILTER (WHERE is_suspended) AS suspended_count FROM stock_daily GROUP BY 1")
ORACLES["a03_distinct_days"] = "SELECT p_type, COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS day_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"
ORACLES["a04_filtered_sum"] = using("stock_daily", "SELECT market, trade_date, CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE NOT is_suspended AND NOT is_st AND amount > 0) AS DOUBLE) AS amount FROM stock_daily GROUP BY 1, 2")
ORACLES["a05_weighted_mean"] = using("stock_changes", """
SELECT market, trade_date, ROUND(SUM(pct_chg * amount) FILTER (WHERE NOT is_suspended AND NOT is_st AND pct_chg IS NOT NULL AND amount > 0)
 / NULLIF(SUM(amount) FILTER (WHERE NOT is_suspended AND NOT is_st AND pct_chg IS NOT NULL AND amount > 0), 0), 6) AS pct_chg FROM stock_changes GROUP BY 1, 2""")
ORACLES["a06_dup_keys"] = "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1"
ORACLES["a07_filtered_min_max"] = using("bars_sparse", """
SELECT code, MIN(trade_date) FILTER (WHERE volume > 25) AS first_day, MAX(trade_date) FILTER (WHERE volume > 25) AS last_day, MIN(volume) FILTER (WHERE volume > 25) AS least_volume FROM bars_sparse GROUP BY 1""")
ORACLES["a08_least_max"] = """
SELECT LEAST(a, b) AS target_date, CASE WHEN a = b THEN 1 ELSE 2 END::BIGINT AS day_count
FROM (SELECT (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) AS a, (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem) AS b)"""
ORACLES["a09_matched_count"] = using("calendar bars_daily", """
SELECT CAST(YEAR(c.trade_date) AS INT) AS year, b.code, COUNT(*) AS expected_days, COUNT(b.volume) AS actual_days FROM calendar c LEFT JOIN bars_daily b ON b.trade_date = c.trade_date GROUP BY 1, 2""")
ORACLES["a10_distinct"] = "SELECT DISTINCT p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey"
_DAY_CHECKS = """
WITH d AS (SELECT code, CAST(DATE_TRUNC('month', trade_date) AS DATE) AS month, COUNT(*) AS n FROM bars_sparse GROUP BY 1, 2),
checks AS (SELECT code || ':' || YEAR(month) AS capability_id, code, month, CASE WHEN n < 12 THEN 'unhealthy' WHEN n < 15 THEN 'warning' WHEN n = 16 THEN 'unknown' ELSE 'healthy' END AS status FROM d),
caps AS (SELECT capability_id, CASE WHEN MAX(CASE WHEN status = 'unhealthy' THEN 1 ELSE 0 END) = 1 THEN 'unhealthy' WHEN MAX(CASE WHEN status IN ('warning', 'unknown') THEN 1 ELSE 0 END) = 1 THEN 'warning' ELSE 'healthy' END AS status FROM checks GROUP BY 1)"""
ORACLES["a11_rollup"] = using("bars_sparse", _DAY_CHECKS + """
SELECT SPLIT_PART(capability_id, ':', 1) AS "group", CASE WHEN COUNT(*) FILTER (WHERE status = 'unhealthy') > 0 THEN 'unhealthy' WHEN COUNT(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'healthy' END AS status,
  COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'healthy') AS healthy, COUNT(*) FILTER (WHERE status = 'warning') AS warning, COUNT(*) FILTER (WHERE status = 'unhealthy') AS unhealthy FROM caps GROUP BY 1""")
ORACLES["a12_worst"] = using("bars_sparse", _DAY_CHECKS + """
SELECT code, ARG_MAX(status, CASE status WHEN 'unhealthy' THEN 3 WHEN 'warning' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) AS worst_status FROM checks GROUP BY 1""")
ORACLES["a13_capability"] = using("bars_sparse", _DAY_CHECKS + " SELECT capability_id, status FROM caps")
ORACLES["a14_enough_rows"] = using("bars_sparse", """
WITH c AS (SELECT p_brand AS code, (SELECT COUNT(*) FROM bars_sparse b WHERE b.code = p_brand) AS n FROM (SELECT DISTINCT p_brand FROM part))
SELECT BOOL_AND(n >= 1) AS enough, 1 AS wanted FROM c UNION ALL SELECT BOOL_AND(n >= 2000), 2000 FROM c""")


# -- windows --
def _recursive_mean(source: str, value: str, alpha: str, back: int) -> str:
    """Rows of ``source`` with y = recursive mean of ``value``, by folding the list of the last values."""
    return f"""
SELECT *, LIST_REDUCE(a, LAMBDA acc, v: acc * (1 - {alpha}) + v * {alpha}) AS y
FROM (SELECT *, LIST({value}) FILTER (WHERE {value} IS NOT NULL) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS a FROM {source})"""


def _gated(expression: str, value: str, n: int) -> str:
    frame = f"OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({value}) {frame} = {n} THEN {expression}({value}) {frame} END"


def _sma(n: int) -> str:
    return f"ROUND({_gated('AVG', 'close', n)}, 4) AS ma{n}"


def _rsi(n: int) -> str:
    gain, loss = _gated("AVG", "gain", n), _gated("AVG", "loss", n)
    return f"ROUND(100 - 100 / (1 + ({gain}) / NULLIF({loss}, 0)), 4) AS rsi{n}"


_EMA = f"""
e12 AS (SELECT code, trade_date, y AS ema12 FROM ({_recursive_mean('bars_daily', 'close', '(2.0::DOUBLE/13)', 230)})),
e26 AS (SELECT code, trade_date, y AS ema26 FROM ({_recursive_mean('bars_daily', 'close', '(2.0::DOUBLE/27)', 490)})),
d AS (SELECT code, trade_date, ema12, ema26, ema12 - ema26 AS dif FROM e12 JOIN e26 USING (code, trade_date)),
m AS (SELECT code, trade_date, ema12, ema26, dif, y AS dea FROM ({_recursive_mean('d', 'dif', '0.2::DOUBLE', 175)}))"""
_RSV = """
x AS (SELECT code, trade_date, close, CASE WHEN COUNT(low) OVER w = 9 THEN MIN(low) OVER w END AS low9, CASE WHEN COUNT(high) OVER w = 9 THEN MAX(high) OVER w END AS high9 FROM {source}
  WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
r AS (SELECT code, trade_date, (close - low9) / NULLIF(high9 - low9, 0) * 100 AS rsv FROM x)"""
_KDJ = f"""{_RSV.format(source='bars_daily')},
k AS (SELECT code, trade_date, y AS kdj_k FROM ({_recursive_mean('r', 'rsv', '(1.0::DOUBLE/3)', 100)})),
kd AS (SELECT code, trade_date, kdj_k, y AS kdj_d FROM ({_recursive_mean('k', 'kdj_k', '(1.0::DOUBLE/3)', 100)}))"""
_BOLL = f"""ROUND({_gated('AVG', 'close', 20)} + 2 * {_gated('STDDEV_SAMP', 'close', 20)}, 4) AS boll_upper, ROUND({_gated('AVG', 'close', 20)}, 4) AS boll_mid,
  ROUND({_gated('AVG', 'close', 20)} - 2 * {_gated('STDDEV_SAMP', 'close', 20)}, 4) AS boll_lower"""
_DELTA = """delta AS (SELECT *, GREATEST(diff, 0) + 0 * diff AS gain, GREATEST(-diff, 0) + 0 * diff AS loss FROM (SELECT *, close - LAG(close) OVER (PARTITION BY code ORDER BY trade_date) AS diff FROM bars_daily))"""

ORACLES["w01_prev_close"] = using("bars_sparse", """
WITH p AS (SELECT code, trade_date, close, LAG(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre FROM bars_sparse)
SELECT code, trade_date, close AS close, pre AS pre_close, close - pre AS change, (close - pre) / NULLIF(pre, 0) * 100 AS pct_chg FROM p""")
ORACLES["w02_sma"] = using("bars_daily", f"SELECT code, trade_date, {_sma(5)}, {_sma(10)}, {_sma(20)}, {_sma(60)} FROM bars_daily")
ORACLES["w03_ema"] = using("bars_daily", f"WITH {_EMA} SELECT code, trade_date, ROUND(ema12, 4) AS ema12, ROUND(ema26, 4) AS ema26 FROM m")
ORACLES["w04_macd"] = using("bars_daily", f"WITH {_EMA} SELECT code, trade_date, ROUND(dif, 4) AS dif, ROUND(dea, 4) AS dea, ROUND((dif - dea) * 2, 4) AS macd FROM m")
ORACLES["w05_rsi"] = using("bars_daily", f"WITH {_DELTA} SELECT code, trade_date, {_rsi(6)}, {_rsi(12)}, {_rsi(24)} FROM delta")
ORACLES["w06_extremes"] = using("bars_daily", f"WITH {_RSV.format(source='bars_daily')} SELECT code, trade_date, low9 AS low9, high9 AS high9 FROM x")
ORACLES["w07_rsv"] = using("bars_sparse", f"WITH {_RSV.format(source='bars_sparse')} SELECT code, trade_date, ROUND(rsv, 4) AS rsv FROM r")
ORACLES["w08_kdj"] = using("bars_daily", f"WITH {_KDJ} SELECT code, trade_date, ROUND(kdj_k, 4) AS kdj_k, ROUND(kdj_d, 4) AS kdj_d, ROUND(3 * kdj_k - 2 * kdj_d, 4) AS kdj_j FROM kd")
ORACLES["w09_boll"] = using("bars_daily", f"SELECT code, trade_date, {_BOLL} FROM bars_daily")
_TECHNICAL = f"""
{_EMA}, {_KDJ}, {_DELTA},
s AS (SELECT code, trade_date, {_sma(5)}, {_sma(10)}, {_sma(20)}, {_sma(60)}, {_rsi(6)}, {_rsi(12)}, {_rsi(24)}, {_BOLL} FROM delta)
SELECT s.code, s.trade_date, 'none' AS adjust, ma5, ma10, ma20, ma60, ROUND(ema12, 4) AS ema12, ROUND(ema26, 4) AS ema26, ROUND(dif, 4) AS dif, ROUND(dea, 4) AS dea, ROUND((dif - dea) * 2, 4) AS macd,
  rsi6, rsi12, rsi24, ROUND(kdj_k, 4) AS kdj_k, ROUND(kdj_d, 4) AS kdj_d, ROUND(3 * kdj_k - 2 * kdj_d, 4) AS kdj_j, boll_upper, boll_mid, boll_lower
FROM s JOIN m USING (code, trade_date) JOIN kd USING (code, trade_date)"""
ORACLES["w10_technical"] = using("bars_daily", "WITH " + _TECHNICAL)
ORACLES["w10_technical_minutes"] = using("bars_minute", "WITH minutes AS (SELECT * RENAME (bar_time AS trade_date) FROM bars_minute), " + _TECHNICAL.replace("bars_daily", "minutes"))
ORACLES["w10_technical_segmented"] = ORACLES["w10_technical"]
ORACLES["w11_holder_change"] = using("holder_counts", """
WITH p AS (SELECT *, LAG(holder_count) OVER (PARTITION BY code ORDER BY trade_date) AS pre FROM holder_counts)
SELECT code, trade_date, holder_count, holder_count - pre AS change_count, ROUND((holder_count - pre) / NULLIF(pre, 0)::DOUBLE * 100, 4) AS change_pct FROM p""")
ORACLES["w12_mean_volume"] = using("bars_sparse", "SELECT code, trade_date, ROUND(AVG(volume) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS mean_volume_5d_shares FROM bars_sparse")
ORACLES["w13_moving_averages"] = using("bars_sparse", f"SELECT code, trade_date, {_sma(10)}, {_sma(20)}, {_sma(40)} FROM bars_sparse")
_STRATEGY = f"""
parts AS (SELECT p_brand AS code, CASE WHEN p_brand = 'Brand#3' THEN 0.0 ELSE {_money('p_retailprice')} END AS cap, CASE WHEN p_brand <> 'Brand#5' THEN CAST(SUM(p_size) AS DOUBLE) END AS shares FROM part GROUP BY p_brand),
v AS (SELECT *, AVG(volume) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mv, {_sma(10)}, {_sma(20)}, {_sma(40)} FROM bars_sparse),
factors AS (SELECT code, trade_date, amount / 2 / NULLIF(cap * 10000, 0) AS active_buy_amount_proportion_all, mv / NULLIF(shares * 10000, 0) AS mean_volume_5d_to_free_float_shares,
  CASE WHEN close >= low * 1.5 THEN 'upper' WHEN close <= high * 0.6 THEN 'lower' ELSE 'inside' END AS price_band_state, ROUND(mv, 4) AS mean_volume_5d_shares, ma10, ma20, ma40, amount, volume, close
  FROM v JOIN parts USING (code))"""
ORACLES["w14_ratios"] = using("bars_sparse", f"WITH {_STRATEGY} SELECT * EXCLUDE (amount, volume, close) FROM factors")
ORACLES["w15_latest_days"] = using("bars_sparse", "SELECT DISTINCT trade_date FROM bars_sparse WHERE trade_date <= DATE '1999-12-31' ORDER BY 1 DESC LIMIT 8")
ORACLES["w16_gaps"] = using("calendar bars_sparse", """
WITH days AS (SELECT trade_date, ROW_NUMBER() OVER (ORDER BY trade_date) AS p FROM calendar), brands AS (SELECT DISTINCT p_brand AS code FROM part),
missing AS (SELECT b.code, d.trade_date, d.p FROM brands b CROSS JOIN days d WHERE NOT EXISTS (SELECT 1 FROM bars_sparse s WHERE s.code = b.code AND s.trade_date = d.trade_date)),
islands AS (SELECT *, p - ROW_NUMBER() OVER (PARTITION BY code ORDER BY p) AS island FROM missing)
SELECT code, MIN(trade_date) AS start_date, MAX(trade_date) AS end_date, COUNT(*) AS day_count FROM islands GROUP BY code, island""")

ORACLES["o01_entity_time"] = using("bars_sparse", "SELECT code, trade_date, volume FROM bars_sparse ORDER BY code, trade_date")
ORACLES["o02_time_entity"] = using("bars_sparse", "SELECT trade_date, code, amount FROM bars_sparse ORDER BY trade_date, code")
ORACLES["o03_top_n"] = using("bars_sparse", "SELECT code, trade_date, amount FROM bars_sparse ORDER BY amount DESC, code, trade_date LIMIT 20")
ORACLES["o04_first_issues"] = using("bars_sparse", """
SELECT code, COALESCE(ARRAY_TO_STRING(LIST_SLICE(LIST(CAST(trade_date AS VARCHAR) ORDER BY trade_date) FILTER (WHERE volume < 20), 1, 8), ';'), '') AS issues, COUNT(*) FILTER (WHERE volume < 20) AS issue_count FROM bars_sparse GROUP BY 1""")
ORACLES["o05_groups"] = "SELECT p_type, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 1"
ORACLES["o06_sort_by"] = "SELECT event_id, ts AS announcement_time FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 25"
ORACLES["u01_union_maxima"] = using("bars_daily concept_daily calendar", """
SELECT 'daily' AS table_name, MAX(trade_date) AS trade_date FROM bars_daily UNION ALL SELECT 'stock', MAX(trade_date) FROM stock_daily
UNION ALL SELECT 'concept', MAX(trade_date) FROM concept_daily UNION ALL SELECT 'calendar', MAX(trade_date) FROM calendar""")
ORACLES["u02_session_minutes"] = using("bars_minute", _GRID + " SELECT trade_date, COUNT(*) AS minutes_with_events FROM grid WHERE bar_time IN (SELECT bar_time FROM bars_minute) GROUP BY 1")
ORACLES["u03_keep_first"] = """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) = 1"""
ORACLES["u04_missing"] = using("calendar bars_sparse", """
SELECT b.code, d.trade_date FROM (SELECT DISTINCT p_brand AS code FROM part) b CROSS JOIN calendar d
WHERE NOT EXISTS (SELECT 1 FROM bars_sparse s WHERE s.code = b.code AND s.trade_date = d.trade_date)""")
ORACLES["f02_guarded_ratio"] = f"""
SELECT l_returnflag, l_linestatus, CAST(NULL AS DOUBLE) AS by_zero, ROUND({_money('l_tax')} / ({_money('l_tax')} + 1), 8) AS by_tax FROM lineitem GROUP BY 1, 2"""
ORACLES["f03_greatest_least"] = using("bars_daily", "SELECT code, trade_date, GREATEST(volume, 500.0::DOUBLE) AS at_least, LEAST(volume, 500.0::DOUBLE) AS at_most FROM bars_daily")
ORACLES["f06_market_code"] = using("stock_ref", """
SELECT market, code, CASE market WHEN 'SHSE' THEN code[1] IN ('5', '6') OR code[1:3] = '900' WHEN 'BJSE' THEN code[1] IN ('4', '8') OR code[1:3] = '920' ELSE code[1] NOT IN ('4', '5', '6', '8', '9') END AS valid FROM stock_ref""")
ORACLES["f07_garbled_names"] = "SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (WHERE text IS NULL OR text = '' OR text LIKE '%?%') AS garbled_count FROM documents GROUP BY 1"
ORACLES["f09_local_time"] = "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_date, STRFTIME(ts + INTERVAL 8 HOUR, '%H:%M') AS local_minute FROM events"
ORACLES["f10_date_arithmetic"] = using("calendar", "SELECT trade_date, trade_date - 20 AS from_date, trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AS in_1997 FROM calendar")
ORACLES["f12_json_field"] = "SELECT event_id, json_extract_string(props, '$.k') AS k, COALESCE(json_extract_string(props, '$.absent'), '') AS absent FROM events"
ORACLES["f15_to_numeric"] = "SELECT o_orderpriority, MAX(TRY_CAST(SPLIT_PART(o_orderpriority, '-', 1) AS DOUBLE)) AS number, COUNT(TRY_CAST(SPLIT_PART(o_orderpriority, '-', 2) AS DOUBLE)) AS parsed_tail FROM orders GROUP BY 1"
ORACLES["f16_dates"] = using("calendar", "SELECT trade_date, trade_date AS compact, trade_date AS dashed, CAST(NULL AS DATE) AS bad FROM calendar")
ORACLES["f17_code_list"] = "SELECT p_partkey, p_brand || '|' || p_type AS codes FROM part"
ORACLES["f20_array_member"] = "SELECT event_id, user_id AS stock_code FROM events WHERE user_id IN (7, 8)"
ORACLES["f01_coalesce"] = """
SELECT p_brand, CAST(l_shipdate AS DATE) AS trade_date, COALESCE(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE), 0.0) AS returned FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
ORACLES["f04_tolerance"] = using("bars_daily", """
SELECT code, COUNT(*) FILTER (WHERE ABS(close - (low + high) / 2) > GREATEST(1.0, ABS((low + high) / 2) * 0.5)) AS beyond_half, COUNT(*) FILTER (WHERE ABS(close - (low + high) / 2) > 100) AS beyond_100 FROM bars_daily GROUP BY 1""")
ORACLES["f05_case"] = using("bars_sparse", "SELECT CASE WHEN close >= low * 2 THEN 'upper' WHEN close <= high / 2 THEN 'lower' ELSE 'inside' END AS price_band_state, COUNT(*) AS n FROM bars_sparse GROUP BY 1")
ORACLES["f08_casts"] = "SELECT event_id, CAST(ts AS DATE) AS day, STRFTIME(ts, '%H:%M:%S') AS time_text, CAST(CAST(ts AS DATE) AS VARCHAR) AS day_text, CAST(FLOOR(value / 100) AS BIGINT) + 1 AS score FROM events"
ORACLES["f11_sequence"] = using("bars_sparse", """
WITH s AS (SELECT code, MIN(trade_date) AS a, MAX(trade_date) AS b FROM bars_sparse GROUP BY 1) SELECT code, CAST(UNNEST(GENERATE_SERIES(a, b, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM s""")
ORACLES["f13_invalid_number"] = "SELECT l_linestatus, COUNT(*) FILTER (WHERE l_tax IN (0, 0.01, 0.02)) AS invalid_count, COUNT(*) FILTER (WHERE l_tax IN (0, 0.01)) AS not_finite_count FROM lineitem GROUP BY 1"
ORACLES["f14_diff_clip"] = using("bars_daily", f"WITH {_DELTA} SELECT code, trade_date, diff, gain, loss FROM delta")
ORACLES["f18_join_texts"] = using("stock_daily", """
SELECT CONCAT_WS(';', CASE WHEN is_st THEN 'st' END, CASE WHEN is_suspended THEN 'suspended' END, CASE WHEN volume < 10 THEN 'thin' END) AS issues, COUNT(*) AS n FROM stock_daily GROUP BY 1""")
ORACLES["f19_hour_minute"] = using("bars_minute", "SELECT code, STRFTIME(MIN(bar_time), '%H:%M') AS first_minute, STRFTIME(MAX(bar_time), '%H:%M') AS last_minute FROM bars_minute GROUP BY 1")
