"""SQL of the derived market tables, used as CTEs in the oracle queries."""

from __future__ import annotations

_BARS = """
SELECT {code} AS code, CAST(l_shipdate AS DATE) AS trade_date,
  MIN(l_extendedprice/l_quantity) AS low, MAX(l_extendedprice/l_quantity) AS high,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)/CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY {code}, CAST(l_shipdate AS DATE)
"""

TABLES = {
    "calendar": "SELECT DISTINCT 'SSE' AS exchange, CAST(o_orderdate AS DATE) AS trade_date, true AS is_open FROM orders",
    "bars_daily": _BARS.format(code="p_type"),
    "bars_sparse": _BARS.format(code="p_brand"),
    "stock_ref": """
SELECT CASE n % 3 WHEN 0 THEN 'SHSE' WHEN 1 THEN 'SZSE' ELSE 'BJSE' END AS market,
  CONCAT(CASE WHEN n % 47 = 0 THEN '7' WHEN n % 3 = 0 THEN '6' WHEN n % 3 = 1 THEN '0' ELSE '8' END, LPAD(CAST(n AS VARCHAR(10)), 5, '0')) AS code,
  p_brand, p_type, CAST(p_type AS VARCHAR(20)) AS listing_board, CASE WHEN n % 41 = 0 THEN '' ELSE p_type END AS board_type,
  DATE '1995-01-01' AS listed_date, CASE WHEN n % 25 = 0 THEN DATE '2001-06-30' END AS delisted_date
FROM (SELECT p_brand, p_type, ROW_NUMBER() OVER (ORDER BY p_brand, p_type) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part) d) x
""",
    "stock_daily": """
SELECT r.market, r.code, CAST(DATE_TRUNC('week', l_shipdate) AS DATE) AS trade_date,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)/CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
  MAX(CASE WHEN l_quantity = 1 AND l_tax = 0 THEN 1 ELSE 0 END) = 1 AS is_suspended,
  MAX(CASE WHEN l_returnflag = 'R' AND l_discount = 0.10 AND l_tax = 0.08 THEN 1 ELSE 0 END) = 1 AS is_st
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN stock_ref r ON r.p_brand = part.p_brand AND r.p_type = part.p_type
GROUP BY r.market, r.code, CAST(DATE_TRUNC('week', l_shipdate) AS DATE)
""",
    "membership": """
SELECT p_type AS concept_id, market AS stock_market, code AS stock_code, listed_date AS valid_from,
  CASE WHEN CAST(SUBSTRING(code, 2, 5) AS INT) % 10 = 0 THEN DATE '2000-12-31' END AS valid_to FROM stock_ref
""",
    "concept_daily": """
SELECT m.concept_id, s.trade_date, CAST(SUM(CAST(s.amount AS DECIMAL(18,2))) AS DOUBLE) + CASE WHEN m.concept_id = 'PROMO' THEN 100.0 ELSE 0.0 END AS amount
FROM stock_daily s JOIN membership m ON m.stock_market = s.market AND m.stock_code = s.code
 AND m.valid_from <= s.trade_date AND (m.valid_to IS NULL OR m.valid_to >= s.trade_date)
WHERE NOT s.is_suspended AND NOT s.is_st GROUP BY m.concept_id, s.trade_date
""",
    "bars_minute": """
SELECT event_type AS code, DATE_TRUNC('minute', ts) AS bar_time, MIN_BY(value, event_id) AS open, MAX(value) AS high,
  MIN(value) AS low, MAX_BY(value, event_id) AS close, COUNT(*) AS volume, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM events GROUP BY event_type, DATE_TRUNC('minute', ts)
""",
    "holder_counts": """
SELECT c_nationkey AS code, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS trade_date, COUNT(DISTINCT o_custkey) AS holder_count
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(DATE_TRUNC('month', o_orderdate) AS DATE)
""",
    "news": """
SELECT event_id, CAST(ts AS DATE) AS trade_date, ts AS announcement_time, event_type, CAST(FLOOR(value / 100) AS INT) + 1 AS importance_score, user_id AS stock_code FROM events
""",
    # -- further tables of the contract and the checks --
    "stock_changes": """
SELECT *, close - pre_close AS change, (close - pre_close) / NULLIF(pre_close, 0) * 100 AS pct_chg
FROM (SELECT *, LAG(close) OVER (PARTITION BY market, code ORDER BY trade_date) AS pre_close FROM stock_daily)
""",
    "type_bars": """
SELECT code, trade_date, (low + high) / 2 AS open, high, low, close, volume, amount, pre_close, close - pre_close AS change, (close - pre_close) / pre_close * 100 AS pct_chg
FROM (SELECT *, LAG(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre_close FROM bars_daily)
""",
    "brand_bars": """
SELECT code AS board_code, trade_date, (low + high) / 2 AS open, high, low, close, volume, amount, pre_close, close - pre_close AS change, (close - pre_close) / pre_close * 100 AS pct_chg
FROM (SELECT *, LAG(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre_close FROM bars_sparse)
""",
    "faulty_bars": """
SELECT code, trade_date, CASE WHEN CAST(volume AS BIGINT) % 97 = 0 THEN high + 1 ELSE (low + high) / 2 END AS open, high, low, close,
  CASE WHEN CAST(volume AS BIGINT) % 89 = 0 THEN -volume ELSE volume END AS volume, amount,
  CASE WHEN CAST(volume AS BIGINT) % 83 = 0 THEN CAST('NaN' AS DOUBLE) WHEN CAST(volume AS BIGINT) % 79 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN CAST(volume AS BIGINT) % 73 = 0 THEN NULL ELSE amount END AS inflow,
  CASE WHEN code = 'Brand#9' AND CAST(volume AS BIGINT) % 71 = 0 THEN '2d' ELSE '1d' END AS freq
FROM bars_sparse
""",
    "reports_f": """
SELECT c_nationkey AS code, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) AS report_period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
  COUNT(*) AS order_count, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) + 20 AS announcement_date
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL
""",
    "reports_p": """
SELECT c_nationkey AS code, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) AS report_period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
  COUNT(*) AS order_count, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) + 20 AS announcement_date
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY ALL
""",
}
NEEDS = {
    "stock_daily": ("stock_ref",),
    "membership": ("stock_ref",),
    "concept_daily": ("stock_ref", "stock_daily", "membership"),
    "stock_changes": ("stock_ref", "stock_daily"),
    "type_bars": ("bars_daily",),
    "brand_bars": ("bars_sparse",),
    "faulty_bars": ("bars_sparse",),
}


def with_tables(names: str, body: str) -> str:
    """``body`` with the named tables and what they need as CTEs in front."""
    ordered: list[str] = []
    for name in names.split():
        for needed in (*NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{name} AS ({TABLES[name]})" for name in ordered]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
