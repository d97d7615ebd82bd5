"""Rows before a window: equal to a look at all history, and read no further back than needed."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import lookback
from tapeloom.operators.lookback import rows_before
from tapeloom.plans.views import query_view
from tapeloom.sources.store import MarketStore

DAY = dt.date(2024, 3, 1)


def history(seed, codes=40, span=4000):
    """(market, code, day, close): some codes trade daily, some paused for years, some have no earlier row."""
    draw, rows = random.Random(seed), []
    for k in range(codes):
        days = sorted(draw.sample(range(1, span), draw.choice([0, 1, 3, 60])), reverse=True)
        if k % 3 == 0:
            days = [d for d in days if d > span // 2]
        rows += [("m" if k % 2 else "n", f"c{k // 2}", DAY - dt.timedelta(days=d), float(d)) for d in days]
        rows.append(("m" if k % 2 else "n", f"c{k // 2}", DAY, 0.0))
    return rows


@pytest.mark.parametrize("seed, count, oldest, literals", [(1, 1, None, 500), (2, 7, None, 3), (3, 39, None, 500), (4, 5, 300, 0)])
def test_rows_equal_those_of_all_history(spark, monkeypatch, seed, count, oldest, literals):
    monkeypatch.setattr(lookback, "LITERAL_KEYS", literals)
    rows = history(seed)
    table = spark.createDataFrame(rows, "market string, code string, trade_date date, close double")
    wanted = table.where((F.col("trade_date") == F.lit(DAY)) & (F.col("code") != "c3")).unionByName(spark.createDataFrame([(None, "c1", DAY, 0.0), ("m", "new", DAY, 0.0)], table.schema))
    first = None if oldest is None else DAY - dt.timedelta(days=oldest)
    got = rows_before(table, wanted, ["market", "code"], DAY, count, oldest=first)
    assert got.columns == table.columns
    expected = []
    for key in {(m, c) for m, c, *_ in rows if c != "c3"}:
        mine = sorted((r for r in rows if r[:2] == key and r[2] < DAY and (first is None or r[2] >= first)), key=lambda r: r[2])
        expected += mine[-count:]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_no_rows_and_no_keys(spark):
    table = spark.createDataFrame(history(5), "market string, code string, trade_date date, close double")
    assert rows_before(table.limit(0), table, ["market", "code"], DAY).count() == 0
    assert rows_before(table, table.limit(0), ["market", "code"], DAY).count() == 0


BAR = "code string, trade_date date, open double, high double, low double, close double, volume double, amount double, is_suspended boolean, is_st boolean"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Ten years of daily bars stored by day; code z last traded six years ago. Days of the first five years cannot be read."""
    root = tmp_path_factory.mktemp("daily")
    days = spark.range(3650).select(F.date_sub(F.lit(DAY), F.col("id").cast("int")).alias("trade_date"), F.col("id").alias("back")).where("back % 7 < 5 and (back < 900 or back % 50 = 0)")
    rows = days.crossJoin(spark.createDataFrame([("a",), ("b",), ("z",)], "code string")).where("code <> 'z' or back > 2200")
    bars = rows.selectExpr("code", "trade_date", "1D as open", "2D as high", "0D as low", "cast(back as double) as close", "1D as volume", "1D as amount", "false as is_suspended", "false as is_st")
    store = MarketStore(spark, str(root))
    store.write("fact.stock_daily_1d", bars, "trade_date")
    broken = 0
    for folder in (root / "fact" / "stock_daily_1d").glob("trade_date=*"):
        if folder.name.split("=")[1] < "2019-01-01":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"no parquet at all")
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
                broken += 1
    assert broken > 20
    schema = spark.createDataFrame([], BAR).schema
    daily = spark.read.schema(schema).parquet(f"{root}/fact/stock_daily_1d")
    ones = {name: F.lit(1.0) for name in ("volume_shares", "active_buy_amount", "float_market_cap", "free_float_shares", "upper_limit", "lower_limit", "listing_board", "dividend_yield_pct", "circulating_shares")}
    return MarketStore(spark, tables={"fact.stock_daily_1d": daily, "stocks.factors.strategy_window": daily.withColumns(ones)})


def test_a_full_market_snapshot_reads_few_days(stored):
    got = query_view(stored, "stocks.quotes.daily_snapshot", trade_date="2024-03-01").collect()
    assert [(r.code, r.close, r.pre_close) for r in got] == [("a", 0.0, 1.0), ("b", 0.0, 1.0)]
    window = query_view(stored, "stocks.quotes.daily_local_window", start_date="2024-02-28", end_date="2024-03-01").collect()
    assert {(r.code, str(r.trade_time), r.pre_close) for r in window if str(r.trade_time) == "2024-02-28"} == {("a", "2024-02-28", 3.0), ("b", "2024-02-28", 3.0)}
    factors = query_view(stored, "stocks.factors.strategy_window", start_date="2024-02-28", end_date="2024-03-01").collect()
    assert len(factors) == 6 and all(r.ma40 is not None for r in factors)


def test_what_needs_old_days_reads_them(stored, spark):
    table = stored.table("fact.stock_daily_1d")
    with pytest.raises(Exception, match="parquet"):
        rows_before(table, spark.createDataFrame([("z",)], "code string"), ["code"], DAY).collect()
