from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import indicators as I
from tapeloom.operators.series import cut_segments, over_segments, previous_change, row_positions


def series(spark, values, code="a", name="close"):
    start = dt.date(2020, 1, 1)
    rows = [(code, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"code string, trade_date date, {name} double")


def values(df, column):
    return [row[column] for row in df.orderBy("code", "trade_date").collect()]


def close_to(actual, expected, tolerance=1e-9):
    assert len(actual) == len(expected)
    for a, e in zip(actual, expected):
        assert (a is None) == (e is None or (isinstance(e, float) and math.isnan(e))), (actual, expected)
        if a is not None:
            assert abs(a - e) <= tolerance * max(1.0, abs(e)), (a, e)


def mean(spark, data, alpha):
    return values(I.ewm_mean(series(spark, data), ["code"], "trade_date", {"y": ("close", alpha)}), "y")


def test_recursive_mean_weights_interior_nulls(spark):
    close_to(mean(spark, [1, 2, None, 4, 5], 1 / 3), [1, 4 / 3, 4 / 3, 2.476190476, 3.317460317], 1e-8)


def test_recursive_mean_skips_leading_nulls(spark):
    close_to(mean(spark, [None, None, 3, 6], 0.5), [None, None, 3.0, 4.5])


def test_recursive_mean_of_sparse_series_matches_pandas(spark):
    random = np.random.default_rng(3)
    data = [None if random.random() < 0.85 else float(x) for x in random.normal(100, 30, 900)]
    for alpha in (1 / 3, 2 / 27):
        expected = pd.Series([math.nan if x is None else x for x in data]).ewm(alpha=alpha, adjust=False).mean()
        close_to(mean(spark, data, alpha), list(expected), 1e-11)


def test_recursive_mean_of_long_dense_series(spark):
    data = np.random.default_rng(5).normal(1000, 300, 3000)
    expected = pd.Series(data).ewm(span=26, adjust=False).mean()
    close_to(mean(spark, data, I.span_alpha(26)), list(expected), 1e-11)


def numbered(spark, data):
    return spark.createDataFrame([("x", i, None if x is None or math.isnan(x) else float(x)) for i, x in enumerate(data)], "code string, n int, close double")


@pytest.mark.parametrize("plan", ["whole", "segments"])
def test_recursive_mean_across_a_gap_of_17000_rows(spark, plan):
    """No bound on history: the mean is carried over any run of nulls, and the value after it is weighted by its length."""
    data = np.full(20_000, math.nan)
    data[:10], data[17_010:] = 5.0, np.random.default_rng(2).normal(7, 1, 2_990)
    outputs = {"y": ("close", 1 / 3), "z": ("close", I.span_alpha(26))}
    df = numbered(spark, data)
    if plan == "whole":
        got = I.ewm_mean(df, ["code"], "n", outputs)
    else:
        got = I.ewm_mean_by_segment(cut_segments(df, ["code"], "n", (F.col("n") / 3000).cast("int"), 1024), ["code"], outputs)
    rows = got.orderBy("n").collect()
    for name, (_, alpha) in outputs.items():
        close_to([row[name] for row in rows], list(pd.Series(data).ewm(alpha=alpha, adjust=False).mean()), 1e-11)
    assert rows[16_999].y == 5.0


def test_segments_carry_values_over_a_long_flat_run(spark):
    """Minute bars flat for longer than two segments have no RSV there; K and D are those of the whole series."""
    close = 100 + np.cumsum(np.random.default_rng(4).normal(0, 1, 3000))
    close[101:2499] = close[101]
    rows = [("x", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(c), float(c), float(c)) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "code string, trade_date timestamp_ntz, close double, high double, low double")
    whole = I.technical(bars).orderBy("trade_date").collect()
    cut = I.technical_by_segment(bars, block=F.col("trade_date").cast("date"), rows=512).orderBy("trade_date").collect()
    for name in I.TECHNICAL_FIELDS[3:]:
        close_to([row[name] for row in cut], [row[name] for row in whole])
    assert whole[2000].kdj_k is not None


def test_sample_deviation(spark):
    df = series(spark, [1, 2, 4]).withColumn("s", I.rolling(F.stddev_samp, "close", I.series_window(["code"], "trade_date"), 3))
    close_to(values(df, "s"), [None, None, 1.527525], 1e-6)


def test_moving_average_needs_all_values(spark):
    df = I.sma(series(spark, [1, 2, None, 4, 5, 6, 7, 8]), ["code"], "trade_date", (3,))
    close_to(values(df, "ma3"), [None, None, None, None, None, 5, 6, 7])


def test_rsi_is_null_without_losses(spark):
    df = I.rsi(series(spark, range(1, 11)), ["code"], "trade_date", (6,))
    assert values(df, "rsi6") == [None] * 10


def test_zero_range_gives_null_and_keeps_k(spark):
    flat = series(spark, [5] * 12 + [6, 7, 8]).withColumns({"low": F.col("close"), "high": F.col("close")})
    rows = I.kdj(flat, ["code"], "trade_date").orderBy("trade_date").collect()
    assert [row.rsv for row in rows[:12]] == [None] * 12
    assert rows[12].rsv == 100.0 and rows[12].kdj_k == 100.0


def reference(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("trade_date").reset_index(drop=True)
    close = frame["close"]
    out = frame[["code", "trade_date"]].copy()
    for n in (5, 10, 20, 60):
        out[f"ma{n}"] = close.rolling(n).mean()
    out["ema12"], out["ema26"] = close.ewm(span=12, adjust=False).mean(), close.ewm(span=26, adjust=False).mean()
    out["dif"] = out.ema12 - out.ema26
    out["dea"] = out.dif.ewm(span=9, adjust=False).mean()
    out["macd"] = 2 * (out.dif - out.dea)
    change = close.diff()
    for n in (6, 12, 24):
        loss = change.clip(upper=0).abs().rolling(n).mean()
        out[f"rsi{n}"] = 100 - 100 / (1 + change.clip(lower=0).rolling(n).mean() / loss.where(loss != 0))
    span = frame["high"].rolling(9).max() - frame["low"].rolling(9).min()
    rsv = (close - frame["low"].rolling(9).min()) / span.where(span != 0) * 100
    out["kdj_k"] = rsv.ewm(com=2, adjust=False).mean()
    out["kdj_d"] = out.kdj_k.ewm(com=2, adjust=False).mean()
    out["kdj_j"] = 3 * out.kdj_k - 2 * out.kdj_d
    mid, spread = close.rolling(20).mean(), close.rolling(20).std()
    out["boll_upper"], out["boll_mid"], out["boll_lower"] = mid + 2 * spread, mid, mid - 2 * spread
    return out


@pytest.fixture(scope="module")
def walks(spark):
    random = np.random.default_rng(11)
    frames = []
    for code, size in (("long", 2500), ("short", 70), ("tiny", 3)):
        close = 100 + np.cumsum(random.normal(0, 1, size))
        wide = random.uniform(0, 2, size)
        days = pd.bdate_range("2010-01-01", periods=size).date
        frames.append(pd.DataFrame({"code": code, "trade_date": days, "close": close, "high": close + wide, "low": close - wide, "is_suspended": random.random(size) < 0.02}))
    frame = pd.concat(frames)
    return frame, spark.createDataFrame(frame, "code string, trade_date date, close double, high double, low double, is_suspended boolean").repartition(5)


@pytest.mark.parametrize("plan", ["whole", "segments"])
def test_technical_table_matches_pandas(walks, plan):
    frame, df = walks
    result = I.technical(df) if plan == "whole" else I.technical_by_segment(df, rows=800)
    actual = result.toPandas().sort_values(["code", "trade_date"]).reset_index(drop=True)
    live = frame[~frame.is_suspended]
    expected = pd.concat([reference(part) for _, part in live.groupby("code")]).sort_values(["code", "trade_date"]).reset_index(drop=True)
    assert list(actual.columns) == list(I.TECHNICAL_FIELDS)
    assert len(actual) == len(expected)
    for name in I.TECHNICAL_FIELDS[3:]:
        assert (actual[name].isna() == expected[name].isna()).all(), name
        assert np.nanmax(np.abs(actual[name] - expected[name])) < 1e-7, name


def test_row_positions_of_a_hot_series(spark):
    """One entity holds most rows; positions are counted over blocks and are those of one sorted series."""
    hot = series(spark, range(1000), "hot").unionByName(series(spark, range(7), "cold"))
    rows = row_positions(hot.repartition(6), ["code"], "trade_date", F.date_trunc("month", "trade_date")).collect()
    assert all(row["_pos"] == int(row["close"]) for row in rows) and len(rows) == 1007


def test_segments_bound_the_group_a_task_sees(spark):
    """No window partition holds more than rows + halo rows, and the result is that of the whole series."""
    hot = series(spark, np.random.default_rng(1).normal(0, 1, 1000), "hot")
    sizes = []

    def compute(pieces, keys):
        sizes.append(pieces.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return previous_change(pieces, keys, "trade_date")

    cut = over_segments(hot, ["code"], "trade_date", F.year("trade_date"), 1, compute, rows=64)
    whole = previous_change(hot, ["code"], "trade_date")
    assert sizes == [65]
    assert values(cut, "change") == values(whole, "change")
