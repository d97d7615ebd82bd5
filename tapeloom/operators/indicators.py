"""Technical indicators for all entities in one pass.

All windows share one partitioning and one ordering, so a chain of indicators costs one shuffle and one sort.
Rolling values are null until the frame holds ``n`` non-null values. A daily series holds at most one row per
trading day, which bounds the group a task sees; longer series go through ``technical_by_segment``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio, to_double
from tapeloom.operators.selection import drop_flagged_rows
from tapeloom.operators.series import cut_segments, series_window, with_halo

# Output columns of the technical table.
TECHNICAL_FIELDS = (
    "code", "trade_date", "adjust", "ma5", "ma10", "ma20", "ma60", "ema12", "ema26", "dif", "dea", "macd",
    "rsi6", "rsi12", "rsi24", "kdj_k", "kdj_d", "kdj_j", "boll_upper", "boll_mid", "boll_lower",
)

# exp(-37) is below half a unit in the last place of a double.
NEGLIGIBLE = 37.0


def rolling(function, value: str | Column, window: WindowSpec, n: int) -> Column:
    """``function`` over the last ``n`` rows, null unless all ``n`` values are present."""
    value = F.col(value) if isinstance(value, str) else value
    frame = window.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, function(value).over(frame))


def sma(df: DataFrame, keys: Sequence[str], time: str, spans: Sequence[int] = (5, 10, 20, 60), value: str = "close", prefix: str = "ma") -> DataFrame:
    window = series_window(keys, time)
    return df.withColumns({f"{prefix}{n}": rolling(F.avg, value, window, n) for n in spans})


def look_back(alpha: float) -> int:
    """Rows after which an exponential weight no longer changes a double."""
    return math.ceil(NEGLIGIBLE / -math.log(1.0 - alpha))


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def com_alpha(com: float) -> float:
    return 1.0 / (1.0 + com)


def _add_steps(work: DataFrame, outputs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Affine step y -> p·y + q of each row with a value, null elsewhere; needs ``_i`` and the ``_prev_`` positions."""
    steps: dict[str, Column] = {}
    for out, (x, alpha) in outputs.items():
        old = F.pow(F.lit(1.0 - alpha), (F.col("_i") - F.col(f"_prev_{x}")).cast("double"))
        first, value = F.col(f"_prev_{x}").isNull(), F.col(x).cast("double")
        # The first value forgets everything before it.
        steps[f"_p_{out}"] = F.when(value.isNotNull(), F.when(first, F.lit(0.0)).otherwise(old / (old + alpha)))
        steps[f"_q_{out}"] = F.when(value.isNotNull(), F.when(first, value).otherwise(value * alpha / (old + alpha)))
    return work.withColumns(steps)


def _compose(work: DataFrame, keys: Sequence[str], order: str, alphas: Mapping[str, float]) -> DataFrame:
    """Replace each step by the composition of all steps before it and itself, as far back as a double can tell.

    Three lags of the composition so far reach four times as far back. Lags skip rows without a step, so a run of nulls
    of any length costs nothing, and the look-back counts values, each of which shrinks the past by 1 - alpha or more.
    """
    over = f"OVER (PARTITION BY {', '.join(f'`{key}`' for key in keys)} ORDER BY `{order}`)"
    reach = 1
    while active := [out for out, alpha in alphas.items() if reach < look_back(alpha)]:
        composed: dict[str, Column] = {}
        for out in active:
            # Before the series every step is the identity.
            p = [f"`_p_{out}`", *(f"lag(`_p_{out}`, {k * reach}, 1D) IGNORE NULLS {over}" for k in (1, 2, 3))]
            q = [f"`_q_{out}`", *(f"lag(`_q_{out}`, {k * reach}, 0D) IGNORE NULLS {over}" for k in (1, 2, 3))]
            composed[f"_q_{out}"] = F.expr(f"{q[0]} + {p[0]} * ({q[1]} + {p[1]} * ({q[2]} + {p[2]} * {q[3]}))")
            composed[f"_p_{out}"] = F.expr(" * ".join(p))
        work = work.withColumns(composed)
        reach *= 4
    return work


def ewm_mean(df: DataFrame, keys: Sequence[str], time: str, outputs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Recursive exponential means: ``outputs`` maps a new column to (input column, alpha).

    y0 = x0, then y = (1-a)·y + a·x. A null input repeats y, and a value after g-1 nulls is weighted against
    (1-a)^g, renormalised; leading nulls stay null.

    Each value is the affine step y -> p·y + q. Steps compose, so the cost per row is logarithmic in the look-back,
    with no arrays and no Python, and all outputs share every round's window.
    """
    window = series_window(keys, time)
    keep = list(df.columns)
    before, until = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.unboundedPreceding, 0)
    work = df.withColumn("_i", F.row_number().over(window)).withColumns(
        {f"_prev_{x}": F.max(F.when(F.col(x).isNotNull(), F.col("_i"))).over(before) for x in _inputs(outputs)}
    )
    work = _compose(_add_steps(work, outputs), keys, time, {out: alpha for out, (_, alpha) in outputs.items()})
    return work.withColumns({out: F.last(f"_q_{out}", ignorenulls=True).over(until) for out in outputs}).select(*keep, *outputs)


def _inputs(outputs: Mapping[str, tuple[str, float]]) -> list[str]:
    return sorted({name for name, _ in outputs.values()})


def ewm_mean_by_segment(df: DataFrame, keys: Sequence[str], outputs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``ewm_mean`` over rows with ``_segment`` and ``_pos`` (``cut_segments``), for series too long for one task.

    What a segment hands on is small: the place of the last value, and the composition of the segment's steps. These are
    composed along the series, one row per segment, and every segment starts from the carried mean.
    """
    keep = list(df.columns)
    parts = [*keys, "_segment"]
    window, along = series_window(parts, "_pos"), series_window(keys, "_segment")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    before, until = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*parts).agg(*[F.max(F.when(F.col(x).isNotNull(), F.col("_pos"))).alias(f"_end_{x}") for x in _inputs(outputs)])
    carried = ends.select(*parts, *[F.max(f"_end_{x}").over(earlier).alias(f"_carried_{x}") for x in _inputs(outputs)])
    work = df.join(carried, parts).withColumn("_i", F.col("_pos")).withColumns(
        {f"_prev_{x}": F.coalesce(F.max(F.when(F.col(x).isNotNull(), F.col("_i"))).over(before), F.col(f"_carried_{x}")) for x in _inputs(outputs)}
    )
    alphas = {out: alpha for out, (_, alpha) in outputs.items()}
    work = _compose(_add_steps(work, outputs), parts, "_pos", alphas)
    totals = work.groupBy(*parts).agg(*[F.max_by(f"_{k}_{out}", F.when(F.col(f"_p_{out}").isNotNull(), F.col("_pos"))).alias(f"_{k}_{out}") for out in outputs for k in "pq"])
    totals = _compose(totals, keys, "_segment", alphas)
    starts = totals.select(*parts, *[F.last(f"_q_{out}", ignorenulls=True).over(earlier).alias(f"_start_{out}") for out in outputs])
    work = work.join(starts, parts)
    own = {out: F.col(f"_q_{out}") + F.col(f"_p_{out}") * F.coalesce(f"_start_{out}", F.lit(0.0)) for out in outputs}
    work = work.withColumns({f"_q_{out}": value for out, value in own.items()})
    done = {out: F.coalesce(F.last(f"_q_{out}", ignorenulls=True).over(until), F.col(f"_start_{out}")) for out in outputs}
    return work.withColumns(done).select(*keep, *outputs)


def ema(df: DataFrame, keys: Sequence[str], time: str, spans: Sequence[int] = (12, 26), value: str = "close") -> DataFrame:
    return ewm_mean(df, keys, time, {f"ema{n}": (value, span_alpha(n)) for n in spans})


def macd(df: DataFrame, keys: Sequence[str], time: str, value: str = "close") -> DataFrame:
    """DIF = EMA12 - EMA26, DEA = EMA9 of DIF, MACD = 2 (DIF - DEA)."""
    work = ema(df, keys, time, (12, 26), value).withColumn("dif", F.col("ema12") - F.col("ema26"))
    work = ewm_mean(work, keys, time, {"dea": ("dif", span_alpha(9))})
    return work.withColumn("macd", (F.col("dif") - F.col("dea")) * 2)


def _gain_loss(df: DataFrame, window: WindowSpec, value: str) -> DataFrame:
    delta = F.col(value) - F.lag(value).over(window)
    return df.withColumn("_delta", delta).withColumns(
        {
            "_gain": F.when(F.col("_delta").isNotNull(), F.greatest(F.col("_delta"), F.lit(0.0))),
            "_loss": F.when(F.col("_delta").isNotNull(), F.greatest(-F.col("_delta"), F.lit(0.0))),
        }
    )


def _rsi_of(window: WindowSpec, n: int) -> Column:
    return 100 - 100 / (1 + ratio(rolling(F.avg, "_gain", window, n), rolling(F.avg, "_loss", window, n)))


def rsi(df: DataFrame, keys: Sequence[str], time: str, spans: Sequence[int] = (6, 12, 24), value: str = "close") -> DataFrame:
    """RSI on simple rolling means of gains and losses; null while the mean loss is zero."""
    window = series_window(keys, time)
    work = _gain_loss(df, window, value)
    return work.withColumns({f"rsi{n}": _rsi_of(window, n) for n in spans}).drop("_delta", "_gain", "_loss")


def _rsv(window: WindowSpec, n: int = 9) -> Column:
    low, high = rolling(F.min, "low", window, n), rolling(F.max, "high", window, n)
    return ratio(F.col("close") - low, high - low) * 100


def kdj(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """RSV over 9 rows, K and D as recursive means with alpha 1/3, J = 3K - 2D; a zero range gives a null RSV."""
    work = df.withColumn("rsv", _rsv(series_window(keys, time)))
    work = ewm_mean(work, keys, time, {"kdj_k": ("rsv", com_alpha(2))})
    work = ewm_mean(work, keys, time, {"kdj_d": ("kdj_k", com_alpha(2))})
    return work.withColumn("kdj_j", F.col("kdj_k") * 3 - F.col("kdj_d") * 2)


def _bands(window: WindowSpec, value: str, n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, spread = rolling(F.avg, value, window, n), rolling(F.stddev_samp, value, window, n)
    return {"boll_upper": mid + spread * width, "boll_mid": mid, "boll_lower": mid - spread * width}


def bollinger(df: DataFrame, keys: Sequence[str], time: str, value: str = "close") -> DataFrame:
    """20-row mean and the mean plus and minus two sample standard deviations."""
    return df.withColumns(_bands(series_window(keys, time), value))


def _rolling_columns(window: WindowSpec) -> dict[str, Column]:
    return {
        **{f"ma{n}": rolling(F.avg, "close", window, n) for n in (5, 10, 20, 60)},
        **{f"rsi{n}": _rsi_of(window, n) for n in (6, 12, 24)},
        **_bands(window, "close"),
    }


# Recursive means of the technical table: those of prices first, then those of their results.
FIRST_MEANS = {"ema12": ("close", span_alpha(12)), "ema26": ("close", span_alpha(26)), "kdj_k": ("rsv", com_alpha(2))}
SECOND_MEANS = {"dea": ("dif", span_alpha(9)), "kdj_d": ("kdj_k", com_alpha(2))}


def _technical(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The recursive means come first, while rows are narrow; the rolling columns are added last."""
    window = series_window(keys, time)
    work = ewm_mean(df.withColumn("rsv", _rsv(window)), keys, time, FIRST_MEANS).drop("rsv", "high", "low")
    work = ewm_mean(work.withColumn("dif", F.col("ema12") - F.col("ema26")), keys, time, SECOND_MEANS)
    return _last_columns(_gain_loss(work, window, "close").withColumns(_rolling_columns(window)))


def _last_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"macd": (F.col("dif") - F.col("dea")) * 2, "kdj_j": F.col("kdj_k") * 3 - F.col("kdj_d") * 2})


def _clean(bars: DataFrame) -> DataFrame:
    if "is_suspended" in bars.columns:
        bars = drop_flagged_rows(bars, "is_suspended")
    return bars.withColumns({name: to_double(F.col(name)) for name in ("close", "high", "low")})


def technical(bars: DataFrame, adjust: str = "none") -> DataFrame:
    """All indicators of (code, trade_date) bars; suspended rows are left out first."""
    work = _clean(bars).select("code", "trade_date", "close", "high", "low")
    return _technical(work, ["code"], "trade_date").withColumn("adjust", F.lit(adjust)).select(*TECHNICAL_FIELDS)


def technical_by_segment(bars: DataFrame, adjust: str = "none", block: Column | None = None, rows: int = 4096) -> DataFrame:
    """``technical`` over pieces of each series, for series too long for one task.

    Rolling columns look back 60 rows at most and take a halo of that; recursive means, which have no such bound where
    values are missing, are carried from piece to piece. ``block`` groups the time axis for numbering the rows
    (default: calendar year).
    """
    work = _clean(bars).select("code", "trade_date", "close", "high", "low")
    cut = cut_segments(work, ["code"], "trade_date", F.year("trade_date") if block is None else block, rows)

    def rolled(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = series_window(keys, "_pos")
        return _gain_loss(pieces, window, "close").withColumns({**_rolling_columns(window), "rsv": _rsv(window)}).drop("high", "low", "_delta", "_gain", "_loss")

    work = ewm_mean_by_segment(with_halo(cut, ["code"], 60, rows, rolled), ["code"], FIRST_MEANS).drop("rsv")
    work = ewm_mean_by_segment(work.withColumn("dif", F.col("ema12") - F.col("ema26")), ["code"], SECOND_MEANS)
    return _last_columns(work).withColumn("adjust", F.lit(adjust)).select(*TECHNICAL_FIELDS)
