"""Market-data contract: 31 metrics over facts and references on the latest common trading day.

Each table is read with as few passes as its metrics allow; one-row results are unpivoted and unioned into
(metric, actual) rows and compared with their expectations.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalars import blank, differs, garbled_name, ratio, valid_market_code
from tapeloom.operators.lookback import rows_before
from tapeloom.operators.predicates import valid_on
from tapeloom.operators.series import latest_days
from tapeloom.quality.ledger import KeyLedger

# Metric, expected value, operator, title.
EXPECTATIONS = (
    ("first_stage_index_trade_date_count", 6, "eq", "第一阶段核心指数最近 6 根日线"),
    ("first_stage_index_core_null_count", 0, "eq", "第一阶段核心指数核心字段非空"),
    ("first_stage_index_invalid_volume_amount_count", 0, "eq", "第一阶段核心指数成交量和成交额为正"),
    ("first_stage_ref_index_missing_count", 0, "eq", "第一阶段核心指数存在目录元数据"),
    ("first_stage_ref_index_bad_name_count", 0, "eq", "第一阶段核心指数名称有效"),
    ("first_stage_concept_trade_date_count", 3, "eq", "第一阶段概念最近 3 个交易日"),
    ("first_stage_incomplete_concept_count", 0, "eq", "第一阶段概念日线覆盖完整"),
    ("first_stage_concept_core_invalid_count", 0, "eq", "第一阶段概念涨跌幅和成交额有效"),
    ("second_stage_trade_date_count", 8, "eq", "第二阶段概念最近 8 个交易日"),
    ("second_stage_incomplete_concept_count", 0, "eq", "第二阶段概念日线覆盖完整"),
    ("second_stage_null_pct_chg_count", 0, "eq", "第二阶段概念涨跌幅非空"),
    ("second_stage_invalid_amount_count", 0, "eq", "第二阶段概念成交额为正"),
    ("second_stage_missing_member_stock_count", 0, "eq", "第二阶段概念成分匹配当日个股日线"),
    ("second_stage_missing_member_pre_close_count", 0, "eq", "第二阶段概念成分前收完整"),
    ("second_stage_invalid_market_code_count", 0, "eq", "第二阶段概念成分市场和代码前缀一致"),
    ("second_stage_amount_mismatch_count", 0, "eq", "第二阶段概念成交额可由成分股重算一致"),
    ("second_stage_pct_chg_mismatch_count", 0, "eq", "第二阶段概念涨跌幅可由成分股重算一致"),
    ("global_latest_date_mismatch_count", 0, "eq", "核心事实表最新交易日一致"),
    ("global_duplicate_concept_key_count", 0, "eq", "概念日线主键不重复"),
    ("global_duplicate_stock_key_count", 0, "eq", "个股日线主键不重复"),
    ("global_duplicate_board_key_count", 0, "eq", "板块日线主键不重复"),
    ("global_duplicate_index_key_count", 0, "eq", "指数日线主键不重复"),
    ("global_board_daily_core_null_count", 0, "eq", "板块日线当日核心字段非空"),
    ("global_stock_daily_core_null_count", 0, "eq", "个股日线当日核心字段非空"),
    ("global_stock_daily_without_ref_count", 0, "eq", "当日个股日线匹配股票目录"),
    ("global_active_stock_without_daily_count", 0, "eq", "有效股票有当日日线"),
    ("global_missing_board_type_column_count", 0, "eq", "股票目录提供 board_type 字段"),
    ("global_blank_board_type_count", 0, "eq", "股票目录 board_type 非空"),
    ("global_board_type_listing_board_mismatch_count", 0, "eq", "股票目录 board_type 与 listing_board 一致"),
    ("global_index_daily_without_ref_count", 0, "eq", "当日指数日线匹配指数目录"),
    ("global_ref_index_bad_name_count", 0, "eq", "指数目录名称有效"),
)


def any_null(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(name).isNull() for name in columns])


def not_positive(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) <= 0)


def to_metrics(row: DataFrame) -> DataFrame:
    """One-row frame of counts to (metric, actual) rows."""
    counts = row.select(*(F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name) for name in row.columns))
    return counts.unpivot([], counts.columns, "metric", "actual")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def contract_metrics(tables: Mapping[str, DataFrame], index_code: str, max_members: int | None = None, look_back_days: int | None = None, key_ledger: str = "") -> DataFrame:
    """(metric, actual) for the tables index_daily, concept_daily, stock_daily, board_daily, ref_index, ref_stock,
    ref_concept and membership.

    ``max_members`` leaves larger concepts out of the recomputation, and ``look_back_days`` looks for a stock's previous
    bar in so many days only; neither cut is made unless asked for. With ``key_ledger``, a folder, duplicate keys are looked
    for in days that have changed since the last run only (:class:`KeyLedger`). The target day and the (at most eight) latest concept
    days come to the driver, so that every later scan is pruned by literals.
    """
    index, concept, stock, board = (tables[name] for name in ("index_daily", "concept_daily", "stock_daily", "board_daily"))
    ref_index, ref_stock, ref_concept = (tables[name] for name in ("ref_index", "ref_stock", "ref_concept"))
    day = F.col("trade_date")

    # Latest day all facts share; none if one of them is empty.
    maxima = [df.agg(F.max("trade_date").alias("d")) for df in (index.where(F.col("index_code") == index_code), concept, stock, board)]
    target_day = reduce(DataFrame.unionByName, maxima).agg(F.min("d")).first()[0]
    target = F.lit(target_day).cast("date")
    latest = [row.trade_date for row in latest_days(concept, 8, target).collect()]
    first3, first8 = (F.lit(min(latest[:n], default=None)).cast("date") for n in (3, 8))
    one = index.sparkSession.range(1)

    frames = [
        _index_bars(index.where((F.col("index_code") == index_code) & (day <= target))),
        _index_reference(ref_index, index_code),
        to_metrics(one.select(F.lit(len(latest[:3])).alias("first_stage_concept_trade_date_count"), F.lit(len(latest)).alias("second_stage_trade_date_count"))),
        _keys_and_latest({"concept": (concept, ("concept_id",)), "stock": (stock, ("market", "code")), "board": (board, ("board_code",)), "index": (index, ("index_code",))}, target, key_ledger),
        to_metrics(
            board.where(day == target).agg(
                F.count_if(any_null("open", "high", "low", "close", "pre_close", "change", "pct_chg", "amount", "volume")).alias("global_board_daily_core_null_count")
            )
        ),
        _stock_today(stock.where(day == target), ref_stock),
        to_metrics(
            ref_stock.where(valid_on(target, "listed_date", "delisted_date"))
            .join(stock.where(day == target).select("market", "code"), ["market", "code"], "left_anti")
            .agg(F.count("*").alias("global_active_stock_without_daily_count"))
        ),
        _stock_reference(ref_stock),
        to_metrics(
            index.where(day == target).join(ref_index.select("index_code"), "index_code", "left_anti")
            .agg(F.count("*").alias("global_index_daily_without_ref_count"))
        ),
    ]

    active = tables["membership"].where(valid_on(target)).select("concept_id", "stock_market", "stock_code").distinct()
    sizes = active.groupBy("concept_id").agg(F.count("*").alias("members"))
    if max_members is not None:
        sizes = sizes.where(F.col("members") <= max_members)
    named = ref_concept.where(~blank(F.col("name"))).select("concept_id")
    eligible = concept.where(day == target).select("concept_id").join(named, "concept_id").join(sizes, "concept_id").select("concept_id")
    frames.append(_concept_days(concept.where((day >= first8) & (day <= target)), eligible, first3))

    expected = _recomputed(active, eligible, ref_stock, stock, target_day, look_back_days)
    frames.append(
        to_metrics(
            expected.agg(
                F.sum("missing").alias("second_stage_missing_member_stock_count"),
                F.sum("without_pre_close").alias("second_stage_missing_member_pre_close_count"),
                F.sum("bad_code").alias("second_stage_invalid_market_code_count"),
            )
        )
    )
    stored = concept.where(day == target).select("concept_id", "amount", "pct_chg").join(eligible, "concept_id")
    compared = stored.join(expected.select("concept_id", "expected_amount", "expected_pct"), "concept_id")
    frames.append(
        to_metrics(
            compared.agg(
                F.count_if(
                    F.col("expected_amount").isNull() | differs(F.col("amount"), F.col("expected_amount"), relative=1e-6, absolute=1.0)
                ).alias("second_stage_amount_mismatch_count"),
                F.count_if(
                    F.col("expected_pct").isNull() | differs(F.col("pct_chg"), F.col("expected_pct"), absolute=0.001)
                ).alias("second_stage_pct_chg_mismatch_count"),
            )
        )
    )
    return reduce(DataFrame.unionByName, frames)


def _index_bars(bars: DataFrame) -> DataFrame:
    latest = bars.orderBy(F.col("trade_date").desc()).limit(6)
    return to_metrics(
        latest.agg(
            F.count("*").alias("first_stage_index_trade_date_count"),
            F.count_if(any_null("open", "high", "low", "close", "pre_close", "volume", "amount", "pct_chg")).alias("first_stage_index_core_null_count"),
            F.count_if((F.col("volume") <= 0) | (F.col("amount") <= 0)).alias("first_stage_index_invalid_volume_amount_count"),
        )
    )


def _index_reference(ref_index: DataFrame, index_code: str) -> DataFrame:
    wanted, bad = F.col("index_code") == index_code, garbled_name(F.col("index_name"))
    return to_metrics(
        ref_index.agg(
            F.when(F.count_if(wanted) > 0, 0).otherwise(1).alias("first_stage_ref_index_missing_count"),
            F.count_if(wanted & bad).alias("first_stage_ref_index_bad_name_count"),
            F.count_if(bad).alias("global_ref_index_bad_name_count"),
        )
    )


def _keys_and_latest(facts: Mapping[str, tuple[DataFrame, Sequence[str]]], target: Column, key_ledger: str) -> DataFrame:
    """Duplicate keys and latest day of every fact: from one pass over its key columns, or from the ledger of its keys."""
    rows = []
    for name, (df, keys) in facts.items():
        if key_ledger:
            ledger = KeyLedger(df.sparkSession, f"{key_ledger.rstrip('/')}/{name}", [*keys, "trade_date"])
            duplicates = ledger.update(df).agg(F.count("*").alias("duplicates"))
            latest = ledger.days().where(F.col("day") <= target).agg(F.max("day").alias("latest"))
            rows.append(duplicates.select("duplicates", latest.scalar().alias("latest"), F.lit(name).alias("fact")))
            continue
        groups = df.groupBy(*keys, "trade_date").agg(F.count("*").alias("copies"))
        rows.append(
            groups.agg(
                F.count_if(F.col("copies") > 1).alias("duplicates"), F.max(F.when(F.col("trade_date") <= target, F.col("trade_date"))).alias("latest")
            ).withColumn("fact", F.lit(name))
        )
    both = reduce(DataFrame.unionByName, rows)
    duplicates = [F.max(F.when(F.col("fact") == name, F.col("duplicates"))).alias(f"global_duplicate_{name}_key_count") for name in facts]
    mismatch = F.when(F.count_distinct("latest") == 1, 0).otherwise(1).alias("global_latest_date_mismatch_count")
    return to_metrics(both.agg(*duplicates, mismatch))


def _stock_today(today: DataFrame, ref_stock: DataFrame) -> DataFrame:
    known = ref_stock.select("market", "code").distinct().withColumn("_known", F.lit(True))
    return to_metrics(
        today.join(known, ["market", "code"], "left").agg(
            F.count_if(any_null("close", "pre_close", "pct_chg", "amount")).alias("global_stock_daily_core_null_count"),
            F.count_if(F.col("_known").isNull()).alias("global_stock_daily_without_ref_count"),
        )
    )


def _stock_reference(ref_stock: DataFrame) -> DataFrame:
    has_column = "board_type" in ref_stock.columns
    board_type = F.coalesce(F.col("board_type"), F.lit("")) if has_column else F.lit("")
    return to_metrics(
        ref_stock.agg(
            F.lit(0 if has_column else 1).alias("global_missing_board_type_column_count"),
            F.count_if(board_type == "").alias("global_blank_board_type_count"),
            F.count_if(board_type != F.coalesce(F.col("listing_board"), F.lit(""))).alias("global_board_type_listing_board_mismatch_count"),
        )
    )


def _concept_days(recent: DataFrame, eligible: DataFrame, first3: Column) -> DataFrame:
    """Coverage and validity of eligible concepts over the latest 3 and 8 days, reduced per concept first."""
    in3 = F.col("trade_date") >= first3
    per_concept = recent.groupBy("concept_id").agg(
        F.count("*").alias("n8"), F.count_if(in3).alias("n3"),
        F.count_if(F.col("pct_chg").isNull()).alias("null_pct8"), F.count_if(not_positive("amount")).alias("bad_amount8"),
        F.count_if(in3 & (F.col("pct_chg").isNull() | not_positive("amount"))).alias("invalid3"),
    )
    copies = eligible.groupBy("concept_id").agg(F.count("*").alias("k"))
    joined = copies.join(per_concept, "concept_id", "left").fillna(0)
    return to_metrics(
        joined.agg(
            F.count_if(F.col("k") * F.col("n3") != 3).alias("first_stage_incomplete_concept_count"),
            F.sum(F.col("k") * F.col("invalid3")).alias("first_stage_concept_core_invalid_count"),
            F.count_if(F.col("k") * F.col("n8") != 8).alias("second_stage_incomplete_concept_count"),
            F.sum(F.col("k") * F.col("null_pct8")).alias("second_stage_null_pct_chg_count"),
            F.sum(F.col("k") * F.col("bad_amount8")).alias("second_stage_invalid_amount_count"),
        )
    )


def weighted_pct(live: Column) -> Column:
    """Amount-weighted mean of pct_chg over live rows with a pct_chg and a positive amount."""
    usable = live & F.col("pct_chg").isNotNull() & (F.col("amount") > 0)
    return ratio(F.sum(F.when(usable, F.col("pct_chg") * F.col("amount"))), F.sum(F.when(usable, F.col("amount"))))


def live_row() -> Column:
    return ~F.coalesce(F.col("is_suspended"), F.lit(False)) & ~F.coalesce(F.col("is_st"), F.lit(False))


def _recomputed(active: DataFrame, eligible: DataFrame, ref_stock: DataFrame, stock: DataFrame, day: dt.date | None, look_back_days: int | None) -> DataFrame:
    """Per concept: amount and weighted change recomputed from its members, and the members' faults.

    The previous close of each stock of the day may be of any age, unless ``look_back_days`` says otherwise.
    """
    target = F.lit(day).cast("date")
    alive = ref_stock.where(valid_on(target, "listed_date", "delisted_date")).select(F.col("market").alias("stock_market"), F.col("code").alias("stock_code"))
    members = active.join(eligible, "concept_id").join(alive, ["stock_market", "stock_code"])
    today = stock.where(F.col("trade_date") == target)
    closes = stock.select("market", "code", "trade_date", F.col("close").alias("pre_close"))
    if day is None:
        before = closes.limit(0)
    else:
        before = rows_before(closes, today, ["market", "code"], day, oldest=None if look_back_days is None else day - dt.timedelta(days=look_back_days))
    before = before.drop("trade_date")
    today = today.drop("pre_close").join(before, ["market", "code"], "left").select(
        F.col("market").alias("stock_market"), F.col("code").alias("stock_code"), "trade_date", "close", "pct_chg", "amount", "is_st", "is_suspended",
        "pre_close", F.lit(True).alias("_bar"),
    )
    joined = members.join(today, ["stock_market", "stock_code"], "left")
    counted = live_row() & F.col("close").isNotNull() & F.col("pre_close").isNotNull() & (F.col("amount") > 0)
    return joined.groupBy("concept_id").agg(
        F.sum(F.when(counted, F.col("amount"))).alias("expected_amount"),
        weighted_pct(live_row()).alias("expected_pct"),
        F.count_if(F.col("_bar").isNull()).alias("missing"),
        F.count_if(F.col("_bar").isNotNull() & F.col("pre_close").isNull()).alias("without_pre_close"),
        F.count_if(~valid_market_code(F.col("stock_market"), F.col("stock_code"))).alias("bad_code"),
    )


def compare_expectations(metrics: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Attach expectation and outcome to (metric, actual) rows; a metric without a rule is expected to be 0."""
    wanted = {name: (expected, operator, title) for name, expected, operator, title in EXPECTATIONS}
    if names:
        metrics = metrics.where(F.col("metric").isin(list(names)))

    def rule(position: int, default: Column) -> Column:
        pairs = [F.lit(part) for name, values in wanted.items() for part in (name, values[position])]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("metric")), default)

    ruled = metrics.withColumns(
        {"expected": rule(0, F.lit(0)).cast("long"), "operator": rule(1, F.lit("eq")), "title": rule(2, F.col("metric"))}
    )
    passed = F.when(F.col("operator") == "gte", F.col("actual") >= F.col("expected")).otherwise(F.col("actual") == F.col("expected"))
    return ruled.withColumn("status", F.when(passed, "healthy").otherwise("unhealthy"))
