"""Rule-driven data-quality checks.

Rules are configuration; tables are DataFrames by name. All row-level rules of one table over the recent window
fold into one aggregate over it; key and reference rules are one aggregation or anti join each. The result is a
lazy frame of check rows (check_id, title, status, result_text, error_text).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalars import invalid_number
from tapeloom.operators.predicates import recent
from tapeloom.operators.series import open_days
from tapeloom.quality.contract import compare_expectations, contract_metrics, duplicate_keys
from tapeloom.quality.ledger import KeyLedger

# Primary key of each known table.
PRIMARY_KEYS = {
    "fact.stock_daily_1d": ("market", "code", "trade_date"),
    "fact.stock_bar_1m": ("market", "code", "bar_time"),
    "fact.stock_bar_30m": ("market", "code", "bar_time"),
    "fact.index_bar_1d": ("index_code", "trade_date"),
    "fact.board_daily_1d": ("board_code", "trade_date"),
    "fact.concept_daily_1d": ("concept_id", "trade_date"),
    "ref.trade_calendar": ("exchange", "trade_date"),
    "ref.stock": ("market", "code"),
    "ref.stock_name_history": ("market", "code", "valid_from"),
    "ref.concept": ("concept_id",),
    "ref.concept_stock_membership": ("concept_id", "stock_market", "stock_code", "valid_from"),
    "ref.index": ("index_code",),
}
# Time column of each fact table.
TIME_COLUMNS = {
    "fact.stock_daily_1d": "trade_date",
    "fact.stock_bar_1m": "bar_time",
    "fact.stock_bar_30m": "bar_time",
    "fact.index_bar_1d": "trade_date",
    "fact.board_daily_1d": "trade_date",
    "fact.concept_daily_1d": "trade_date",
}
# Tables of the market-data contract and their short names.
CONTRACT_TABLES = {
    "fact.index_bar_1d": "index_daily",
    "fact.concept_daily_1d": "concept_daily",
    "fact.stock_daily_1d": "stock_daily",
    "fact.board_daily_1d": "board_daily",
    "ref.index": "ref_index",
    "ref.stock": "ref_stock",
    "ref.concept": "ref_concept",
    "ref.concept_stock_membership": "membership",
}
CHECK_FIELDS = ("check_id", "title", "status", "result_text", "error_text")
CHECK_SCHEMA = ", ".join(f"{name} string" for name in CHECK_FIELDS)
SESSION_MINUTES = 240
MORNING, AFTERNOON = (9 * 60 + 31, 11 * 60 + 30), (13 * 60 + 1, 15 * 60)


@dataclass(frozen=True)
class Rule:
    """One configured check. ``reference`` and ``reference_keys`` name the table and columns a key must exist in.

    ``max_members`` and ``member_lookback_days`` bound the contract's recomputation as its definition does (500 members,
    20 days); without them nothing is left out.
    """

    type: str
    object: str = ""
    check_id: str = ""
    title: str = ""
    column: str = ""
    fields: tuple[str, ...] = ()
    expected_value: str = ""
    provider_earliest_date: str = ""
    expected_minutes: int = SESSION_MINUTES
    lookback_days: int = 10
    min_row_ratio: float = 0.95
    required_objects: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    index_code: str = "000001"
    reference: str = ""
    reference_keys: tuple[str, ...] = ()
    max_idle_days: int = 30
    max_members: int | None = None
    member_lookback_days: int | None = None


@dataclass
class Checks:
    """Tables (None where absent), the calendar table and the reference time of one run."""

    spark: SparkSession
    tables: Mapping[str, DataFrame | None]
    as_of: dt.datetime
    exchange: str = "SSE"
    calendar_name: str = "ref.trade_calendar"
    time_columns: Mapping[str, str] = field(default_factory=lambda: dict(TIME_COLUMNS))
    primary_keys: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(PRIMARY_KEYS))
    key_ledger: str = ""  # a folder: key checks of tables stored by day look at changed days only

    # -- building blocks ---------------------------------------------------------------------------

    @property
    def today(self) -> dt.date:
        return self.as_of.date()

    def table(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def fixed(self, rule_id: str, title: str, status: str, result: str, error: str = "") -> DataFrame:
        return self.spark.createDataFrame([(rule_id, title, status, result, error)], CHECK_SCHEMA)

    def row(self, rule_id: str, title: str, status: Column, result: Column, error: Column) -> Column:
        texts = (F.lit(rule_id), F.lit(title), status, result, error)
        return F.struct(*(text.cast("string").alias(name) for name, text in zip(CHECK_FIELDS, texts)))

    def verdict(self, rule_id: str, title: str, bad: Column, error: Column, healthy: str = "正常", status: str = "unhealthy") -> Column:
        """Healthy unless ``bad``."""
        label = {"unhealthy": "异常", "warning": "警告"}[status]
        return self.row(
            rule_id, title, F.when(bad, status).otherwise("healthy"), F.when(bad, label).otherwise(healthy), F.when(bad, error).otherwise("")
        )

    def calendar(self) -> DataFrame | None:
        return self.table(self.calendar_name)

    def calendar_state(self) -> DataFrame:
        """One row: recent_days, recent_open_days, max_trade_date."""
        calendar = self.calendar()
        return calendar.where(recent("trade_date", self.today)).agg(
            F.count("*").alias("recent_days"), F.count_if("is_open").alias("recent_open_days"), F.max("trade_date").cast("string").alias("max_trade_date")
        )

    def calendar_ok(self) -> Column:
        if self.calendar() is None:
            return F.lit(False)
        return self.calendar_state().select((F.col("recent_days") > 0) & (F.col("recent_open_days") > 0)).scalar()

    def needs_calendar(self, check: Column, text: str) -> Column:
        """The check row, or an unknown one when the calendar is not usable."""
        unknown = F.struct(
            check.getField("check_id").alias("check_id"), check.getField("title").alias("title"),
            F.lit("unknown").alias("status"), F.lit("未执行").alias("result_text"), F.lit(text).alias("error_text"),
        )
        return F.when(self.calendar_ok(), check).otherwise(unknown)

    def expected_days(self, since: dt.date) -> Column:
        return open_days(self.calendar(), self.exchange, F.lit(since), F.lit(self.today - dt.timedelta(days=1)))

    # -- running -----------------------------------------------------------------------------------

    def run(self, rules: Sequence[Rule]) -> DataFrame:
        """Check rows of all rules; a check id configured twice is planned once, the first rule wins."""
        singles: list[DataFrame] = []
        folded: dict[str, list[tuple[str, Column, object]]] = {}
        seen: set[str] = set()
        for rule in rules:
            rule = self.named(rule)
            if rule.check_id in seen:
                continue
            seen.add(rule.check_id)
            gate = self.gate(rule)
            if gate is not None:
                singles.append(gate)
            elif rule.type in FOLDED:
                metric, outcome = FOLDED[rule.type](self, rule)
                folded.setdefault(rule.object, []).append((metric, outcome))
            else:
                handler = HANDLERS.get(rule.type)
                singles.append(handler(self, rule) if handler else self.fixed(rule.check_id, rule.title, "unknown", "未执行", "检查配置无法识别"))
        for name, parts in folded.items():
            df = self.table(name).where(recent(self.time_columns.get(name), self.today))
            stats = df.agg(*(metric.alias(f"m{i}") for i, (metric, _) in enumerate(parts)))
            rows = F.array(*(outcome(F.col(f"m{i}")) for i, (_, outcome) in enumerate(parts)))
            singles.append(stats.select(F.inline(rows)))
        nothing = self.spark.createDataFrame([], CHECK_SCHEMA)
        return reduce(DataFrame.unionByName, [frame.select(*CHECK_FIELDS) for frame in singles] or [nothing])

    def watch(self, df: DataFrame, name: str, rules: Sequence[Rule]) -> tuple[DataFrame, Callable[[], DataFrame]]:
        """``df`` as it is, and a function that gives the row rules' check rows of all its rows once it has been written.

        The rules' metrics are observed while the rows pass by on their way to an action, so they cost no scan. Rules
        that compare rows with each other or with other tables cannot be told that way and are an error.
        """
        wanted = list({rule.check_id: rule for rule in reversed([self.named(rule) for rule in rules])}.values())[::-1]
        other = [rule.type for rule in wanted if rule.type not in FOLDED or rule.object != name]
        if other:
            raise ValueError(f"cannot be observed on {name}: {', '.join(other)}")
        parts = [FOLDED[rule.type](self, rule) for rule in wanted]
        seen = Observation()
        metrics = [metric.alias(f"m{i}") for i, (metric, _) in enumerate(parts)]
        watched = df.observe(seen, *metrics) if metrics else df

        def rows() -> DataFrame:
            nothing = self.spark.createDataFrame([], CHECK_SCHEMA)
            if not parts:
                return nothing
            found = self.spark.createDataFrame([tuple(seen.get[f"m{i}"] for i in range(len(parts)))], df.agg(*metrics).schema)
            return nothing.unionByName(found.select(F.inline(F.array(*(outcome(F.col(f"m{i}")) for i, (_, outcome) in enumerate(parts))))))

        return watched, rows

    def named(self, rule: Rule) -> Rule:
        """Rule with its check id and title filled in."""
        name = rule.object
        ids = {
            "table_exists": (f"table_exists:{name}", f"依赖表 {name}"),
            "table_non_empty": (f"table_non_empty:{name}", f"依赖表 {name} 非空"),
            "trade_calendar_available": ("trade_calendar_available", "交易日历可用"),
            "non_trading_day_empty_result": ("non_trading_day_empty_result", "非交易日空结果"),
            "trade_day_missing_data_unhealthy": ("trade_day_missing_data_unhealthy", "交易日缺失异常"),
            "logic_rule_registered": ("logic_rule_registered", "逻辑健康规则已登记"),
            "capability_key_unique_rule": ("capability_key_unique_rule", "同一 " + "/".join(rule.fields) + " 唯一" if rule.fields else "capability 主键唯一"),
            "primary_key_duplicate_absent": (f"primary_key_duplicate_absent:{name}", f"{name} 主键重复"),
            "ohlc_valid": (f"ohlc_valid:{name}", f"{name} OHLC 合法"),
            "non_negative": (f"non_negative:{name}:{rule.column}", f"{name} {rule.column} 数值合法"),
            "money_flow_values_valid": ("money_flow_values_valid", "inflow/outflow/net_inflow 数值合法"),
            "calendar_continuity_90d": ("calendar_continuity_90d", "交易日历最近 90 天连续覆盖"),
            "recent_coverage_90d": (rule.check_id or f"recent_coverage_90d:{name}", rule.title or f"{name} 最近 90 天覆盖"),
            "recent_minute_session_complete": (rule.check_id or f"recent_minute_session_complete:{name}", rule.title or f"{name} 最近交易日分钟完整性"),
            "long_empty": (rule.check_id or "long_empty", rule.title or "长期无数据检查"),
            "reference_valid": (rule.check_id or f"reference_valid:{name}", REFERENCE_TITLES.get(rule.check_id, f"{name} 引用有效")),
            "fixed_field": (rule.check_id or f"fixed_field:{rule.column}", rule.title or f"{rule.check_id or rule.column} 固定为 {rule.expected_value}"),
            "market_data_contract": (rule.check_id or f"market_data_contract:{rule.index_code}", rule.title),
        }
        check_id, title = ids.get(rule.type, (f"unknown_check_type:{rule.type}", f"未知检查类型 {rule.type}"))
        return replace(rule, check_id=check_id, title=title)

    def gate(self, rule: Rule) -> DataFrame | None:
        """Unknown row when a table the rule reads is absent."""
        if rule.type in ("table_exists", "trade_calendar_available", "logic_rule_registered", "market_data_contract") or rule.type not in {**FOLDED, **HANDLERS}:
            return None
        if (rule.type == "non_negative" and not rule.column) or (rule.type == "money_flow_values_valid" and not rule.object):
            return self.fixed(rule.check_id, rule.title, "not_applicable", "不适用")
        needed = list(rule.required_objects) if rule.type == "long_empty" else [name for name in (rule.object, rule.reference) if name]
        absent = [name for name in needed if self.table(name) is None]
        if absent:
            if rule.type == "reference_valid":
                return self.fixed(rule.check_id, rule.title, "unhealthy", "异常", "缺少依赖表 " + ", ".join(absent))
            return self.fixed(rule.check_id, rule.title, "unknown", "未执行", "缺少依赖表 " + ", ".join(absent))
        return None


# Titles of the reference checks.
REFERENCE_TITLES = {
    "stock_reference_valid": "stock 引用有效",
    "stock_lifecycle_valid": "stock 生命周期有效",
    "concept_reference_valid": "concept_id 引用有效",
    "concept_membership_valid": "概念成员有效",
    "index_reference_valid": "index 引用有效",
}


# -- rules folded into one aggregate per table: (metric over the recent rows, metric -> check row) --------------


def _count_outcome(checks: Checks, rule: Rule, text: str):
    return lambda count: checks.verdict(rule.check_id, rule.title, count > 0, F.concat(F.lit(f"{text}: "), count.cast("string"), F.lit(" 条")))


def _ohlc(checks: Checks, rule: Rule):
    opened, high, low, close = (F.col(name) for name in ("open", "high", "low", "close"))
    known = opened.isNotNull() & high.isNotNull() & low.isNotNull() & close.isNotNull()
    broken = (low > high) | (opened < low) | (opened > high) | (close < low) | (close > high)
    return F.count_if(known & broken), _count_outcome(checks, rule, "OHLC 关系异常")


def _non_negative(checks: Checks, rule: Rule):
    return F.count_if(F.col(rule.column) < 0), _count_outcome(checks, rule, f"{rule.column} 出现负数")


def _money_flow(checks: Checks, rule: Rule):
    present = [name for name in ("inflow", "outflow", "net_inflow") if name in checks.table(rule.object).columns]
    if not present:
        text = "本地依赖表未提供 inflow/outflow/net_inflow 字段，无法执行资金流数值检查"
        return F.lit(0), lambda count: checks.row(rule.check_id, rule.title, F.lit("unknown"), F.lit("未执行"), F.lit(text))
    bad = reduce(lambda a, b: a | b, [invalid_number(F.col(name)) for name in present])
    return F.count_if(bad), _count_outcome(checks, rule, "资金流字段出现非法数值")


def _fixed_field(checks: Checks, rule: Rule):
    return F.count_if(~F.col(rule.column).eqNullSafe(rule.expected_value)), _count_outcome(checks, rule, f"{rule.column} 不为 {rule.expected_value}")


FOLDED = {"ohlc_valid": _ohlc, "non_negative": _non_negative, "money_flow_values_valid": _money_flow, "fixed_field": _fixed_field}


# -- rules with a plan of their own -----------------------------------------------------------------------------


def _registered(checks: Checks, rule: Rule) -> DataFrame:
    if rule.fields:
        return checks.fixed(rule.check_id, rule.title, "healthy", "健康")
    return checks.fixed(rule.check_id, rule.title, "unhealthy", "异常", "缺少本条 capability 的逻辑健康规则")


def _exists(checks: Checks, rule: Rule) -> DataFrame:
    if checks.table(rule.object) is None:
        return checks.fixed(rule.check_id, rule.title, "unhealthy", "异常", "表不存在")
    return checks.fixed(rule.check_id, rule.title, "healthy", "正常")


def _non_empty(checks: Checks, rule: Rule) -> DataFrame:
    found = checks.table(rule.object).limit(1).agg(F.count("*").alias("n"))
    return found.select(F.inline(F.array(checks.verdict(rule.check_id, rule.title, F.col("n") == 0, F.lit("表为空"), status="warning"))))


def _calendar_available(checks: Checks, rule: Rule) -> DataFrame:
    if checks.calendar() is None:
        return checks.fixed(rule.check_id, rule.title, "unhealthy", "异常", "缺少 ref.trade_calendar，无法判断缺失日期是否为交易日")
    no_days, no_open = F.col("recent_days") == 0, F.col("recent_open_days") == 0
    issues = F.concat_ws(
        "；", F.when(no_days, "ref.trade_calendar 最近 90 天没有日期记录"), F.when(no_open, "ref.trade_calendar 最近 90 天没有交易日记录")
    )
    return checks.calendar_state().select(F.inline(F.array(checks.verdict(rule.check_id, rule.title, no_days | no_open, issues))))


def _recent_days(checks: Checks, rule: Rule) -> DataFrame:
    column = rule.column or checks.time_columns.get(rule.object, "trade_date")
    return checks.table(rule.object).where(recent(column, checks.today)).select(F.col(column).cast("date").alias("trade_date")).distinct()


def _closed_day_rows(checks: Checks, rule: Rule) -> DataFrame:
    """Days with rows although the exchange was closed."""
    days = checks.expected_days(checks.today - dt.timedelta(days=90))
    found = _recent_days(checks, rule).agg(F.count_if(~F.array_contains(days, F.col("trade_date"))).alias("n"))
    check = checks.verdict(rule.check_id, rule.title, F.col("n") > 0, F.concat(F.lit("非交易日存在数据: "), F.col("n").cast("string"), F.lit(" 天")), "健康")
    return found.select(F.inline(F.array(checks.needs_calendar(check, "交易日历不可用，无法判断非交易日空结果是否健康"))))


def _open_day_gaps(checks: Checks, rule: Rule) -> DataFrame:
    """Open days without any row."""
    days = checks.expected_days(checks.today - dt.timedelta(days=90))
    found = _recent_days(checks, rule).agg(F.size(F.array_except(days, F.collect_set("trade_date"))).alias("n"))
    check = checks.verdict(rule.check_id, rule.title, F.col("n") > 0, F.concat(F.lit("交易日缺失数据: "), F.col("n").cast("string"), F.lit(" 天")))
    return found.select(F.inline(F.array(checks.needs_calendar(check, "交易日历不可用，无法判断交易日缺失"))))


def _reference(checks: Checks, rule: Rule) -> DataFrame:
    """Table not empty and, where a reference is named, no key without a reference row."""
    healthy = "有效" if rule.check_id in REFERENCE_TITLES else "正常"
    df = checks.table(rule.object)
    if rule.reference:
        keys = rule.reference_keys or rule.fields
        known = checks.table(rule.reference).select(*(F.col(there).alias(here) for here, there in zip(rule.fields, keys))).distinct()
        matched = df.select(*rule.fields).distinct().join(known.withColumn("_known", F.lit(True)), list(rule.fields), "left")
        found = matched.agg(F.count("*").alias("n"), F.count_if(F.col("_known").isNull()).alias("orphans"))
    else:
        found = df.limit(1).agg(F.count("*").alias("n"), F.lit(0).alias("orphans"))
    empty, orphaned = F.col("n") == 0, F.col("orphans") > 0
    check = checks.row(
        rule.check_id, rule.title,
        F.when(empty, "warning").when(orphaned, "unhealthy").otherwise("healthy"),
        F.when(empty, "警告").when(orphaned, "异常").otherwise(healthy),
        F.when(empty, f"依赖表 {rule.object} 为空").when(orphaned, F.concat(F.lit("引用缺失: "), F.col("orphans").cast("string"), F.lit(" 个"))).otherwise(""),
    )
    return found.select(F.inline(F.array(check)))


def _duplicates(checks: Checks, rule: Rule) -> DataFrame:
    keys = list(rule.fields) or list(checks.primary_keys.get(rule.object, ()))
    healthy = "无" if rule.type == "primary_key_duplicate_absent" else "正常"
    if not keys:
        return checks.fixed(rule.check_id, rule.title, "not_applicable", "不适用")
    table, day = checks.table(rule.object), checks.time_columns.get(rule.object, "trade_date")
    if checks.key_ledger and dict(table.dtypes).get(day) == "date":
        repeated = KeyLedger(checks.spark, f"{checks.key_ledger.rstrip('/')}/{rule.object}/{'-'.join(keys)}", keys, day).update(table)
    else:
        repeated = duplicate_keys(table, keys)
    found = repeated.limit(1).agg(F.count("*").alias("n"))
    return found.select(F.inline(F.array(checks.verdict(rule.check_id, rule.title, F.col("n") > 0, F.lit("存在主键重复记录"), healthy))))


def _coverage(checks: Checks, rule: Rule) -> DataFrame:
    """Open days covered by rows since max(as_of - 90 days, provider start), compared as day sets of one exchange."""
    try:
        earliest = dt.datetime.strptime(rule.provider_earliest_date if len(rule.provider_earliest_date) == 10 else "", "%Y-%m-%d").date()
    except ValueError:
        return checks.fixed(rule.check_id, rule.title, "unknown", "未执行", f"provider_earliest_date 配置非法: {rule.provider_earliest_date}")
    start = max(checks.today - dt.timedelta(days=90), earliest)
    days = checks.expected_days(start)
    covered = _recent_days(checks, rule).where(F.col("trade_date") >= F.lit(start)).agg(
        F.size(F.array_intersect(days, F.collect_set("trade_date"))).alias("actual")
    ).withColumn("expected", F.size(days))
    actual, expected, since = F.col("actual"), F.col("expected"), F.lit(f"provider 起点 {rule.provider_earliest_date} 后的最近窗口")
    counts = F.concat(since, F.lit("覆盖 "), actual.cast("string"), F.lit("/"), expected.cast("string"), F.lit(" 个交易日"))
    none_expected, empty, partial = expected <= 0, actual <= 0, actual < expected
    check = checks.row(
        rule.check_id, rule.title,
        F.when(none_expected, "unknown").when(empty, "unhealthy").when(partial, "warning").otherwise("healthy"),
        F.when(none_expected, "未执行").when(empty, "异常").when(partial, "警告").otherwise("正常"),
        F.when(none_expected, "provider 起点后的最近窗口没有交易日记录").when(empty, F.concat(since, F.lit("没有本地覆盖数据"))).when(partial, counts).otherwise(""),
    )
    return covered.select(F.inline(F.array(checks.needs_calendar(check, "交易日历不可用，无法判断覆盖缺口"))))


def session_days(bars: DataFrame, time: str, days: Column) -> DataFrame:
    """Per expected day: minutes present in the session, first and last minute, fewest and most rows per minute.

    Bars are counted per minute first, so a day's group holds at most the session's minutes.
    """
    minute = F.hour(time) * 60 + F.minute(time)
    in_session = minute.between(*MORNING) | minute.between(*AFTERNOON)
    whole = F.second(time) == 0
    per_minute = bars.where(in_session & whole & F.array_contains(days, F.col(time).cast("date"))).groupBy(time).agg(F.count("*").alias("n"))
    per_day = per_minute.groupBy(F.col(time).cast("date").alias("trade_date")).agg(
        F.count("*").alias("minute_count"), F.sum("n").alias("total_rows"),
        F.date_format(F.min(time), "HH:mm").alias("first_minute"), F.date_format(F.max(time), "HH:mm").alias("last_minute"),
        F.min("n").alias("min_rows_per_minute"), F.max("n").alias("max_rows_per_minute"),
    )
    expected = bars.sparkSession.range(1).select(F.explode(days).alias("trade_date"))
    counts = ["minute_count", "total_rows", "min_rows_per_minute", "max_rows_per_minute"]
    return expected.join(per_day, "trade_date", "left").fillna(0, counts).fillna("", ["first_minute", "last_minute"])


def session_issues(days: DataFrame, expected_minutes: int, min_row_ratio: float) -> DataFrame:
    """Add the issue text of each day, null where the session is complete."""
    minutes, low, high = F.col("minute_count"), F.col("min_rows_per_minute"), F.col("max_rows_per_minute")
    parts = F.concat_ws(
        "，",
        F.when(minutes < expected_minutes, F.concat(F.lit("分钟数 "), minutes.cast("string"), F.lit(f"/{expected_minutes}"))),
        F.when((F.col("first_minute") != "09:31") | (F.col("last_minute") != "15:00"), F.concat(F.lit("首尾分钟 "), F.col("first_minute"), F.lit("-"), F.col("last_minute"))),
        F.when((high > 0) & (low < F.floor(high * min_row_ratio)), F.concat(F.lit("每分钟股票数 "), low.cast("string"), F.lit("-"), high.cast("string"))),
    )
    text = F.when(minutes <= 0, F.concat(F.col("trade_date").cast("string"), F.lit(" 无 1m 数据"))).when(
        parts != "", F.concat(F.col("trade_date").cast("string"), F.lit(" "), parts)
    )
    return days.withColumn("issue", text)


def completed_days(checks: Checks, lookback_days: int) -> Column:
    """Open days of the lookback that are over: today counts after 15:10 on the exchange's clock (``as_of``)."""
    over = checks.as_of.time() >= dt.time(15, 10)
    last = checks.today if over else checks.today - dt.timedelta(days=1)
    return open_days(checks.calendar(), checks.exchange, F.lit(checks.today - dt.timedelta(days=lookback_days)), F.lit(last))


def _minute_session(checks: Checks, rule: Rule) -> DataFrame:
    if rule.expected_minutes <= 0 or rule.lookback_days <= 0:
        return checks.fixed(rule.check_id, rule.title, "unknown", "未执行", "分钟完整性检查配置非法")
    days = completed_days(checks, rule.lookback_days)
    time = checks.time_columns.get(rule.object, "bar_time")
    first, after = checks.today - dt.timedelta(days=rule.lookback_days), checks.today + dt.timedelta(days=1)
    looked_at = (F.col(time) >= F.lit(first).cast("timestamp_ntz")) & (F.col(time) < F.lit(after).cast("timestamp_ntz"))
    per_day = session_days(checks.table(rule.object).where(looked_at), time, days)
    issues = session_issues(per_day, rule.expected_minutes, rule.min_row_ratio)
    listed = F.reverse(F.array_sort(F.collect_list(F.when(F.col("issue").isNotNull(), F.col("issue")))))
    found = issues.agg(F.count("*").alias("days"), listed.alias("issues"))
    none, bad = F.col("days") == 0, F.size("issues") > 0
    check = checks.row(
        rule.check_id, rule.title,
        F.when(none, "unknown").when(bad, "warning").otherwise("healthy"),
        F.when(none, "未执行").when(bad, "警告").otherwise(F.concat(F.lit("最近 "), F.col("days").cast("string"), F.lit(" 个已完成交易日完整"))),
        F.when(none, "最近窗口没有已完成交易日").when(bad, F.array_join("issues", "；")).otherwise(""),
    )
    return found.select(F.inline(F.array(checks.needs_calendar(check, "交易日历不可用，无法判断分钟完整性"))))


def _continuity(checks: Checks, rule: Rule) -> DataFrame:
    """The calendar has a row for every date of the last 90 days. All arrays here hold at most 90 dates."""
    if checks.calendar() is None:
        return checks.fixed(rule.check_id, rule.title, "unhealthy", "异常", "交易日历不可用")
    dates = F.sequence(F.lit(checks.today - dt.timedelta(days=90)), F.lit(checks.today - dt.timedelta(days=1)))
    known = checks.calendar().where((F.col("exchange") == checks.exchange) & recent("trade_date", checks.today))
    missing = known.agg(F.array_except(dates, F.collect_set("trade_date")).alias("missing"))
    starts = F.filter("missing", lambda day: ~F.array_contains("missing", F.date_sub(day, 1)))
    text = F.concat(F.lit("缺少 "), F.size("missing").cast("string"), F.lit(" 天，"), F.size(starts).cast("string"), F.lit(" 段"))
    return missing.select(F.inline(F.array(checks.verdict(rule.check_id, rule.title, F.size("missing") > 0, text))))


def _long_empty(checks: Checks, rule: Rule) -> DataFrame:
    """No required table has been without new rows for longer than the allowed days."""
    latest = [
        checks.table(name).agg(F.max(F.col(checks.time_columns.get(name, rule.column or "trade_date")).cast("date")).alias("d")).select(F.lit(name).alias("name"), "d")
        for name in rule.required_objects
    ]
    if not latest:
        return checks.fixed(rule.check_id, rule.title, "healthy", "正常")
    idle = F.coalesce(F.datediff(F.lit(checks.today), F.col("d")), F.lit(2**31 - 1)) > rule.max_idle_days
    stale = F.array_sort(F.collect_list(F.when(idle, F.col("name"))))
    found = reduce(DataFrame.unionByName, latest).agg(stale.alias("stale"))
    check = checks.verdict(rule.check_id, rule.title, F.size("stale") > 0, F.concat(F.lit("长期无数据: "), F.array_join("stale", ", ")))
    return found.select(F.inline(F.array(checks.needs_calendar(check, "交易日历不可用，无法判断长期无数据"))))


def _contract(checks: Checks, rule: Rule) -> DataFrame:
    required = rule.required_objects or tuple(CONTRACT_TABLES)
    absent = [name for name in required if checks.table(name) is None]
    if absent:
        return checks.fixed(rule.check_id, rule.title, "unknown", "未执行", "缺少依赖表 " + ", ".join(absent))
    tables = {short: checks.table(name) for name, short in CONTRACT_TABLES.items()}
    metrics = contract_metrics(tables, rule.index_code, rule.max_members, rule.member_lookback_days, checks.key_ledger)
    compared = compare_expectations(metrics, rule.metrics)
    sign = F.when(F.col("operator") == "gte", ">=").otherwise("=")
    failed = F.col("status") == "unhealthy"
    text = F.concat(F.lit("实际 "), F.col("actual").cast("string"), F.lit("，期望 "), sign, F.lit(" "), F.col("expected").cast("string"))
    return compared.select(
        F.concat(F.lit(f"{rule.check_id}:"), F.col("metric")).alias("check_id"), "title", "status",
        F.when(failed, "异常").otherwise(F.col("actual").cast("string")).alias("result_text"), F.when(failed, text).otherwise("").alias("error_text"),
    )


HANDLERS = {
    "logic_rule_registered": _registered,
    "table_exists": _exists,
    "table_non_empty": _non_empty,
    "trade_calendar_available": _calendar_available,
    "non_trading_day_empty_result": _closed_day_rows,
    "trade_day_missing_data_unhealthy": _open_day_gaps,
    "reference_valid": _reference,
    "capability_key_unique_rule": _duplicates,
    "primary_key_duplicate_absent": _duplicates,
    "recent_coverage_90d": _coverage,
    "recent_minute_session_complete": _minute_session,
    "calendar_continuity_90d": _continuity,
    "long_empty": _long_empty,
    "market_data_contract": _contract,
}
