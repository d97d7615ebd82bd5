from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.quality.checks import CHECK_FIELDS, CONTRACT_TABLES, Checks, Rule, session_days, session_issues
from tapeloom.quality.contract import EXPECTATIONS, compare_expectations, contract_metrics
from tapeloom.quality.health import run_health
from tapeloom.quality.rollup import capability_status, group_summary, overall_summary, worst
from tapeloom.sources.store import profile_rules, read_profiles, rules_of

AS_OF = dt.datetime(2024, 3, 1, 16, 0)
DAYS = [dt.date(2023, 12, 1) + dt.timedelta(days=n) for n in range(92)]


def calendar(spark, days=DAYS, closed=()):
    return spark.createDataFrame([("SSE", d, d not in closed) for d in days] + [("HKEX", d, True) for d in days[:5]], "exchange string, trade_date date, is_open boolean")


def bars(spark, rows):
    return spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double, inflow double, freq string")


def good(d, code="a", **changes):
    row = {"code": code, "trade_date": d, "open": 2.0, "high": 3.0, "low": 1.0, "close": 2.0, "volume": 5.0, "inflow": 0.0, "freq": "1d"}
    return tuple({**row, **changes}.values())


def checks(spark, rows=None, **tables):
    given = {"ref.trade_calendar": calendar(spark), "t": bars(spark, rows if rows is not None else [good(d) for d in DAYS]), **tables}
    return Checks(spark, given, AS_OF, time_columns={"t": "trade_date"}, primary_keys={"t": ("code", "trade_date")})


def outcome(made, *rules):
    return {row.check_id: row for row in made.run(rules).collect()}


RULES = {
    "table_non_empty": Rule("table_non_empty", "t"),
    "ohlc_valid": Rule("ohlc_valid", "t"),
    "non_negative": Rule("non_negative", "t", column="volume"),
    "money_flow_values_valid": Rule("money_flow_values_valid", "t"),
    "fixed_field": Rule("fixed_field", "t", "freq_valid", column="freq", expected_value="1d"),
    "primary_key_duplicate_absent": Rule("primary_key_duplicate_absent", "t"),
    "recent_coverage_90d": Rule("recent_coverage_90d", "t", "coverage", provider_earliest_date="2020-01-01"),
    "trade_day_missing_data_unhealthy": Rule("trade_day_missing_data_unhealthy", "t"),
    "non_trading_day_empty_result": Rule("non_trading_day_empty_result", "t"),
    "reference_valid": Rule("reference_valid", "t", "stock_reference_valid", fields=("code",), reference="codes"),
    "long_empty": Rule("long_empty", check_id="idle", required_objects=("t",)),
    "calendar_continuity_90d": Rule("calendar_continuity_90d"),
    "trade_calendar_available": Rule("trade_calendar_available"),
    "table_exists": Rule("table_exists", "t"),
}


def test_clean_table_is_healthy(spark):
    rows = outcome(checks(spark, codes=spark.createDataFrame([("a",)], "code string")), *RULES.values())
    assert len(rows) == len(RULES)
    assert {row.status for row in rows.values()} == {"healthy"}, rows
    assert all(row.error_text == "" for row in rows.values())


INSIDE, OUTSIDE = dt.date(2024, 1, 10), dt.date(2023, 12, 1)
BASE = [good(d) for d in DAYS]


@pytest.mark.parametrize(
    "kind, rows, status, text",
    [
        ("ohlc_valid", BASE + [good(INSIDE, "b", low=9.0)], "unhealthy", "OHLC 关系异常: 1 条"),
        ("ohlc_valid", BASE + [good(INSIDE, "b", low=9.0, close=None)], "healthy", ""),
        ("ohlc_valid", BASE + [good(OUTSIDE, "b", low=9.0)], "healthy", ""),
        ("non_negative", BASE + [good(INSIDE, "b", volume=-1.0), good(INSIDE, "c", volume=None)], "unhealthy", "volume 出现负数: 1 条"),
        ("money_flow_values_valid", BASE + [good(INSIDE, x, inflow=v) for x, v in (("b", None), ("c", float("nan")), ("d", float("inf")))], "unhealthy", "资金流字段出现非法数值: 3 条"),
        ("fixed_field", BASE + [good(INSIDE, "b", freq=None)], "unhealthy", "freq 不为 1d: 1 条"),
        ("primary_key_duplicate_absent", BASE + BASE[:1], "unhealthy", "存在主键重复记录"),
        ("table_non_empty", [], "warning", "表为空"),
        ("recent_coverage_90d", BASE[:50], "warning", "provider 起点 2020-01-01 后的最近窗口覆盖 49/90 个交易日"),
        ("recent_coverage_90d", BASE[:1], "unhealthy", "provider 起点 2020-01-01 后的最近窗口没有本地覆盖数据"),
        ("trade_day_missing_data_unhealthy", BASE[:-4], "unhealthy", "交易日缺失数据: 3 天"),
        ("reference_valid", BASE + [good(INSIDE, "b"), good(INSIDE, "c")], "unhealthy", "引用缺失: 2 个"),
        ("long_empty", BASE[:20], "unhealthy", "长期无数据: t"),
    ],
)
def test_one_seeded_fault(spark, kind, rows, status, text):
    made = checks(spark, rows, codes=spark.createDataFrame([("a",)], "code string"))
    (row,) = outcome(made, RULES[kind]).values()
    assert (row.status, row.error_text) == (status, text)


def test_rows_on_closed_days(spark):
    closed = {dt.date(2024, 2, 10), dt.date(2024, 2, 11)}
    made = checks(spark, **{"ref.trade_calendar": calendar(spark, closed=closed)})
    (row,) = outcome(made, RULES["non_trading_day_empty_result"]).values()
    assert (row.status, row.error_text) == ("unhealthy", "非交易日存在数据: 2 天")


def test_gaps_in_the_calendar(spark):
    missing = {dt.date(2024, 2, 10), dt.date(2024, 2, 11), dt.date(2024, 2, 20)}
    made = checks(spark, **{"ref.trade_calendar": calendar(spark, [d for d in DAYS if d not in missing])})
    (row,) = outcome(made, RULES["calendar_continuity_90d"]).values()
    assert (row.status, row.error_text) == ("unhealthy", "缺少 3 天，2 段")


def test_unusable_inputs_give_unknown(spark):
    old = calendar(spark, [dt.date(2020, 1, 1)])
    rows = outcome(checks(spark, **{"ref.trade_calendar": old}), RULES["recent_coverage_90d"], RULES["trade_calendar_available"], Rule("no_such_rule"), Rule("ohlc_valid", "absent"), Rule("table_exists", "absent"))
    assert rows["coverage"].status == "unknown"
    assert rows["trade_calendar_available"].status == "unhealthy"
    assert rows["unknown_check_type:no_such_rule"].status == "unknown"
    assert rows["ohlc_valid:absent"].status == "unknown"
    assert rows["table_exists:absent"].status == "unhealthy"


def test_row_rules_of_a_table_share_one_scan(spark):
    plan = checks(spark).run([RULES["ohlc_valid"], RULES["non_negative"], RULES["money_flow_values_valid"]])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def minute_rows(day, minutes, codes=("a", "b")):
    return [(code, dt.datetime.combine(day, dt.time(m // 60, m % 60))) for m in minutes for code in codes]


FULL = [*range(571, 691), *range(781, 901)]


def session(spark, rows, days, **options):
    df = spark.createDataFrame(rows, "code string, bar_time timestamp_ntz")
    array = F.array(*(F.lit(d) for d in days))
    return [r.issue for r in session_issues(session_days(df, "bar_time", array), options.get("minutes", 240), 0.95).orderBy("trade_date").collect()]


def test_minute_sessions(spark):
    first, second, third, fourth = (dt.date(2024, 1, n) for n in (2, 3, 4, 5))
    rows = minute_rows(first, FULL) + minute_rows(second, [m for m in FULL if m != 600]) + minute_rows(third, FULL[1:], ("a", "b", "c")) + minute_rows(third, [571, 570, 700], ("a",))
    assert session(spark, rows, [first, second, third, fourth]) == [None, "2024-01-03 分钟数 239/240", "2024-01-04 每分钟股票数 1-3", "2024-01-05 无 1m 数据"]


def test_today_counts_after_the_close(spark):
    calendar_rows = spark.createDataFrame([("SSE", dt.date(2024, 1, 2), True)], "exchange string, trade_date date, is_open boolean")
    rows = spark.createDataFrame(minute_rows(dt.date(2024, 1, 2), FULL), "code string, bar_time timestamp_ntz")
    rule = Rule("recent_minute_session_complete", "fact.stock_bar_1m", lookback_days=5)
    run = lambda hour: outcome(Checks(spark, {"ref.trade_calendar": calendar_rows, "fact.stock_bar_1m": rows}, dt.datetime(2024, 1, 3 if hour is None else 2, hour or 9, 30)), rule)
    assert run(None)["recent_minute_session_complete:fact.stock_bar_1m"].result_text == "最近 1 个已完成交易日完整"
    assert run(10)["recent_minute_session_complete:fact.stock_bar_1m"].status == "unknown"


# -- contract ----------------------------------------------------------------------------------------------------

LAST = dt.date(2024, 1, 12)
TRADING = [dt.date(2024, 1, n) for n in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12)]


def contract_inputs(spark, **changes):
    price = "open double, high double, low double, close double, pre_close double, change double, pct_chg double, volume double, amount double"
    priced = lambda key: [(key, d, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 2.0, 10.0, 100.0) for d in TRADING]
    stocks = [("SHSE", "600001"), ("SZSE", "000001")]
    tables = {
        "index_daily": (priced("000001"), f"index_code string, trade_date date, {price}"),
        "board_daily": (priced("B1"), f"board_code string, trade_date date, {price}"),
        "concept_daily": ([("C1", d, 2.0, 200.0) for d in TRADING], "concept_id string, trade_date date, pct_chg double, amount double"),
        "stock_daily": ([(m, c, d, 1.0, 1.0, 2.0, 100.0, False, None) for m, c in stocks for d in TRADING], "market string, code string, trade_date date, close double, pre_close double, pct_chg double, amount double, is_suspended boolean, is_st boolean"),
        "ref_index": ([("000001", "Index")], "index_code string, index_name string"),
        "ref_stock": ([(m, c, "main", "main", dt.date(2000, 1, 1), None) for m, c in stocks], "market string, code string, listing_board string, board_type string, listed_date date, delisted_date date"),
        "ref_concept": ([("C1", "Concept")], "concept_id string, name string"),
        "membership": ([("C1", m, c, dt.date(2020, 1, 1), None) for m, c in stocks], "concept_id string, stock_market string, stock_code string, valid_from date, valid_to date"),
    }
    return {name: spark.createDataFrame(changes.get(name, lambda rows: rows)(list(rows)), schema) for name, (rows, schema) in tables.items()}


def faults(spark, **changes):
    rows = compare_expectations(contract_metrics(contract_inputs(spark, **changes), "000001")).collect()
    assert len(rows) == len(EXPECTATIONS) == 31
    return {row.metric: row.actual for row in rows if row.status == "unhealthy"}


def test_clean_contract(spark):
    assert faults(spark) == {}


def edit(position, column, value):
    def apply(rows):
        row = list(rows[position])
        row[column] = value
        rows[position] = tuple(row)
        return rows

    return apply


@pytest.mark.parametrize(
    "table, change, metrics",
    [
        ("index_daily", lambda rows: rows[-5:], {"first_stage_index_trade_date_count": 5}),
        ("index_daily", edit(-1, 2, None), {"first_stage_index_core_null_count": 1}),
        ("index_daily", edit(-2, 9, 0.0), {"first_stage_index_invalid_volume_amount_count": 1}),
        ("index_daily", lambda rows: rows + rows[:1], {"global_duplicate_index_key_count": 1}),
        ("ref_index", lambda rows: [("x", "Other")], {"first_stage_ref_index_missing_count": 1, "global_index_daily_without_ref_count": 1}),
        ("ref_index", edit(0, 1, "In?ex"), {"first_stage_ref_index_bad_name_count": 1, "global_ref_index_bad_name_count": 1}),
        ("concept_daily", lambda rows: rows[:8] + rows[9:], {"first_stage_incomplete_concept_count": 0}),
        ("concept_daily", edit(-2, 2, None), {"first_stage_concept_core_invalid_count": 1, "second_stage_null_pct_chg_count": 1}),
        ("concept_daily", edit(-5, 3, 0.0), {"second_stage_invalid_amount_count": 1}),
        ("concept_daily", edit(-1, 3, 205.0), {"second_stage_amount_mismatch_count": 1}),
        ("concept_daily", edit(-1, 2, 2.5), {"second_stage_pct_chg_mismatch_count": 1}),
        ("stock_daily", lambda rows: rows[:-1], {"second_stage_missing_member_stock_count": 1, "second_stage_amount_mismatch_count": 1, "global_active_stock_without_daily_count": 1}),
        ("stock_daily", lambda rows: rows[:10] + rows[-1:], {"second_stage_missing_member_pre_close_count": 1, "second_stage_amount_mismatch_count": 1}),
        ("stock_daily", edit(-1, 6, None), {"second_stage_amount_mismatch_count": 1, "global_stock_daily_core_null_count": 1}),
        ("board_daily", edit(-1, 7, None), {"global_board_daily_core_null_count": 1}),
        ("board_daily", lambda rows: rows + rows[:2], {"global_duplicate_board_key_count": 2}),
        ("ref_stock", edit(0, 3, ""), {"global_blank_board_type_count": 1, "global_board_type_listing_board_mismatch_count": 1}),
        ("ref_stock", lambda rows: rows + [("SZSE", "000009", "main", "main", dt.date(2000, 1, 1), None)], {"global_active_stock_without_daily_count": 1}),
        ("membership", edit(0, 1, "SZSE"), {"second_stage_missing_member_stock_count": 0}),
    ],
)
def test_seeded_contract_faults(spark, table, change, metrics):
    found = faults(spark, **{table: change})
    expected = {name: count for name, count in metrics.items() if count}
    if table == "concept_daily" and not expected:
        # A missing day shortens the calendar of days for everyone: coverage stays complete.
        assert "first_stage_incomplete_concept_count" not in found
    elif table == "membership":
        # The member has no reference row any more and drops out; the recomputed amount no longer fits.
        assert found == {"second_stage_amount_mismatch_count": 1}
    else:
        assert found == expected


def test_code_prefixes_and_unmatched_latest_days(spark):
    both = {
        "ref_stock": edit(0, 1, "700001"), "membership": edit(0, 2, "700001"),
        "stock_daily": lambda rows: [("SHSE", "700001", *row[2:]) if row[1] == "600001" else row for row in rows],
    }
    assert faults(spark, **both) == {"second_stage_invalid_market_code_count": 1}
    late = faults(spark, index_daily=lambda rows: rows[:-1] + [(rows[-1][0], dt.date(2024, 1, 15), *rows[-1][2:])])
    assert late["global_latest_date_mismatch_count"] == 1


def test_missing_board_type_column(spark):
    tables = contract_inputs(spark)
    tables["ref_stock"] = tables["ref_stock"].drop("board_type")
    rows = {r.metric: r.actual for r in contract_metrics(tables, "000001").collect()}
    assert rows["global_missing_board_type_column_count"] == 1 and rows["global_blank_board_type_count"] == 2


# -- rollups and profiles ----------------------------------------------------------------------------------------


def test_rollups(spark):
    rows = [("a", "healthy"), ("a", "not_applicable"), ("b", "unknown"), ("b", "healthy"), ("c", "warning"), ("c", "unhealthy"), ("d", "strange")]
    df = spark.createDataFrame(rows, "capability_id string, status string")
    capabilities = capability_status(df)
    assert {r.capability_id: r.status for r in capabilities.collect()} == {"a": "healthy", "b": "warning", "c": "unhealthy", "d": "healthy"}
    grouped = group_summary(capabilities.withColumn("group", F.when(F.col("capability_id") == "c", "y").otherwise("x")))
    assert {r.group: (r.status, r.total, r.healthy, r.warning, r.unhealthy) for r in grouped.collect()} == {"x": ("warning", 3, 2, 1, 0), "y": ("unhealthy", 1, 0, 0, 1)}
    assert overall_summary(capabilities).first().status == "unhealthy"
    assert df.where("capability_id in ('a', 'b')").agg(worst("status").alias("s")).first().s == "unknown"


def test_profiles_drive_a_run(spark, tmp_path):
    profile = {
        "capabilities": {
            "bars": {"group": "facts", "checks": [{"type": "ohlc_valid", "object": "t"}, {"type": "non_negative", "object": "t", "column": "volume"}, {"type": "ohlc_valid", "object": "t"}]},
            "more": {"checks": [{"type": "ohlc_valid", "object": "t"}, {"type": "trade_calendar_available"}]},
        }
    }
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps(profile, ensure_ascii=False, indent=1))
    profiles = read_profiles(spark, str(path))
    assert {r.capability_id: r.group for r in profiles.collect()} == {"bars": "facts", "more": "未分组"}
    assert profile_rules(profiles).count() == 5
    made = checks(spark, [good(d) for d in DAYS] + [good(INSIDE, "b", volume=-2.0)])
    result = run_health(made, ["bars", "more", "unlisted"], profiles.select("capability_id", "group"), rules_of(profiles))
    status = {r.capability_id: r.status for r in result["capabilities"].collect()}
    assert status == {"bars": "unhealthy", "more": "healthy", "unlisted": "unhealthy"}
    assert result["checks"].count() == 5 and set(CHECK_FIELDS) < set(result["checks"].columns)
    assert [r.group for r in result["groups"].collect()] == ["facts", "未分组"]
    assert result["status"].first().status == "unhealthy"
    assert read_profiles(spark, str(tmp_path / "absent.json")).count() == 0


def test_contract_rule_belongs_to_its_capability(spark):
    names = {"fact.index_bar_1d": "index_daily", "fact.concept_daily_1d": "concept_daily", "fact.stock_daily_1d": "stock_daily", "fact.board_daily_1d": "board_daily",
             "ref.index": "ref_index", "ref.stock": "ref_stock", "ref.concept": "ref_concept", "ref.concept_stock_membership": "membership"}
    inputs = contract_inputs(spark, board_daily=edit(-1, 7, None))
    made = Checks(spark, {"ref.trade_calendar": calendar(spark), **{name: inputs[short] for name, short in names.items()}}, AS_OF)
    groups = spark.createDataFrame([("contract", "all")], "capability_id string, group string")
    result = run_health(made, ["contract"], groups, [("contract", Rule("market_data_contract", metrics=("global_board_daily_core_null_count", "global_duplicate_index_key_count")))])
    rows = {r.check_id: (r.status, r.result_text, r.error_text) for r in result["checks"].collect()}
    assert rows == {
        "market_data_contract:000001:global_board_daily_core_null_count": ("unhealthy", "异常", "实际 1，期望 = 0"),
        "market_data_contract:000001:global_duplicate_index_key_count": ("healthy", "0", ""),
    }
    assert result["capabilities"].first().status == "unhealthy"


def test_two_contract_rules_keep_their_capabilities(spark):
    inputs = contract_inputs(spark)
    names = {short: name for name, short in CONTRACT_TABLES.items()}
    made = Checks(spark, {"ref.trade_calendar": calendar(spark), **{names[short]: df for short, df in inputs.items()}}, AS_OF)
    groups = spark.createDataFrame([("x", "all"), ("y", "all")], "capability_id string, group string")
    rules = [("x", Rule("market_data_contract", metrics=("first_stage_ref_index_missing_count",))), ("y", Rule("market_data_contract", index_code="nope", metrics=("first_stage_ref_index_missing_count",)))]
    result = run_health(made, ["x", "y"], groups, rules)
    assert {r.capability_id: r.check_id for r in result["checks"].collect()} == {
        "x": "market_data_contract:000001:first_stage_ref_index_missing_count", "y": "market_data_contract:nope:first_stage_ref_index_missing_count"}
    assert {r.capability_id: r.status for r in result["capabilities"].collect()}["y"] == "unhealthy"


def test_rules_that_cannot_run_say_so(spark):
    made = checks(spark, [good(d) for d in DAYS])
    assert made.run([]).count() == 0
    rules = [Rule("non_negative", "t"), Rule("money_flow_values_valid"), Rule("reference_valid", "t", fields=("code",), reference="ref.absent"), Rule("recent_coverage_90d", "t", provider_earliest_date="20240101")]
    rows = {r.check_id: (r.status, r.error_text) for r in made.run(rules).collect()}
    assert rows["non_negative:t:"][0] == rows["money_flow_values_valid"][0] == "not_applicable"
    assert rows["reference_valid:t"] == ("unhealthy", "缺少依赖表 ref.absent")
    assert rows["recent_coverage_90d:t"][0] == "unknown"


def test_a_profile_can_ask_for_the_bounds_of_the_contract(spark, tmp_path, monkeypatch):
    """max_members and member_lookback_days of a JSON rule reach the metrics; without them nothing is left out."""
    inputs, asked = contract_inputs(spark), []
    monkeypatch.setattr("tapeloom.quality.checks.contract_metrics", lambda *args: asked.append(args[1:4]) or contract_metrics(*args))
    tables = {name: inputs[short] for name, short in CONTRACT_TABLES.items()}
    for bounds in ({}, {"max_members": 500, "member_lookback_days": 20}):
        path = tmp_path / f"{len(bounds)}.json"
        path.write_text(json.dumps({"capabilities": {"contract": {"checks": [{"type": "market_data_contract", "index_code": "000001", **bounds}, {"type": "long_empty", "required_objects": ["ref.index"], "max_idle_days": 7}]}}}))
        rules = dict((rule.type, rule) for _, rule in rules_of(read_profiles(spark, str(path))))
        assert rules["long_empty"].max_idle_days == 7
        rows = Checks(spark, tables, AS_OF).run([rules["market_data_contract"]]).collect()
        expected = {r.metric: r.status for r in compare_expectations(contract_metrics(inputs, "000001", *bounds.values())).collect()}
        assert {r.check_id.rsplit(":", 1)[1]: r.status for r in rows} == expected
    assert asked == [("000001", None, None), ("000001", 500, 20)]
    small = {r.metric: r.actual for r in contract_metrics(inputs, "000001", 0).collect()}
    assert small["second_stage_amount_mismatch_count"] == 0 == small["second_stage_missing_member_stock_count"]
