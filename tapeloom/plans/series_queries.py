"""Registered queries: predicates, windows, bars, joins, aggregations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import scalars as S
from tapeloom.operators import bars as B
from tapeloom.operators import asof, bits, factors, indicators, intervals, merge, predicates as P, selection, series
from tapeloom.plans.catalog import query, round_columns, rounded
from tapeloom.plans.quotes import expected_times, session_ends
from tapeloom.sources.market_tables import MarketTables, exact_sum
from tapeloom.sources.store import MarketStore, availability, stored_availability

CODE, DAY = ["code"], "trade_date"
BRANDS = "Brand#3, Brand#7,,Brand#1"


# -- sources -----------------------------------------------------------------------------------------------------


@query("io1_fact_scan")
def _(t: MarketTables) -> DataFrame:
    """Column-pruned scan with the range on the stored column, so it reaches the parquet reader."""
    line = t.raw("lineitem").where((F.col("l_shipdate") >= F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(dt.datetime(1996, 7, 1)).cast("timestamp_ntz")))
    return line.groupBy(F.col("l_shipdate").cast("date").alias("trade_date")).agg(F.count("*").alias("row_count"), exact_sum("l_quantity").alias("volume"))


@query("io2_ref_scan")
def _(t: MarketTables) -> DataFrame:
    nations = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    homes = nations.select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return t.raw("customer").select("c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(homes, "c_nationkey").groupBy("r_name").agg(F.sum("n").alias("customers"))


@query("io3_json_rules")
def _(t: MarketTables) -> DataFrame:
    parsed = t.raw("events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return parsed.groupBy("event_type").agg(F.sum("k").alias("k_total"), F.max("k").alias("k_max"))


@query("io7_availability")
def _(t: MarketTables) -> DataFrame:
    orders = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("d"))
    line = t.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    events = t.raw("events").select(F.col("ts").cast("date").alias("d"))
    return availability(t.spark, {"orders": (orders, "d"), "lineitem": (line, "d"), "events": (events, "d"), "absent": (None, "d")})


# -- predicates, projection, selection ---------------------------------------------------------------------------


@query("q01_entities")
def _(t: MarketTables) -> DataFrame:
    return P.keep_entities(t.bars_sparse, "code", P.codes_of("Brand#1", BRANDS)).select("code", "trade_date", "volume")


@query("q01_entities_semi")
def _(t: MarketTables) -> DataFrame:
    """The semi-join form, with the wanted codes taken from a table."""
    wanted = t.raw("part").where(F.col("p_size") == 50).select(F.col("p_brand").alias("code")).distinct()
    return t.bars_sparse.join(wanted, "code", "left_semi").groupBy("code").agg(F.count("*").alias("n"))


@query("q02_enum_check")
def _(t: MarketTables) -> DataFrame:
    allowed = ["1-URGENT", "2-HIGH", "5-LOW"]
    return t.raw("orders").where(~F.col("o_orderpriority").isin(allowed)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("q03_range")
def _(t: MarketTables) -> DataFrame:
    return t.between("1997-03-01", "1997-04-30").bars_sparse.where(P.in_days("trade_date", "", "1997-03-01", "19970430")).select("code", "trade_date", "volume", "amount")


@query("q03_point")
def _(t: MarketTables) -> DataFrame:
    return t.between("1997-03-05", "1997-03-05").bars_sparse.where(P.in_days("trade_date", "1997-03-05", "1990-01-01", "1990-01-02")).select("code", "trade_date", "volume", "amount")


@query("q04_times")
def _(t: MarketTables) -> DataFrame:
    return t.between("2024-01-05", "2024-01-07").bars_minute.where(P.in_times("bar_time", "2024-01-05 09:30:00", "2024-01-07 15:00:00")).select("code", "bar_time", "open", "close", "volume")


@query("q05_last_n")
def _(t: MarketTables) -> DataFrame:
    return selection.last_n(t.bars_sparse, CODE, DAY, 7).select("code", "trade_date", "volume")


@query("q06_cut")
def _(t: MarketTables) -> DataFrame:
    return selection.cut_counts(t.bars_sparse, 500)


@query("q07_exclude_entity")
def _(t: MarketTables) -> DataFrame:
    return selection.drop_flagged_entities(t.stock_daily, ["market", "code"], "is_st").select("market", "code", "trade_date", "volume")


@query("q08_skip_suspended")
def _(t: MarketTables) -> DataFrame:
    return selection.drop_flagged_rows(selection.drop_flagged_entities(t.stock_daily, ["market", "code"], "is_st"), "is_suspended").select("market", "code", "trade_date", "volume")


@query("q09_page")
def _(t: MarketTables) -> DataFrame:
    return selection.page(t.stock_daily, ["trade_date", "code"], 250, 1000).select("trade_date", "code", "volume")


@query("io6_columns")
def _(t: MarketTables) -> DataFrame:
    """Column names of three tables and of one that does not exist, as a store tells them."""
    store = MarketStore(t.spark, tables={name: t.raw(name) for name in ("lineitem", "orders", "part")})
    rows = [(name, k, column) for name in ("lineitem", "orders", "part", "nowhere") for k, column in enumerate(store.columns(name), 1)]
    return t.spark.createDataFrame(rows, "table_name string, position int, column_name string")


@query("io7_footers")
def _(t: MarketTables) -> DataFrame:
    """Availability of stored tables from their files' footers."""
    columns = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "nowhere": "x"}
    return stored_availability(t.spark, {name: (f"{t.folder}/{name}.parquet", column) for name, column in columns.items()})


@query("q16_clamped_limit")
def _(t: MarketTables) -> DataFrame:
    """A limit beyond the allowed one is cut to it."""
    rows = t.raw("orders").select("o_orderkey", "o_totalprice")
    return selection.page(rows, [F.col("o_totalprice").desc(), "o_orderkey"], P.clamp_limit(999_999, 1000))


@query("q09_deep_page")
def _(t: MarketTables) -> DataFrame:
    """A page three quarters down all trades, dearest first, from range partitions."""
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    pages = selection.Pages(rows, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"])
    return pages.page(200, 3 * sum(n for _, n in pages.counts) // 4)


@query("q10_project")
def _(t: MarketTables) -> DataFrame:
    return selection.pick_fields(t.bars_sparse, "code, trade_date,high", ("code", "trade_date", "high", "low"))


@query("q11_completeness")
def _(t: MarketTables) -> DataFrame:
    days = series.open_days(t.calendar, "SSE", F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    codes = t.raw("part").select(F.col("p_brand").alias("code"))
    rows = t.bars_sparse.where(P.in_days("trade_date", "", "1997-01-01", "1997-12-31"))
    meta = B.completeness(rows, codes, days)
    return meta.withColumn("missing_trade_dates", F.array_join(F.transform("missing_trade_dates", lambda d: d.cast("string")), ","))


def _minute_bits(t: MarketTables):
    """Bits of all minute bars, the codes, and the expected minutes of the sessions of every day with events."""
    ends = session_ends(1)
    days = series.open_days(t.news.select(F.lit("SSE").alias("exchange"), "trade_date", F.lit(True).alias("is_open")).distinct())
    return bits.day_bits(t.bars_minute, ["code"], "bar_time", ends), t.bars_minute.select("code").distinct(), bits.expected_bits(expected_times(days, ends, t.spark), "end", ends), ends


@query("q11_minute_completeness")
def _(t: MarketTables) -> DataFrame:
    held, codes, expected, _ = _minute_bits(t)
    return bits.bit_counts(held, codes, expected, "code")


@query("w16_minute_gaps")
def _(t: MarketTables) -> DataFrame:
    """Ranges of consecutive session minutes without a bar, over nights and breaks."""
    held, codes, expected, ends = _minute_bits(t)
    return bits.missing_bar_ranges(bits.missing_bits(held, codes, expected, "code"), "code", ends)


@query("q12_fill")
def _(t: MarketTables) -> DataFrame:
    return B.fill_suspended(t.bars_sparse, series.open_days(t.calendar))


def _weekly(t: MarketTables, freq: str) -> DataFrame:
    return round_columns(B.rollup_days(t.bars_sparse, freq), ["volume", "amount"], 2)


@query("q13_weekly")
def _(t: MarketTables) -> DataFrame:
    return _weekly(t, "1w")


@query("q13_monthly")
def _(t: MarketTables) -> DataFrame:
    return _weekly(t, "1mo")


@query("q14_minutes")
def _(t: MarketTables) -> DataFrame:
    return round_columns(B.rollup_minutes(t.bars_minute, 30), ["volume", "amount"], 2)


@query("q14_session")
def _(t: MarketTables) -> DataFrame:
    return round_columns(B.rollup_minutes(t.bars_minute, 60, sessions=(("09:30", "11:30"), ("13:00", "15:00"))), ["volume", "amount"], 2)


def with_factor(bars: DataFrame) -> DataFrame:
    return bars.withColumn("adj_factor", 1 + (F.year("trade_date") - 1995) * 0.05)


@query("q15_qfq")
def _(t: MarketTables) -> DataFrame:
    return B.adjust_prices(with_factor(t.bars_daily), "qfq").select("code", "trade_date", "low", "high", "close")


@query("q15_qfq_base")
def _(t: MarketTables) -> DataFrame:
    return B.adjust_prices(with_factor(t.bars_daily), "qfq", dt.date(1998, 6, 30)).select("code", "trade_date", "close")


@query("q15_hfq")
def _(t: MarketTables) -> DataFrame:
    return B.adjust_prices(with_factor(t.bars_daily), "hfq").select("code", "trade_date", "close")


@query("q17_finite")
def _(t: MarketTables) -> DataFrame:
    tax = F.col("l_tax")
    seeded = F.when(tax == 0, float("nan")).when(tax == 0.01, float("inf")).when(tax == 0.02, -float("inf")).otherwise(F.col("l_extendedprice"))
    line = selection.finite_doubles(t.raw("lineitem").select("l_returnflag", seeded.alias("price")))
    return line.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("price").alias("finite_count"), exact_sum("price").alias("total"))


@query("q18_catalog")
def _(t: MarketTables) -> DataFrame:
    return P.catalog_filter(t.raw("part"), "widget", "p_name", p_brand="Brand#7", p_type="").select("p_partkey", "p_name", "p_brand")


@query("q18_listed_only")
def _(t: MarketTables) -> DataFrame:
    return P.catalog_filter(t.stock_ref, include_delisted=False, delist_column="delisted_date", market="SHSE").select("market", "code", "listing_board")


@query("q19_validity")
def _(t: MarketTables) -> DataFrame:
    return t.membership.where(P.valid_on(F.lit("2001-01-15").cast("date"))).select("concept_id", "stock_market", "stock_code")


@query("q20_recent")
def _(t: MarketTables) -> DataFrame:
    return t.between("2000-04-02", "2000-06-30").bars_sparse.where(P.recent("trade_date", "2000-07-01")).groupBy("code").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


# -- joins and merges --------------------------------------------------------------------------------------------


@query("j01_target_rows")
def _(t: MarketTables) -> DataFrame:
    """Rows on the latest day all tables share; the day is a scalar subquery."""
    target = t.stock_daily.agg(F.max("trade_date").alias("d")).unionByName(t.concept_daily.agg(F.max("trade_date").alias("d"))).agg(F.min("d")).scalar()
    return t.stock_daily.where(F.col("trade_date") == target).select("market", "code", "trade_date", "volume")


@query("j02_concept_members")
def _(t: MarketTables) -> DataFrame:
    sizes = t.membership.groupBy("concept_id").agg(F.count("*").alias("member_count"))
    return t.concept_daily.join(sizes, "concept_id").groupBy("concept_id", "member_count").agg(F.count("*").alias("day_count"))


@query("j03_coverage")
def _(t: MarketTables) -> DataFrame:
    """Rows per brand over the 8 latest days, brands without rows included."""
    first = series.latest_days(t.bars_sparse, 8).agg(F.min("trade_date")).scalar()
    counts = t.bars_sparse.where(F.col("trade_date") >= first).groupBy("code").agg(F.count("*").alias("n"))
    brands = t.raw("part").select(F.col("p_brand").alias("code")).distinct()
    return brands.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("bar_count"))


def _valid_members(t: MarketTables, horizon, cover: bool = False) -> DataFrame:
    members = t.membership.withColumnsRenamed({"stock_market": "market", "stock_code": "code"})
    keys = ["market", "code"]
    joined = intervals.cover_join(t.stock_daily, members, keys, DAY) if cover else merge.interval_join(t.stock_daily, members, keys, DAY, horizon=horizon)
    return joined.groupBy("concept_id", "trade_date").agg(F.count("*").alias("member_count"), exact_sum("volume").alias("volume"))


@query("j04_valid_join")
def _(t: MarketTables) -> DataFrame:
    return _valid_members(t, None)


@query("j04_valid_join_by_year")
def _(t: MarketTables) -> DataFrame:
    """The same with intervals spread over years, for keys with many intervals or very many facts."""
    return _valid_members(t, t.raw("lineitem").agg(F.max("l_shipdate").cast("date")).scalar())


@query("j04_valid_join_by_cover")
def _(t: MarketTables) -> DataFrame:
    """The same with every interval as its dyadic cover."""
    return _valid_members(t, None, cover=True)


@query("j05_anti")
def _(t: MarketTables) -> DataFrame:
    return t.raw("customer").join(t.raw("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("j06_members_without_bar")
def _(t: MarketTables) -> DataFrame:
    day = F.lit("1997-03-03").cast("date")
    bars = t.stock_daily.where((F.col("trade_date") == day) & ~F.col("is_suspended")).select(F.col("market").alias("stock_market"), F.col("code").alias("stock_code"))
    return t.membership.where(P.valid_on(day)).join(bars, ["stock_market", "stock_code"], "left_anti").select("concept_id", "stock_market", "stock_code")


def _recomputed_concepts(t: MarketTables) -> DataFrame:
    members = t.membership.withColumnsRenamed({"stock_market": "market", "stock_code": "code"})
    live = t.stock_daily.where(~F.col("is_suspended") & ~F.col("is_st"))
    joined = merge.interval_join(live, members, ["market", "code"], DAY)
    return joined.groupBy("concept_id", "trade_date").agg(exact_sum("amount").alias("expected_amount"))


@query("j07_tolerance")
def _(t: MarketTables) -> DataFrame:
    """Stored against recomputed amounts (also metric h16's comparison, over all days)."""
    both = t.concept_daily.join(_recomputed_concepts(t), ["concept_id", "trade_date"])
    wrong = S.differs(F.col("amount"), F.col("expected_amount"), relative=1e-6, absolute=1.0)
    return both.groupBy("concept_id").agg(F.count("*").alias("day_count"), F.count_if(wrong).alias("mismatch_count"))


def _session_minutes(days: DataFrame) -> DataFrame:
    minutes = F.concat(F.sequence(F.lit(571), F.lit(690)), F.sequence(F.lit(781), F.lit(900)))
    return days.withColumn("minute", F.explode(minutes)).withColumn(
        "bar_time", F.date_trunc("day", "trade_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("minute"))
    )


@query("j08_grid")
def _(t: MarketTables) -> DataFrame:
    """Days x session minutes, by exploding sequences; counted per day and minute range."""
    days = t.news.select("trade_date").distinct()
    return _session_minutes(days).groupBy("trade_date").agg(F.count("*").alias("minute_count"), F.min("bar_time").alias("first_minute"), F.max("bar_time").alias("last_minute"))


@query("j09_minute_rows")
def _(t: MarketTables) -> DataFrame:
    counts = t.bars_minute.groupBy("bar_time").agg(F.count("*").alias("n"))
    grid = _session_minutes(t.news.select("trade_date").distinct())
    return grid.join(counts, "bar_time", "left").select("trade_date", "bar_time", F.coalesce("n", F.lit(0)).alias("row_count"))


def _side(t: MarketTables, flag: str) -> DataFrame:
    """Monthly facts per brand from one return flag, with holes for the merge to fill."""
    price = F.col("l_extendedprice")
    grouped = t.trades.where(F.col("l_returnflag") == flag).groupBy(F.col("p_brand").alias("code"), F.date_trunc("month", "trade_date").cast("date").alias("month"))
    sums = grouped.agg(exact_sum("l_quantity").alias("volume"), exact_sum(price).alias("amount"), F.count("*").alias("n"))
    return sums.select("code", "month", F.when(F.col("n") % 3 != 0, F.col("volume")).alias("volume"), "amount", F.when(F.col("n") % 2 == 0, F.lit(flag)).otherwise("").alias("note"))


@query("j10_merge")
def _(t: MarketTables) -> DataFrame:
    return merge.priority_merge([_side(t, "R"), _side(t, "A"), _side(t, "N")], ["code", "month"])


@query("j11_left_two_keys")
def _(t: MarketTables) -> DataFrame:
    day = F.lit("1997-03-03").cast("date")
    bars = t.stock_daily.where(F.col("trade_date") == day).select(F.col("market").alias("stock_market"), F.col("code").alias("stock_code"), "volume")
    joined = t.membership.join(bars, ["stock_market", "stock_code"], "left")
    return joined.groupBy("concept_id").agg(F.count("*").alias("member_count"), F.count("volume").alias("with_bar"))


def _reports(t: MarketTables, status: str, value: str) -> DataFrame:
    """Quarterly facts per nation, announced 20 days after the quarter starts."""
    placed = t.raw("orders").where(F.col("o_orderstatus") == status).select(
        F.col("o_custkey").alias("c_custkey"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("report_period"), "o_totalprice"
    )
    homes = t.raw("customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    sums = placed.join(homes, "c_custkey").groupBy("code", "report_period").agg(exact_sum("o_totalprice").alias(value), F.count("*").alias("order_count"))
    return sums.withColumn("announcement_date", F.date_add("report_period", 20))


def pit_sources(t: MarketTables) -> tuple[DataFrame, DataFrame]:
    """Two sources of quarterly facts, of finished and of pending orders; few quarters have both."""
    return _reports(t, "F", "profit"), _reports(t, "P", "revenue")


@query("j12_pit_merge")
def _(t: MarketTables) -> DataFrame:
    return merge.pit_merge(*pit_sources(t), ["code", "report_period", "announcement_date"])


@query("j13_column_exists")
def _(t: MarketTables) -> DataFrame:
    """Blank values of an optional column: every row counts as blank where the column does not exist."""
    def blanks(df: DataFrame, column: str) -> DataFrame:
        found = column in df.columns
        value = S.blank(F.col(column)) if found else F.lit(True)
        return df.agg(F.lit(column).alias("column_name"), F.lit(0 if found else 1).cast("long").alias("missing_column"), F.count_if(value).alias("blank_count"))

    return blanks(t.stock_ref, "board_type").unionByName(blanks(t.stock_ref, "industry"))


@query("j14_fill")
def _(t: MarketTables) -> DataFrame:
    sources = [
        t.trades.where(F.col("l_returnflag") == flag).groupBy(F.col("p_brand").alias("code"), "trade_date").agg(exact_sum("l_quantity").alias("volume"))
        for flag in ("R", "A", "N")
    ]
    return merge.fill_missing_only(sources, ["code", "trade_date"]).withColumn("source_rank", F.col("source_rank").cast("long"))


@query("j15_sources")
def _(t: MarketTables) -> DataFrame:
    """Events with their documents as nested sources, shown as text."""
    docs = t.raw("documents").select((F.floor(F.col("doc_id") / 3)).alias("event_id"), F.col("doc_id").alias("source_record_id"), F.col("source").alias("source_name"))
    events = t.news.select("event_id", "event_type")
    nested = merge.nest_children(events, docs, "event_id", "source_record_id", "sources")
    text = F.array_join(F.transform("sources", lambda s: F.concat(s.getField("source_record_id").cast("string"), F.lit(":"), s.getField("source_name"))), ",")
    return nested.select("event_id", "event_type", F.coalesce(text, F.lit("")).alias("sources"))


@query("j16_active_members")
def _(t: MarketTables) -> DataFrame:
    day = F.lit("2001-09-03").cast("date")
    alive = t.stock_ref.where(P.valid_on(day, "listed_date", "delisted_date")).select(F.col("market").alias("stock_market"), F.col("code").alias("stock_code"))
    return t.membership.where(P.valid_on(day)).join(alive, ["stock_market", "stock_code"]).select("concept_id", "stock_market", "stock_code")


@query("j17_asof")
def _(t: MarketTables) -> DataFrame:
    """Daily order totals per nation with the latest announced quarter."""
    homes = t.raw("customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    daily = t.raw("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("trade_date"), "o_totalprice")
    totals = daily.join(homes, "c_custkey").groupBy("code", "trade_date").agg(exact_sum("o_totalprice").alias("total"))
    reports = _reports(t, "F", "profit").select("code", "announcement_date", "report_period", "profit")
    return merge.as_of_latest(totals, reports, CODE, DAY, "announcement_date")


@query("j17_asof_blocks")
def _(t: MarketTables) -> DataFrame:
    """Every purchase with the latest view of the same user, carried over blocks of four days: two sides of the same size."""
    events = t.raw("events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return asof.as_of_blocks(bought, seen, ["user_id"], "ts", "seen_at", lambda time: asof.day_blocks(time, 4), tie=["seen_id"])


# -- aggregations ------------------------------------------------------------------------------------------------


@query("a01_counts")
def _(t: MarketTables) -> DataFrame:
    return t.membership.groupBy("concept_id").agg(F.count("*").alias("member_count"))


@query("a02_filtered_count")
def _(t: MarketTables) -> DataFrame:
    return t.stock_daily.groupBy("market").agg(F.count("*").alias("row_count"), F.count_if("is_st").alias("st_count"), F.count_if("is_suspended").alias("suspended_count"))


@query("a03_distinct_days")
def _(t: MarketTables) -> DataFrame:
    """Distinct days per type: duplicates are removed on the map side before the count."""
    days = t.trades.select("p_type", "trade_date").distinct()
    return days.groupBy("p_type").agg(F.count("*").alias("day_count"))


@query("a04_filtered_sum")
def _(t: MarketTables) -> DataFrame:
    live = ~F.col("is_suspended") & ~F.col("is_st") & (F.col("amount") > 0)
    return t.stock_daily.groupBy("market", "trade_date").agg(exact_sum(F.when(live, F.col("amount"))).alias("amount"))


def stock_changes(t: MarketTables) -> DataFrame:
    return series.previous_change(t.stock_daily, ["market", "code"], DAY)


@query("a05_weighted_mean")
def _(t: MarketTables) -> DataFrame:
    from tapeloom.quality.contract import live_row, weighted_pct

    return stock_changes(t).groupBy("market", "trade_date").agg(rounded(weighted_pct(live_row()), 6).alias("pct_chg"))


@query("a06_dup_keys")
def _(t: MarketTables) -> DataFrame:
    from tapeloom.quality.contract import duplicate_keys

    return duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("a07_filtered_min_max")
def _(t: MarketTables) -> DataFrame:
    usable = F.when(F.col("volume") > 25, F.col("trade_date"))
    return t.bars_sparse.groupBy("code").agg(F.min(usable).alias("first_day"), F.max(usable).alias("last_day"), F.min(F.when(F.col("volume") > 25, F.col("volume"))).alias("least_volume"))


@query("a08_least_max")
def _(t: MarketTables) -> DataFrame:
    frames = [t.raw("orders").select(F.col("o_orderdate").cast("date").alias("d")), t.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("d"))]
    maxima = [frame.agg(F.max("d").alias("d")) for frame in frames]
    return maxima[0].unionByName(maxima[1]).agg(F.min("d").alias("target_date"), F.count_distinct("d").alias("day_count"))


@query("a09_matched_count")
def _(t: MarketTables) -> DataFrame:
    """Open days and days with a bar, per year, over the bars of all codes."""
    matched = t.calendar.join(t.bars_daily.select("trade_date", "code", "volume"), "trade_date", "left")
    return matched.groupBy(F.year("trade_date").alias("year"), "code").agg(F.count("*").alias("expected_days"), F.count("volume").alias("actual_days"))


@query("a10_distinct")
def _(t: MarketTables) -> DataFrame:
    return t.trades.select("p_brand", "p_type").distinct()


def _day_checks(t: MarketTables) -> DataFrame:
    """A check per brand and month: unhealthy below 20 rows' worth of days, warning below 25."""
    days = t.bars_sparse.groupBy("code", F.date_trunc("month", "trade_date").cast("date").alias("month")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") < 12, "unhealthy").when(F.col("n") < 15, "warning").when(F.col("n") == 16, "unknown").otherwise("healthy")
    return days.select(F.concat_ws(":", "code", F.year("month")).alias("capability_id"), "code", "month", status.alias("status"))


@query("a11_rollup")
def _(t: MarketTables) -> DataFrame:
    from tapeloom.quality.rollup import capability_status, group_summary

    capabilities = capability_status(_day_checks(t)).withColumn("group", F.substring_index("capability_id", ":", 1))
    return group_summary(capabilities)


@query("a12_worst")
def _(t: MarketTables) -> DataFrame:
    from tapeloom.quality.rollup import worst

    return _day_checks(t).groupBy("code").agg(worst("status").alias("worst_status"))


@query("a13_capability")
def _(t: MarketTables) -> DataFrame:
    from tapeloom.quality.rollup import capability_status

    return capability_status(_day_checks(t))


@query("a14_enough_rows")
def _(t: MarketTables) -> DataFrame:
    brands = t.raw("part").select(F.col("p_brand").alias("code"))
    few, many = (series.every_code_has(t.bars_sparse, brands, "code", n) for n in (1, 2000))
    return few.withColumn("wanted", F.lit(1)).unionByName(many.withColumn("wanted", F.lit(2000)))


# -- windows -----------------------------------------------------------------------------------------------------


@query("w01_prev_close")
def _(t: MarketTables) -> DataFrame:
    return series.previous_change(t.bars_sparse, CODE, DAY).select("code", "trade_date", "close", "pre_close", "change", "pct_chg")


@query("w02_sma")
def _(t: MarketTables) -> DataFrame:
    names = ["ma5", "ma10", "ma20", "ma60"]
    return round_columns(indicators.sma(t.bars_daily, CODE, DAY), names).select("code", "trade_date", *names)


@query("w03_ema")
def _(t: MarketTables) -> DataFrame:
    return round_columns(indicators.ema(t.bars_daily, CODE, DAY), ["ema12", "ema26"]).select("code", "trade_date", "ema12", "ema26")


@query("w04_macd")
def _(t: MarketTables) -> DataFrame:
    names = ["dif", "dea", "macd"]
    return round_columns(indicators.macd(t.bars_daily, CODE, DAY), names).select("code", "trade_date", *names)


@query("w05_rsi")
def _(t: MarketTables) -> DataFrame:
    names = ["rsi6", "rsi12", "rsi24"]
    return round_columns(indicators.rsi(t.bars_daily, CODE, DAY), names).select("code", "trade_date", *names)


@query("w06_extremes")
def _(t: MarketTables) -> DataFrame:
    window = series.series_window(CODE, DAY)
    return t.bars_daily.select(
        "code", "trade_date", indicators.rolling(F.min, "low", window, 9).alias("low9"), indicators.rolling(F.max, "high", window, 9).alias("high9")
    )


@query("w07_rsv")
def _(t: MarketTables) -> DataFrame:
    return round_columns(indicators.kdj(t.bars_sparse, CODE, DAY), ["rsv"]).select("code", "trade_date", "rsv")


@query("w08_kdj")
def _(t: MarketTables) -> DataFrame:
    names = ["kdj_k", "kdj_d", "kdj_j"]
    return round_columns(indicators.kdj(t.bars_daily, CODE, DAY), names).select("code", "trade_date", *names)


@query("w09_boll")
def _(t: MarketTables) -> DataFrame:
    names = ["boll_upper", "boll_mid", "boll_lower"]
    return round_columns(indicators.bollinger(t.bars_daily, CODE, DAY), names).select("code", "trade_date", *names)


TECHNICAL_VALUES = list(indicators.TECHNICAL_FIELDS[3:])


@query("w10_technical")
def _(t: MarketTables) -> DataFrame:
    return round_columns(indicators.technical(t.bars_daily), TECHNICAL_VALUES)


@query("w10_technical_segmented")
def _(t: MarketTables) -> DataFrame:
    """The same over pieces of each series, the plan for series too long for one task."""
    return round_columns(indicators.technical_by_segment(t.bars_daily, rows=1024), TECHNICAL_VALUES)


@query("w10_technical_minutes")
def _(t: MarketTables) -> DataFrame:
    """Minute bars: few, very long series, cut into pieces of 2048 rows and numbered per day."""
    minutes = t.bars_minute.withColumnRenamed("bar_time", "trade_date")
    return round_columns(indicators.technical_by_segment(minutes, block=F.col("trade_date").cast("date"), rows=2048), TECHNICAL_VALUES)


@query("w11_holder_change")
def _(t: MarketTables) -> DataFrame:
    return round_columns(series.count_change(t.holder_counts, CODE, DAY), ["change_pct"])


@query("w12_mean_volume")
def _(t: MarketTables) -> DataFrame:
    mean = factors.mean_volume(t.bars_sparse, CODE, DAY, value="volume")
    return mean.select("code", "trade_date", rounded("mean_volume_5d_shares").alias("mean_volume_5d_shares"))


@query("w13_moving_averages")
def _(t: MarketTables) -> DataFrame:
    names = ["ma10", "ma20", "ma40"]
    return round_columns(indicators.sma(t.bars_sparse, CODE, DAY, (10, 20, 40)), names).select("code", "trade_date", *names)


def strategy_rows(t: MarketTables) -> DataFrame:
    """Factor inputs: shares and market value per brand from the part catalogue, zero for two brands."""
    parts = t.raw("part").groupBy(F.col("p_brand").alias("code")).agg(exact_sum("p_retailprice").alias("cap"), F.sum("p_size").cast("double").alias("shares"))
    known = parts.select("code", F.when(F.col("code") == "Brand#3", 0.0).otherwise(F.col("cap")).alias("float_market_cap"), F.when(F.col("code") != "Brand#5", F.col("shares")).alias("free_float_shares"))
    return t.bars_sparse.join(known, "code").withColumns(
        {"volume_shares": F.col("volume"), "active_buy_amount": F.col("amount") / 2, "upper_limit": F.col("low") * 1.5, "lower_limit": F.col("high") * 0.6}
    )


@query("w14_ratios")
def _(t: MarketTables) -> DataFrame:
    result = factors.strategy_window(strategy_rows(t))
    names = ["mean_volume_5d_shares", "ma10", "ma20", "ma40"]
    return round_columns(result, names).select("code", "trade_date", "active_buy_amount_proportion_all", "mean_volume_5d_to_free_float_shares", "price_band_state", *names)


@query("w15_latest_days")
def _(t: MarketTables) -> DataFrame:
    return series.latest_days(t.bars_sparse, 8, F.lit("1999-12-31").cast("date"))


@query("w16_gaps")
def _(t: MarketTables) -> DataFrame:
    brands = t.raw("part").select(F.col("p_brand").alias("code"))
    return series.missing_ranges(t.bars_sparse, brands, series.open_days(t.calendar), "code")


# -- sort, set operations, scalars -------------------------------------------------------------------------------


@query("o01_entity_time")
def _(t: MarketTables) -> DataFrame:
    return t.bars_sparse.orderBy("code", "trade_date").select("code", "trade_date", "volume")


@query("o02_time_entity")
def _(t: MarketTables) -> DataFrame:
    return t.bars_sparse.orderBy("trade_date", "code").select("trade_date", "code", "amount")


@query("o03_top_n")
def _(t: MarketTables) -> DataFrame:
    return t.bars_sparse.orderBy(F.col("amount").desc(), "code", "trade_date").limit(20).select("code", "trade_date", "amount")


@query("o04_first_issues")
def _(t: MarketTables) -> DataFrame:
    """First 8 thin days of each brand as text. A brand's list is bounded by the calendar."""
    thin = F.array_sort(F.collect_list(F.when(F.col("volume") < 20, F.col("trade_date").cast("string"))))
    return t.bars_sparse.groupBy("code").agg(F.array_join(F.slice(thin, 1, 8), ";").alias("issues"), F.size(thin).cast("long").alias("issue_count"))


@query("o05_groups")
def _(t: MarketTables) -> DataFrame:
    return t.trades.groupBy("p_type").agg(F.count("*").alias("n")).orderBy("p_type")


@query("o06_sort_by")
def _(t: MarketTables) -> DataFrame:
    return selection.page(t.news, [F.col("announcement_time").desc(), "event_id"], 50, 25).select("event_id", "announcement_time")


@query("u01_union_maxima")
def _(t: MarketTables) -> DataFrame:
    rows = [df.agg(F.max("trade_date").alias("trade_date")).select(F.lit(name).alias("table_name"), "trade_date") for name, df in (("daily", t.bars_daily), ("stock", t.stock_daily), ("concept", t.concept_daily), ("calendar", t.calendar))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("u02_session_minutes")
def _(t: MarketTables) -> DataFrame:
    """Trades of the session minutes: how many of the 240 minutes of each day have events."""
    grid = _session_minutes(t.news.select("trade_date").distinct())
    return grid.join(t.bars_minute.select("bar_time").distinct(), "bar_time", "left_semi").groupBy("trade_date").agg(F.count("*").alias("minutes_with_events"))


@query("u03_keep_first")
def _(t: MarketTables) -> DataFrame:
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    first = selection.keep_first(rows, ["l_orderkey", "l_linenumber"], F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_suppkey"))
    return first.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")


@query("u04_missing")
def _(t: MarketTables) -> DataFrame:
    """Open days without a bar, per brand: the calendar exploded per brand, minus the bars."""
    days = series.open_days(t.calendar)
    grid = t.raw("part").select(F.col("p_brand").alias("code")).distinct().withColumn("trade_date", F.explode(days))
    return merge.absent_rows(grid, t.bars_sparse, ["code", "trade_date"])


@query("f02_guarded_ratio")
def _(t: MarketTables) -> DataFrame:
    line = t.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(exact_sum("l_tax").alias("tax"), exact_sum(F.when(F.col("l_discount") == 0.05, 0).otherwise(0)).alias("zero"))
    return line.select("l_returnflag", "l_linestatus", S.ratio(F.col("tax"), F.col("zero")).alias("by_zero"), rounded(S.ratio(F.col("tax"), F.col("tax") + 1), 8).alias("by_tax"))


@query("f03_greatest_least")
def _(t: MarketTables) -> DataFrame:
    return t.bars_daily.select("code", "trade_date", F.greatest("volume", F.lit(500.0)).alias("at_least"), F.least("volume", F.lit(500.0)).alias("at_most"))


@query("f06_market_code")
def _(t: MarketTables) -> DataFrame:
    return t.stock_ref.select("market", "code", S.valid_market_code(F.col("market"), F.col("code")).alias("valid"))


@query("f07_garbled_names")
def _(t: MarketTables) -> DataFrame:
    texts = t.raw("documents").select("doc_id", "lang", S.garbled_name(F.col("text")).alias("garbled"))
    return texts.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("garbled").alias("garbled_count"))


@query("f09_local_time")
def _(t: MarketTables) -> DataFrame:
    local = S.local_time(F.col("announcement_time"))
    return t.news.select("event_id", local.cast("date").alias("local_date"), S.hour_minute(local).alias("local_minute"))


@query("f10_date_arithmetic")
def _(t: MarketTables) -> DataFrame:
    day = F.col("trade_date")
    return t.calendar.select("trade_date", F.date_sub(day, 20).alias("from_date"), day.between(F.lit("1997-01-01"), F.lit("1997-12-31")).alias("in_1997"))


@query("f12_json_field")
def _(t: MarketTables) -> DataFrame:
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("")).alias("absent"))


@query("f15_to_numeric")
def _(t: MarketTables) -> DataFrame:
    """Text to number, null where it does not parse."""
    value = S.to_double(F.substring_index(F.col("o_orderpriority"), "-", 1))
    tail = S.to_double(F.substring_index(F.col("o_orderpriority"), "-", -1))
    return t.raw("orders").groupBy("o_orderpriority").agg(F.max(value).alias("number"), F.count(tail).alias("parsed_tail"))


@query("f16_dates")
def _(t: MarketTables) -> DataFrame:
    text = F.date_format("trade_date", "yyyyMMdd")
    dashed = F.date_format("trade_date", "yyyy-MM-dd")
    return t.calendar.select("trade_date", S.to_day(text).alias("compact"), S.to_day(dashed).alias("dashed"), S.to_day(F.concat(dashed, F.lit("x"))).alias("bad"))


@query("f17_code_list")
def _(t: MarketTables) -> DataFrame:
    text = F.concat(F.lit(" "), "p_brand", F.lit(", ,"), "p_type", F.lit(" ,"), "p_brand")
    return t.raw("part").select("p_partkey", F.array_join(S.code_list(text), "|").alias("codes"))


@query("f20_array_member")
def _(t: MarketTables) -> DataFrame:
    related = F.array(F.col("stock_code"), F.col("stock_code") + 1)
    return t.news.where(F.array_contains(related, F.lit(8).cast("long"))).select("event_id", "stock_code")


@query("f01_coalesce")
def _(t: MarketTables) -> DataFrame:
    """Brand-days without a trade of one return flag count as zero."""
    by_flag = t.trades.groupBy("p_brand", "trade_date").agg(exact_sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"))
    return by_flag.select("p_brand", "trade_date", F.coalesce("returned", F.lit(0.0)).alias("returned"))


@query("f04_tolerance")
def _(t: MarketTables) -> DataFrame:
    """Close against the middle of the day's range: relative and absolute tolerances."""
    middle = (F.col("low") + F.col("high")) / 2
    return t.bars_daily.groupBy("code").agg(
        F.count_if(S.differs(F.col("close"), middle, relative=0.5, absolute=1.0)).alias("beyond_half"), F.count_if(S.differs(F.col("close"), middle, absolute=100.0)).alias("beyond_100")
    )


@query("f05_case")
def _(t: MarketTables) -> DataFrame:
    state = factors.price_band_state(F.col("close"), F.col("low") * 2, F.col("high") / 2)
    return t.bars_sparse.groupBy(state.alias("price_band_state")).agg(F.count("*").alias("n"))


@query("f08_casts")
def _(t: MarketTables) -> DataFrame:
    ts = F.col("announcement_time")
    return t.news.select("event_id", ts.cast("date").alias("day"), F.date_format(ts, "HH:mm:ss").alias("time_text"), ts.cast("date").cast("string").alias("day_text"), F.col("importance_score").cast("long").alias("score"))


@query("f11_sequence")
def _(t: MarketTables) -> DataFrame:
    """Every date between the first and last bar of each brand."""
    spans = t.bars_sparse.groupBy("code").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    return spans.select("code", F.explode(F.sequence("first_day", "last_day")).alias("trade_date"))


@query("f13_invalid_number")
def _(t: MarketTables) -> DataFrame:
    tax = F.col("l_tax")
    seeded = F.when(tax == 0, float("nan")).when(tax == 0.01, -float("inf")).when(tax != 0.02, F.col("l_extendedprice"))
    return t.raw("lineitem").groupBy("l_linestatus").agg(F.count_if(S.invalid_number(seeded)).alias("invalid_count"), F.count_if(S.not_finite(seeded)).alias("not_finite_count"))


@query("f14_diff_clip")
def _(t: MarketTables) -> DataFrame:
    window = series.series_window(CODE, DAY)
    delta = F.col("close") - F.lag("close").over(window)
    moved = t.bars_daily.withColumn("diff", delta)
    return moved.select("code", "trade_date", "diff", F.when(F.col("diff").isNotNull(), F.greatest("diff", F.lit(0.0))).alias("gain"), F.when(F.col("diff").isNotNull(), F.greatest(-F.col("diff"), F.lit(0.0))).alias("loss"))


@query("f18_join_texts")
def _(t: MarketTables) -> DataFrame:
    parts = F.concat_ws(";", F.when(F.col("is_st"), "st"), F.when(F.col("is_suspended"), "suspended"), F.when(F.col("volume") < 10, F.lit("thin")))
    return t.stock_daily.groupBy(parts.alias("issues")).agg(F.count("*").alias("n"))


@query("f19_hour_minute")
def _(t: MarketTables) -> DataFrame:
    return t.bars_minute.groupBy("code").agg(S.hour_minute(F.min("bar_time")).alias("first_minute"), S.hour_minute(F.max("bar_time")).alias("last_minute"))
