"""Stored bar states, observed checks, chained streams and joined streams against plain versions."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.bar_states import merge_states, state_of
from tapeloom.operators.bars import rollup_days
from tapeloom.plans.quotes import session_ends
from tapeloom.quality.checks import Checks, Rule
from tapeloom.sources.bar_store import BarStore
from tapeloom.sources.commits import Commits
from tapeloom.sources.store import MarketStore
from tapeloom.streaming import jobs

BAR = "code string, bar_time timestamp_ntz, open double, high double, low double, close double, volume double, amount double"
START = dt.datetime(2024, 1, 1, 9, 31)


def minute(code, day, k, price=None):
    price = float((k * 7 + day * 3) % 23) if price is None else price
    return (code, START + dt.timedelta(days=day, minutes=k), price, price + 1, price - 1, price + 0.5, 1.0 + k, 10.0 * k)


def bars(spark, rows):
    return spark.createDataFrame(rows, BAR).repartition(3)


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def by_hand(rows, label):
    """Bars of the minutes that ``label`` puts together, by code and its value."""
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault((r[0], label(r[1].date())), []).append(r)
    return sorted((code, g[-1][1].date(), g[0][2], max(r[3] for r in g), min(r[4] for r in g), g[-1][5], sum(r[6] for r in g), sum(r[7] for r in g), len(g)) for (code, _), g in groups.items())


LABELS = {"1d": lambda d: d, "1w": lambda d: d - dt.timedelta(days=d.weekday()), "1mo": lambda d: (d.year, d.month)}


def test_states_merge_in_any_order_and_number_of_steps(spark):
    draw, rows = random.Random(1), [minute("a", d, k) for d in range(3) for k in range(40)]
    states = state_of(bars(spark, rows), ["code"], "bar_time").withColumn("part", (F.rand(draw.randrange(99)) * 5).cast("int"))
    once = merge_states(states, ["code"]).collect()
    twice = merge_states(merge_states(merge_states(states, ["code", "part", F.hour("open_time").alias("h")]), ["code", "part"]), ["code"]).collect()
    assert once == twice and (once[0].open, once[0].close, once[0].bar_count) == (rows[0][2], rows[-1][5], 120)
    plan = merge_states(states, ["code"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_max_by" in plan


def test_a_correction_rewrites_its_day_on_each_level_and_no_other(spark, tmp_path):
    store, rows = BarStore(spark, str(tmp_path)), [minute(c, d, k) for c in "ab" for d in range(40) for k in range(6)]
    assert len(store.apply(bars(spark, rows))) == 40
    files = lambda: {p for p in tmp_path.rglob("part-*") if "/days/" not in str(p)}
    before = files()
    fixed = [r if r[:2] != ("a", START + dt.timedelta(days=12, minutes=3)) else minute("a", 12, 3, 99.0) for r in rows]
    reading = store.bars("1w")  # planned before the correction
    assert store.apply(bars(spark, [minute("a", 12, 3, 99.0)])) == [dt.date(2024, 1, 13)]
    written = {(p.relative_to(tmp_path).parts[0], p.parent.name) for p in files() - before}
    assert written == {("1m", "day=2024-01-13"), ("1d", "day=2024-01-13")} and before <= files()
    assert listed(reading) == by_hand(rows, LABELS["1w"])
    for freq, label in LABELS.items():
        assert listed(store.bars(freq)) == by_hand(fixed, label), freq
    assert listed(store.bars("1m")) == sorted((*r, 1) for r in fixed)
    weekly = rollup_days(bars(spark, fixed).withColumn("trade_date", F.col("bar_time")), "1w")
    assert sorted((r.code, r.open, r.close, r.volume) for r in weekly.collect()) == sorted((r.code, r.open, r.close, r.volume) for r in store.bars("1w").collect())


def test_new_days_nothing_and_a_run_that_dies(spark, tmp_path, monkeypatch):
    store, rows = BarStore(spark, str(tmp_path)), [minute("a", d, k) for d in range(3) for k in range(4)]
    assert store.apply(bars(spark, rows[:0])) == [] and store.commits.latest() is None
    store.apply(bars(spark, rows))
    monkeypatch.setattr(Commits, "add", lambda self, content: (_ for _ in ()).throw(RuntimeError("lost driver")))
    with pytest.raises(RuntimeError):
        store.apply(bars(spark, [minute("a", 1, 2, 50.0), minute("a", 9, 0)]))
    monkeypatch.undo()
    assert listed(store.bars("1d")) == by_hand(rows, LABELS["1d"])
    assert len(store.apply(bars(spark, [minute("a", 9, 0)]))) == 1
    assert listed(BarStore(spark, str(tmp_path)).bars("1d")) == by_hand(rows + [minute("a", 9, 0)], LABELS["1d"])


def test_observed_checks_equal_those_of_a_scan(spark, tmp_path):
    rows = [(f"c{k}", dt.date(2024, 1, 1 + k % 5), 1.0, 2.0 if k % 7 else 0.5, 0.8, 1.5, -1.0 if k % 9 == 0 else 1.0, 5.0) for k in range(100)]
    table = spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double, amount double")
    store = MarketStore(spark, str(tmp_path))
    checks = Checks(spark, {}, dt.datetime(2024, 1, 20))
    rules = [Rule("ohlc_valid", "fact.x"), Rule("non_negative", "fact.x", column="volume"), Rule("non_negative", "fact.x", column="amount"), Rule("ohlc_valid", "fact.x")]
    jobs_before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = store.write_checked("fact.x", table, checks, rules, "trade_date").collect()
    scanned = Checks(spark, {"fact.x": store.table("fact.x")}, dt.datetime(2024, 1, 20), time_columns={"fact.x": "trade_date"}).run(rules).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, scanned)) and {r.status for r in got} == {"healthy", "unhealthy"}
    assert len(jobs_before) >= 0 and store.table("fact.x").count() == 100
    assert store.write_checked("fact.y", table, checks, []).count() == 0
    for rule in (Rule("primary_key_duplicate_absent", "fact.x"), Rule("ohlc_valid", "fact.other")):
        with pytest.raises(ValueError):
            store.write_checked("fact.x", table, checks, [rule])


TICKS = "event_id long, ts timestamp_ntz, code string, value double"


def deliver(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/.staged-{name}")
    folder.mkdir(exist_ok=True)
    for part in (folder / f".staged-{name}").glob("part-*.parquet"):
        part.rename(folder / f"{name}.parquet")


def test_chained_levels_resume_and_equal_batch_bars(spark, tmp_path):
    draw = random.Random(3)
    ticks = sorted((dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(seconds=draw.randrange(4 * 3600)), draw.choice("ab"), float(draw.randrange(100))) for _ in range(900))
    ticks = [(k, *t) for k, t in enumerate(ticks)]
    widths, source = ("1 minute", "5 minutes", "30 minutes"), tmp_path / "ticks"

    def run():
        stream = jobs.read_events(spark, str(source), spark.createDataFrame([], TICKS).schema)
        jobs.append_to(jobs.live_bars(stream), str(tmp_path / "bars/1-minute"), str(tmp_path / "check/1-minute")).awaitTermination()
        jobs.chain_bars(spark, str(tmp_path / "bars"), str(tmp_path / "check"), widths)
        return {w: listed(spark.read.parquet(str(tmp_path / "bars" / w.replace(" ", "-"))).select("code", F.col("bar_time").cast("timestamp_ntz"), "open", "high", "low", "close", "volume")) for w in widths}

    def floor(at, minutes):
        return at.replace(minute=at.minute // minutes * minutes, second=0)

    def plain(some, minutes, until):
        groups = {}
        for _, at, code, value in some:
            groups.setdefault((code, floor(at, minutes)), []).append(value)
        return sorted((c, at, g[0], max(g), min(g), g[-1], len(g)) for (c, at), g in groups.items() if at + dt.timedelta(minutes=minutes) <= until)

    def expected(some):
        out, until = {}, some[-1][1] - dt.timedelta(minutes=10)
        for width in widths:
            out[width] = plain(some, int(width.split()[0]), until)
            until = max((r[1] for r in out[width]), default=until)
        return out

    cut = 500
    deliver(spark, source, "one", ticks[:cut], TICKS)
    assert run() == expected(ticks[:cut])
    assert run() == expected(ticks[:cut])  # nothing new
    deliver(spark, source, "two", ticks[cut:], TICKS)
    assert run() == expected(ticks)


def test_a_days_audit_comes_when_its_close_has_passed(spark, tmp_path):
    schema = "code string, bar_time timestamp, bar_end timestamp, open double, high double, low double, close double, volume long, amount double"
    ends = session_ends(1)

    def rows(day, minutes, code="a"):
        at = [dt.datetime(2024, 1, day) + dt.timedelta(minutes=m) for m in minutes]
        return [(code, x, x + dt.timedelta(minutes=1), 1.0, 1.0, 1.0, 1.0, 1, 1.0) for x in at]

    def run():
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "bars"))
        jobs.append_to(jobs.session_audit(stream, ends), str(tmp_path / "days"), str(tmp_path / "check")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "days"))
        return sorted((r.code, r.trade_date.day, r.minute_count, r.missing_count, r.first_minute, r.last_minute) for r in found.collect())

    deliver(spark, tmp_path / "bars", "one", rows(2, ends) + rows(2, ends[3:200], "b") + rows(2, [100, 1400]) + rows(3, ends[:50]), schema)
    two = [("a", 2, 240, 0, "09:31", "15:00"), ("b", 2, 197, 43, "09:34", "14:20")]
    assert run() == two  # the third day is still open
    deliver(spark, tmp_path / "bars", "two", rows(3, ends[60:]), schema)
    assert run() == two  # 15:00 itself has come, nothing after it
    deliver(spark, tmp_path / "bars", "three", rows(3, [901], "c"), schema)
    assert run() == sorted([*two, ("a", 3, 230, 10, "09:31", "15:00")])


def test_streams_out_of_order_are_joined_as_in_a_batch(spark, tmp_path):
    draw, base = random.Random(5), dt.datetime(2024, 1, 2)
    event = "id long, user string, ts timestamp_ntz"
    source = "user string, source_ts timestamp_ntz, source long"
    events = [(k, draw.choice("abcd"), base + dt.timedelta(minutes=k, seconds=draw.randrange(60))) for k in range(240)]
    sources = [(draw.choice("abcx"), base + dt.timedelta(minutes=2 * k, seconds=draw.randrange(60)), k) for k in range(120)]

    def run():
        one = jobs.read_events(spark, str(tmp_path / "events"), spark.createDataFrame([], event).schema)
        two = jobs.read_events(spark, str(tmp_path / "sources"), spark.createDataFrame([], source).schema, "source_ts")
        jobs.append_to(jobs.with_sources(one, two, ["user"], "ts", "source_ts", "5 minutes"), str(tmp_path / "rows"), str(tmp_path / "check")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "rows"))
        assert rows.columns == ["id", "user", "ts", "source_ts", "source"]
        return sorted((r.id, -1 if r.source is None else r.source) for r in rows.collect())

    def plain(some, others):
        pairs = [(e[0], s[2]) for e in some for s in others if e[1] == s[0] and e[2] <= s[1] <= e[2] + dt.timedelta(minutes=5)]
        clock = min(max(e[2] for e in some), max(s[1] for s in others)) - dt.timedelta(minutes=10)
        met = {k for k, _ in pairs}
        return sorted(pairs + [(e[0], -1) for e in some if e[0] not in met and e[2] + dt.timedelta(minutes=5) < clock])

    deliver(spark, tmp_path / "events", "one", events[:100], event)
    deliver(spark, tmp_path / "sources", "one", sources[:30], source)  # sources lag behind
    first = run()
    assert first == plain(events[:100], sources[:30])
    deliver(spark, tmp_path / "sources", "two", sources[30:], source)
    deliver(spark, tmp_path / "events", "two", events[100:], event)
    got = run()
    assert got == plain(events, sources) and len(got) > len(first) and any(s < 0 for _, s in got)
