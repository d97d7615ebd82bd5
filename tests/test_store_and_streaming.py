from __future__ import annotations

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from tapeloom.session import shared_folder
from tapeloom.sources.store import MarketStore, availability, read_result, write_result
from tapeloom.streaming import jobs

SCHEMA = "code string, trade_date date, close double"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def day(n):
    return dt.date(2024, 1, n)


def found(df):
    return {(r.code, r.trade_date.day): r.close for r in df.collect()}


def test_write_replaces_only_present_partitions(spark, tmp_path):
    store = MarketStore(spark, str(tmp_path))
    store.write("fact.x", frame(spark, ("a", day(1), 1.0), ("a", day(2), 2.0)), "trade_date", ["code"])
    store.write("fact.x", frame(spark, ("b", day(2), 5.0)), "trade_date", ["code"])
    assert found(store.table("fact.x")) == {("a", 1): 1.0, ("b", 2): 5.0}
    assert set(store.columns("fact.x")) == {"code", "trade_date", "close"}
    assert store.find("fact.absent") is None and store.columns("fact.absent") == []


def test_later_sources_fill_the_store(spark, tmp_path):
    store = MarketStore(spark, str(tmp_path))
    store.write("fact.x", frame(spark, ("a", day(1), 1.0), ("a", day(2), 2.0)), "trade_date")
    second, third = frame(spark, ("a", day(2), 9.0), ("b", day(2), 3.0)), frame(spark, ("b", day(2), 8.0), ("b", day(3), 4.0))
    filled = store.fill_and_write_back("fact.x", [second, third], ["code", "trade_date"], "trade_date")
    expected = {("a", 1): 1.0, ("a", 2): 2.0, ("b", 2): 3.0, ("b", 3): 4.0}
    assert found(filled) == expected
    assert found(MarketStore(spark, str(tmp_path)).table("fact.x")) == expected


def test_availability_lists_absent_tables(spark):
    rows = {r.name: (r.table_exists, r.row_count, r.min_value, r.max_value) for r in availability(spark, {"x": (frame(spark, ("a", day(1), 1.0), ("a", day(3), 1.0)), "trade_date"), "y": (None, "d")}).collect()}
    assert rows == {"x": (True, 2, "2024-01-01", "2024-01-03"), "y": (False, 0, "", "")}


def test_availability_of_absent_tables_only(spark):
    assert [tuple(r) for r in availability(spark, {"y": (None, "d")}).collect()] == [("y", False, 0, "", "")]
    assert availability(spark, {}).count() == 0


def test_footers_answer_what_is_asked_without_reading_rows(spark, tmp_path):
    from tapeloom.sources.store import _footer_aggregates, stored_availability

    path, texts, empty = (str(tmp_path / name) for name in ("t", "texts", "empty"))
    spark.range(1000).selectExpr("id", "date_add(date'2024-01-01', cast(id % 90 as int)) as d", "concat('x', id) as s").repartition(3).write.parquet(path)
    spark.range(0).selectExpr("id", "date'2024-01-01' as d").write.parquet(empty)
    rows = {r.name: tuple(r)[1:] for r in stored_availability(spark, {"a": (path, "id"), "d": (path, "d"), "s": (path, "s"), "none": (empty, "d"), "absent": (str(tmp_path / "no"), "d")}).collect()}
    assert rows == {"a": (True, 1000, "0", "999"), "d": (True, 1000, "2024-01-01", "2024-03-30"), "s": (True, 1000, "x0", "x999"), "none": (True, 0, "", ""), "absent": (False, 0, "", "")}
    plan = _footer_aggregates(spark, path, "d")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(d), MAX(d)]" in plan
    assert {r.name: tuple(r)[1:] for r in availability(spark, {"a": (spark.read.parquet(path), "id")}).collect()}["a"] == rows["a"]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_a_fill_leaves_other_partitions_alone(spark, tmp_path):
    store = MarketStore(spark, str(tmp_path))
    store.write("fact.x", frame(spark, ("a", day(1), 1.0), ("a", day(2), 2.0)), "trade_date")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path).rglob("part-*") if "__offered" not in str(p)}
    before = files()
    store.fill_and_write_back("fact.x", [frame(spark, ("b", day(2), 3.0))], ["code", "trade_date"], "trade_date")
    after = files()
    assert all(after[p] == t for p, t in before.items()) and len(after) == len(before) + 1
    again = store.fill_and_write_back("fact.x", [frame(spark, ("b", day(2), 3.0))], ["code", "trade_date"], "trade_date")
    assert again.count() == 3


def test_results_are_read_from_the_latest_whole_run(spark, tmp_path):
    root = str(tmp_path / "health")
    schema = "check_id string, title string, status string, result_text string, error_text string"
    assert read_result(spark, root).count() == 0
    for run, status in (("1", "healthy"), ("2", "warning")):
        write_result(spark.createDataFrame([("c", "t", status, "", "")], schema), root, run)
    assert read_result(spark, root).first().status == "warning"
    shutil.rmtree(next((tmp_path / "health").glob("run=2-*")))
    assert read_result(spark, root).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


TICKS = "event_id long, ts timestamp_ntz, code string, value double"


def tick(i, minute, value, code="a"):
    return (i, dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=minute), code, value)


def test_late_ticks_correct_bars_across_runs(spark, tmp_path):
    """Two runs of the same stream: open windows are corrected by the second run; a replay changes nothing."""
    source, keys = tmp_path / "ticks", ["code", "bar_time"]

    def run():
        stream = jobs.read_events(spark, str(source), spark.createDataFrame([], TICKS).schema)
        bars = jobs.live_bars(stream, "5 minutes", "10 minutes")
        jobs.for_each_batch(bars, jobs.upsert_into(str(tmp_path / "bars"), keys), str(tmp_path / "checkpoint")).awaitTermination()
        return {r.bar_time.minute: (r.open, r.close, r.volume) for r in jobs.read_upserts(spark, str(tmp_path / "bars"), keys).collect()}

    spark.createDataFrame([tick(1, 0, 1.0), tick(3, 4, 3.0), tick(4, 6, 4.0)], TICKS).write.parquet(str(source / "one.parquet"))
    for part in (source / "one.parquet").glob("*.parquet"):
        part.rename(source / f"one-{part.name}")
    assert run() == {30: (1.0, 3.0, 2), 35: (4.0, 4.0, 1)}
    spark.createDataFrame([tick(2, 2, 2.0), tick(9, 7, 9.0)], TICKS).write.parquet(str(source / "two.parquet"))
    for part in (source / "two.parquet").glob("*.parquet"):
        part.rename(source / f"two-{part.name}")
    expected = {30: (1.0, 3.0, 3), 35: (4.0, 9.0, 2)}
    assert run() == expected
    assert run() == expected
    jobs.compact_upserts(spark, str(tmp_path / "bars"), str(tmp_path / "compact"), keys, "code")
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2


def test_replayed_batch_overwrites_its_version(spark, tmp_path):
    handle = jobs.upsert_into(str(tmp_path / "x"), ["code"], order="n")
    batch = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "one")], "code string, n int, v string")
    handle(batch, 0)
    handle(batch, 0)
    handle(spark.createDataFrame([("b", 0, "two")], "code string, n int, v string"), 1)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3
    assert {r.code: r.v for r in jobs.read_upserts(spark, str(tmp_path / "x"), ["code"]).collect()} == {"a": "new", "b": "two"}


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    spark.createDataFrame([tick(1, 0, 1.0), tick(1, 0, 1.0), tick(2, 1, 2.0)], TICKS).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], TICKS).schema)
    jobs.append_to(jobs.drop_repeats(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_gap_audit_judges_touched_days_on_stored_bars(spark, tmp_path):
    """A day split over two batches is complete after the second; days not touched are not reported."""
    minutes = [*range(571, 691), *range(781, 901)]
    rows = lambda n, wanted: spark.createDataFrame([("a", dt.datetime(2024, 1, n, m // 60, m % 60)) for m in wanted], "code string, bar_time timestamp_ntz")
    bars, issues, keys = str(tmp_path / "bars"), str(tmp_path / "issues"), ["code", "bar_time"]
    store, asked = jobs.upsert_into(bars, keys, time="bar_time"), []

    def stored(days):
        asked.append(sorted(d.day for d in days))
        df = jobs.read_upserts(spark, bars, keys, days)
        assert "stored_day" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
        return df

    audit = jobs.audit_gaps(issues, stored, F.array(*(F.lit(day(n)) for n in (2, 3, 4))))
    current = lambda: {r.trade_date.day: r.issue for r in jobs.read_issues(spark, issues).collect()}
    for batch_id, batch in enumerate([rows(2, minutes[:100]).unionByName(rows(3, [m for m in minutes if m != 600])), rows(2, minutes[90:])]):
        store(batch, batch_id)
        audit(batch, batch_id)
        if batch_id == 0:
            assert current() == {2: "2024-01-02 分钟数 100/240，首尾分钟 09:31-11:10", 3: "2024-01-03 分钟数 239/240"}
    assert current() == {3: "2024-01-03 分钟数 239/240"}
    assert asked == [[2, 3], [2]]
    before = sorted(map(str, jobs.read_upserts(spark, bars, keys).collect()))
    jobs.fold_versions(spark, bars, keys, [day(2)])
    assert sorted(map(str, jobs.read_upserts(spark, bars, keys).collect())) == before
    versions = lambda: sorted(p.name for p in (tmp_path / "bars" / "stored_day=2024-01-02").glob("batch_id=*"))
    assert versions() == ["batch_id=0", "batch_id=1"]
    jobs.delete_folded(spark, bars)
    assert versions() == [] and sorted(map(str, jobs.read_upserts(spark, bars, keys).collect())) == before


def test_a_reader_sees_the_same_rows_between_all_steps_of_a_fold(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "bars"), ["code", "bar_time"]
    at = lambda d, m: dt.datetime(2024, 1, d, 9, m)
    batch = lambda *rows: spark.createDataFrame(rows, "code string, bar_time timestamp_ntz, close double")
    store = jobs.upsert_into(path, keys, time="bar_time")
    seen = lambda days=None: sorted((r.code, r.bar_time.day, r.bar_time.minute, r.close) for r in jobs.read_upserts(spark, path, keys, days).collect())
    store(batch(("a", at(2, 1), 1.0), ("a", at(2, 2), 2.0), ("a", at(3, 1), 3.0)), 0)
    store(batch(("a", at(2, 1), 1.5), ("b", at(3, 1), 4.0)), 1)
    now = [("a", 2, 1, 1.5), ("a", 2, 2, 2.0), ("a", 3, 1, 3.0), ("b", 3, 1, 4.0)]
    assert seen() == now
    create = jobs.Commits._create
    monkeypatch.setattr(jobs.Commits, "_create", lambda self, *a: seen() == now and create(self, *a))  # written, not committed
    reading = jobs.read_upserts(spark, path, keys)
    jobs.fold_versions(spark, path, keys, [day(2), day(9)])
    assert seen() == now and len(reading.collect()) == 4

    def dies(self, *a):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(jobs.Commits, "_create", dies)
    store(batch(("a", at(2, 2), 9.0), ("c", at(2, 7), 7.0)), 2)  # newer than the fold
    now = [("a", 2, 1, 1.5), ("a", 2, 2, 9.0), ("a", 3, 1, 3.0), ("b", 3, 1, 4.0), ("c", 2, 7, 7.0)]
    assert seen() == now and seen([day(2)]) == [r for r in now if r[1] == 2]
    with pytest.raises(RuntimeError):
        jobs.fold_versions(spark, path, keys, [day(2), day(3)])
    assert seen() == now
    monkeypatch.setattr(jobs.Commits, "_create", create)
    jobs.delete_folded(spark, path)  # what the first fold has replaced
    assert seen() == now and sorted(p.name for p in (tmp_path / "bars" / "stored_day=2024-01-02").glob("batch_id=*")) == ["batch_id=2"]
    jobs.fold_versions(spark, path, keys, [day(2), day(3)])
    jobs.delete_folded(spark, path)
    assert seen() == now and seen([day(3)]) == [r for r in now if r[1] == 3]
    store(batch(("a", at(3, 1), 8.0)), 3)
    assert ("a", 3, 1, 8.0) in seen() and len(seen()) == 5
