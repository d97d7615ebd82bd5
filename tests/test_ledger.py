"""Commit log and incremental key check."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.quality import ledger as L
from tapeloom.quality.checks import Checks, Rule
from tapeloom.quality.contract import contract_metrics
from tapeloom.quality.ledger import KeyLedger
from tapeloom.sources.commits import Commits
from tapeloom.sources.store import read_result, write_result

FIRST = dt.date(2024, 1, 1)


def test_commits_are_numbered_and_cut_ones_passed_over(spark, tmp_path):
    log = Commits(spark, str(tmp_path))
    assert log.latest() is None and log.numbers() == []
    assert [log.add({"run": k}) for k in range(3)] == [0, 1, 2]
    assert log.latest() == (2, {"run": 2})
    whole = json.dumps({"run": 3, "complete": True})
    for text in ("", whole[:-3], "[1]", json.dumps({"run": 9})):  # written halfway, or by something else
        (tmp_path / "_commits" / "000000000003.json").write_text(text)
        (tmp_path / "_commits" / ".000000000003.json.crc").unlink(missing_ok=True)
        assert log.latest() == (2, {"run": 2})
    assert log.add({"run": 4}) == 4 and log.latest() == (4, {"run": 4})


def test_a_number_is_given_once(spark, tmp_path):
    one, two = Commits(spark, str(tmp_path)), Commits(spark, str(tmp_path))
    assert one.add({"run": "a"}) == 0
    seen = two.numbers
    two.numbers = lambda: []  # what a writer saw before the other committed
    assert two.add({"run": "b"}) == 1 and seen() == [0, 1]
    assert one.read(0) == {"run": "a"} and one.read(1) == {"run": "b"}


def test_a_reader_sees_a_whole_result_between_all_steps(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = lambda text: spark.createDataFrame([("c", "t", "healthy", text, "")], "check_id string, title string, status string, result_text string, error_text string")
    seen = lambda: [r.result_text for r in read_result(spark, root).collect()]
    assert seen() == []
    write_result(rows("one"), root, "run")
    assert seen() == ["one"]
    reading = read_result(spark, root)
    create = Commits._create
    monkeypatch.setattr(Commits, "_create", lambda self, *a: seen() == ["one"] and create(self, *a))  # rows are written, the commit is not
    write_result(rows("two"), root, "run")
    assert seen() == ["two"] and [r.result_text for r in reading.collect()] == ["one"]

    def dies(self, *a):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(Commits, "_create", dies)
    with pytest.raises(RuntimeError):
        write_result(rows("three"), root, "run")
    assert seen() == ["two"]


def day_rows(spark, numbers, per_day=50):
    return spark.createDataFrame([(f"k{d * per_day + k}", FIRST + dt.timedelta(days=d), float(k)) for d in numbers for k in range(per_day)], "id string, trade_date date, x double")


def store(df, path, mode="append"):
    df.write.mode(mode).partitionBy("trade_date").parquet(str(path))


def found(spark, ledger, path):
    table = spark.read.parquet(str(path))
    return sorted((r.id, r.copies) for r in ledger.update(table).collect())


@pytest.mark.parametrize("literals", [1000, 0])
def test_a_duplicate_across_days_is_found_by_a_later_run(spark, tmp_path, monkeypatch, literals):
    monkeypatch.setattr(L, "LITERAL_DAYS", literals)
    path, ledger = tmp_path / "fact", KeyLedger(spark, str(tmp_path / "ledger"), ["id"])
    store(day_rows(spark, range(6)), path)
    assert found(spark, ledger, path) == []
    store(day_rows(spark, [6]).unionByName(day_rows(spark, [2]).where("id = 'k100'").withColumn("trade_date", F.lit(FIRST + dt.timedelta(days=6)))), path)
    assert found(spark, ledger, path) == [("k100", 2)]
    assert found(spark, ledger, path) == [("k100", 2)]  # nothing has changed
    store(day_rows(spark, [7]).unionByName(day_rows(spark, [7]).where("x < 2")), path)
    store(day_rows(spark, [3]).where("x = 5"), path)  # a late row of an old day
    assert found(spark, ledger, path) == [("k100", 2), ("k155", 2), ("k350", 2), ("k351", 2)]


def test_days_that_go_or_are_rewritten(spark, tmp_path):
    path, ledger = tmp_path / "fact", KeyLedger(spark, str(tmp_path / "ledger"), ["id"])
    store(day_rows(spark, range(4)).unionByName(day_rows(spark, [1]).where("x = 0").withColumn("trade_date", F.lit(FIRST))), path)
    assert found(spark, ledger, path) == [("k50", 2)]
    left = spark.read.parquet(str(path)).where("trade_date <> date'2024-01-01'")
    assert ledger.update(left).count() == 0
    same = left.withColumn("id", F.when(F.col("trade_date") == F.lit(FIRST + dt.timedelta(days=2)), F.lit("same")).otherwise(F.col("id")))
    assert ledger.update(same).count() == 0  # as many rows as before
    assert [tuple(r) for r in ledger.update(same, again=[FIRST + dt.timedelta(days=2)]).collect()] == [("same", 50)]


def test_nulls_in_keys_and_days(spark, tmp_path):
    rows = [(None, FIRST), (None, FIRST), ("a", None), ("a", None), ("b", FIRST)]
    table = spark.createDataFrame(rows, "id string, trade_date date")
    ledger = KeyLedger(spark, str(tmp_path / "ledger"), ["id", "trade_date"])
    expected = sorted(map(repr, [(None, FIRST, 2), ("a", None, 2)]))
    assert sorted(repr(tuple(r)) for r in ledger.update(table).collect()) == expected
    assert sorted(repr(tuple(r)) for r in ledger.update(table).collect()) == expected
    assert ledger.update(table.limit(0)).count() == 0


def test_an_update_that_dies_leaves_the_last_one(spark, tmp_path, monkeypatch):
    path, ledger = tmp_path / "fact", KeyLedger(spark, str(tmp_path / "ledger"), ["id"])
    store(day_rows(spark, range(3)), path)
    assert found(spark, ledger, path) == []
    store(day_rows(spark, [0]).where("x = 1"), path)
    monkeypatch.setattr(Commits, "add", lambda self, content: (_ for _ in ()).throw(RuntimeError("lost driver")))
    with pytest.raises(RuntimeError):
        found(spark, ledger, path)
    monkeypatch.undo()
    assert ledger.days().agg(F.sum("n")).first()[0] == 150
    assert found(spark, ledger, path) == [("k1", 2)]


def test_a_second_run_reads_and_shuffles_new_days_only(spark, tmp_path):
    """Old days cannot be read any more; the key columns of the new day are all that the second run needs."""
    path, ledger = tmp_path / "fact", KeyLedger(spark, str(tmp_path / "ledger"), ["id"])
    store(day_rows(spark, range(20)), path)
    assert found(spark, ledger, path) == []
    store(day_rows(spark, [20]).unionByName(day_rows(spark, [20]).where("x = 3")), path)
    old = [folder for folder in path.glob("trade_date=*") if folder.name != "trade_date=2024-01-21"]
    for file in [f for folder in old for f in folder.glob("*.parquet")]:
        data = file.read_bytes()
        file.write_bytes(data[:4] + b"\0" * 40 + data[44:])  # the values are broken, the footer with the row count is not
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert found(spark, ledger, path) == [("k1003", 2)]
    stored = ledger._hashes(ledger.days())
    fresh = stored.where("run = 'x'").select("h").distinct()
    plan = stored.join(fresh, "h")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # stored hashes are scanned, the few new ones are sent to them


def test_checks_and_contract_with_a_ledger_agree_with_whole_scans(spark, tmp_path):
    table = day_rows(spark, range(3)).unionByName(day_rows(spark, [1]).where("x < 2"))
    rules = [Rule("primary_key_duplicate_absent", "fact.rows", fields=("id", "trade_date")), Rule("capability_key_unique_rule", "fact.rows", fields=("trade_date", "x"))]
    as_of = dt.datetime(2024, 2, 1)
    plain = Checks(spark, {"fact.rows": table}, as_of).run(rules).collect()
    for _ in range(2):
        assert Checks(spark, {"fact.rows": table}, as_of, key_ledger=str(tmp_path / "keys")).run(rules).collect() == plain


@pytest.fixture(scope="module")
def contract(spark, folder):
    from tapeloom.plans.market_queries import contract_tables
    from tapeloom.sources.market_tables import MarketTables

    return contract_tables(MarketTables(spark, folder))


def test_the_contract_counts_the_same_duplicates_from_a_ledger(spark, contract, tmp_path):
    stocks = contract["stock_daily"]
    contract = {**contract, "stock_daily": stocks.unionByName(stocks.where("trade_date = date'1996-02-05'"))}
    plain = sorted(contract_metrics(contract, "PROMO").collect())
    assert {r.metric: r.actual for r in plain}["global_duplicate_stock_key_count"] > 0
    for _ in range(2):
        assert sorted(contract_metrics(contract, "PROMO", key_ledger=str(tmp_path)).collect()) == plain
