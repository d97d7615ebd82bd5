"""Every registered query against its oracle SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tapeloom.plans.oracles import ORACLES
from tapeloom.plans.queries import QUERIES
from compare import differences, oracle_connection


@pytest.fixture(scope="module")
def connection(folder):
    return oracle_connection(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, folder, connection):
    assert differences(entry.queries()[name](spark, folder), connection, entry.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["code", "trade_date", "adjust"]
    assert df.limit(1).count() == 1
