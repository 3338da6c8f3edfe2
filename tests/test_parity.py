"""Every registered query against its check on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from parity import compare, database

ROOT = "/root/testdata/sf0.001"
PLANS, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(ROOT)


@pytest.mark.parametrize("name", list(PLANS))
def test_query_matches_check(spark, con, name):
    ok, note = compare(spark, con, name, PLANS[name](spark, ROOT), CHECKS.get(name))
    assert ok, note


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
