"""Every registered query against its reference SQL; the rest must at least run."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, mismatch

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_reference_sql(spark, con, name):
    assert mismatch(queries()[name](spark, ROOT), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, ROOT).count() > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 26
    assert sum(r["best"] for r in rows) == 1


def test_oracles_have_queries():
    assert set(oracle_sql()) <= set(queries())
