"""Every registered query with an oracle must match it on sf0.01."""

import pytest

from conftest import SF001
from oracle import compare, duck

import __spark_entry__ as entry_mod

QUERIES = entry_mod.queries()
ORACLES = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    problems = compare(df, con, ORACLES[name])
    assert not problems, f"{name}: " + "; ".join(problems)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF001)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
