"""Every registered query against its SQL on whole tables; the rest must give rows."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_points


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_sql(spark, con, small, name):
    problem, _ = compare(spark, con, name, entry_points.queries()[name], entry_points.oracle_sql()[name], small)
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql()) - {"review_study"}))
def test_gives_rows(spark, small, name):
    assert entry_points.queries()[name](spark, small).limit(1).count() == 1


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 15 and {r["rating"] for r in rows} == {1, 2, 3, 4, 5}


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
