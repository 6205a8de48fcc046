"""Every registered query that SQL can express gives the rows of that SQL on DuckDB."""

import os

import duckdb
import pytest

from ontoloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.7g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and y is not None and abs(x - y) <= 2e-6 * max(1, abs(x))


def test_others_are_compared_by_hand():
    """A query without SQL has a test of its name in test_by_hand.py."""
    import test_by_hand

    assert {f"test_{name}" for name in set(catalog.queries()) - set(SQL)} <= set(dir(test_by_hand))


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
