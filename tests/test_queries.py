"""Queries against their SQL in another engine, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from quillframe.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name[:-8]} as select * from '{SMALL}/{name}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(float(x), 5) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, engine, name):
    df = registry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    found = engine.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    assert plain([tuple(r[c] for c in names) for r in df.collect()]) == plain([tuple(r[theirs.index(c)] for c in names) for r in found.fetchall()])


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
