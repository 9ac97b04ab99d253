"""Every core query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from folioscope.plans import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 4)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.oracles()[name])
    assert sorted(rel.columns) == columns
    theirs = sorted((tuple(_plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b or all(x == y or isinstance(x, float) and abs(x - y) < 2e-4 for x, y in zip(a, b))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
