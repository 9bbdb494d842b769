"""Every query of the registry against its DuckDB twin."""

import glob
import math
import os

import duckdb
import pytest

from signalspark.plans import registry, searches, steps, stored

assert steps.query is searches.query is stored.query is registry.query  # their queries are in the registry, too

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    if name not in registry.ORACLES:
        assert got
        return
    result = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert normal(got) == normal([r[k] for k in at] for r in result.fetchall())
