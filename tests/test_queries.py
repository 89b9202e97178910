"""Every registered query of the graph engine against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from graphloom.plans import registry


def canonical(frame):
    def cell(x):
        if pd.isna(x):
            return "~"
        if isinstance(x, bool):
            return str(x)
        return repr(round(float(x), 6)) if hasattr(x, "__float__") else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in row) for row in frame.values.tolist())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE:
        assert canonical(got) == canonical(db.execute(registry.ORACLE[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
