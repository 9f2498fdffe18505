"""The driver's contract, and the registered queries of the engine against DuckDB at the smallest scale."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from brindle import queries as Q

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return round(float(v), 6) if math.isfinite(float(v)) else str(v)
    return str(v)


def same(got, want):
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    flat = lambda f: sorted([tuple(norm(v) for v in r) for r in f[key].astype(object).where(f[key].notna(), None).values.tolist()], key=str)
    assert flat(got) == flat(want)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    same(Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df())
