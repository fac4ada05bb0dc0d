"""Every query of the library that has SQL gives the SQL's rows on the smallest tables."""

import decimal
import math
import os

import pytest

import __spark_entry__ as contract
from dealgraph.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) & set(registry.oracle_sql())))
def test_rows_equal_the_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(repr(tuple(norm(r[c]) for c in names)) for r in df.collect())
    result = duck.sql(registry.oracle_sql()[name])
    assert sorted(result.columns) == names
    at = [result.columns.index(c) for c in names]
    assert ours == sorted(repr(tuple(norm(r[k]) for k in at)) for r in result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
