"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from curalith.plans import inventory, register  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(register.QUERIES))
def test_query(spark, duck, name):
    df = register.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in register.ORACLES:
        assert rows
        return
    found = duck.sql(register.ORACLES[name])
    assert sorted(found.columns) == columns
    assert Counter(tuple(shown(dict(zip(found.columns, r, strict=True))[c]) for c in columns) for r in found.fetchall()) == rows
