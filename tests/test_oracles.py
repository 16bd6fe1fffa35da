"""Every query with an oracle gives DuckDB's rows."""

import decimal
import math
from collections import Counter

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.sources import TABLES

ORACLES = registry.oracle_sql()
QUERIES = registry.queries()


def plain(v):
    if isinstance(v, float):
        return ("float", None if math.isnan(v) else float(f"{v:.9g}"))
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v.normalize()))
    if isinstance(v, bool):
        return ("bool", v)
    return v if v is None or isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, data, con, name):
    df = QUERIES[name](spark, f"{data}/sf0.001")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
