"""Every query of the library's own operators against DuckDB."""

import math

import duckdb
import pytest

from depotscan.plans.adapters import TABLES
from depotscan.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("<NA>", "NaT"):
        return "~"
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_against_duckdb(spark, duck, key):
    got, want = QUERIES[key](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[key]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]
