"""Every registered query against its DuckDB twin on the smallest tables."""

import math
import os

import pytest

from cairngraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.5f}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
    rel = con.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in rel.fetchall())


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
