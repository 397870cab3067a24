"""Every registered query against its DuckDB SQL on the smallest driver tables,
and the driver contract itself."""

import os

import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of, type_mismatches

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

# streaming and model-fit keys run in their own tests
SKIP = {"stream_ingest", "stream_last_n", "stream_drift_check", "stream_metrics", "fit_predict"}     # stream_*: their twins


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(k for k in E.oracle_sql() if k not in SKIP))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    res = duck.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(res.columns)
    assert type_mismatches(df.schema, res.columns, res.types) == []
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(res.columns, res.fetchall())
    assert a == b


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and set(df.columns) == {"model", "n", "mae", "mse", "mae_rank"}


def test_every_key_has_oracle_or_is_rows_only():
    from tidepool.plans.registry import QUERIES
    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only == {"fit_predict"}
