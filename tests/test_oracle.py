"""Every registered query against its DuckDB oracle.

Runs on the sf0.001 tables; set PLAYMETRICS_ORACLE_SF to another folder
(e.g. /root/testdata/sf0.01, the driver's correctness scale) to check there.
"""

import math
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import core_oracle_sql as oracle_sql, core_queries as queries, entry
from conftest import SF_SMALL

SF = os.environ.get("PLAYMETRICS_ORACLE_SF", SF_SMALL)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["artist", "listens"] and df.count() == 10


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_matches_oracle(spark, duck, key):
    got = queries()[key](spark, SF).toPandas()
    exp = duck.sql(oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _rows(got) == _rows(exp)


@pytest.fixture()
def scale_shapes(spark):
    """Plans as at 100 TB: no input is small enough for a threshold broadcast,
    so every join of the test view and of the operators is a sort-merge join
    (explicit broadcasts of proven-bounded sets stay)."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_matches_oracle_with_scale_plan_shapes(spark, duck, scale_shapes, key):
    got = queries()[key](spark, SF).toPandas()
    exp = duck.sql(oracle_sql()[key]).df()
    assert len(got) == len(exp)
    assert _rows(got) == _rows(exp)
