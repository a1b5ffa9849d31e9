"""Every registered query runs on the smallest scale factor with a stable schema,
and agrees with its DuckDB oracle."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from baitline.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"event_type", "verdict", "n_messages"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    oracle = entry.oracle_sql().get(name)
    pdf = sdf.toPandas()
    if oracle is None:
        assert len(pdf.columns) > 0
        return
    dpdf = duck.execute(oracle).fetch_df()
    sc, sr = _rows(pdf)
    dc, dr = _rows(dpdf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
