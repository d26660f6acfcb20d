"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tickspark.jobs import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "labels", "documents")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{v:.6g}" if not v.is_integer() else str(int(v)) if math.isfinite(v) else str(v)
    return str(v)[:10] if hasattr(v, "isoformat") else str(v)


def rows(df, columns):
    return sorted(tuple(map(plain, x)) for x in df[columns].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"baseline_scores", "mlp_scores"}


@pytest.mark.parametrize("name", ["baseline_scores", "mlp_scores"])
def test_scores_are_probabilities(spark, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    p = got[["p_no_trade", "p_long", "p_short"]].to_numpy()
    assert len(got) and (abs(p.sum(1) - 1) < 1e-9).all() and (p >= 0).all()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_pair(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))
    assert len(ours)
