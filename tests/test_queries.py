"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tributary import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cells(df):
    cols = sorted(df.columns)

    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, int | float) or hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return cols, sorted(repr([one(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.ORACLES:
        assert cells(got) == cells(duck.execute(Q.ORACLES[name]).df())
    else:
        assert len(got) > 0


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_matrix_file_in_a_shared_folder_of_any_form(spark, duck, tmp_path, monkeypatch, form):
    """Without a scheme, too, the shared folder is Spark's, and nothing has been written to it before."""
    get, base = type(spark.conf).get, form.format(tmp_path / "new")
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *default: base if key == "spark.checkpoint.dir" else get(conf, key, *default))
    got = Q.matrix_file_roundtrip(spark, SF).toPandas()
    assert cells(got) == cells(duck.execute(Q.ORACLES["matrix_file_roundtrip"]).df())
    assert len(list(tmp_path.glob("new/engine-*/case_001_newton_max_lag_1_causality.csv/part-*.csv"))) == 1


def test_plans(spark):
    """Only needed columns are read, one window serves all lags, and nothing runs in Python."""
    plan = Q.lag_features_1_3(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert plan.count("Window [") == 1 and "Python" not in plan and "Arrow" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
