import math
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import plain_tests as plain

from tributary.operators import stationarity as S
from tributary.sources import panel as P


def series(kind, n, rng):
    e = rng.normal(size=n)
    if kind == "noise":
        return 1e4 + e
    if kind == "ar":
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = 0.6 * x[i - 1] + e[i]
        return x
    if kind == "walk":
        return np.cumsum(e)
    if kind == "twice":
        return np.cumsum(np.cumsum(e))
    return 0.01 * np.arange(n) ** 2 + e  # trend


KINDS = ("noise", "ar", "walk", "twice", "trend")


def panel(spark, frames):
    return P.from_frames(spark, frames)


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(3)
    return [pd.DataFrame({k: series(k, n, rng) for k in KINDS}) for n in (4, 5, 9, 17, 40, 41, 130, 400)]


@pytest.mark.parametrize("chunk", [None, 40])
def test_adf_equals_whole_series(spark, many, chunk):
    table = S.Series(panel(spark, many), KINDS, 2, chunk).adf_statistics().toPandas()
    for r in table.itertuples():
        x = np.diff(many[r.segment_id][r.variable].to_numpy(), r.d)
        try:
            tau, lags = plain.adf(x)
        except (ValueError, ZeroDivisionError):
            tau = math.nan
        if len(x) >= 9 and math.isfinite(tau):
            assert int(r.lags) == lags, r
            assert r.tau == pytest.approx(tau, rel=1e-5, abs=1e-6), r


@pytest.mark.parametrize("chunk", [None, 30])
def test_kpss_equals_whole_series(spark, many, chunk):
    table = S.Series(panel(spark, many), KINDS, 2, chunk).kpss_statistics().toPandas()
    assert len(table) == len(many) * len(KINDS) * 3
    longer = 0
    for r in table.itertuples():
        x = np.diff(many[r.segment_id][r.variable].to_numpy(), r.d)
        if len(x) < 4:
            continue
        stat, lags = plain.kpss(x)
        assert r.lags == lags and r.n == len(x) and r.span == pytest.approx(np.ptp(x))
        assert r.stat == pytest.approx(stat, rel=1e-6, abs=1e-9), r
        longer += lags > int(len(x) ** (2 / 9))
    assert longer > 10  # the third pass had work to do


@pytest.mark.parametrize("test", ["adf", "kpss"])
def test_orders_equal_whole_series(spark, many, test):
    some = many[3:]
    got = S.StationarityTransformer(test, 3).orders_table(panel(spark, some), 45).collect()
    assert len(got) == len(some) * len(KINDS)
    for r in got:
        assert r["order"] == plain.order(some[r["segment_id"]][r["variable"]].to_numpy(), test, 3, 0.05), r


def test_known_orders(spark):
    rng = np.random.default_rng(42)
    one = pd.DataFrame({"ar": series("ar", 1200, rng), "walk": series("walk", 1200, rng), "flat": np.ones(1200)})
    for test in ("adf", "kpss"):
        found = {r["variable"]: r["order"] for r in S.StationarityTransformer(test).orders_table(panel(spark, one)).collect()}
        assert found == {v: plain.order(one[v].to_numpy(), test, 5, 0.05) for v in one}
        assert found["ar"] == found["flat"] == 0 and found["walk"] > 0
    t = S.StationarityTransformer(skip=["walk"]).fit(panel(spark, [one, one.assign(ar=one["walk"])]))
    assert t.orders == {"ar": 1, "walk": 0, "flat": 0}
    assert S.StationarityTransformer("adf").prepare_static(panel(spark, one), ["ar"], ["walk", "flat"])[:2] == (1, [1, 2])


def test_odd_series(spark):
    """Nulls fail every test, so the first order is taken; two rows need none; gaps in t don't matter."""
    gap = spark.createDataFrame([(0, 3 * i * i, None if i == 5 else float(i % 3), float((i * 7919) % 13)) for i in range(40)] + [(1, 5, 1.0, 2.0), (1, 9, 2.0, 4.0)], "segment_id int, t long, a double, b double")
    p = P.from_table(gap, ["a", "b"], "segment_id")
    for test in ("adf", "kpss"):
        got = {(r["segment_id"], r["variable"]): r["order"] for r in S.StationarityTransformer(test, 2).orders_table(p, 30).collect()}
        assert got[0, "a"] == 0 and got[1, "a"] == got[1, "b"] == 0
        assert got[0, "b"] == plain.order(np.array([(i * 7919) % 13 for i in range(40)], float), test, 2, 0.05)
    assert S.StationarityTransformer().fit(P.from_table(gap.limit(0), ["a"], "segment_id")).orders == {"a": 0}


def test_a_long_series_is_spread(spark):
    """No task sees more than a chunk of a series of a million rows, and a level far from zero costs no digits."""
    n = 1_000_000
    from pyspark.sql import functions as F

    df = spark.range(n).select(F.lit(0).alias("segment_id"), F.col("id").alias("t"), (F.lit(1e6) + F.randn(7)).alias("x"))
    p = P.Panel(df, ("x",), "t", True)
    s = S.Series(p, ["x"], 1, 100_000)
    seen = s.over_chunks(lambda seg, chunk, x, own, first, known: pd.DataFrame({"rows": [len(x)], "own": [own]}), 200, "rows int, own int", s.facts).collect()
    assert len(seen) == 10 and max(r["rows"] for r in seen) == 100_200
    assert {r["variable"]: r["order"] for r in S.StationarityTransformer(max_order=1).orders_table(p, 100_000).collect()} == {"x": 0}
