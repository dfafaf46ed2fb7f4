import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.operators import quantiles as Q
from tributary.operators import scaling

PS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def table(spark, *columns):
    n = max(map(len, columns))
    rows = [tuple(float(c[i]) if i < len(c) and c[i] is not None else None for c in columns) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"`c {i}` double" for i in range(len(columns)))).repartition(3)


def test_narrowed_ranges_equal_percentile(spark):
    rng = np.random.default_rng(0)
    n = 3000
    columns = [
        rng.normal(size=n),
        np.exp(rng.normal(0, 200, n)),  # 1e-300 to 1e300
        rng.integers(0, 3, n),  # ties
        np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
        [None if i % 3 else v for i, v in enumerate(rng.normal(size=n))],
        np.zeros(n),
        np.sort(rng.normal(size=n))[: n // 2],
        [None] * n,
        [5.0],
        [1.0, 2.0],
    ]
    df = table(spark, *columns)
    names = df.columns
    want = df.agg(*(F.percentile(f"`{c}`", F.array(*map(F.lit, PS))).alias(f"q{i}") for i, c in enumerate(names))).first()
    for few, shrink in ((5000, 100), (40, 50), (1, 10), (3, 1000)):
        got = Q.exact_quantiles(df, names, PS, few, shrink)
        for g, w in zip(got, want, strict=True):
            assert g == [None] * len(PS) if w is None else g == pytest.approx(w, rel=1e-14, abs=0), (few, shrink)


def test_order_statistics_that_are_not_numbers(spark):
    df = table(spark, [1.0, math.nan, 2.0, math.nan, math.inf, -math.inf])
    for few in (1, 10):
        (got,) = Q.exact_quantiles(df, df.columns, (0.0, 0.2, 0.4, 0.6, 1.0), few, 10)
        assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])
    assert Q.exact_quantiles(df, [], PS) == [] and Q.exact_quantiles(df, df.columns, []) == [[]]
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, df.columns, [1.1])


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.data())
def test_narrowing(values, data):
    """A range always holds its order statistic, and each round finds it or makes the range smaller."""
    values = sorted(values)
    w = Q.Wanted("x", data.draw(st.integers(0, len(values) - 1)), len(values))
    while w.value is None:
        inside = [v for v in values if (w.low is None or v > w.low) and (w.high is None or v < w.high)]
        assert len(inside) == w.size and inside[w.rank - w.below] == values[w.rank]
        split = sorted(set(data.draw(st.lists(st.sampled_from(inside), min_size=1, max_size=3))))
        w.narrow([(v, sum(x < v for x in inside), inside.count(v)) for v in split])
        assert w.value is not None or w.size < len(inside)
    assert w.value == values[w.rank]


def test_robust_scaler_of_many_rows(spark):
    """No task holds a column's values: the plan has sketches and counts only, and the last ranges are small."""
    df = spark.range(200_000).select((F.rand(3) * 1000).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    s = scaling.scaler("robust").fit(df, ["a", "b"])
    low, middle, high = df.agg(F.percentile("a", F.array(*map(F.lit, (0.25, 0.5, 0.75))))).first()[0]
    assert s.centre[0] == pytest.approx(middle, rel=1e-14) and s.scale[0] == pytest.approx(high - low, rel=1e-12) and (s.centre[1], s.scale[1]) == (3, 4)
