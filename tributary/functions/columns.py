"""Distribution tails as column functions, in Arrow batches; for long tables of statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dist


def f_tail(statistic, d1, d2) -> Column:
    """P(F >= statistic); null where it isn't defined."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dist.f_sf(float(i), float(j), float(k)) for i, j, k in zip(x, a, b, strict=True)], dtype=float)

    return F.nanvl(tail(statistic, d1, d2), F.lit(None).cast("double"))


def chi2_tail(statistic, df) -> Column:
    """P(chi-squared >= statistic); null where it isn't defined."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([dist.chi2_sf(float(i), float(j)) for i, j in zip(x, a, strict=True)], dtype=float)

    return F.nanvl(tail(statistic, df), F.lit(None).cast("double"))
