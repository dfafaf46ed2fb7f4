"""Differences and lags as window projections over chunks of a segment, each with a halo of the rows before it.

All expressions of one call share a window, so Spark sorts once. Rows with consecutive numbers are cut as they are; others are numbered first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import LagConfigurationError
from ..sources.panel import SEGMENT, TIME, Panel, drop_nulls, indexed


#: Rows of a segment that one task sorts.
CHUNK = 1 << 18


def chunked(panel: Panel, deepest: int, chunk: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """The panel's rows by chunks of a segment, and the window over a chunk in the order of t.

    A chunk holds `chunk` rows (or twice the longest lag), by their consecutive numbers, and copies of the `deepest` rows before it, whose
    __own is false: they are there for others' sake only. No segment is gathered in one task.
    """
    if chunk is not None and chunk <= deepest:
        raise LagConfigurationError("a chunk must be longer than the longest lag")
    size = chunk or max(CHUNK, 2 * deepest)
    panel = indexed(panel)
    own = F.floor(F.col(panel.index) / size)
    homes = F.when(F.pmod(F.col(panel.index), F.lit(size)) >= size - deepest, F.array(own, own + 1)).otherwise(F.array(own))
    df = panel.df.withColumn("__chunk", F.explode(homes)).withColumn("__own", own == F.col("__chunk"))
    return df, Window.partitionBy(SEGMENT, "__chunk").orderBy(TIME)


def has_history(deepest: int, w: WindowSpec) -> Column:
    """Whether `deepest` rows of the segment lie before this one."""
    return F.lag(F.lit(1), deepest).over(w).isNotNull() if deepest else F.lit(True)


def difference(panel: Panel, orders: Mapping[str, int] | int, dropna: bool = True, chunk: int | None = None) -> Panel:
    """Differences of the given orders (binomial sums of lags); rows that lack history hold nulls, and go with `dropna`."""
    of = (lambda v: orders) if isinstance(orders, int) else (lambda v: orders.get(v, 0))
    deepest = max(0, *map(of, panel.variables))
    if not deepest:
        return drop_nulls(panel) if dropna else panel
    panel = indexed(panel)
    df, w = chunked(panel, deepest, chunk)

    def one(v: str, d: int) -> Column:
        if d <= 0:
            return F.col(v)
        terms = [F.col(v) if k == 0 else F.lag(v, k).over(w) * float((-1) ** k * comb(d, k)) for k in range(d + 1)]
        out = terms[0]
        for x in terms[1:]:
            out = out + x
        return out.alias(v)

    extra = [panel.index] if panel.index != TIME else []
    rows = df.select(SEGMENT, TIME, *extra, "__own", has_history(deepest, w).alias("__full"), *(one(v, of(v)) for v in panel.variables)).where("__own")
    if dropna and panel.whole:  # all that lack history, and no others, hold nulls
        return panel.with_df(rows.where("__full").drop("__own", "__full"), panel.index, True)
    out = panel.with_df(rows.drop("__own", "__full"), panel.index)
    return drop_nulls(out) if dropna else out


def lag_columns(min_lags: Sequence[int], max_lags: Sequence[int], variables: Sequence[str]) -> list[tuple[str, str, int]]:
    """(name, variable, lag) of each design column, in blocks of variables."""
    if any(a < 0 or b < a for a, b in zip(min_lags, max_lags, strict=True)):
        raise LagConfigurationError("lags must be 0 <= min <= max")
    return [(f"{v}_lag{k}", v, k) for v, a, b in zip(variables, min_lags, max_lags, strict=True) for k in range(a, b + 1)]


def lag_features(panel: Panel, min_lags: Sequence[int], max_lags: Sequence[int], effects: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """segment_id, t, the effects and one column for each lag; rows without full history are dropped. A task sorts a chunk, not a segment."""
    columns = lag_columns(min_lags, max_lags, panel.variables)
    deepest = max(max_lags)
    df, w = chunked(panel, deepest, chunk)
    lagged = [F.col(v).alias(n) if k == 0 else F.lag(v, k).over(w).alias(n) for n, v, k in columns]
    rows = df.select(SEGMENT, TIME, *(F.col(e) for e in effects), *lagged, "__own", has_history(deepest, w).alias("__full"))
    return rows.where("__own AND __full").select(SEGMENT, TIME, *effects, *(n for n, _, _ in columns))
