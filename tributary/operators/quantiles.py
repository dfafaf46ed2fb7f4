"""Exact, interpolated quantiles of many columns at once, in bounded memory: selection by narrowing ranges.

A quantile lies between two order statistics. For each of them an open range of values is kept that holds it, with the number of values
at or below the range. A round asks Spark's mergeable sketch for three values around each wanted rank of a range (one pass for all
columns), counts exactly how many values are below and at them (another), and so either has found the order statistic, as one of these values
itself, or goes on in the range between two of them, which holds a `SHRINK`-th of the rows or so. Ranges of `FEW` values are read.
So 10^12 rows take three rounds; ties make ranges shrink all the more.

Nulls don't count; NaN is larger than all numbers, as Spark sorts it. A column without values has null quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that are read at once, and the sketch's accuracy: its ranks are at most one part in SHRINK off.
FEW, SHRINK = 2000, 5000


@dataclass
class Wanted:
    """An order statistic (rank 0, 1, ..) of a column, and the open range that holds it; None is no bound."""

    column: str
    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    def inside(self) -> Column:
        x = F.col(f"`{self.column}`").cast("double")
        out = x.isNotNull()
        if self.low is not None:
            out = out & (x > F.lit(self.low))
        if self.high is not None:
            out = out & (x < F.lit(self.high))
        return out

    def values(self) -> Column:
        return F.when(self.inside(), F.col(f"`{self.column}`").cast("double"))

    def narrow(self, found: Sequence[tuple[float, int, int]]) -> None:
        """found: ascending values of the range, with the numbers of the range's values below and at each."""
        want, end = self.rank - self.below, self.size
        low, start = self.low, 0
        for v, less, at in found:
            if less <= want < less + at:
                self.value = v
                return
            if want < less:
                self.high, end = v, less
                break
            low, start = v, less + at
        self.low, self.below, self.size = low, self.below + start, end - start


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], few: int = FEW, shrink: int = SHRINK) -> list[list[float | None]]:
    """For each column, its quantiles: the value at rank p (n - 1), between two order statistics in proportion."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities are between 0 and 1")
    if not columns or not probabilities:
        return [[] for _ in columns]
    counts = df.agg(*(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns))).first()
    wanted: dict[tuple[str, int], Wanted] = {}
    for c, n in zip(columns, counts, strict=True):
        for p in probabilities if n else ():
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                wanted.setdefault((c, rank), Wanted(c, rank, n))
    while missing := [w for w in wanted.values() if w.value is None]:
        small = [w for w in missing if w.size <= few]
        if small:
            # several ranks of one range are read once
            ranges = list({(w.column, w.low, w.high): w for w in small}.values())
            row = df.agg(*(F.sort_array(F.collect_list(w.values())).alias(f"v{i}") for i, w in enumerate(ranges))).first()
            read = {(w.column, w.low, w.high): v for w, v in zip(ranges, row, strict=True)}
            for w in small:
                w.value = float(read[w.column, w.low, w.high][w.rank - w.below])
        large = [w for w in missing if w.size > few]
        if large:
            _round(df, large, shrink)
    return [[_between(wanted, c, p, n) for p in probabilities] for c, n in zip(columns, counts, strict=True)]


def _round(df: DataFrame, wanted: list[Wanted], shrink: int) -> None:
    ranges: dict[tuple, list[Wanted]] = {}
    for w in wanted:
        ranges.setdefault((w.column, w.low, w.high), []).append(w)
    around = []
    for i, ws in enumerate(ranges.values()):
        shares = {min(max((w.rank - w.below + 0.5) / w.size + k * 2.0 / shrink, 0.0), 1.0) for w in ws for k in (-1, 0, 1)}
        around.append(F.percentile_approx(ws[0].values(), F.array(*map(F.lit, sorted(shares))), F.lit(shrink)).alias(f"s{i}"))
    splits = [sorted(set(map(float, s)), key=lambda v: (math.isnan(v), v)) for s in df.agg(*around).first()]
    counts = []
    for i, (ws, split) in enumerate(zip(ranges.values(), splits, strict=True)):
        x = ws[0].values()
        for j, v in enumerate(split):
            counts += [F.count_if(x < F.lit(v)).alias(f"l{i}_{j}"), F.count_if(x == F.lit(v)).alias(f"e{i}_{j}")]
    row = df.agg(*counts).first()
    for i, (ws, split) in enumerate(zip(ranges.values(), splits, strict=True)):
        for w in ws:
            w.narrow([(v, row[f"l{i}_{j}"], row[f"e{i}_{j}"]) for j, v in enumerate(split)])


def _between(wanted: dict[tuple[str, int], Wanted], column: str, p: float, n: int) -> float | None:
    if not n:
        return None
    at = p * (n - 1)
    a, b = wanted[column, math.floor(at)].value, wanted[column, math.ceil(at)].value
    return a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
