"""Which lags each effect may use of each variable: blocks of lags per variable, and a mask over them."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import LagConfigurationError


@dataclass(frozen=True)
class LagConfiguration:
    """Lags as asked for. Variable overrides are (max,) or (min, max); pair overrides are keyed (effect, cause)."""

    max_lag: int = 12
    use_lag_zero: bool = False
    custom_lags: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    custom_pair_lags: Mapping[tuple[str, str], tuple[int, ...]] = field(default_factory=dict)


@dataclass
class Layout:
    """Lags min..max of each variable lie side by side, variables in order; mask[target, column] = 1 where a lag is in use."""

    variables: tuple[str, ...]
    min_lags: list[int]
    max_lags: list[int]
    mask: np.ndarray

    @property
    def widths(self) -> list[int]:
        return [b - a + 1 for a, b in zip(self.min_lags, self.max_lags, strict=True)]

    @property
    def offsets(self) -> list[int]:
        return [0, *np.cumsum(self.widths).tolist()]

    @property
    def names(self) -> list[str]:
        return [f"{v}_lag{k}" for v, a, b in zip(self.variables, self.min_lags, self.max_lags, strict=True) for k in range(a, b + 1)]

    @property
    def lags(self) -> list[int]:
        return [k for a, b in zip(self.min_lags, self.max_lags, strict=True) for k in range(a, b + 1)]

    def block(self, variable: str) -> slice:
        i = self.variables.index(variable)
        return slice(self.offsets[i], self.offsets[i + 1])

    def rows(self, effects: Sequence[str]) -> np.ndarray:
        """The mask's rows of the effects, in their order."""
        return self.mask[[self.variables.index(e) for e in effects]]

    def mask_table(self, spark: SparkSession, effects: Sequence[str] | None = None) -> DataFrame:
        rows = [(e, v, a + k, int(self.mask[self.variables.index(e), self.block(v)][k])) for e in effects or self.variables for v, a, n in zip(self.variables, self.min_lags, self.widths, strict=True) for k in range(n)]
        return spark.createDataFrame(rows, "effect string, cause string, lag int, active int")

    def summary_table(self, spark: SparkSession) -> DataFrame:
        rows = [(v, a, b, b - a + 1) for v, a, b in zip(self.variables, self.min_lags, self.max_lags, strict=True)]
        return spark.createDataFrame(rows, "variable string, min_lag int, max_lag int, n_features int")


def fixed(variables: Sequence[str], config: LagConfiguration) -> Layout:
    """The same lags everywhere; a variable's own lag 0 is never in use."""
    low = 0 if config.use_lag_zero else 1
    if config.max_lag < low:
        raise LagConfigurationError(f"max_lag must be at least {low}")
    d = len(variables)
    matrix = np.full((d, d), config.max_lag)
    return overridden(from_matrix(variables, matrix, low), config)


def from_matrix(variables: Sequence[str], matrix: np.ndarray, min_lag: int) -> Layout:
    """From the longest lag of each (target, predictor): lags min..L in use, none where L is 0 (but for lag 0 alone of others)."""
    d = len(variables)
    top = [max(int(matrix[:, j].max()), min_lag) for j in range(d)]
    layout = Layout(tuple(variables), [min_lag] * d, top, np.zeros((d, sum(t - min_lag + 1 for t in top)), np.int64))
    for i in range(d):
        for j in range(d):
            cells = layout.mask[i, layout.block(variables[j])]
            longest = int(matrix[i, j])
            if longest > 0:
                cells[: longest - min_lag + 1] = 1
            if min_lag == 0 and i == j:
                cells[0] = 0
    return layout


def _resized(layout: Layout, j: int, low: int, high: int, fill: int) -> Layout:
    """Variable j with lags low..high: shared lags keep their cells, new ones hold `fill` (never the own lag 0)."""
    at = layout.block(layout.variables[j])
    old, first = layout.mask[:, at], layout.min_lags[j]
    new = np.full((len(layout.variables), high - low + 1), fill, np.int64)
    for k in range(low, high + 1):
        if first <= k <= layout.max_lags[j]:
            new[:, k - low] = old[:, k - first]
    if low == 0 and not (first == 0):
        new[j, 0] = 0
    mins, maxs = list(layout.min_lags), list(layout.max_lags)
    mins[j], maxs[j] = low, high
    return Layout(layout.variables, mins, maxs, np.concatenate([layout.mask[:, : at.start], new, layout.mask[:, at.stop :]], axis=1))


def remapped(layout: Layout, variable: str, low: int, high: int, fill: int = 0, align: str = "overlap") -> Layout:
    """A variable with lags low..high. Cells go by lag ("overlap"), or by place from the first ("left") or last ("right") lag on; others hold `fill`."""
    j = layout.variables.index(variable)
    if align == "overlap":
        return _resized(layout, j, low, high, fill)
    if align not in ("left", "right"):
        raise LagConfigurationError(f"no alignment {align!r}")
    old, n = layout.mask[:, layout.block(variable)], high - low + 1
    keep = min(n, old.shape[1])
    out = _resized(layout, j, low, high, fill)
    cells = np.full((len(layout.variables), n), fill, np.int64)
    cells[:, slice(0, keep) if align == "left" else slice(n - keep, n)] = old[:, :keep] if align == "left" else old[:, old.shape[1] - keep :]
    if low == 0:
        cells[j, 0] = 0  # the own lag 0
    out.mask[:, out.block(variable)] = cells
    return out


def _range(spec: Sequence[int], low: int) -> tuple[int, int]:
    a, b = (low, spec[0]) if len(spec) == 1 else (spec[0], spec[1])
    if a < 0 or b < a:
        raise LagConfigurationError(f"{tuple(spec)} is no range of lags")
    return a, b


def overridden(layout: Layout, config: LagConfiguration) -> Layout:
    """With the configuration's overrides: of variables first, then of pairs. Unknown names are warned of and left out."""
    base = 0 if config.use_lag_zero else 1
    for v, spec in config.custom_lags.items():
        if v not in layout.variables:
            warnings.warn(f"custom lags for unknown variable {v!r}", stacklevel=2)
            continue
        layout = _resized(layout, layout.variables.index(v), *_range(spec, base), 1)
    for (effect, cause), spec in config.custom_pair_lags.items():
        if effect not in layout.variables or cause not in layout.variables:
            warnings.warn(f"custom lags for unknown pair {(effect, cause)!r}", stacklevel=2)
            continue
        i, j = layout.variables.index(effect), layout.variables.index(cause)
        a, b = _range(spec, base)
        layout = _resized(layout, j, min(a, layout.min_lags[j]), max(b, layout.max_lags[j]), 0)
        cells = layout.mask[i, layout.block(cause)]
        cells[:] = 0
        cells[a - layout.min_lags[j] : b - layout.min_lags[j] + 1] = 1
        if i == j and layout.min_lags[j] == 0:
            cells[0] = 0
    return layout
