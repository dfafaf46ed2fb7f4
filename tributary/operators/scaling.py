"""Column scalers: fit is one aggregation, transform and inverse are projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, ScalerNotFittedError
from .quantiles import exact_quantiles

EPS = 1e-12


@dataclass
class Scaler:
    """(x - centre) / scale * gain + shift, by column; subclasses say which aggregates give centre and scale."""

    columns: tuple[str, ...] = ()
    centre: np.ndarray | None = field(default=None, repr=False)
    scale: np.ndarray | None = field(default=None, repr=False)
    gain: float = 1.0
    shift: float = 0.0

    def aggregates(self, c: str) -> list:
        raise NotImplementedError

    def constants(self, *found: float) -> tuple[float, float]:
        raise NotImplementedError

    def found(self, df: DataFrame, columns: Sequence[str]) -> list[Sequence[float]]:
        """What `constants` takes, for each column."""
        each = [self.aggregates(c) for c in columns]
        flat = [a for x in each for a in x]
        row = iter(df.agg(*(a.alias(f"a{i}") for i, a in enumerate(flat))).first() if flat else ())
        return [[next(row) for _ in x] for x in each]

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Scaler:
        self.columns = tuple(columns)
        pairs = [self.constants(*x) for x in self.found(df, columns)]
        self.centre = np.array([float(a) for a, _ in pairs])
        self.scale = np.array([float(b) if abs(b) > EPS else 1.0 for _, b in pairs])
        return self

    def _ready(self) -> None:
        if self.centre is None or self.scale is None:
            raise ScalerNotFittedError(f"{type(self).__name__} isn't fitted")

    def transform(self, df: DataFrame) -> DataFrame:
        self._ready()
        new = {c: ((F.col(c) - F.lit(float(m))) / F.lit(float(s)) * F.lit(self.gain) + F.lit(self.shift)).alias(c) for c, m, s in zip(self.columns, self.centre, self.scale, strict=True)}
        return df.select(*(new.get(c, F.col(c)) for c in df.columns))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._ready()
        new = {c: ((F.col(c) - F.lit(self.shift)) / F.lit(self.gain) * F.lit(float(s)) + F.lit(float(m))).alias(c) for c, m, s in zip(self.columns, self.centre, self.scale, strict=True)}
        return df.select(*(new.get(c, F.col(c)) for c in df.columns))

    def affine(self) -> tuple[np.ndarray, np.ndarray]:
        """x -> a * x + b, for use on sufficient statistics."""
        self._ready()
        a = self.gain / self.scale
        return a, self.shift - self.centre * a


class Standard(Scaler):
    def aggregates(self, c):
        return [F.avg(c), F.stddev_pop(c)]

    def constants(self, mean, std):
        return mean, std


class MinMax(Scaler):
    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        low, high = feature_range
        if high <= low:
            raise ConfigError("the range's end must lie above its start")
        super().__init__(gain=high - low, shift=low)

    def aggregates(self, c):
        return [F.min(c), F.max(c)]

    def constants(self, low, high):
        return low, high - low


class Robust(Scaler):
    """Median and interquartile range, interpolated exactly."""

    def found(self, df, columns):
        return exact_quantiles(df, columns, (0.25, 0.5, 0.75))

    def constants(self, low, middle, high):
        return middle, high - low


class MaxAbs(Scaler):
    def aggregates(self, c):
        return [F.max(F.abs(c))]

    def constants(self, top):
        return 0.0, top


class Identity(Scaler):
    def aggregates(self, c):
        return []

    def constants(self):
        return 0.0, 1.0


SCALERS = {"standard": Standard, "zscore": Standard, "minmax": MinMax, "robust": Robust, "maxabs": MaxAbs, "identity": Identity, "none": Identity}


def scaler(spec) -> Scaler:
    """A scaler from its name, a class, an object with fit and transform, or None."""
    if spec is None:
        return Identity()
    if isinstance(spec, str):
        if spec.lower() not in SCALERS:
            raise ConfigError(f"no scaler {spec!r}; there are {sorted(SCALERS)}")
        return SCALERS[spec.lower()]()
    if isinstance(spec, type):
        return spec()
    if hasattr(spec, "fit") and hasattr(spec, "transform"):
        return spec
    raise ConfigError(f"{spec!r} is no scaler")
