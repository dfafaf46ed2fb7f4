"""F, likelihood-ratio and Wald statistics of dropping a cause, and the tables they make."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, RankError
from ..functions.dist import chi2_sf, f_sf
from .solvers import Problem, oriented

EPS = float(np.finfo(float).eps)
SCHEMA = "effect string, cause string, base_error double, ref_error double, f_test double, p_value double, wald_test double, wald_p_value double, lr_test double, lr_p_value double, sign double, n_restrictions int, residual_df int"
TESTS = {"f": "p_value", "f_test": "p_value", "ftest": "p_value", "wald": "wald_p_value", "wald_test": "wald_p_value"} | dict.fromkeys(("lr", "likelihood_ratio", "likelihood_ratio_test", "lrt", "lr_test"), "lr_p_value")


def covariances(problem: Problem, mask: np.ndarray, rss: np.ndarray, strict: bool = True) -> list[np.ndarray | None]:
    """Per output, the covariance of all p coefficients (0 where inactive). Raises RankError, or gives None if not strict."""
    out: list[np.ndarray | None] = []
    for i, row in enumerate(mask):
        at = np.flatnonzero(row)
        df = problem.n - len(at) - 1
        block = problem.xx[np.ix_(at, at)]
        w = np.linalg.eigvalsh(block) if len(at) else np.zeros(0)
        if not len(at) or df <= 0 or w.min() <= max(w.max(), 0) * len(at) * EPS:
            if strict:
                raise RankError(f"output {i}: no active coefficients, no degrees of freedom, or a design without full rank")
            out.append(None)
            continue
        full = np.zeros((mask.shape[1],) * 2)
        full[np.ix_(at, at)] = np.linalg.inv(block) * rss[i] / df
        out.append(full)
    return out


def rows_for(problem: Problem, mask: np.ndarray, effects: Sequence[str], cause: str, block: slice, base: np.ndarray, rss: np.ndarray, ref_rss: np.ndarray, cov: list, compat: bool = False) -> list[tuple]:
    """One row an effect (columns SCHEMA)."""
    out, n, m = [], problem.n, len(effects)
    for i, effect in enumerate(effects):
        at = [c for c in range(block.start, block.stop) if mask[i, c]]
        q, k = len(at), int(mask[i].sum()) + 1
        e0, e1 = rss[i] / (n * m), ref_rss[i] / (n * m)
        f = max(e1 - e0, 0.0) / max(q, EPS) / max(e0 / (n - k), EPS) if n > k else math.nan
        lr = n * math.log(max(e1, EPS) / max(e0, EPS))
        wald = math.nan
        if q and cov[i] is not None:
            b = base[i, at]
            wald = float(b @ np.linalg.solve(cov[i][np.ix_(at, at)], b))
        w = base[i, block]
        sign = float(np.sign(w[int(np.argmax(np.abs(w)))])) if len(w) else 0.0
        p_f = f_sf(f, q, n - k) if q else math.nan
        p_lr = chi2_sf(lr, q) if q else math.nan
        p_wald = p_lr if compat else chi2_sf(wald, q) if q and math.isfinite(wald) else math.nan
        out.append((effect, cause, float(e0), float(e1), float(f), p_f, wald, p_wald, float(lr), p_lr, sign, q, int(n - k)))
    return out


def significant(p: Column, threshold: float) -> Column:
    """1 where p < threshold, else 0; null and NaN are 0."""
    return F.when(p < threshold, 1).otherwise(0)


@dataclass
class Results:
    """All pairs' statistics as a long table, and views of it."""

    spark: SparkSession
    rows: list[tuple]
    effects: list[str]
    causes: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    extras: dict = field(default_factory=dict)

    @property
    def table(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in self.rows], SCHEMA)

    def set_weights(self, run: str, weights) -> None:
        """Replaces a fit's weights ("base", or a cause), which predictions are made from; given in either orientation."""
        self.weights[run] = oriented(weights, len(self.effects), self.weights["base"].shape[1])

    def result(self, threshold: float = 0.01, with_sign: bool = False, test: str = "f") -> DataFrame:
        """effect, cause, value: 0 or 1, or the sign where significant."""
        if str(test).lower() not in TESTS:
            raise ConfigError(f"no test {test!r}; there are {sorted(TESTS)}")
        hit = significant(F.col(TESTS[str(test).lower()]), threshold)
        value = F.when(hit == 1, F.col("sign")).otherwise(0.0) if with_sign else hit
        return self.table.select("effect", "cause", value.alias("value"))

    def matrix(self, column: str = "p_value") -> DataFrame:
        return wide(self.table.select("effect", "cause", F.col(column).alias("value")), self.causes)


def wide(long: DataFrame, causes: Sequence[str]) -> DataFrame:
    """One row an effect, one column a cause."""
    return long.groupBy("effect").pivot("cause", list(causes)).agg(F.first("value"))


def constant(spark: SparkSession, effects: Sequence[str], causes: Sequence[str], value: float = 0.0) -> DataFrame:
    """A matrix (one row an effect, one column a cause) of one value."""
    return spark.createDataFrame([(e,) for e in effects], "effect string").select("effect", *(F.lit(float(value)).alias(c) for c in causes))


def set_column(matrix: DataFrame, cause: str, values: Mapping[str, float]) -> DataFrame:
    """The matrix with a cause's column set, or added, by effect; effects without a value get null."""
    known = matrix.sparkSession.createDataFrame([(e, float(v)) for e, v in values.items()], "effect string, __value double")
    out = matrix.join(F.broadcast(known), "effect", "left")  # as many rows as effects
    return out.select("effect", *(F.col("__value").alias(c) if c == cause else F.col(c) for c in matrix.columns[1:]), *([] if cause in matrix.columns else [F.col("__value").alias(cause)]))
