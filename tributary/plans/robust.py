"""Absolute and Huber losses inside of fits: reweighted least squares, one pass over the features a round for all of them.

A fit and all its reference fits, for all effects, are cells (run, effect) of one computation. A round weighs each row by how a squared loss
of its residual touches the loss, adds up the weighted products of every cell that still moves, in one pass, and solves each on the
driver from its (columns + 2)^2 numbers. Cells that have settled leave the pass. Fits start at least squares, which takes no pass.

Penalties and rules act as in a Newton step: a penalty's gradient is added to that of the summed loss, rules project after each round.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TrainingConfigurationError
from ..operators import gram as G
from . import solvers
from .layout import Layout

#: Residuals below this count as this for the absolute loss.
FLOOR = 1e-6
LOSSES = {"mse": "mse", "squared": "mse", "mae": "mae", "l1": "mae", "huber": "huber", "smooth_l1": "huber"}


@dataclass(frozen=True)
class Loss:
    """mse, mae or huber (half a square up to delta, then a line)."""

    kind: str = "mse"
    delta: float = 1.0

    @classmethod
    def of(cls, spec) -> Loss:
        """From None, a name, or {type, delta}."""
        if isinstance(spec, Loss):
            return spec
        spec = {"type": spec or "mse"} if spec is None or isinstance(spec, str) else spec
        if not isinstance(spec, Mapping) or str(spec.get("type", spec.get("name"))).lower() not in LOSSES:
            raise TrainingConfigurationError(f"no loss {spec!r}; there are {sorted(LOSSES)}")
        delta = float(spec.get("delta", spec.get("beta", 1.0)))
        if not delta > 0:
            raise TrainingConfigurationError("the Huber loss needs a positive delta")
        return cls(LOSSES[str(spec.get("type", spec.get("name"))).lower()], delta)

    def weights(self, r: np.ndarray) -> np.ndarray:
        """What makes half a squared loss touch the loss at residuals r."""
        r = np.abs(r)
        if self.kind == "mae":
            return 1 / np.maximum(r, FLOOR)
        return np.where(r <= self.delta, 1.0, self.delta / np.maximum(r, FLOOR)) if self.kind == "huber" else np.ones_like(r)

    def values(self, r: np.ndarray) -> np.ndarray:
        r = np.abs(r)
        if self.kind == "mae":
            return r
        return np.where(r <= self.delta, r * r / 2, self.delta * (r - self.delta / 2)) if self.kind == "huber" else r * r


@dataclass
class Run:
    """One fit of all effects: its mask, what projects its weights, and its callbacks."""

    mask: np.ndarray
    project: Callable[[np.ndarray], np.ndarray] | None = None
    callbacks: Sequence[solvers.Callback] = ()
    weights: np.ndarray | None = None
    intercept: np.ndarray | None = None
    loss: float = float("nan")
    epochs: int = 0
    moving: set[int] = field(default_factory=set)
    lost: np.ndarray | None = None

    def fit(self, problem: solvers.Problem) -> solvers.Fit:
        """As solvers give it; squared residuals count the intercept as it is."""
        off = self.intercept - problem.intercept(self.weights)
        return solvers.Fit(self.weights, self.intercept, problem.rss(self.weights) + problem.n * off * off, self.loss, self.epochs)


def weighted(rows: DataFrame, features: Sequence[str], effects: Sequence[str], runs: Sequence[Run], loss: Loss) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """Of each cell that moves: the weighted products of (1, features, effect), and the sum of losses before this round; one pass."""
    p, cells = len(features), [(r, i) for r, run in enumerate(runs) for i in sorted(run.moving)]
    beta = np.array([np.append(runs[r].intercept[i], runs[r].weights[i]) for r, i in cells])
    upper = np.triu_indices(p + 2)

    def run(batches):
        total, lost = np.zeros((len(cells), len(upper[0]))), np.zeros(len(cells))
        for b in batches:
            z = np.column_stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False) for c in b.columns)])
            x = z[:, : p + 1]
            for k, (_, i) in enumerate(cells):
                y = z[:, p + 1 + i]
                r = y - x @ beta[k]
                full = np.column_stack([x, y])
                total[k] += (full.T @ (full * loss.weights(r)[:, None]))[upper]
                lost[k] += loss.values(r).sum()
        k, i = np.indices((len(cells), total.shape[1] + 1), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(i.ravel()), pa.array(np.column_stack([total, lost]).ravel())], names=["cell", "i", "value"])

    parts = rows.select(*(F.col(c).cast("double") for c in [*features, *effects])).mapInArrow(run, "cell int, i int, value double")
    found = np.zeros((len(cells), len(upper[0]) + 1))
    for r in parts.groupBy("cell", "i").agg(F.sum("value").alias("value")).collect():  # a fixed number of sums a cell
        found[r["cell"], r["i"]] = r["value"]
    return {cell: (G.from_upper(v[:-1], p + 1), float(v[-1])) for cell, v in zip(cells, found, strict=True)}


def _step(products: np.ndarray, w: np.ndarray, mask: np.ndarray, penalty) -> tuple[np.ndarray, float]:
    """Weighted least squares of one effect on its active columns, pulled by a penalty; and the intercept."""
    one = solvers.Problem.of(products, len(w))
    at = np.flatnonzero(mask)
    grad = one.xy[at, 0].copy()
    if penalty:
        grad = grad - penalty.gradient(w[None])[0, at]
    out = np.zeros(len(w))
    if len(at):
        out[at] = np.linalg.pinv(one.xx[np.ix_(at, at)], rcond=1e-13, hermitian=True) @ grad
    return out, float(one.y_mean[0] - one.x_mean @ out)


def fit_runs(rows: DataFrame, problem: solvers.Problem, features: Sequence[str], effects: Sequence[str], runs: Sequence[Run], loss: Loss, rounds: int = 50, tol: float = 1e-8, penalty=None) -> None:
    """Fits all runs in place. `problem` has the unweighted products of the same rows."""
    states = []
    for run in runs:
        run.weights = solvers.least_squares(problem, run.mask)
        run.weights = run.project(run.weights) if run.project else run.weights
        run.intercept, run.moving, run.lost = problem.intercept(run.weights), set(range(len(effects))), np.zeros(len(effects))
        states.append({"lr": 1.0, "loss": float("inf"), "weights": run.weights})
        for c in run.callbacks:
            c.on_train_beginning(states[-1])
    for epoch in range(1, rounds + 1):
        if not any(run.moving for run in runs):
            break
        found = weighted(rows, features, effects, runs, loss)
        for r, (run, state) in enumerate(zip(runs, states, strict=True)):
            if not run.moving:
                continue
            for c in run.callbacks:
                c.on_epoch_beginning(epoch, state)
            new, shift = run.weights.copy(), run.intercept.copy()
            for i in run.moving:
                new[i], shift[i] = _step(found[r, i][0], run.weights[i], run.mask[i], penalty)
            if run.project:
                fixed = run.project(new.copy())
                for i in run.moving:
                    if (fixed[i] != new[i]).any():  # the intercept follows what the projection moved
                        one = solvers.Problem.of(found[r, i][0], len(features))
                        shift[i] = float(one.y_mean[0] - one.x_mean @ fixed[i])
                new = fixed
            for i in run.moving:
                run.lost[i] = found[r, i][1]
            run.loss = float(run.lost.sum()) / (problem.n * len(effects)) + (penalty.penalty(run.weights) if penalty else 0.0)
            size = np.maximum(1.0, np.abs(new).max(axis=1, initial=0.0))
            still = {i for i in run.moving if max(np.abs(new[i] - run.weights[i]).max(initial=0.0), abs(shift[i] - run.intercept[i])) <= tol * max(size[i], abs(shift[i]))}
            run.weights, run.intercept, run.epochs = new, shift, epoch
            state |= {"loss": run.loss, "weights": new}
            go_on = [c.on_epoch_end(epoch, state) is not False for c in run.callbacks]
            run.moving = run.moving - still if all(go_on) and loss.kind != "mse" else set()
    for run, state in zip(runs, states, strict=True):
        for c in run.callbacks:
            c.on_train_end(state)


def fit(rows: DataFrame, layout: Layout, effects: list[str], loss="huber", delta: float = 1.0, rounds: int = 100, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Weights (effects x columns, on the columns as they are) and intercepts; inactive columns stay at 0."""
    kind = Loss.of({"type": loss, "delta": delta})
    rows = rows.persist()
    try:
        names = layout.names
        problem = solvers.Problem.of(G.gram(rows, [*names, *effects]).matrix, len(names))
        run = Run(layout.rows(effects).astype(float))
        fit_runs(rows, problem, names, effects, [run], kind, rounds, tol)
    finally:
        rows.unpersist()
    return run.weights, run.intercept
