"""Multi-output linear models fitted on sufficient statistics alone: no pass over the data for any fit, penalty or callback.

`newton` repeats damped Newton steps from zero (one step is least squares at rate 1); `adam` is Adam or another descent rule. Both step on all
rows' products, or on those of one batch after the other, and take an
L1 or lag-dependent L1 penalty, a mask, relation rules and callbacks. With `projection="masked"` each output is fitted on its
own active columns; with "projected" the full system is solved and then masked.
"""

from __future__ import annotations

import copy
import math
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..errors import BackendCompatibilityError, BackendNotAvailableError, BackendSelectionError, ConstraintError, ConvergenceError, DataShapeError, RegularizerConfigurationError, TrainingConfigurationError, TrainingError
from .layout import Layout


@dataclass
class Problem:
    """Centred products of p columns and m outputs."""

    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    x_mean: np.ndarray
    y_mean: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray, p: int) -> Problem:
        n = matrix[0, 0]
        mean = matrix[0, 1:] / n
        c = matrix[1:, 1:] - n * np.outer(mean, mean)
        return cls(float(n), c[:p, :p], c[:p, p:], np.diag(c[p:, p:]).copy(), mean[:p], mean[p:])

    def rss(self, w: np.ndarray) -> np.ndarray:
        """Residual sum of squares of each output for weights w (m x p), with the best intercept."""
        return np.maximum(self.yy - 2 * np.einsum("mp,pm->m", w, self.xy) + np.einsum("mp,pq,mq->m", w, self.xx, w), 0.0)

    def intercept(self, w: np.ndarray) -> np.ndarray:
        return self.y_mean - w @ self.x_mean


# Penalties


@dataclass
class L1:
    l1: float = 0.01

    def penalty(self, w: np.ndarray) -> float:
        return self.l1 * float(np.abs(w).sum())

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.l1 * np.sign(w)


@dataclass
class LagL1:
    """L1 whose weight grows with the lag itself: column k of a block of b columns stands for lag max_lag - b + 1 + k."""

    l1: float
    max_lag: int
    block_lengths: Sequence[int]
    lag_weights: Sequence[float] = tuple(range(1, 21))

    def __post_init__(self):
        out = []
        for b in self.block_lengths:
            lags = [self.max_lag - b + 1 + k for k in range(b)]
            out += [self.lag_weights[max(lag - 1, 0)] if max(lag - 1, 0) < len(self.lag_weights) else None for lag in lags]
        if None in out:
            raise RegularizerConfigurationError("there are fewer lag weights than lags")
        self.weights = np.array(out, float)

    def penalty(self, w):
        return self.l1 * float((np.abs(w) * self.weights).sum())

    def gradient(self, w):
        return self.l1 * np.sign(w) * self.weights


@dataclass
class CalledPenalty:
    """A function of the weights that gives a penalty, its gradient, or both."""

    call: Callable[[np.ndarray], object]

    def both(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        out = self.call(w)
        value, grad = out if isinstance(out, tuple) and len(out) == 2 else (out, None) if np.ndim(out) == 0 else (0.0, out)
        grad = np.zeros(w.shape) if grad is None else np.asarray(grad, float)
        if np.ndim(value) or grad.shape != w.shape:
            raise TrainingError("a penalty is a number, a gradient of the weights' shape, or both")
        return float(value), grad

    def penalty(self, w: np.ndarray) -> float:
        return self.both(w)[0]

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.both(w)[1]


def lag_l1(l1: float, layout: Layout, lag_weights: Sequence[float] = tuple(range(1, 21))) -> LagL1:
    out = LagL1(l1, max(layout.max_lags), [1], lag_weights)
    if max(layout.lags) > len(lag_weights):
        raise RegularizerConfigurationError("there are fewer lag weights than lags")
    out.weights = np.array([lag_weights[max(k - 1, 0)] for k in layout.lags], float)
    return out


# Constraints


@dataclass
class Constraint:
    """w -> w * mask, then each rule's columns are spread out until their absolute sum reaches its minimum."""

    mask: np.ndarray
    rules: Sequence[tuple[int, Sequence[int], float]] = ()
    eps: float = 1e-8

    def __post_init__(self):
        seen: dict[tuple[int, int], int] = {}
        for r, (output, columns, least) in enumerate(self.rules):
            if least < 0:
                raise ConstraintError("a minimum can't be negative")
            for c in columns:
                if seen.setdefault((output, c), r) != r:
                    raise ConstraintError(f"two rules for output {output}, column {c}")

    def __call__(self, w: np.ndarray) -> np.ndarray:
        w = w * self.mask
        for output, columns, least in self.rules:
            at = [c for c in columns if self.mask[output, c]]
            total = float(np.abs(w[output, at]).sum())
            if at and total < least - self.eps:
                sign = np.where(w[output, at] < 0, -1.0, 1.0)
                w[output, at] += sign * (least - total) / len(at)
        return w


@dataclass
class Also:
    """A rule, then a function of the weights that a caller brings along; what the rule's mask forbids stays at 0."""

    rule: Constraint
    extra: Callable[[np.ndarray], np.ndarray]

    def __call__(self, w: np.ndarray) -> np.ndarray:
        return np.asarray(self.extra(self.rule(w)), float) * self.rule.mask


def constraint_of(spec, outputs: int, columns: int) -> Constraint | Callable | None:
    """A constraint from None, a function of the weights, a Constraint, or a spec {type, mask, rules, eps}: mask, or mask_and_min_abs_sum
    with rules {output_index, feature_indices, min_abs_sum}."""
    if spec is None or isinstance(spec, Constraint) or callable(spec):
        return spec
    if not isinstance(spec, Mapping):
        raise ConstraintError(f"{spec!r} is no constraint")
    params = dict(spec.get("params") or {}) | {k: v for k, v in spec.items() if k not in ("type", "name", "kind", "params")}
    kind = str(spec.get("type", spec.get("name", spec.get("kind", "")))).lower()
    if kind not in ("mask", "mask_constraint", "mask_and_min_abs_sum", "mask_min_abs_sum"):
        raise ConstraintError(f"no constraint {kind!r}; there are mask and mask_and_min_abs_sum")
    if params.get("mask") is None:
        raise ConstraintError("the constraint has no mask")
    mask = np.asarray(params["mask"], float)
    mask = mask if mask.shape == (outputs, columns) else mask.T
    rules = params.get("rules") or [] if "min" in kind else []
    if mask.shape != (outputs, columns) or not np.isin(mask, (0, 1)).all():
        raise ConstraintError(f"the mask isn't {outputs} x {columns} of 0 and 1")
    if not isinstance(rules, list | tuple) or not all(isinstance(r, Mapping) and "output_index" in r for r in rules):
        raise ConstraintError("rules are a list of {output_index, feature_indices, min_abs_sum}")
    made = [(int(r["output_index"]), tuple(map(int, r.get("feature_indices") or ())), float(r.get("min_abs_sum", 0.0))) for r in rules]
    if any(not 0 <= o < outputs or not all(0 <= c < columns for c in at) for o, at, _ in made):
        raise ConstraintError("a rule is for an output or a column that isn't there")
    return Constraint(mask, made, float(params.get("eps", 1e-8)))


def oriented(weights, outputs: int, columns: int) -> np.ndarray:
    """Weights as outputs x columns from an array of either orientation, or a list of it and an intercept; square ones are taken as they are."""
    w = np.asarray(weights[0] if isinstance(weights, list | tuple) and np.ndim(weights[0]) == 2 else weights, float)
    if w.shape == (outputs, columns):
        return w.copy()
    if w.shape == (columns, outputs):
        return w.T.copy()
    raise DataShapeError(f"weights of shape {w.shape}, not {(outputs, columns)}")


def relation(value) -> float | None:
    """A rule's minimum absolute sum, or None for a forbidden relation."""
    if value is None or value is False or (isinstance(value, str) and value.strip().lower() in ("zero", "off", "none", "0")):
        return None
    if isinstance(value, Mapping):
        if value.get("zero"):
            return None
        key = next((k for k in ("min_abs_sum", "force_abs_sum", "rule", "value") if k in value), None)
        if key is None:
            raise ConstraintError(f"{value!r} is no relation")
        return relation(value[key])
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise ConstraintError(f"{value!r} is no relation")
    least = float(value)
    if least < 0:
        raise ConstraintError("a minimum can't be negative")
    return least if least > 0 else None


def constraint(relations: Mapping[tuple[str, str], object] | None, layout: Layout, effects: Sequence[str], enforce: bool = True) -> Constraint | None:
    """The mask with forbidden relations cleared, and minima on the active cells of the others."""
    mask = layout.rows(effects).astype(float)
    rules = []
    for (effect, cause), value in (relations or {}).items():
        if effect not in effects or cause not in layout.variables:
            raise ConstraintError(f"unknown relation {(effect, cause)}")
        least, at, i = relation(value), layout.block(cause), list(effects).index(effect)
        if least is None:
            mask[i, at] = 0
        else:
            columns = [c for c in range(at.start, at.stop) if mask[i, c]]
            if columns:
                rules.append((i, columns, least))
            else:
                warnings.warn(f"relation {(effect, cause)} has no active lag", stacklevel=2)
    return Constraint(mask, rules) if relations or enforce else None


# Callbacks


class Callback:
    """Hooks of a fit; `on_epoch_end` returning False stops it."""

    def on_train_beginning(self, state: dict) -> None: ...

    def on_epoch_beginning(self, epoch: int, state: dict) -> None: ...

    def on_epoch_end(self, epoch: int, state: dict) -> bool | None: ...

    def on_train_end(self, state: dict) -> None: ...

    def clone_for_run(self, name: str) -> Callback:
        return copy.deepcopy(self)


@dataclass
class EarlyStopping(Callback):
    patience: int = 20
    min_delta: float = 0.0
    monitor: str = "loss"
    best: float = field(default=math.inf, init=False)
    wait: int = field(default=0, init=False)

    def on_train_beginning(self, state):
        self.best, self.wait = math.inf, 0

    def on_epoch_end(self, epoch, state):
        if state["loss"] < self.best - self.min_delta:
            self.best, self.wait = state["loss"], 0
        else:
            self.wait += 1
        return self.wait < self.patience


@dataclass
class ReduceLR(Callback):
    patience: int = 10
    factor: float = 0.5
    min_lr: float = 1e-6
    min_delta: float = 0.0
    monitor: str = "loss"
    best: float = field(default=math.inf, init=False)
    wait: int = field(default=0, init=False)

    def on_train_beginning(self, state):
        self.best, self.wait = math.inf, 0

    def on_epoch_end(self, epoch, state):
        if state["loss"] < self.best - self.min_delta:
            self.best, self.wait = state["loss"], 0
        else:
            self.wait += 1
            if self.wait >= self.patience:
                state["lr"], self.wait = max(state["lr"] * self.factor, self.min_lr), 0


@dataclass
class ConvergenceCheck(Callback):
    tol: float = 1e-4
    last: float | None = field(default=None, init=False)

    def on_train_beginning(self, state):
        self.last = None

    def on_epoch_end(self, epoch, state):
        last, self.last = self.last, state["loss"]
        return last is None or abs(last - state["loss"]) > self.tol * max(abs(last), 1e-12)


@dataclass
class History(Callback):
    """Loss and rate of each epoch, and each `every` epochs how many weights lie between `edges` (those beyond them in the outer bins), to be made tables."""

    run: str = ""
    rows: list[tuple[str, int, float, float]] = field(default_factory=list)
    every: int = 0
    edges: Sequence[float] = (-1.0, -0.5, -0.1, 0.0, 0.1, 0.5, 1.0)
    histograms: list[tuple[str, int, float, float, int]] = field(default_factory=list)

    def on_epoch_end(self, epoch, state):
        self.rows.append((self.run, epoch, state["loss"], state["lr"]))
        if self.every and epoch % self.every == 0:
            edges = [-math.inf, *self.edges, math.inf]
            place = np.searchsorted(np.asarray(self.edges, float), np.ravel(state["weights"]), side="right")
            for low, high, n in zip(edges[:-1], edges[1:], np.bincount(place, minlength=len(edges) - 1).tolist(), strict=True):
                self.histograms.append((self.run, epoch, float(low), float(high), n))

    def clone_for_run(self, name):
        return History(name, self.rows, self.every, self.edges, self.histograms)  # one log for all runs


CALLBACKS = {"early_stopping": EarlyStopping, "reduce_lr": ReduceLR, "reduce_lr_on_plateau": ReduceLR, "convergence_check": ConvergenceCheck, "history": History, "csv_logger": History, "tensorboard": History}


# Initial weights


def initial(kind, problem: Problem, mask: np.ndarray, seed: int | None = None, mean: float = 0.0) -> np.ndarray:
    """zeros, random_normal (variance 1 / fan-in), ols (each output on its active columns) or a callable (problem, mask) -> weights."""
    if callable(kind):
        return np.asarray(kind(problem, mask), float)
    name = str(kind or "zeros").lower()
    if name in ("zeros", "zero"):
        return np.zeros(mask.shape)
    if name in ("random_normal", "normal", "random"):
        return np.random.default_rng(seed).normal(mean, 1 / math.sqrt(max(mask.shape[1], 1)), mask.shape) * mask
    if name in ("ols", "least_squares"):
        return least_squares(problem, mask)
    raise TrainingConfigurationError(f"no initializer {kind!r}")


def least_squares(problem: Problem, mask: np.ndarray) -> np.ndarray:
    w = np.zeros(mask.shape)
    for i in range(len(w)):
        at = np.flatnonzero(mask[i])
        if len(at):
            w[i, at] = np.linalg.pinv(problem.xx[np.ix_(at, at)], rcond=1e-12, hermitian=True) @ problem.xy[at, i]
    return w


# Solvers


@dataclass
class Fit:
    weights: np.ndarray
    intercept: np.ndarray
    rss: np.ndarray
    loss: float
    epochs: int


def _loop(problem: Problem, step: Callable, w: np.ndarray, mask: np.ndarray, rounds: int, lr: float, tol: float, penalty, callbacks: Sequence[Callback]) -> Fit:
    state = {"lr": lr, "loss": math.inf, "weights": w}
    for c in callbacks:
        c.on_train_beginning(state)
    last, epoch = math.inf, 0
    for epoch in range(1, rounds + 1):
        for c in callbacks:
            c.on_epoch_beginning(epoch, state)
        w = step(w, state["lr"], epoch)
        loss = float(problem.rss(w).sum()) / (problem.n * len(w)) + (penalty.penalty(w) if penalty else 0.0)
        state |= {"loss": loss, "weights": w}
        go_on = [c.on_epoch_end(epoch, state) is not False for c in callbacks]
        if not all(go_on) or abs(last - loss) <= tol:
            break
        last = loss
    for c in callbacks:
        c.on_train_end(state)
    return Fit(w, problem.intercept(w), problem.rss(w), state["loss"], epoch)


def newton(problem: Problem, mask: np.ndarray, constraint: Constraint | None = None, penalty=None, callbacks: Sequence[Callback] = (), learning_rate: float = 1.0, max_iter: int = 1000, tol: float = 1e-8, projection: str = "masked", start=None, warn_start: bool = False, batches: Iterable | None = None, **_) -> Fit:
    """Damped Newton steps on the summed squares; the penalty's gradient is added to theirs. Constant columns stay at 0.

    With `batches` an epoch takes a step on each batch's own products, in order; the loss remains that of all rows.
    """
    if start is not None and np.any(start) and warn_start:
        warnings.warn("newton starts at zero: the initializer has no effect", stacklevel=2)
    project = constraint or (lambda w: w * mask)

    def inverses(xx: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        free = np.where(np.diag(xx) > 1e-12, mask if projection == "masked" else np.ones_like(mask), 0)
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for row in free:
            if row.tobytes() not in known:
                at = np.flatnonzero(row)
                known[row.tobytes()] = at, np.linalg.pinv(xx[np.ix_(at, at)] + 1e-12 * np.eye(len(at)), rcond=1e-13, hermitian=True)
        return [known[row.tobytes()] for row in free]

    def one(w: np.ndarray, lr: float, xx: np.ndarray, xy: np.ndarray, inverse: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        grad = w @ xx - xy.T
        if penalty:
            grad = grad + penalty.gradient(w)
        out = w.copy()
        for i, (at, inv) in enumerate(inverse):
            out[i, at] -= lr * inv @ grad[i, at]
        return project(out)

    if batches is None:
        whole = inverses(problem.xx)

        def step(w: np.ndarray, lr: float, epoch: int) -> np.ndarray:
            return one(w, lr, problem.xx, problem.xy, whole)

    else:

        def step(w: np.ndarray, lr: float, epoch: int) -> np.ndarray:
            for _, xx, xy in batches:
                w = one(w, lr, xx, xy, inverses(xx))
            return w

    return _loop(problem, step, np.zeros(mask.shape), mask, max_iter, learning_rate, tol, penalty, callbacks)


def rule(name: str = "adam", momentum: float = 0.0, nesterov: bool = False, beta1: float = 0.9, beta2: float = 0.999, rho: float = 0.99, eps: float = 1e-8, weight_decay: float = 0.0, **options) -> Callable:
    """A descent rule (w, gradient, rate, step number) -> w with a memory of its own; `options` are those of lbfgs."""
    name = name.lower()
    if name == "lbfgs":
        return LBFGS(**options)
    if options or name not in ("sgd", "adam", "adamw", "nadam", "adamax", "rmsprop", "adagrad", "muon"):
        raise TrainingConfigurationError(f"no optimizer {name!r} with options {sorted(options)}")
    first = second = 0.0

    def step(w: np.ndarray, grad: np.ndarray, lr: float, epoch: int) -> np.ndarray:
        nonlocal first, second
        if weight_decay and name not in ("adamw", "muon"):
            grad = grad + weight_decay * w
        if name == "muon":
            kept = momentum or 0.95
            first = kept * first + grad
            return w * (1 - lr * weight_decay) - lr * math.sqrt(max(1.0, w.shape[0] / w.shape[1])) * orthogonalised(grad + kept * first if nesterov else first)
        if name == "sgd":
            first = momentum * first + grad
            return w - lr * (grad + momentum * first if nesterov else first)
        if name in ("rmsprop", "adagrad"):
            second = second + grad * grad if name == "adagrad" else rho * second + (1 - rho) * grad * grad
            return w - lr * grad / (np.sqrt(second) + eps)
        first = beta1 * first + (1 - beta1) * grad
        mean = first / (1 - beta1**epoch)
        if name == "adamax":
            second = np.maximum(beta2 * second, np.abs(grad))
            return w - lr * mean / (second + eps)
        second = beta2 * second + (1 - beta2) * grad * grad
        if name == "nadam":
            mean = beta1 * mean + (1 - beta1) * grad / (1 - beta1**epoch)
        out = w - lr * mean / (np.sqrt(second / (1 - beta2**epoch)) + eps)
        return out - lr * weight_decay * w if name == "adamw" else out

    return step


def adam(problem: Problem, mask: np.ndarray, constraint: Constraint | None = None, penalty=None, callbacks: Sequence[Callback] = (), learning_rate: float = 1e-3, epochs: int = 100, tol: float = 0.0, start: np.ndarray | None = None, optimizer: str = "adam", optimizer_params: Mapping | None = None, batches: Iterable | None = None, gradient_accumulation_steps: int = 1, **_) -> Fit:
    """Descent on the mean square by Adam or another rule, the same each time: on all rows, or with `batches` on one after the other.

    The gradients of `gradient_accumulation_steps` batches are averaged for a step; what is left of an epoch's batches makes its last one.
    """
    project = constraint or (lambda w: w * mask)
    descend = rule(optimizer, **(optimizer_params or {}))
    if optimizer.lower() == "lbfgs" and gradient_accumulation_steps > 1:
        raise TrainingConfigurationError("lbfgs evaluates gradients itself, so they can't be accumulated")
    count = 0

    def step(w: np.ndarray, lr: float, epoch: int) -> np.ndarray:
        nonlocal count
        held, size = np.zeros(w.shape), 0
        for n, xx, xy in [(problem.n, problem.xx, problem.xy)] if batches is None else batches:

            def slope(v: np.ndarray, n=n, xx=xx, xy=xy) -> np.ndarray:
                grad = 2 * (v @ xx - xy.T) / (n * len(v))
                return grad + penalty.gradient(v) if penalty else grad

            def value(v: np.ndarray, n=n, xx=xx, xy=xy) -> float:
                """The loss less a constant."""
                return float((v @ xx * v).sum() - 2 * (v * xy.T).sum()) / (n * len(v)) + (penalty.penalty(v) if penalty else 0.0)

            if hasattr(descend, "minimise"):
                w = project(descend.minimise(w, slope, value, lr, mask))
                continue
            held, size = held + slope(w) / gradient_accumulation_steps, size + 1
            if size == gradient_accumulation_steps:
                count += 1
                w, held, size = project(descend(w, held, lr, count)), np.zeros(w.shape), 0
        if size:
            count += 1
            w = project(descend(w, held, lr, count))
        return w

    w = project(np.zeros(mask.shape) if start is None else start.copy())
    return _loop(problem, step, w, mask, epochs, learning_rate, tol or -1.0, penalty, callbacks)


class LBFGS:
    """Limited-memory BFGS: the two-loop recursion over the last `history_size` steps, and a backtracking line search that asks for enough
    descent (Armijo). A step takes up to `max_iter` inner iterations; only unmasked weights move."""

    def __init__(self, history_size: int = 10, max_iter: int = 20, tolerance_grad: float = 1e-12):
        if history_size < 1 or max_iter < 1:
            raise TrainingConfigurationError("lbfgs needs a history and an iteration")
        self.size, self.most, self.flat = history_size, max_iter, tolerance_grad
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def direction(self, grad: np.ndarray) -> np.ndarray:
        """Minus the approximate inverse Hessian times the gradient."""
        q, used = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            used.append(a)
            q = q - a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q = q * ((s * y).sum() / (y * y).sum())
        for (s, y), a in zip(self.pairs, reversed(used), strict=True):
            q = q + (a - (y * q).sum() / (s * y).sum()) * s
        return -q

    def minimise(self, w: np.ndarray, slope: Callable, value: Callable, lr: float, mask: np.ndarray) -> np.ndarray:
        self.pairs = []  # a constraint may have moved the weights since
        grad, at = slope(w) * mask, value(w)
        for _ in range(self.most):
            if np.abs(grad).max(initial=0.0) <= self.flat:
                break
            d = self.direction(grad)
            fall = float((d * grad).sum())
            if fall >= 0:
                self.pairs, d = [], -grad
                fall = float((d * grad).sum())
            t = lr if self.pairs else min(lr, 1 / max(float(np.abs(grad).sum()), 1e-300))
            noise = 1e-14 * max(1.0, abs(at))  # near the minimum values no longer tell points apart, but gradients do
            while (new := value(w + t * d)) > at + 1e-4 * t * fall + noise and t > 1e-16:
                t /= 2
            step = t * d
            after = slope(w + step) * mask
            if new >= at and np.abs(after).max() >= np.abs(grad).max():
                break
            if (step * (after - grad)).sum() > 1e-300:
                self.pairs = [*self.pairs, (step, after - grad)][-self.size :]
            w, grad, at = w + step, after, new
        return w


def orthogonalised(m: np.ndarray, steps: int = 5) -> np.ndarray:
    """A matrix with singular values near 1 and the same singular vectors, by Newton-Schulz steps."""
    a, b, c = 3.4445, -4.7750, 2.0315  # fixed values of the quintic step
    wide = m.shape[0] <= m.shape[1]
    x = (m if wide else m.T) / max(float(np.linalg.norm(m)), 1e-7)
    for _ in range(steps):
        g = x @ x.T
        x = a * x + (b * g + c * g @ g) @ x
    return x if wide else x.T


class LinearModel:
    """A fit of one's own: a subclass says what a step does, by products alone, and is registered by a name (or given as the backend).

    It sees the problem (centred products), the mask, `project` (what a constraint makes of weights), the penalty, and what its
    configuration holds. The fit of all causes and each reference fit make a new one; masked weights stay at 0.
    """

    learning_rate, epochs, tol = 1e-3, 100, 0.0

    def __init__(self, problem: Problem, mask: np.ndarray, project: Callable[[np.ndarray], np.ndarray], penalty=None, start: np.ndarray | None = None, batches: Iterable | None = None, **config):
        self.problem, self.mask, self.project, self.penalty, self.batches = problem, mask, project, penalty, batches
        self.start = np.zeros(mask.shape) if start is None else start
        for k, v in config.items():
            if not hasattr(type(self), k):
                raise BackendCompatibilityError(f"{type(self).__name__} has no setting {k!r}")
            setattr(self, k, v)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of the mean square, and of the penalty."""
        grad = 2 * (w @ self.problem.xx - self.problem.xy.T) / (self.problem.n * len(w))
        return grad + self.penalty.gradient(w) if self.penalty else grad

    def step(self, w: np.ndarray, lr: float, epoch: int) -> np.ndarray:
        raise NotImplementedError

    def fit(self, callbacks: Sequence[Callback] = ()) -> Fit:
        def step(w: np.ndarray, lr: float, epoch: int) -> np.ndarray:
            out = np.asarray(self.step(w, lr, epoch), float)
            if out.shape != w.shape:
                raise TrainingError(f"a step gave weights of shape {out.shape}, not {w.shape}")
            if not np.isfinite(out).all():
                raise ConvergenceError(f"weights of epoch {epoch} are no numbers")
            return self.project(out) * self.mask

        return _loop(self.problem, step, self.project(self.start.copy()) * self.mask, self.mask, int(self.epochs), self.learning_rate, self.tol or -1.0, self.penalty, callbacks)


@dataclass
class Backend:
    """A solver, its other names, and whether it can run here."""

    solve: Callable
    aliases: tuple[str, ...] = ()
    available: Callable[[], bool] = lambda: True
    own: bool = False


#: In order of preference: the first one that can run is taken where none is named.
BACKENDS: dict[str, Backend] = {
    "newton": Backend(newton, ("sklearn", "scikit", "scikit-learn")),
    "adam": Backend(adam, ("pytorch", "torch", "tensorflow", "tf", "keras")),
}


def _solve_by(model: type[LinearModel]) -> Callable:
    def solve(problem: Problem, mask: np.ndarray, constraint: Constraint | None = None, penalty=None, callbacks: Sequence[Callback] = (), warn_start: bool = False, **config) -> Fit:
        return model(problem, mask, constraint or (lambda w: w * mask), penalty, **config).fit(callbacks)

    return solve


def register_solver(name: str, model: type[LinearModel] | Callable, aliases: Sequence[str] = (), available: Callable[[], bool] = lambda: True) -> None:
    """Makes a model, or a function with the arguments of `newton`, known by a name; an older one of the name is replaced."""
    key = name.lower()
    solve = _solve_by(model) if isinstance(model, type) and issubclass(model, LinearModel) else model
    if isinstance(model, type) and solve is model or not callable(model):
        raise BackendCompatibilityError(f"{model!r} is no solver")
    taken = {a for k, b in BACKENDS.items() if k != key for a in (k, *b.aliases)} & {key, *(a.lower() for a in aliases)}
    if taken:
        raise BackendSelectionError(f"{sorted(taken)} name other solvers")
    BACKENDS[key] = Backend(solve, tuple(a.lower() for a in aliases), available, own=True)


def available_solvers() -> list[str]:
    return [k for k, b in BACKENDS.items() if b.available()]


def solver(name: str | type[LinearModel] | None) -> tuple[str, Callable]:
    """A solver's name and function, from its name, another name, or a model; the first that can run where none is named."""
    if isinstance(name, type) and issubclass(name, LinearModel):
        return name.__name__, _solve_by(name)
    if name is None:
        if not (ready := available_solvers()):
            raise BackendNotAvailableError("no solver can run")
        return ready[0], BACKENDS[ready[0]].solve
    key = str(name).lower()
    key = next((k for k, b in BACKENDS.items() if key == k or key in b.aliases), key)
    if key not in BACKENDS:
        raise BackendSelectionError(f"no solver {name!r}; there are {sorted(a for k, b in BACKENDS.items() for a in (k, *b.aliases))}")
    if not BACKENDS[key].available():
        raise BackendNotAvailableError(f"solver {key!r} can't run here")
    return key, BACKENDS[key].solve


def settings(key: str, config: Mapping) -> dict:
    """A model configuration's entries by the solver's names; entries without a meaning here are left out with a warning."""
    known = {"learning_rate", "max_iter", "tol", "projection", "epochs", "start", "optimizer_params", "batch_size", "gradient_accumulation_steps"}
    names = {"lr": "learning_rate"}
    out = {}
    for k, v in config.items():
        k = names.get(k, k)
        if key not in BACKENDS or BACKENDS[key].own:  # its own model knows its settings
            out[k] = v
            continue
        if k == "epochs" and key == "newton":
            warnings.warn("epochs count as max_iter for newton", stacklevel=2)
            k = "max_iter"
        if k == "optimizer" and key != "newton" and v is not None:
            spec = {"type": v} if isinstance(v, str) else dict(v)
            params = dict(spec.get("params", {})) | {a: b for a, b in spec.items() if a not in ("type", "name", "kind", "params")}
            if (rate := params.pop("lr", params.pop("learning_rate", None))) is not None:
                out["learning_rate"] = rate
            out |= {"optimizer": spec.get("type", spec.get("name", spec.get("kind", "adam"))), "optimizer_params": params}
        elif k in known:
            out[k] = v
        elif k in ("device", "optimizer", "verbose", "shuffle"):
            warnings.warn(f"{k} has no effect: fits run on sufficient statistics", stacklevel=2)
    return out


def penalty_of(spec, layout: Layout):
    """A penalty from None, a number, a spec {type, l1, ..}, an object or a function."""
    if spec is None:
        return None
    if isinstance(spec, int | float):
        return L1(float(spec))
    if isinstance(spec, Mapping):
        spec = dict(spec)
        kind = str(spec.pop("type", spec.pop("name", spec.pop("kind", "l1")))).lower()
        params = dict(spec.pop("params", {})) | spec
        if kind == "l1":
            return L1(float(params.get("l1", 0.01)))
        if kind == "lag_dependent_l1":
            return lag_l1(float(params.get("l1", 0.01)), layout, params.get("lag_weights", tuple(range(1, 21))))
        if kind in ("none", "null"):
            return None
        raise RegularizerConfigurationError(f"no penalty {kind!r}")
    if hasattr(spec, "penalty") and hasattr(spec, "gradient"):
        return spec
    if callable(spec):
        return CalledPenalty(spec)
    raise RegularizerConfigurationError(f"{spec!r} is no penalty")


def callbacks_of(specs) -> list[Callback]:
    out = []
    for s in [specs] if isinstance(specs, Mapping | Callback | str) else specs or ():
        if isinstance(s, Callback) or hasattr(s, "on_epoch_end"):
            out.append(s)
            continue
        spec = {"type": s} if isinstance(s, str) else dict(s)
        kind = str(spec.pop("type", spec.pop("name", spec.pop("kind", "")))).lower()
        params = dict(spec.pop("params", {})) | spec
        if kind in ("terminate_on_nan", "model_checkpoint"):
            warnings.warn(f"callback {kind} has no effect", stacklevel=2)
            continue
        if kind not in CALLBACKS:
            raise TrainingConfigurationError(f"no callback {kind!r}; there are {sorted(CALLBACKS)}")
        fields = CALLBACKS[kind].__dataclass_fields__
        out.append(CALLBACKS[kind](**{k: v for k, v in params.items() if k in fields and fields[k].init}))
    return out
