"""Whole analyses: difference, lay out lags, scale, sum up once, then fit, drop each cause and test on the sums alone."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataValidationError, HyperoptError, LagPreparationError, RankError
from ..functions.dist import chi2_sf, f_sf
from ..operators import gram as G
from ..operators import lagging, scaling
from ..operators.stationarity import StationarityTransformer
from ..sources import panel as P
from . import inference, robust, selectors, solvers
from .batches import Batches
from .layout import LagConfiguration, Layout


@dataclass
class Prepared:
    """What is left of the data once they are read: a layout, scalers, and products of fixed size."""

    variables: tuple[str, ...]
    effects: list[str]
    layout: Layout
    problem: solvers.Problem
    x_scaler: scaling.Scaler
    y_scaler: scaling.Scaler
    orders: dict[str, int]
    features: DataFrame = field(repr=False)
    scaled: DataFrame = field(repr=False, default=None)
    signature: tuple = ()
    held: dict = field(repr=False, default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.layout.names, *self.effects]

    def batches(self, size: int) -> Batches:
        """Products by contiguous batches of `size` rows; made once for each size."""
        key = ("batches", size)
        if key not in self.held:
            self.held[key] = Batches(self.scaled, self.columns, self.problem, size)
        return self.held[key]


def as_panel(data, spark: SparkSession | None = None) -> P.Panel:
    """A Panel, a Spark table with segment_id and t, or pandas frames."""
    if isinstance(data, P.Panel):
        return data
    if isinstance(data, DataFrame):
        variables = [c for c in data.columns if c not in (P.SEGMENT, P.TIME)]
        return P.from_table(data, variables, P.SEGMENT if P.SEGMENT in data.columns else None)
    return P.from_frames(spark or SparkSession.getActiveSession(), data)


def fingerprint(panel: P.Panel) -> tuple:
    """Names, and a hash of all rows: two panels with the same one hold the same data."""
    row = panel.df.agg(F.count("*"), F.bit_xor(F.xxhash64(P.SEGMENT, P.TIME, *panel.variables))).first()
    return (panel.variables, *row)


def prepare(panel: P.Panel, effects: Sequence[str], config: LagConfiguration | None = None, selector=None, transformer: StationarityTransformer | None = None, x_scaler="standard", y_scaler="standard", sample_fraction: float = 1.0, max_samples: int | None = None, chunk: int | None = None) -> Prepared:
    """Reads the data: unit-root tests, lag selection (if asked for), one pass for the scalers and one for the products."""
    transformer = transformer or StationarityTransformer()
    panel = P.indexed(panel)
    # unit-root tests and selectors take several passes over the panel, scalers and products two over its features
    source = panel.df.persist()
    try:
        panel = P.indexed(transformer.fit_transform(panel.with_df(source, panel.index, panel.whole), chunk=chunk))
        layout = selectors.select_layout(panel, config or LagConfiguration(), selector, effects, chunk)
        # an effect and its own lag 0 would share a name only if lags had no suffix, so all names differ
        names = layout.names
        rows = lagging.lag_features(panel, layout.min_lags, layout.max_lags, effects, chunk).persist()
        try:
            sx, sy = scaling.scaler(x_scaler).fit(rows, names), scaling.scaler(y_scaler).fit(rows, list(effects))
            scaled = sy.transform(sx.transform(rows))
            scaled = P.head_sample(scaled, sample_fraction, max_samples)
            sums = G.gram(scaled, [*names, *effects])
        finally:
            rows.unpersist()
    finally:
        source.unpersist()
    if sums.n < 1:
        raise LagPreparationError("no rows are left once lags are taken")
    return Prepared(panel.variables, list(effects), layout, solvers.Problem.of(sums.matrix, len(names)), sx, sy, dict(transformer.orders), rows, scaled)


class MultiTaskCausality:
    """Which causes help to predict which effects, given all variables' pasts.

    fit() takes what its keyword arguments say; `causes` only sets the default of `tested_causes`, as every variable is a
    predictor. Relations restrict pairs (effect, cause): None forbids, a number asks for a minimal sum of absolute weights;
    `constraint` is any further function of the weights, or a spec of a mask and rules. `backend` names a solver, or is a LinearModel.
    """

    def __init__(self, backend: str | type[solvers.LinearModel] | None = None, stationarity_transformer: StationarityTransformer | None = None, reuse_data: bool = False, compat: bool = False):
        self.backend, self.transformer, self.reuse_data, self.compat = backend, stationarity_transformer, reuse_data, compat
        self.prepared: Prepared | None = None

    def fit(
        self, data=None, causes=None, effects=None, tested_causes=None, relations: Mapping | None = None, lag_config: LagConfiguration | None = None, lag_selector=None, stationarity_transformer=None, prepared_data: Prepared | None = None,
        backend_sample_fraction: float = 1.0, backend_max_samples: int | None = None, x_scaler="standard", y_scaler="standard", regularizer=None, regularizer_spec=None, callbacks=None,
        hiperoptimalization_state: bool | None = None, hiperoptimalization_conf: Mapping | None = None, initializer=None, model_config: Mapping | None = None, chunk: int | None = None, constraint=None,
    ) -> inference.Results:
        spark = SparkSession.getActiveSession()
        if prepared_data is None and self.reuse_data:
            prepared_data = self.prepared
        if prepared_data is None:
            if data is None:
                raise DataValidationError("no data")
            panel = as_panel(data, spark)
            _, effects, tested = P.check_roles(panel.variables, causes, effects, tested_causes)
            prepared_data = prepare(panel, effects, lag_config, lag_selector, stationarity_transformer or self.transformer, x_scaler, y_scaler, backend_sample_fraction, backend_max_samples, chunk)
        else:
            _, effects, tested = P.check_roles(prepared_data.variables, causes, effects or prepared_data.effects, tested_causes)
            if list(effects) != prepared_data.effects:
                raise DataValidationError("the prepared data are for other effects")
        self.prepared = prepared_data
        config = dict(model_config or {})
        callbacks = callbacks if callbacks is not None else config.pop("callbacks", None)
        config.pop("callbacks", None)
        config_penalty = config.pop("regularizer", None)
        seed = config.pop("seed", None)
        key, solve = solvers.solver(self.backend)
        layout, problem = prepared_data.layout, prepared_data.problem
        spec = regularizer_spec if regularizer_spec is not None else regularizer if regularizer is not None else config_penalty
        penalty = solvers.penalty_of(spec, layout)
        rule = solvers.constraint(relations, layout, effects)
        own = solvers.constraint_of(constraint if constraint is not None else config.pop("constraint", None), *rule.mask.shape)
        if isinstance(own, solvers.Constraint):  # one with the relations
            rule, own = solvers.Constraint(rule.mask * own.mask, [*rule.rules, *own.rules], own.eps), None
        mask = rule.mask
        loss = robust.Loss.of(config.pop("loss", None))
        if hiperoptimalization_state and hiperoptimalization_conf:
            config, penalty = search(prepared_data, mask, rule, key, solve, config, penalty, hiperoptimalization_conf)
        made = solvers.callbacks_of(callbacks)
        cloned = lambda cause: [c.clone_for_run("base" if cause is None else f"without_{cause}") if hasattr(c, "clone_for_run") else c for c in made]
        # a caller's own constraint: a function of the weights (effects x columns), applied after the relations at each step
        bound = lambda r: solvers.Also(r, own) if own is not None else r
        masks, rules = {None: mask}, {None: rule}  # None is the fit with all causes
        for cause in tested:
            block = layout.block(cause)
            masks[cause] = mask.copy()
            masks[cause][:, block] = 0
            rules[cause] = solvers.Constraint(masks[cause], [r for r in rule.rules if not set(r[1]) & set(range(block.start, block.stop))], rule.eps)
        if loss.kind == "mse":
            fits = self._squared(prepared_data, key, solve, config, masks, rules, bound, penalty, cloned, initializer, seed)
        else:
            fits = robust_fits(prepared_data, config, masks, rules, bound, penalty, cloned, loss)
        base = fits.pop(None)
        cov = inference.covariances(problem, mask, base.rss, strict=True)
        rows, weights = [], {"base": base.weights} | {run: f.weights for run, f in fits.items()}
        for cause in tested:
            rows += inference.rows_for(problem, mask, effects, cause, layout.block(cause), base.weights, base.rss, fits[cause].rss, cov, self.compat)
        return inference.Results(spark, rows, list(effects), list(tested), weights, {"loss": base.loss, "epochs": base.epochs, "intercept": base.intercept, "covariance": cov, "layout": layout, "orders": prepared_data.orders})

    def _squared(self, prepared: Prepared, key: str, solve, config: Mapping, masks: Mapping, rules: Mapping, bound, penalty, cloned, initializer, seed) -> dict[str | None, solvers.Fit]:
        """All runs by a solver, on products alone; reference fits start at the base fit's weights."""
        problem, settings = prepared.problem, batched(prepared, solvers.settings(key, config))
        start = solvers.initial(initializer, problem, masks[None], seed) if initializer is not None else None
        out: dict[str | None, solvers.Fit] = {}
        for cause, mask in masks.items():
            first = {} if start is None else {"start": start, "warn_start": True}
            own = settings | (first if cause is None else {"start": out[None].weights * mask})
            out[cause] = solve(problem, mask, bound(rules[cause]), penalty, cloned(cause), **own)
        return out

    def predict(self, results: inference.Results) -> DataFrame:
        """Predictions in the effects' own units (differences stay differences): segment_id, t, effects, {effect}_pred."""
        d = self.prepared
        ax, bx = d.x_scaler.affine()
        ay, by = d.y_scaler.affine()
        w = results.weights["base"]
        scaled = w * ax  # weights on raw columns
        shift = results.extras["intercept"] + w @ bx

        def one(i: int, e: str):
            out = F.lit(float((shift[i] - by[i]) / ay[i]))
            for c, v in zip(d.layout.names, scaled[i] / ay[i], strict=True):
                if v:
                    out = out + F.col(c) * float(v)
            return out.alias(f"{e}_pred")

        return d.features.select(P.SEGMENT, P.TIME, *d.effects, *(one(i, e) for i, e in enumerate(d.effects)))


def robust_fits(prepared: Prepared, config: Mapping, masks: Mapping, rules: Mapping, bound, penalty, cloned, loss: robust.Loss) -> dict[str | None, solvers.Fit]:
    """All runs under an absolute or Huber loss, in passes over the scaled features that serve them all."""
    limit = int(config.get("max_iter", config.get("epochs", 50)))
    if "batch_size" in config or config.get("optimizer"):
        warnings.warn("batch sizes and optimizers have no effect on absolute and Huber losses", stacklevel=3)
    runs = {cause: robust.Run(mask, bound(rules[cause]), cloned(cause)) for cause, mask in masks.items()}
    rows = prepared.scaled.select(*prepared.columns).persist()
    try:
        robust.fit_runs(rows, prepared.problem, prepared.layout.names, prepared.effects, list(runs.values()), loss, limit, float(config.get("tol", 1e-8)), penalty)
    finally:
        rows.unpersist()
    return {cause: run.fit(prepared.problem) for cause, run in runs.items()}


def batched(prepared: Prepared, settings: dict) -> dict:
    """A solver's settings with the batches' products in place of their size."""
    size = settings.pop("batch_size", None)
    return settings if size is None else settings | {"batches": prepared.batches(int(size))}


def search(prepared: Prepared, mask, rule, key: str, solve, config: Mapping, penalty, conf: Mapping) -> tuple[dict, object]:
    """The trial with the lowest training loss, of the grid's product, at most n_trials; a fifth of the epochs each."""
    grid: dict[str, Sequence] = {}
    for section, params in (conf.get("sections") or {}).items():
        grid |= {f"{section}.{k}": v for k, v in params.items()}
    grid |= {k if "." in k else f"model.{k}": v for k, v in (conf.get("param_grid") or {}).items()}
    if not grid:
        raise HyperoptError("the search has no grid")
    if str(conf.get("type", conf.get("mode", "model"))) not in ("model", "regularization"):
        raise HyperoptError("the search is of type model or regularization")
    trial = dict(config)
    if key == "newton":
        trial["max_iter"] = int(conf.get("trial_epochs") or max(10, int(config.get("max_iter", config.get("epochs", 1000))) // 5))
        trial.pop("epochs", None)
    else:
        trial["epochs"] = int(conf.get("trial_epochs") or max(3, int(config.get("epochs", 100)) // 5))
    trial |= conf.get("trial_train_config") or {}
    best = None
    for values in itertools.islice(itertools.product(*grid.values()), int(conf.get("n_trials", 20))):
        chosen = dict(zip(grid, values, strict=True))
        model = {k.split(".", 1)[1]: v for k, v in chosen.items() if k.split(".", 1)[0] in ("model", "optimizer")}
        own = {k.split(".", 1)[1]: v for k, v in chosen.items() if k.startswith(("regularizer.", "regularization."))}
        p = solvers.penalty_of(own, prepared.layout) if own else penalty
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            loss = solve(prepared.problem, mask, rule, p, (), **batched(prepared, solvers.settings(key, trial | {k: v for k, v in model.items() if k != "type"}))).loss
        if best is None or loss < best[0]:
            best = (loss, dict(config) | model, p)
    return best[1], best[2]


class PairwiseCausality:
    """Two-variable tests of each cause on each effect at one lag, with an intercept and no scaling."""

    TESTS = ("ssr_ftest", "ssr_chi2test", "lrtest", "params_ftest")

    def fit(self, data, causes=None, effects=None, test: str = "ssr_chi2test", lag: int | None = None, lag_max: int = 20, stationarity_transformer: StationarityTransformer | None = None, threshold: float = 0.01) -> inference.Results:
        """A result per pair; a variable on itself has p = 1 and sign 0. lag None: the order with the least AIC, one at least."""
        if test not in self.TESTS:
            raise DataValidationError(f"no test {test!r}; there are {self.TESTS}")
        if lag is not None and lag <= 0:
            raise ValueError("the lag must be positive")
        panel = as_panel(data)
        causes, effects, _ = P.check_roles(panel.variables, causes, effects)
        panel = (stationarity_transformer or StationarityTransformer()).fit_transform(panel)
        if lag is None:
            lag = var_order(panel, lag_max)
        names = list(panel.variables)
        rows = lagging.lag_features(panel, [1] * len(names), [lag] * len(names), names)
        cols = [n for n, _, _ in lagging.lag_columns([1] * len(names), [lag] * len(names), names)]
        sums = G.gram(rows, [*cols, *names])
        problem = solvers.Problem.of(sums.matrix, len(cols))
        out = []
        for e in effects:
            for c in causes:
                if e == c:
                    out.append((e, c, *[None] * 2, 0.0, 1.0, None, None, None, 1.0, 0.0, lag, 0))
                    continue
                i, at = names.index(e), [k for v in (e, c) for k in range(names.index(v) * lag, (names.index(v) + 1) * lag)]
                u, r, w = _rss(problem, at, i), _rss(problem, at[:lag], i), _weights(problem, at, i)
                n, df = problem.n, problem.n - 2 * lag - 1
                f = (r - u) / lag / (u / df) if df > 0 and u > 0 else float("nan")
                chi, lr = n * (r - u) / u if u > 0 else float("nan"), n * np.log(r / u) if u > 0 and r > 0 else float("nan")
                p = {"ssr_ftest": f_sf(f, lag, df), "params_ftest": f_sf(f, lag, df), "ssr_chi2test": chi2_sf(chi, lag), "lrtest": chi2_sf(lr, lag)}[test]
                own = w[lag:]
                sign = float(np.sign(own[int(np.argmax(np.abs(own)))]))
                out.append((e, c, float(u / n), float(r / n), float(f), float(p), float(chi), chi2_sf(chi, lag), float(lr), chi2_sf(lr, lag), sign, lag, int(df)))
        return inference.Results(SparkSession.getActiveSession(), out, effects, causes, extras={"lag": lag, "signed": [(r[0], r[1], r[10] if r[5] < threshold else 0.0) for r in out]})


def _weights(problem: solvers.Problem, at: list[int], i: int) -> np.ndarray:
    return np.linalg.pinv(problem.xx[np.ix_(at, at)], rcond=1e-12, hermitian=True) @ problem.xy[at, i]


def _rss(problem: solvers.Problem, at: list[int], i: int) -> float:
    return float(problem.yy[i] - problem.xy[at, i] @ _weights(problem, at, i))


def var_order(panel: P.Panel, most: int) -> int:
    """The order 1..most of a vector autoregression with the least AIC on the common sample."""
    d = len(panel.variables)
    rows = lagging.lag_features(panel, [1] * d, [most] * d, panel.variables)
    cols = [n for n, _, _ in lagging.lag_columns([1] * d, [most] * d, panel.variables)]
    problem = solvers.Problem.of(G.gram(rows, [*cols, *panel.variables]).matrix, len(cols))
    full = G.gram(rows, list(panel.variables)).matrix
    yy = full[1:, 1:] - np.outer(full[0, 1:], full[0, 1:]) / full[0, 0]
    best = (np.inf, 1)
    for p in range(1, most + 1):
        at = [j * most + k for j in range(d) for k in range(p)]
        if problem.n - len(at) - 1 <= 0:
            break
        w = np.linalg.pinv(problem.xx[np.ix_(at, at)], rcond=1e-12, hermitian=True) @ problem.xy[at]
        sign, log_det = np.linalg.slogdet((yy - problem.xy[at].T @ w) / problem.n)
        if sign > 0:
            best = min(best, (log_det + 2 / problem.n * d * (d * p + 1), p))
    return best[1]


__all__ = ["MultiTaskCausality", "PairwiseCausality", "Prepared", "RankError", "as_panel", "fingerprint", "prepare", "search", "var_order"]
