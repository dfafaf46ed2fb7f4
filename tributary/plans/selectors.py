"""Lag orders by information criteria, blocked cross-validation, or a common vector autoregression.

Selection runs per segment on that segment's own products of all lags (lags 0..max of all variables), plus the first rows, which
give candidates with shorter lags their longer samples: the data are read once, and segments are selected in parallel. The
layout takes the longest lag over segments. Cross-validation keeps products by fold, and the rows around the folds' borders, as these
move with a candidate's lags; absolute errors take a pass a round of the search on top. No segment is gathered in one task.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LagSelectionError
from ..operators import gram as G
from ..operators import lagging
from ..operators.chunks import Chunks
from ..sources import shared
from ..sources.panel import SEGMENT, TIME, Panel
from . import layout as L


class Moments:
    """A segment's products over t >= m for any m <= longest lag: those over t >= longest, plus the rows before."""

    def __init__(self, matrix: np.ndarray, head: np.ndarray, d: int, longest: int, centre: bool = True):
        self.d, self.longest, self.total = d, longest, int(matrix[0, 0]) + longest
        self.matrix, self.head = matrix, head  # head: first `longest` rows of the variables
        # the segment's mean, as selection works on centred series
        first = matrix[0, [self.column(j, 0) for j in range(d)]] + head.sum(axis=0)
        self.mean = first / self.total if centre else np.zeros(d)

    def column(self, j: int, lag: int) -> int:
        return 1 + j * (self.longest + 1) + lag

    def products(self, pairs: Sequence[tuple[int, int]], m: int) -> np.ndarray:
        """Products of (1, x_j[t - lag] ..) over t >= m, centred by the segment's means."""
        at = [0, *(self.column(j, k) for j, k in pairs)]
        out = self.matrix[np.ix_(at, at)].copy()
        for t in range(m, self.longest):
            row = np.array([1.0, *(self.head[t - k, j] for j, k in pairs)])
            out += np.outer(row, row)
        shift = np.eye(len(at))
        shift[1:, 0] = [-self.mean[j] for j, _ in pairs]
        return shift @ out @ shift.T


class Folds:
    """Where the folds of a segment of n rows begin, for each number m of rows that a candidate's lags take from the start."""

    def __init__(self, n: int, longest: int, folds: int):
        self.n, self.longest, self.folds = n, longest, folds
        starts = [[self.start(m, f) for m in range(longest + 1)] for f in range(1, folds)]
        #: products are kept by regions that begin at row `longest` and, for each fold, at the last of its starts
        self.regions = [longest, *(max(longest, *s) for s in starts), n]
        #: rows needed by themselves: the first ones, and those that lie between a fold's starts or are looked back on from there
        self.windows = [(0, min(longest, n)), *((max(0, min(s) - longest), min(r, n)) for s, r in zip(starts, self.regions[1:], strict=False))]

    def start(self, m: int, fold: int) -> int:
        return self.n if fold == self.folds else m + fold * (max(self.n - m, 0) // self.folds)


class FoldMoments(Folds):
    """A segment's centred products by fold: of lags 0..longest of all variables over each region, and some rows around their borders."""

    def __init__(self, n: int, d: int, longest: int, folds: int, regions: dict[int, np.ndarray], rows: dict[int, np.ndarray]):
        super().__init__(n, longest, folds)
        self.d, self.total = d, n
        size = d * (longest + 1)
        self.before = np.zeros((folds + 1, size + 1, size + 1))
        for r, upper in regions.items():
            self.before[r + 1 :] += G.from_upper(upper, size)
        self.held = [(a, np.array([rows[t] for t in range(a, b)]).reshape(-1, d)) for a, b in self.windows]
        self.known: dict[tuple, float] = {}
        self.pending: list[tuple] = []

    def design(self, pairs: Sequence[tuple[int, int]], target: int, begin: int, end: int) -> np.ndarray:
        """(1, x_j[t - lag] .., target) of rows begin.. < end, all of them held."""
        deep = max((k for _, k in pairs), default=0)
        a, x = next((a, x) for a, x in self.held if a <= begin - deep and end <= a + len(x))
        t = np.arange(begin, end) - a
        return np.column_stack([np.ones(len(t)), *(x[t - k, j] for j, k in pairs), x[t, target]])

    def products(self, pairs, target: int, m: int, fold: int) -> np.ndarray:
        """Products of (1, x_j[t - lag] .., target) over rows m.. before the fold's start."""
        end = self.start(m, fold)
        at = [0, *(1 + j * (self.longest + 1) + k for j, k in [*pairs, (target, 0)])]
        parts = [(1, m, min(end, self.longest))]
        out = np.zeros((len(at), len(at)))
        if end > self.longest:
            out = self.before[fold][np.ix_(at, at)].copy()
            parts.append((-1, end, self.regions[fold]))
        for sign, a, b in parts:
            if a < b:
                z = self.design(pairs, target, a, b)
                out += sign * (z.T @ z)
        return out

    def models(self, key: tuple) -> list[tuple[int, int, np.ndarray]]:
        """Rows begin.. < end of each fold that is predicted, and the weights (constant first) learned from the rows before it."""
        target, *pairs = key
        m = max((k for _, k in pairs), default=0)
        if not pairs:
            g = self.products(pairs, target, m, self.folds)
            return [(0, self.total, g[:-1, -1] / g[0, 0])]
        return [(self.start(m, f), self.start(m, f + 1), weights(self.products(pairs, target, m, f))) for f in range(1, self.folds)]

    def squared(self, key: tuple) -> float:
        """The mean over folds of the mean squared error."""
        return float(np.mean(self.fold_errors(key)))

    def fold_errors(self, key: tuple) -> list[float]:
        """The mean squared error of each fold that is predicted."""
        target, *pairs = key
        m, errors = max((k for _, k in pairs), default=0), []
        for f, (begin, end, w) in enumerate(self.models(key), 1):
            g = self.products(pairs, target, m, f + 1 if pairs else self.folds)
            if pairs:
                g = g - self.products(pairs, target, m, f)
            v = np.append(-w, 1.0)
            errors.append(max(float(v @ g @ v), 0.0) / (end - begin))
        return errors


def weights(products: np.ndarray) -> np.ndarray:
    """Least squares of the last column on the others; minimum-norm where they are dependent."""
    w, v = np.linalg.eigh(products[:-1, :-1])
    keep = w > max(w.max(), 0) * len(w) * np.finfo(float).eps * 16
    return v[:, keep] @ ((v[:, keep].T @ products[:-1, -1]) / w[keep])


def residual(products: np.ndarray) -> float:
    """Residual sum of squares of the last column on the others (the first is the constant); minimum-norm where they are dependent."""
    a, b, c = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    w, v = np.linalg.eigh(a)
    keep = w > max(w.max(), 0) * len(w) * np.finfo(float).eps * 16
    p = v[:, keep].T @ b
    return float(max(c - (p * p / w[keep]).sum(), 0.0))


@dataclass
class ICLagSelector:
    max_lag: int | None = None
    center: bool = True
    use_lag_zero: bool = False
    use_bic: bool = False
    delta_min_ic: float | None = 2.0
    prune_lags: bool = True
    delta_prune_ic: float = 2.0
    n_jobs: int = -1
    target_indices: Sequence[int] | None = None
    min_lag: int | None = None

    def low(self) -> int:
        return self.min_lag if self.min_lag is not None else 0 if self.use_lag_zero else 1

    def score(self, mo: Moments, target: int, pairs: Sequence[tuple[int, int]]) -> float:
        pairs = [(j, k) for j, k in pairs if k > 0]
        m = max((k for _, k in pairs), default=0)
        n, k = mo.total - m, len(pairs) + 1
        sigma = residual(mo.products([*pairs, (target, 0)], m)) / n
        sigma = sigma if sigma > 0 else 1e-12
        return (k * math.log(n) if self.use_bic else 2 * k) + n * math.log(sigma)

    def scores(self, mo, target: int, candidates: Sequence[Sequence[tuple[int, int]]]) -> list[float]:
        """Scores of candidates that don't depend on each other."""
        return [self.score(mo, target, pairs) for pairs in candidates]

    def improves(self, score: float, best: float) -> bool:
        return score < best - (self.delta_min_ic or 0.0)

    def may_prune(self, candidate: float, current: float) -> bool:
        return candidate <= current + self.delta_prune_ic

    def target(self, mo, i: int) -> np.ndarray:
        """The longest lag of each predictor of target i."""
        grid = range(self.low(), self.max_lag + 1)
        scores = dict(zip(grid, self.scores(mo, i, [[(i, k)] for k in grid]), strict=True))
        own = min(scores, key=lambda k: (scores[k], k))
        lags = np.zeros(mo.d, np.int64)
        lags[i] = own
        others = [(j, k) for j in range(mo.d) if j != i for k in grid]
        best = dict.fromkeys(range(mo.d), scores[own])
        lags[[j for j in range(mo.d) if j != i]] = self.low()
        for (j, k), s in zip(others, self.scores(mo, i, [[(i, own), c] for c in others]), strict=True):
            if self.improves(s, best[j]):
                best[j], lags[j] = s, k
        return self.prune(mo, i, lags) if self.prune_lags else lags

    def prune(self, mo, i: int, lags: np.ndarray) -> np.ndarray:
        """Shortens one lag by one, the best first, as long as the score stays good."""
        order = [i, *(j for j in range(mo.d) if j != i)]
        pairs = lambda x: [(j, int(x[j])) for j in order if x[j] > 0]
        (current,) = self.scores(mo, i, [pairs(lags)])
        while True:
            tried = []
            for j in range(mo.d):
                if lags[j] > self.low() and lags[j] > 0:
                    tried.append(lags.copy())
                    tried[-1][j] -= 1
            good = [(s, k) for k, s in enumerate(self.scores(mo, i, [pairs(x) for x in tried])) if self.may_prune(s, current)]
            if not good:
                return lags
            current, k = min(good)
            lags = tried[k]

    def select(self, mo, targets: Sequence[int]) -> np.ndarray:
        out = np.zeros((mo.d, mo.d), np.int64)
        for i in targets:
            out[i] = self.target(mo, i)
        return out


class Pending(Exception):
    """Scores that need a pass over the rows first."""


@dataclass
class CVLagSelector(ICLagSelector):
    cv_folds: int = 5
    cv_metric: str = "mse"
    delta_min_rel_cv: float | None = None
    prune_lags: bool = False
    delta_prune_rel_cv: float = 0.02

    def folds(self) -> int:
        return max(2, int(self.cv_folds))

    def improves(self, score, best):
        return score < best * (1 - (self.delta_min_rel_cv or 0.0))

    def may_prune(self, candidate, current):
        return candidate <= current * (1 + self.delta_prune_rel_cv)

    def score(self, mo: FoldMoments, target, pairs):
        """Forward-chaining error: fold 1 only trains, the last fold takes the remainder."""
        (out,) = self.scores(mo, target, [pairs])
        return out

    def scores(self, mo: FoldMoments, target, candidates):
        out, missing = [], []
        for pairs in candidates:
            key = (target, *((j, k) for j, k in pairs if k > 0))
            m = max((k for _, k in key[1:]), default=0)
            if key[1:] and (mo.total - m) // mo.folds < 1:  # too short for folds
                n, k = mo.total - m, len(key)
                rss = residual(mo.products(key[1:], target, m, mo.folds))
                out.append((k * math.log(n) if self.use_bic else 2 * k) + n * math.log(max(rss / n, 1e-12)))
            elif self.cv_metric == "mae":
                missing += [key] if key not in mo.known else []
                out.append(mo.known.get(key, math.inf))
            else:
                out.append(mo.squared(key))
        if missing:
            mo.pending += missing
            raise Pending
        return out

    def select(self, mo, targets):
        """Lags of the targets; of those whose scores are pending, nothing yet."""
        out = np.zeros((mo.d, mo.d), np.int64)
        for i in targets:
            try:
                out[i] = self.target(mo, i)
            except Pending:
                pass
        return out


@dataclass
class VARLagSelector:
    max_lag: int | None = None
    center: bool = True
    use_lag_zero: bool = False
    min_lag: int | None = 1
    maximum: bool = True
    target_indices: Sequence[int] | None = None

    def low(self) -> int:
        return self.min_lag if self.min_lag is not None else 1

    def criteria(self, mo: Moments, p: int) -> dict[str, float]:
        """AIC, BIC, HQIC and FPE of a vector autoregression of order p on its own sample."""
        d, n = mo.d, mo.total - p
        pairs = [(j, k) for k in range(1, p + 1) for j in range(d)]
        full = mo.products([*pairs, *((j, 0) for j in range(d))], p)
        r = len(pairs) + 1
        a, b, c = full[:r, :r], full[:r, r:], full[r:, r:]
        free = n - r
        if free <= 0 or np.linalg.matrix_rank(a, hermitian=True) < r:
            return dict.fromkeys(("aic", "bic", "hqic", "fpe"), math.inf)
        sigma = (c - b.T @ np.linalg.solve(a, b)) / n
        sign, log_det = np.linalg.slogdet(sigma)
        if sign <= 0:
            return dict.fromkeys(("aic", "bic", "hqic", "fpe"), math.inf)
        free_params = d * r
        return {"aic": log_det + 2 / n * free_params, "bic": log_det + math.log(n) / n * free_params, "hqic": log_det + 2 * math.log(math.log(n)) / n * free_params, "fpe": ((n + r) / free) ** d * math.exp(log_det)}

    def order(self, mo: Moments) -> int:
        grid = range(max(0, self.low()), self.max_lag + 1)
        found = {p: self.criteria(mo, p) for p in grid}
        best = [min(grid, key=lambda p: (found[p][name], p)) for name in ("aic", "bic", "hqic", "fpe")]
        return max(best) if self.maximum else min(best)

    def select(self, mo, targets):
        return np.full((mo.d, mo.d), self.order(mo), np.int64)


def segment_moments(panel: Panel, longest: int, chunk: int | None = None):
    """Per segment: products of lags 0..longest of all variables (from row longest + 1 on), and the first rows; two small tables."""
    d = len(panel.variables)
    rows = lagging.lag_features(panel, [0] * d, [longest] * d, (), chunk)
    names = [n for n, _, _ in lagging.lag_columns([0] * d, [longest] * d, panel.variables)]
    return G.partial_grams(rows, names, [SEGMENT]), first_rows(panel, longest, chunk), len(names)


def first_rows(panel: Panel, longest: int, chunk: int | None = None) -> DataFrame:
    """segment_id, __rn = 1, 2, .. and x, the variables, of the first `longest` rows of each segment."""
    df, w = lagging.chunked(panel, longest, chunk)
    head = df.withColumn("__full", lagging.has_history(longest, w)).where("__own AND NOT __full")
    return head.select(SEGMENT, F.row_number().over(Window.partitionBy(SEGMENT).orderBy(TIME)).alias("__rn"), F.array(*panel.variables).alias("x"))  # `longest` rows a segment


def lag_matrix(panel: Panel, selector, targets: Sequence[int], chunk: int | None = None) -> np.ndarray:
    """The longest lag of each (target, predictor) over all segments, 0 for rows that aren't targets."""
    d, top = len(panel.variables), selector.max_lag
    schema = "target int, predictor int, lag int"

    def table(m: np.ndarray) -> pd.DataFrame:
        i, j = np.indices(m.shape)
        return pd.DataFrame({"target": i.ravel(), "predictor": j.ravel(), "lag": m.ravel()}).astype("int32")

    if isinstance(selector, CVLagSelector):
        found = _by_folds(panel, selector, targets, chunk, table)
    else:
        sums, head, k = segment_moments(panel, top, chunk)
        cells = sums.groupBy(SEGMENT).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("cells"))  # a fixed number of cells
        heads = head.groupBy(SEGMENT).agg(F.sort_array(F.collect_list(F.struct("__rn", "x"))).alias("head"))  # `longest` rows

        def by_products(batches):
            for pdf in batches:
                for cell, first in zip(pdf["cells"], pdf["head"], strict=True):
                    m = G.from_upper(np.array([c["value"] for c in cell]), k)
                    rows = np.array([list(h["x"]) for h in first]).reshape(-1, d)
                    yield table(selector.select(Moments(m, rows, d, top, selector.center), targets))

        found = cells.join(heads, SEGMENT).mapInPandas(by_products, schema)
    out = np.zeros((d, d), np.int64)
    for r in found.groupBy("target", "predictor").agg(F.max("lag").alias("lag")).collect():
        out[r["target"], r["predictor"]] = r["lag"]
    return out


def fold_table(cut: Chunks, longest: int, folds: int, centre: bool) -> DataFrame:
    """segment_id, n, regions (products by fold) and rows (around the folds' borders): what FoldMoments needs, a row a segment, in one pass."""
    d = len(cut.names)
    upper = np.triu_indices(d * (longest + 1) + 1)
    names = [SEGMENT, "region", "upper", "rows"]

    def products(segment, _, x, own, first, known) -> pd.DataFrame:
        plan, x, out = Folds(int(known["n"]), longest, folds), centred(x, known, centre), []
        for r in range(folds):
            a, b = max(plan.regions[r] - first, own), min(plan.regions[r + 1] - first, len(x))
            if a < b:
                z = np.column_stack([np.ones(b - a), *(x[a - k : b - k, j] for j in range(d) for k in range(longest + 1))])
                out.append((segment, r, (z.T @ z)[upper].tolist(), []))
        at = sorted({t for a, b in plan.windows for t in range(max(a, first + own), min(b, first + len(x)))})
        if at:
            out.append((segment, -1, [], [{"t": t, "x": x[t - first].tolist()} for t in at]))
        return pd.DataFrame(out, columns=names) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in names})

    parts = shared.saved(cut.over_chunks(products, longest, f"{SEGMENT} {cut.kind}, region int, upper array<double>, rows array<struct<t: long, x: array<double>>>"))
    sums = cut.summed(parts.where("region >= 0"), ["region"], "upper").groupBy(SEGMENT).agg(F.collect_list(F.struct("region", "upper")).alias("regions"))  # one a fold
    some = parts.where("region < 0").groupBy(SEGMENT).agg(F.flatten(F.collect_list("rows")).alias("rows"))  # a few for each fold
    return cut.facts.select(SEGMENT, "n").join(sums, SEGMENT, "left").join(some, SEGMENT, "left")


def centred(x: np.ndarray, known, centre: bool) -> np.ndarray:
    return x - np.array([known[f"m{i}"] for i in range(x.shape[1])]) if centre else x


def fold_moments(row, d: int, longest: int, folds: int) -> FoldMoments:
    """From a row of `fold_table`."""
    regions = {c["region"]: np.asarray(c["upper"]) for c in (() if row.regions is None else row.regions)}
    return FoldMoments(int(row.n), d, longest, folds, regions, {c["t"]: np.asarray(c["x"]) for c in (() if row.rows is None else row.rows)})


def _by_folds(panel: Panel, selector: CVLagSelector, targets: Sequence[int], chunk: int | None, table) -> DataFrame:
    """Rows (target, predictor, lag) by cross-validation.

    One pass gives products by fold, from which squared errors follow. For absolute errors, a round of the search fits all candidates
    that it can name on the products, and one pass over the rows scores them; rounds go on until no segment waits for scores.
    """
    d, longest, folds, centre = len(panel.variables), selector.max_lag, selector.folds(), selector.center
    cut = Chunks(panel, panel.variables, chunk)
    kind = f"{SEGMENT} {cut.kind}"
    base = shared.saved(fold_table(cut, longest, folds, centre))
    known = base.select(SEGMENT, F.array().cast("array<struct<key: string, score: double>>").alias("known"))

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mo = fold_moments(r, d, longest, folds)
                mo.known = {_key(c["key"]): c["score"] for c in r.known}
                lags = selector.select(mo, targets)
                waiting = [{"key": json.dumps(k), "models": [{"begin": a, "end": b, "w": w.tolist()} for a, b, w in mo.models(k)]} for k in dict.fromkeys(mo.pending)]
                yield pd.DataFrame({SEGMENT: [r[0]], "lags": [None if waiting else lags.ravel().tolist()], "waiting": [waiting]})

    schema = f"{kind}, lags array<int>, waiting array<struct<key: string, models: array<struct<begin: long, end: long, w: array<double>>>>>"
    while True:
        found = base.join(known, SEGMENT).mapInPandas(search, schema)
        if selector.cv_metric == "mae":
            found = shared.saved(found)
            waiting = found.where(F.size("waiting") > 0)
            if not waiting.isEmpty():
                errors = _absolute_errors(cut, cut.facts.join(waiting.select(SEGMENT, "waiting"), SEGMENT), longest, centre)
                known = shared.saved(known.join(errors, SEGMENT, "left").select(SEGMENT, F.concat("known", F.coalesce("new", F.array().cast("array<struct<key: string, score: double>>"))).alias("known")))
                continue
        break

    def tables(batches):
        for pdf in batches:
            for lags in pdf["lags"]:
                yield table(np.asarray(lags).reshape(d, d))

    return found.select("lags").mapInPandas(tables, "target int, predictor int, lag int")


def _key(text: str) -> tuple:
    target, *pairs = json.loads(text)
    return (target, *map(tuple, pairs))


def _absolute_errors(cut: Chunks, facts: DataFrame, longest: int, centre: bool) -> DataFrame:
    """segment_id, new (key, score): mean absolute errors of the waiting candidates' models, from one pass."""

    def one(segment, _, x, own, first, known) -> pd.DataFrame:
        x, out = centred(x, known, centre), []
        for c in known["waiting"]:
            target, *pairs = _key(c["key"])
            for f, model in enumerate(c["models"]):
                a, b = max(model["begin"] - first, own), min(model["end"] - first, len(x))
                if a < b:
                    z = np.column_stack([np.ones(b - a), *(x[a - k : b - k, j] for j, k in pairs)])
                    out.append((segment, c["key"], f, model["end"] - model["begin"], float(np.abs(x[a:b, target] - z @ np.asarray(model["w"])).sum())))
        return pd.DataFrame(out, columns=[SEGMENT, "key", "fold", "n", "error"])

    sums = cut.over_chunks(one, longest, f"{SEGMENT} {cut.kind}, key string, fold int, n long, error double", facts)
    means = sums.groupBy(SEGMENT, "key", "fold").agg((F.sum("error") / F.first("n")).alias("e")).groupBy(SEGMENT, "key").agg(F.avg("e").alias("score"))
    return means.groupBy(SEGMENT).agg(F.collect_list(F.struct("key", "score")).alias("new"))  # the candidates of a round


def select_layout(panel: Panel, config: L.LagConfiguration, selector, effects: Sequence[str] | None = None, chunk: int | None = None) -> L.Layout:
    """A layout from a selector (its max_lag and min_lag follow the configuration as the engine's contract says), then overrides."""
    if selector is None:
        return L.fixed(panel.variables, config)
    if selector.max_lag is None:
        selector.max_lag = config.max_lag
    if selector.max_lag is None:
        warnings.warn("no max_lag; 10 is used", stacklevel=2)
        selector.max_lag = 10
    selector.min_lag = 0 if config.use_lag_zero else 1
    if selector.max_lag < selector.min_lag:
        raise LagSelectionError("max_lag is below the smallest lag")
    targets = list(selector.target_indices) if selector.target_indices is not None else [panel.variables.index(e) for e in effects or panel.variables]
    matrix = lag_matrix(panel, selector, targets, chunk)
    return L.overridden(L.from_matrix(panel.variables, matrix, selector.min_lag), config)
