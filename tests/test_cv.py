import numpy as np
import pandas as pd
import pytest

from tributary.plans import selectors as S
from tributary.sources import panel as P


class Rows:
    """A segment as an array, and the errors as they read: what products by fold are held against."""

    def __init__(self, x, selector):
        self.x, self.d, self.total = x - x.mean(axis=0) if selector.center else x, x.shape[1], len(x)


class Plain(S.CVLagSelector):
    def scores(self, mo, target, candidates):
        return [self.one(mo, target, [(j, k) for j, k in pairs if k > 0]) for pairs in candidates]

    def one(self, mo, target, pairs):
        x, m = mo.x, max((k for _, k in pairs), default=0)
        y = x[m:, target]
        n = len(y)
        loss = (lambda r: float(np.abs(r).mean())) if self.cv_metric == "mae" else (lambda r: float((r * r).mean()))
        if not pairs:
            return loss(y - y.mean())
        z = np.column_stack([np.ones(n), *(x[m - k : len(x) - k, j] for j, k in pairs)])
        folds = max(2, self.cv_folds)
        size = n // folds
        if size < 1:
            r = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
            k = len(pairs) + 1
            return (k * np.log(n) if self.use_bic else 2 * k) + n * np.log(max(float(r @ r) / n, 1e-12))
        errors = []
        for f in range(1, folds):
            a, b = f * size, n if f == folds - 1 else (f + 1) * size
            beta = np.linalg.lstsq(z[:a], y[:a], rcond=None)[0]
            errors.append(loss(y[a:b] - z[a:b] @ beta))
        return float(np.mean(errors))


def data(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + [5, -100, 0.1]
    for t in range(3, n):
        x[t, 0] += 0.7 * x[t - 2, 1] / 10 + 0.3 * (x[t - 1, 0] - 5)
        x[t, 2] += 0.5 * x[t - 3, 0]
    return pd.DataFrame(x, columns=list("abc"))


def plain_lags(frames, **args):
    out = []
    for f in frames:
        s = Plain(**args)
        out.append(s.select(Rows(f.to_numpy(), s), range(3)))
    return np.max(out, axis=0)


@pytest.mark.parametrize("args", [{}, {"cv_metric": "mae"}, {"prune_lags": True, "delta_prune_rel_cv": 0.05}, {"cv_metric": "mae", "prune_lags": True, "cv_folds": 3}, {"use_lag_zero": True, "prune_lags": True, "delta_min_rel_cv": 0.01, "center": False}])
def test_folds_equal_rows(spark, args):
    frames = [data(1, 60), data(2, 83), data(3, 47)]
    args = {"max_lag": 4} | args
    want = plain_lags(frames, **args)
    for chunk in (None, 13):
        got = S.lag_matrix(P.from_frames(spark, frames), S.CVLagSelector(**args), range(3), chunk)
        assert (got == want).all(), (got, want)
    one = S.lag_matrix(P.from_frames(spark, frames[:1]), S.CVLagSelector(**args), [1])
    assert (one[1] == plain_lags(frames[:1], **args)[1]).all() and not one[[0, 2]].any()


@pytest.mark.parametrize("n", [9, 12, 14, 23])
def test_short_segments(spark, n):
    """Folds of no, one or a few rows, some of them within the longest lag."""
    frames = [data(n, n)]
    for metric in ("mse", "mae"):
        args = {"max_lag": 3, "cv_metric": metric, "cv_folds": 10 if n < 14 else 4}
        selector = S.CVLagSelector(**args)
        got = S.lag_matrix(P.from_frames(spark, frames), selector, range(3))
        plain = Plain(**args)
        rows = Rows(frames[0].to_numpy(), plain)
        # scores of dependent columns may tie, so what counts is the score of the lags taken
        for i in range(3):
            mine, other = (plain.one(rows, i, [(j, int(lags[j])) for j in range(3) if lags[j] > 0]) for lags in (got[i], plain.target(rows, i)))
            assert mine == pytest.approx(other, rel=1e-6, abs=1e-9) or (got[i] == plain.target(rows, i)).all()


def test_fold_products(spark):
    """Each fold's products equal those of its rows, for all lags and folds."""
    x, longest, folds = data(5, 57).to_numpy(), 5, 4
    plan = S.Folds(57, longest, folds)
    from tributary.operators import gram as G

    regions = {}
    for r in range(folds):
        rows = [np.array([1.0, *(x[t - k, j] for j in range(3) for k in range(longest + 1))]) for t in range(plan.regions[r], plan.regions[r + 1])]
        m = np.array(rows).reshape(-1, 19)
        regions[r] = (m.T @ m)[np.triu_indices(19)]
    held = {t: x[t] for a, b in plan.windows for t in range(a, b)}
    assert len(held) < 57
    mo = S.FoldMoments(57, 3, longest, folds, regions, held)
    for pairs in ([(0, 1)], [(0, 5), (2, 1)], [(1, 3), (0, 2)]):
        m = max(k for _, k in pairs)
        for f in range(1, folds + 1):
            end = 57 if f == folds else m + f * ((57 - m) // folds)
            z = np.array([[1.0, *(x[t - k, j] for j, k in pairs), x[t, 1]] for t in range(m, end)])
            assert np.allclose(mo.products(pairs, 1, m, f), z.T @ z)
    assert G.from_upper(regions[0], 18).shape == (19, 19)
