import math

import numpy as np
import pandas as pd
import pytest

from tributary.errors import ConfigError
from tributary.operators.stationarity import StationarityTransformer
from tributary.plans import batches, engine, layout, solvers
from tributary.sources import panel as P

NAMES = list("abc")


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(11)
    frames = [pd.DataFrame(rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, -1], columns=NAMES) for n in (61, 47)]
    for f in frames:
        f.loc[2:, "a"] += 0.5 * f["b"].shift(1)[2:] / 5 + 0.2 * f["c"].shift(2)[2:] * 10
    made = engine.prepare(P.from_frames(spark, frames), NAMES, layout.LagConfiguration(max_lag=2), transformer=StationarityTransformer(max_order=0))
    rows = made.scaled.orderBy("segment_id", "t").toPandas()
    x, y = rows[made.layout.names].to_numpy(), rows[NAMES].to_numpy()
    return made, x - x.mean(axis=0), y - y.mean(axis=0)


def fit(prepared, key, config, **args):
    solver = engine.MultiTaskCausality(key)
    return solver.fit(prepared_data=prepared, model_config=config, **args)


def dense_newton(x, y, size, lr, rounds, l1=0.0):
    w = np.zeros((y.shape[1], x.shape[1]))
    for _ in range(rounds):
        for a in range(0, len(x), size):
            xb, yb = x[a : a + size], y[a : a + size]
            grad = (xb @ w.T - yb).T @ xb + l1 * np.sign(w)
            w = w - lr * grad @ np.linalg.pinv(xb.T @ xb + 1e-12 * np.eye(x.shape[1]), rcond=1e-13, hermitian=True)
    return w


@pytest.mark.parametrize("size", [20, 33, 1000])
def test_newton_batches_equal_dense_rounds(prepared, size):
    made, x, y = prepared
    r = fit(made, "sklearn", {"batch_size": size, "learning_rate": 0.3, "max_iter": 4, "tol": 0}, regularizer=0.05)
    assert np.allclose(r.weights["base"], dense_newton(x, y, size, 0.3, 4, 0.05), atol=1e-9)
    less = x.copy()
    less[:, made.layout.block("b")] = 0
    assert np.allclose(r.weights["b"], dense_newton(less, y, size, 0.3, 4, 0.05), atol=1e-9)  # the fit without a cause too


@pytest.mark.parametrize("steps", [1, 3])
def test_adam_batches_equal_dense_rounds(prepared, steps):
    made, x, y = prepared
    r = fit(made, "torch", {"batch_size": 16, "learning_rate": 0.01, "epochs": 6, "gradient_accumulation_steps": steps})
    w, first, second, t = np.zeros((3, 6)), 0.0, 0.0, 0
    for _ in range(6):
        held, size = np.zeros(w.shape), 0
        starts = range(0, len(x), 16)
        for a in starts:
            xb, yb = x[a : a + 16], y[a : a + 16]
            held, size = held + 2 * (xb @ w.T - yb).T @ xb / yb.size / steps, size + 1
            if size == steps or a == starts[-1]:
                t += 1
                first, second = 0.9 * first + 0.1 * held, 0.999 * second + 0.001 * held**2
                w = w - 0.01 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
                held, size = np.zeros(w.shape), 0
    assert np.allclose(r.weights["base"], w, atol=1e-10)


def test_batches_are_replayed_from_the_table(prepared, monkeypatch):
    """With no room on the driver, each epoch reads the table anew, one batch at a time."""
    made, x, y = prepared
    monkeypatch.setattr(batches, "HELD", 0)
    b = batches.Batches(made.scaled, made.columns, made.problem, 25)
    assert b.held is None
    for _ in range(2):
        got = list(b)
        assert [n for n, _, _ in got] == [25, 25, 25, 25, 4]
        assert all(np.allclose(xx, x[i * 25 : i * 25 + 25].T @ x[i * 25 : i * 25 + 25]) and np.allclose(xy, x[i * 25 : i * 25 + 25].T @ y[i * 25 : i * 25 + 25]) for i, (_, xx, xy) in enumerate(got))
    for size in (0, 2.5):
        with pytest.raises(ConfigError):
            batches.Batches(made.scaled, made.columns, made.problem, size)


def test_batches_in_a_search(prepared):
    made, _, _ = prepared
    r = fit(made, "adam", {"epochs": 30, "batch_size": 50}, hiperoptimalization_state=True, hiperoptimalization_conf={"type": "model", "sections": {"optimizer": {"learning_rate": [1e-4, 1e-2]}}})
    assert np.allclose(r.weights["base"], fit(made, "adam", {"epochs": 30, "batch_size": 50, "learning_rate": 1e-2}).weights["base"])


def dense_problem(seed=0, n=400, p=8, m=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ (2 * np.eye(p) + 0.4 * rng.normal(size=(p, p)))
    y = x @ rng.normal(size=(p, m)) + rng.normal(size=(n, m))
    z = np.column_stack([np.ones(n), x, y])
    mask = np.ones((m, p))
    mask[0, 2] = mask[2, 5:] = 0
    return solvers.Problem.of(z.T @ z, p), mask


def test_lbfgs_ends_at_least_squares():
    for seed in range(5):
        problem, mask = dense_problem(seed)
        f = solvers.adam(problem, mask, optimizer="lbfgs", learning_rate=1.0, epochs=10)
        assert np.allclose(f.weights, solvers.least_squares(problem, mask), atol=2e-6) and not f.weights[mask == 0].any()
    with pytest.raises(ConfigError):
        solvers.adam(problem, mask, optimizer="lbfgs", gradient_accumulation_steps=2)


def test_lbfgs_direction_is_newtons_after_enough_steps():
    """On a quadratic, after as many exact line searches as there are dimensions, the direction leads to the minimum."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 5))
    h, x = a @ a.T + np.eye(5), rng.normal(size=(1, 5))
    rule = solvers.LBFGS(history_size=10)
    for _ in range(5):
        g = x @ h
        d = rule.direction(g)
        step = -float((g * d).sum() / (d @ h * d).sum()) * d
        rule.pairs.append((step, (x + step) @ h - g))
        x = x + step
    assert np.abs(x).max() < 1e-8


def test_newton_schulz():
    rng = np.random.default_rng(4)
    for shape in ((3, 10), (10, 3), (4, 4)):
        m = rng.normal(size=shape)
        o = solvers.orthogonalised(m)
        s = np.linalg.svd(o, compute_uv=False)
        assert o.shape == shape and s.min() > 0.3 and s.max() < 1.3
        u, _, v = np.linalg.svd(m, full_matrices=False)
        assert (np.diag(u.T @ o @ v.T) > 0.3).all()  # along the same singular vectors
    assert not solvers.orthogonalised(np.zeros((2, 3))).any()


def test_muon_ends_at_least_squares():
    problem, _ = dense_problem(1, p=6)
    mask = np.ones((3, 6))
    slower = solvers.ReduceLR(patience=60, factor=0.5, min_lr=1e-12)
    f = solvers.adam(problem, mask, optimizer="muon", learning_rate=0.05, epochs=12000, optimizer_params={"nesterov": True}, callbacks=[slower])
    assert np.allclose(f.weights, solvers.least_squares(problem, mask), atol=1e-3)
    decayed = solvers.rule("muon", weight_decay=0.5)(np.ones((2, 2)), np.zeros((2, 2)), 0.1, 1)
    assert np.allclose(decayed, 0.95) and math.isfinite(decayed.sum())
    for spec in ({"beta3": 1}, {"history_size": 0}):
        with pytest.raises(ConfigError):
            solvers.rule("adam" if "beta3" in spec else "lbfgs", **spec)
