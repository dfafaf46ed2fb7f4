"""Solvers on products alone, without Spark."""

import numpy as np
import pytest

from tributary.errors import ConfigError, DataShapeError
from tributary.plans import solvers as S


def problem(n=300, p=4, m=2, seed=21):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p))
    y = x @ rng.standard_normal((p, m)) + 0.1 * rng.standard_normal((n, m))
    z = np.column_stack([np.ones(n), x, y])
    return S.Problem.of(z.T @ z, p)


@pytest.mark.parametrize("name, rate, more", [("sgd", 0.2, {}), ("sgd", 0.1, {"momentum": 0.8}), ("sgd", 0.1, {"momentum": 0.8, "nesterov": True}), ("adam", 0.05, {}), ("adamw", 0.05, {}), ("nadam", 0.05, {}), ("adamax", 0.05, {}), ("rmsprop", 0.01, {}), ("adagrad", 0.5, {})])
def test_every_rule_comes_to_least_squares(name, rate, more):
    pr, mask = problem(), np.ones((2, 4))
    fit = S.adam(pr, mask, learning_rate=rate, epochs=1500, optimizer=name, optimizer_params=more)
    assert np.allclose(fit.weights, S.least_squares(pr, mask), atol=0.02)


def test_first_steps_by_hand():
    w, g = np.array([[1.0, -2.0]]), np.array([[0.5, 2.0]])
    step = S.rule("sgd", momentum=0.5)
    one = step(w, g, 0.1, 1)
    assert np.allclose(one, [[0.95, -2.2]]) and np.allclose(step(one, g, 0.1, 2), one - 0.1 * 1.5 * g)
    assert np.allclose(S.rule("adam")(w, g, 0.1, 1), w - 0.1 * np.sign(g), atol=1e-6)
    assert np.allclose(S.rule("adagrad")(w, g, 0.1, 1), w - 0.1 * np.sign(g), atol=1e-6)
    assert np.allclose(S.rule("adamw", weight_decay=0.1)(w, g, 0.1, 1), w - 0.1 * np.sign(g) - 0.01 * w, atol=1e-6)
    with pytest.raises(ConfigError):
        S.rule("unheard of")


def test_settings_of_optimizers():
    out = S.settings("adam", {"optimizer": {"type": "SGD", "params": {"lr": 0.3, "momentum": 0.9}}, "epochs": 7})
    assert out == {"learning_rate": 0.3, "optimizer": "SGD", "optimizer_params": {"momentum": 0.9}, "epochs": 7}
    assert S.settings("adam", {"optimizer": "rmsprop"})["optimizer"] == "rmsprop"
    with pytest.warns(UserWarning):
        assert S.settings("newton", {"optimizer": "adam"}) == {}


def test_a_constraint_of_ones_own():
    pr = problem()
    mask = np.array([[1.0, 1, 0, 1], [1, 1, 1, 1]])
    rule = S.Also(S.Constraint(mask), lambda w: np.maximum(w, 0))
    for fit in (S.newton(pr, mask, rule, max_iter=50), S.adam(pr, mask, rule, learning_rate=0.05, epochs=500)):
        assert (fit.weights >= 0).all() and (fit.weights > 0).any() and fit.weights[0, 2] == 0


def test_weights_of_either_orientation():
    w = np.arange(6.0).reshape(2, 3)
    for given in (w, w.T, [w.T, np.zeros(2)], w.tolist()):
        assert (S.oriented(given, 2, 3) == w).all()
    with pytest.raises(DataShapeError):
        S.oriented(w, 3, 3)


def test_histograms_of_weights():
    pr = problem()
    log = S.History(every=2, edges=(-0.5, 0.0, 0.5))
    S.newton(pr, np.ones((2, 4)), callbacks=[log.clone_for_run("base")], learning_rate=0.5, max_iter=5, tol=-1)
    assert [r[1] for r in log.rows] == [1, 2, 3, 4, 5] and sorted({r[1] for r in log.histograms}) == [2, 4]
    final = S.newton(pr, np.ones((2, 4)), learning_rate=0.5, max_iter=4, tol=-1).weights
    got = {(low, high): n for _, epoch, low, high, n in log.histograms if epoch == 4}
    assert sum(got.values()) == 8 and all(n == ((final >= low) & (final < high)).sum() for (low, high), n in got.items())
    (made,) = S.callbacks_of([{"type": "tensorboard", "every": 3, "log_dir": "x"}])
    assert made.every == 3
