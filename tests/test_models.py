import json

import numpy as np
import pandas as pd
import pytest

from tributary import api, errors
from tributary.operators.stationarity import StationarityTransformer
from tributary.plans import config, engine, layout, runner, solvers
from tributary.sources import panel as P

NAMES = list("abc")


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(8)
    f = pd.DataFrame(rng.normal(size=(90, 3)), columns=NAMES)
    f.loc[1:, "b"] += 0.7 * f["a"].shift(1)[1:]
    return engine.prepare(P.from_frames(spark, f), NAMES, layout.LagConfiguration(max_lag=2), transformer=StationarityTransformer(max_order=0))


class Coordinates(solvers.LinearModel):
    """Coordinate descent: each weight in turn takes its best value."""

    epochs, tol, order = 300, 1e-13, "up"

    def step(self, w, lr, epoch):
        w = w.copy()
        for k in range(w.shape[1]) if self.order == "up" else reversed(range(w.shape[1])):
            rest = self.problem.xy[k] - w @ self.problem.xx[k] + w[:, k] * self.problem.xx[k, k]
            w[:, k] = rest / self.problem.xx[k, k] * self.mask[:, k]
        return w


@pytest.fixture
def registry():
    before = dict(solvers.BACKENDS)
    yield
    solvers.BACKENDS.clear()
    solvers.BACKENDS.update(before)


def test_a_model_of_ones_own_runs_through_fit_and_reference_fits(prepared, registry):
    api.register_solver("Coordinates", Coordinates, aliases=["cd"])
    want = engine.MultiTaskCausality().fit(prepared_data=prepared)
    for backend, extra in (("cd", {}), (Coordinates, {"order": "down", "epochs": 400})):
        log = solvers.History()
        got = engine.MultiTaskCausality(backend).fit(prepared_data=prepared, model_config=extra, callbacks=[log])
        for run in ("base", *NAMES):
            assert np.allclose(got.weights[run], want.weights[run], atol=1e-5)
        assert {r[0] for r in log.rows} == {"base", *(f"without_{c}" for c in NAMES)}
        for a, b in zip(got.table.orderBy("effect", "cause").collect(), want.table.orderBy("effect", "cause").collect(), strict=True):
            assert a["p_value"] == pytest.approx(b["p_value"], abs=1e-5)
    with pytest.raises(errors.BackendCompatibilityError):
        engine.MultiTaskCausality("cd").fit(prepared_data=prepared, model_config={"nope": 1})


def test_a_model_runs_through_the_sweep(spark, tmp_path, registry):
    api.register_solver("coordinates", Coordinates)
    rng = np.random.default_rng(0)
    pd.DataFrame(rng.normal(size=(60, 2)), columns=["x", "y"]).to_csv(tmp_path / "data.csv", index_label="t")
    (tmp_path / "truth.csv").write_text("effect,x,y\nx,1,0\ny,1,1\n")
    group = {"base_config": {"backend": "coordinates", "lag_config": {"max_lag": 1}, "stationarity_transformer": {"max_order": 0}}, "sweep": {"param_names": ["backend", "model_config.epochs"], "cases": [["coordinates", 50], ["sklearn", 50], ["coordinates", 60]]}}
    (tmp_path / "group.json").write_text(json.dumps(group))
    (tmp_path / "run.json").write_text(json.dumps({"output_dir": "out", "ground_truth_path": "truth.csv", "group_config_path": "group.json", "threshold": 0.4, "data": {"csv_paths": ["data.csv"], "order_col": "t"}}))
    with pytest.warns(UserWarning):
        rows = runner.run(spark, str(tmp_path / "run.json"))
    assert [r["status"] for r in rows] == ["OK"] * 3 and len({r["tp"] for r in rows}) == 1 and rows[0]["backend"] == "coordinates"


def test_steps_that_go_wrong(prepared):
    class Shape(solvers.LinearModel):
        def step(self, w, lr, epoch):
            return w[:1]

    class Infinite(solvers.LinearModel):
        def step(self, w, lr, epoch):
            return w + np.inf

    for model, error in ((Shape, errors.TrainingError), (Infinite, errors.ConvergenceError)):
        with pytest.raises(error):
            engine.MultiTaskCausality(model).fit(prepared_data=prepared)


def test_availability_and_preference(registry):
    assert solvers.solver(None)[0] == "newton" and solvers.available_solvers() == ["newton", "adam"]
    solvers.register_solver("later", Coordinates, available=lambda: False)
    assert "later" not in solvers.available_solvers()
    with pytest.raises(errors.BackendNotAvailableError):
        solvers.solver("later")
    solvers.BACKENDS["newton"].available = lambda: False
    try:
        assert solvers.solver(None)[0] == "adam"
        with pytest.raises(errors.BackendNotAvailableError):
            solvers.solver("sklearn")
    finally:
        solvers.BACKENDS["newton"].available = lambda: True
    for name, what, error in (("x", 3, errors.BackendCompatibilityError), ("x", dict, errors.BackendCompatibilityError), ("torch", Coordinates, errors.BackendSelectionError), ("mine", Coordinates, None)):
        if error is None:
            solvers.register_solver(name, what)
            solvers.register_solver(name, what)  # again
        else:
            with pytest.raises(error):
                solvers.register_solver(name, what)
    with pytest.raises(errors.BackendSelectionError):
        solvers.solver("nobody")


SPEC = {"type": "mask_and_min_abs_sum", "params": {"mask": [[1, 1, 0, 1, 1, 1], [1] * 6, [1] * 6], "rules": [{"output_index": 2, "feature_indices": [0, 1], "min_abs_sum": 0.8}], "eps": 1e-9}}


def test_constraint_specs(prepared):
    for where in ({"constraint": SPEC}, {"model_config": {"constraint": SPEC}}):
        r = engine.MultiTaskCausality().fit(prepared_data=prepared, relations={("a", "c"): "zero"}, **where)
        w = r.weights["base"]
        assert w[0, 2] == 0 and not w[0, 4:].any() and np.abs(w[2, :2]).sum() == pytest.approx(0.8)
        assert not r.weights["a"][:, :2].any()  # a rule on an omitted cause is no rule
        counts = {(x["effect"], x["cause"]): x["n_restrictions"] for x in r.table.collect()}
        assert counts["a", "b"] == 1 and counts["a", "c"] == 0 and counts["b", "b"] == 2
    only = solvers.constraint_of({"name": "mask", "mask": np.ones((6, 3)).tolist()}, 3, 6)
    assert only.mask.shape == (3, 6) and not only.rules
    own = engine.MultiTaskCausality().fit(prepared_data=prepared, constraint=lambda w: np.clip(w, -0.05, 0.05))
    assert np.abs(own.weights["base"]).max() <= 0.05
    one = {"output_index": 5, "feature_indices": [0]}
    for bad in ({"type": "nope"}, {"type": "mask"}, {"type": "mask", "mask": [[1]]}, {"type": "mask", "mask": [[2] * 6] * 3}, SPEC | {"rules": "x"}, SPEC | {"rules": [{}]}, SPEC | {"rules": [one]}, 3):
        with pytest.raises(errors.ConstraintError):
            solvers.constraint_of(bad, 3, 6)


def test_penalties_that_are_functions(prepared):
    base = engine.MultiTaskCausality().fit(prepared_data=prepared, regularizer=solvers.L1(0.4), tested_causes=["a"])
    for f in (lambda w: (0.4 * np.abs(w).sum(), 0.4 * np.sign(w)), lambda w: 0.4 * np.sign(w)):
        got = engine.MultiTaskCausality().fit(prepared_data=prepared, regularizer=f, tested_causes=["a"])
        assert np.allclose(got.weights["base"], base.weights["base"], atol=1e-9)
    alone = engine.MultiTaskCausality().fit(prepared_data=prepared, regularizer=lambda w: 7.0, tested_causes=["a"])
    assert alone.extras["loss"] > 7
    with pytest.raises(errors.TrainingError):
        engine.MultiTaskCausality().fit(prepared_data=prepared, regularizer=lambda w: w[0])


def test_errors_tell_apart():
    assert not issubclass(errors.LagSelectionError, errors.ConfigError) and not issubclass(errors.LagConfigurationError, errors.LagPreprocessingError)
    with pytest.raises(errors.LagConfigurationError):
        layout.fixed(NAMES, layout.LagConfiguration(max_lag=0))
    with pytest.raises(errors.RegularizerConfigurationError):
        solvers.penalty_of({"type": "l7"}, None)
    with pytest.raises(errors.ConfigError):
        config.selector({"type": "nope"}, layout.LagConfiguration())
    assert api.MissingColumnsError is errors.ColumnError and issubclass(errors.RankError, errors.TrainingError)
