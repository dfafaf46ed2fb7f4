import json
import warnings

import numpy as np
import pandas as pd
import pytest

from tributary import api
from tributary.errors import BackendError, ConfigError, ConstraintError, DataValidationError, RankError
from tributary.operators.stationarity import StationarityTransformer
from tributary.plans import config, engine, inference, layout, runner, selectors, solvers
from tributary.sources import panel as P

STILL = StationarityTransformer(max_order=0)


def dgp(n=400, seed=77):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(n)
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 0.5 * x[t - 1] - 0.4 * x[t - 2] + 0.1 * rng.standard_normal()
    return pd.DataFrame({"x": x, "y": y})


def design(f, lags):
    n = len(f) - lags
    return np.column_stack([f[c].to_numpy()[lags - k : len(f) - k] for c in f for k in range(1, lags + 1)]), f.to_numpy()[lags:], n


def test_finds_the_cause(spark):
    r = api.MultiTaskGrangerAPI().fit(dgp(), lag_config=layout.LagConfiguration(max_lag=3), stationarity_transformer=STILL)
    got = {(x["effect"], x["cause"]): x["value"] for x in r.result(0.01).collect()}
    assert got["y", "x"] == 1 and got["x", "y"] == 0
    assert {(x["effect"], x["cause"]): x["value"] for x in r.result(0.01, with_sign=True, test="lrt").collect()}["y", "x"] == 1.0
    assert [c for c in r.matrix().columns] == ["effect", "x", "y"]


def test_statistics_against_dense_fits(spark):
    f = dgp(200, 5)
    r = engine.MultiTaskCausality().fit(f, lag_config=layout.LagConfiguration(max_lag=2), stationarity_transformer=STILL)
    x, y, n = design(f, 2)
    x, y = (x - x.mean(0)) / x.std(0), (y - y.mean(0)) / y.std(0)
    one = np.ones((n, 1))

    def rss(cols, j):
        z = np.hstack([one, x[:, cols]])
        e = y[:, j] - z @ np.linalg.lstsq(z, y[:, j], rcond=None)[0]
        return e @ e, z

    for row in r.table.collect():
        j, block = ["x", "y"].index(row["effect"]), [0, 1] if row["cause"] == "x" else [2, 3]
        u, z = rss([0, 1, 2, 3], j)
        v, _ = rss([c for c in range(4) if c not in block], j)
        assert row["f_test"] == pytest.approx((v - u) / 2 / (u / (n - 5)), rel=1e-6)
        assert row["lr_test"] == pytest.approx(n * np.log(v / u), rel=1e-6)
        assert row["wald_test"] == pytest.approx(2 * row["f_test"], rel=1e-6)
        assert row["base_error"] == pytest.approx(u / n / 2, rel=1e-9) and (row["n_restrictions"], row["residual_df"]) == (2, n - 5)


def test_predictions_and_shares(spark):
    f = dgp(100, 7)
    e = engine.MultiTaskCausality(reuse_data=True)
    r = e.fit(f, effects=["y"], lag_config=layout.LagConfiguration(max_lag=2), stationarity_transformer=STILL)
    x, y, n = design(f, 2)
    z = np.hstack([np.ones((n, 1)), x])
    want = z @ np.linalg.lstsq(z, y[:, 1], rcond=None)[0]
    assert np.allclose(e.predict(r).orderBy("t").toPandas()["y_pred"], want)
    first = e.prepared
    e.fit(effects=["y"])
    assert e.prepared is first
    with pytest.raises(DataValidationError):
        e.fit(effects=["x"])


def problem(seed=0, n=50, p=8, m=2):
    rng = np.random.default_rng(seed)
    x, w = rng.standard_normal((n, p)), rng.standard_normal((m, p))
    z = np.column_stack([np.ones(n), x, x @ w.T])
    return solvers.Problem.of(z.T @ z, p), w


def test_newton_and_damping():
    pr, w = problem(417)
    full = solvers.newton(pr, np.ones((2, 8)))
    assert np.allclose(full.weights, w) and full.rss.max() < 1e-8
    slow = solvers.newton(pr, np.ones((2, 8)), learning_rate=0.01, max_iter=50, tol=-1)
    assert np.allclose(slow.weights, (1 - 0.99**50) * w)
    mask = np.ones((2, 8))
    mask[0, 2:5] = 0
    sub = solvers.newton(pr, mask)
    assert np.allclose(sub.weights, solvers.least_squares(pr, mask)) and (sub.weights[0, 2:5] == 0).all()
    assert np.allclose(solvers.newton(pr, mask, projection="projected").weights, w * mask)


def test_l1_at_full_rate_shifts_by_the_inverse():
    pr, w = problem(1)
    got = solvers.newton(pr, np.ones((2, 8)), penalty=solvers.L1(0.5), tol=-1, max_iter=30).weights
    assert np.allclose(got, w - 0.5 * np.sign(w) @ np.linalg.inv(pr.xx), atol=1e-6)


def test_adam_comes_close():
    pr, w = problem(2)
    got = solvers.adam(pr, np.ones((2, 8)), learning_rate=0.05, epochs=800)
    assert np.abs(got.weights - w).max() < 0.01


def test_penalties():
    w = np.array([[1.0, -2], [0, 3]])
    assert solvers.L1(0.5).penalty(w) == 3.0 and (solvers.L1(0.5).gradient(w) == 0.5 * np.sign(w)).all()
    p = solvers.LagL1(1.0, 4, [3, 3], [100, 200, 1, 2, 3])
    assert p.weights.tolist() == [200, 1, 2, 200, 1, 2]
    with pytest.raises(ConfigError):
        solvers.LagL1(1.0, 9, [9], [1, 2])


def test_constraints():
    c = solvers.Constraint(np.array([[0, 0, 0, 1, 1, 1.0]]), [(0, [3, 4, 5], 1.5)])
    out = c(np.zeros((1, 6)))
    assert (out[0, :3] == 0).all() and np.abs(out[0, 3:]).sum() >= 1.5
    with pytest.raises(ConstraintError):
        solvers.Constraint(np.ones((1, 2)), [(0, [0], 1), (0, [0, 1], 1)])
    lay = layout.fixed(("a", "b"), layout.LagConfiguration(2))
    made = solvers.constraint({("a", "b"): "zero", ("b", "a"): {"min_abs_sum": 2}}, lay, ["a", "b"])
    assert made.mask.tolist() == [[1, 1, 0, 0], [1, 1, 1, 1]] and made.rules == [(1, [0, 1], 2.0)]
    for bad in (-1, [1], True):
        with pytest.raises(ConstraintError):
            solvers.relation(bad)
    with pytest.raises(ConstraintError):
        solvers.constraint({("q", "b"): 0}, lay, ["a", "b"])


def test_callbacks():
    pr, _ = problem(3)
    log = solvers.History()
    fit = solvers.adam(pr, np.ones((2, 8)), epochs=500, callbacks=[solvers.EarlyStopping(patience=3, min_delta=1e9), log])
    assert fit.epochs == 4 and len(log.rows) == 4
    state = {"lr": 1.0, "loss": 1.0}
    r = solvers.ReduceLR(patience=2)
    for e in range(4):
        r.on_epoch_end(e, state)
    assert state["lr"] == 0.5
    assert [type(c).__name__ for c in solvers.callbacks_of(["reduce_lr_on_plateau", {"type": "convergence_check", "tol": 0.1}])] == ["ReduceLR", "ConvergenceCheck"]
    with pytest.raises(ConfigError):
        solvers.callbacks_of(["nope"])


def test_initial_weights_and_names():
    pr, w = problem(4)
    mask = np.ones((2, 8))
    assert np.allclose(solvers.initial("ols", pr, mask), w) and not solvers.initial(None, pr, mask).any()
    assert np.allclose(solvers.initial("random_normal", pr, mask, 1), solvers.initial("normal", pr, mask, 1))
    assert solvers.solver("sklearn")[0] == "newton" and solvers.solver("torch")[0] == "adam"
    with pytest.raises(BackendError):
        solvers.solver("nope")
    with pytest.warns(UserWarning):
        assert solvers.settings("newton", {"epochs": 7}) == {"max_iter": 7}


def test_rank_deficiency():
    x = np.ones((20, 2)) * np.arange(20)[:, None]
    z = np.column_stack([np.ones(20), x, np.arange(20) % 3])
    pr = solvers.Problem.of(z.T @ z, 2)
    with pytest.raises(RankError):
        inference.covariances(pr, np.ones((1, 2)), np.ones(1))
    assert inference.covariances(pr, np.ones((1, 2)), np.ones(1), strict=False) == [None]


def direct_ic(x, i, pairs, bic):
    pairs = [(j, k) for j, k in pairs if k > 0]
    m = max(k for _, k in pairs)
    y = x[m:, i]
    z = np.column_stack([np.ones(len(y)), *(x[m - k : len(x) - k, j] for j, k in pairs)])
    r = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    n, k = len(y), z.shape[1]
    return (k * np.log(n) if bic else 2 * k) + n * np.log(r @ r / n)


def test_ic_selection_equals_direct_fits(spark):
    rng = np.random.default_rng(42)
    f = pd.DataFrame(rng.standard_normal((150, 3)), columns=["y1", "x1", "x2"])
    f["y1"] += 0.8 * f["x1"].shift(2, fill_value=0)
    p = P.from_frames(spark, [f, f.iloc[::-1].reset_index(drop=True)])
    s = selectors.ICLagSelector(max_lag=4, min_lag=1)
    sums, head, k = selectors.segment_moments(p, 4)
    cells = {(r["segment_id"], r["i"]): r["value"] for r in sums.collect()}
    m = np.zeros((k + 1) * (k + 2) // 2)
    for (seg, i), v in cells.items():
        if seg == 0:
            m[i] = v
    from tributary.operators.gram import from_upper

    rows = np.array([r["x"] for r in head.where("segment_id = 0").orderBy("__rn").collect()])
    mo = selectors.Moments(from_upper(m, k), rows, 3, 4)
    x = (f - f.mean()).to_numpy()
    for pairs in ([(0, 1)], [(0, 2), (1, 3)], [(0, 4), (1, 1), (2, 2)]):
        assert s.score(mo, 0, pairs) == pytest.approx(direct_ic(x, 0, pairs, False), rel=1e-8)
    matrix = selectors.lag_matrix(p, s, [0])
    assert matrix[0, 1] == 2 and not matrix[1:].any()
    loose = selectors.lag_matrix(p, selectors.ICLagSelector(max_lag=4, min_lag=1, prune_lags=False, delta_min_ic=None), [0, 1, 2])
    strict = selectors.lag_matrix(p, selectors.ICLagSelector(max_lag=4, min_lag=1, prune_lags=False, delta_min_ic=50.0), [0, 1, 2])
    off = ~np.eye(3, dtype=bool)
    assert (strict[off] <= loose[off]).all()
    cv = selectors.lag_matrix(P.from_frames(spark, f), selectors.CVLagSelector(max_lag=4, min_lag=1, cv_metric="mae"), [0])
    assert cv[0, 1] == 2
    var = selectors.lag_matrix(p, selectors.VARLagSelector(max_lag=4), [0])
    assert (var == var[0, 0]).all() and 1 <= var[0, 0] <= 4


def test_pairwise(spark):
    f = dgp(200, 11)
    r = api.SimpleGrangerAPI().fit(f, test="ssr_ftest", lag=2, stationarity_transformer=STILL)
    got = {(x["effect"], x["cause"]): x for x in r.table.collect()}
    assert got["y", "x"]["p_value"] < 1e-6 and got["x", "y"]["p_value"] > 0.001 and got["x", "x"]["p_value"] == 1
    assert dict(((e, c), s) for e, c, s in r.extras["signed"])["y", "x"] == 1.0
    with pytest.raises(ValueError):
        api.SimpleGrangerAPI().fit(f, lag=0)
    assert api.SimpleGrangerAPI().fit(f, lag_max=3, stationarity_transformer=STILL).extras["lag"] == 2


def test_config_and_builder(tmp_path, spark):
    cfg = config.normalised({"backend": {"type": "sklearn", "params": {"max_iter": 5}}, "lag_config": {"max_lag": 4, "use_lag_zero": True}, "lag_selector": "bic", "relations": {"y->x": 0.1, "y|z": "zero"}, "causes": "x", "device": "cuda:0"})
    assert cfg["backend"] == "sklearn" and cfg["model_config"] == {"max_iter": 5, "device": "cuda:0"}
    assert cfg["lag_selector"].use_bic and cfg["lag_selector"].max_lag == 4 and cfg["relations"] == {("y", "x"): 0.1, ("y", "z"): "zero"} and cfg["causes"] == ["x"]
    (tmp_path / "rel.json").write_text(json.dumps([{"effect": "y", "cause": "x", "min_abs_sum": 0.05}, {"output": "y", "input": "z", "zero": True}]))
    assert config.relations({"path": "rel.json"}, str(tmp_path)) == {("y", "x"): 0.05, ("y", "z"): None}
    for bad in ({"device": "tpu"}, {"lag_selector": "nope"}, {"relations": {"yx": 1}}, {"lag_config": {"q": 1}}):
        with pytest.raises(ConfigError):
            config.normalised(bad)
    got = list(config.cases({"backend": "torch", "base_config": {"backend": "sklearn"}, "sweep": {"param_names": ["model_config.lr"], "cases": [[0.1], [0.2]]}}))
    assert [c["model_config"]["lr"] for c, _ in got] == [0.1, 0.2] and got[0][0]["backend"] == "sklearn"
    with pytest.raises(ConfigError):
        list(config.cases({"sweep": {"param_names": ["a"], "cases": [[1, 2]]}}))
    b = api.MultiTaskGrangerBuilder().backend("sklearn", max_iter=3).variables([], "y", None).lag({"max_lag": 2}).scaling("minmax").data(dgp(80)).stationarity(STILL)
    assert b.cfg["causes"] is None and b.cfg["effects"] == ["y"] and b.cfg["model_config"] == {"max_iter": 3}
    assert {r["effect"] for r in b.fit().table.collect()} == {"y"}
    (tmp_path / "one.yaml").write_text("backend: newton\nlag_config:\n  max_lag: 1\n")
    assert api.AnalysisBuilder().from_file(str(tmp_path / "one.yaml")).data(dgp(60)).stationarity(STILL).run().table.count() == 4


def test_search(spark):
    r = engine.MultiTaskCausality().fit(dgp(100), lag_config=layout.LagConfiguration(2), stationarity_transformer=STILL, hiperoptimalization_state=True, hiperoptimalization_conf={"param_grid": {"learning_rate": [0.01, 1.0]}})
    assert r.extras["epochs"] <= 3


def test_runner(spark, tmp_path):
    f = dgp(80).rename(columns={"x": "x1", "y": "x2"})
    f.to_csv(tmp_path / "data.csv")
    (tmp_path / "truth.csv").write_text("effect,x1,x2\nx1,1,0\nx2,1,1\n")
    (tmp_path / "group.json").write_text(json.dumps({"base_config": {"backend": "sklearn", "lag_config": {"max_lag": 1}}, "sweep": {"param_names": ["model_config.learning_rate", "lag_config.max_lag"], "cases": [[1.0, 1], [0.5, 1], [1.0, -3]]}}))
    (tmp_path / "run.json").write_text(json.dumps({"output_dir": "out", "ground_truth_path": "truth.csv", "group_config_path": "group.json", "threshold": 0.01, "data": {"csv_paths": "data.csv", "index_col": 0, "order_col": None}}))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = runner.run(spark, str(tmp_path / "run.json"), "matrices")
    assert [r["status"] for r in rows] == ["OK", "OK", "FAILED"]
    assert rows[0]["causality_file"].startswith("case_001_sklearn_model_config.learning_rate_1.0") and 0 <= rows[0]["accuracy"] <= 1
    assert len(list((tmp_path / "out").glob("*.csv"))) == 13
    again = runner.recalculate(spark, str(tmp_path / "out"), str(tmp_path / "truth.csv"), keep=True)
    assert again[0]["tp"] == rows[0]["tp"]


def test_cells_of_files_stay_as_they_are(spark, tmp_path):
    """Tracebacks have line breaks, commas and quotes; names may begin or end with spaces."""
    rows = [["1", 'File "a.py", line 1\n  raise X("\\")\n'], [" x ", "\\"], ["2", ",\"'"]]
    for path in (str(tmp_path / "here.csv"), f"file://{tmp_path}/there"):
        runner.write_rows(spark, ["case id", "trace"], rows, path)
        assert runner.read_rows(spark, path) == (["case id", "trace"], rows)


@pytest.mark.parametrize("loss", ["mse", "mae", "huber"])
def test_robust_losses(spark, loss):
    from tributary.operators import lagging
    from tributary.plans import robust

    f = dgp(120, 3)
    f.loc[::17, "y"] += 5
    lay = layout.fixed(("x", "y"), layout.LagConfiguration(2))
    w, b = robust.fit(lagging.lag_features(P.from_frames(spark, f), [1, 1], [2, 2], ["y"]), lay, ["y"], loss, delta=0.1)
    x, y, n = design(f, 2)
    z, y = np.hstack([np.ones((n, 1)), x]), y[:, 1]
    kind = {"mse": lambda r: r * r, "mae": np.abs, "huber": lambda r: np.where(np.abs(r) <= 0.1, r * r / 2, 0.1 * (np.abs(r) - 0.05))}[loss]
    best = kind(y - z @ np.array([b[0], *w[0]])).sum()
    rng = np.random.default_rng(0)
    for _ in range(200):  # a convex loss: no small step improves it
        assert kind(y - z @ (np.array([b[0], *w[0]]) + rng.standard_normal(5) * 0.02)).sum() >= best - 1e-3
    with pytest.raises(ConfigError):
        robust.fit(lagging.lag_features(P.from_frames(spark, f), [1, 1], [2, 2], ["y"]), lay, ["y"], "nope")
