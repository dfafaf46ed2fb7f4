import numpy as np
import pandas as pd
import pytest

from tributary.errors import ConfigError
from tributary.operators.stationarity import StationarityTransformer
from tributary.plans import engine, layout, robust, solvers
from tributary.sources import panel as P

NAMES = ["base", "x", "y"]  # a variable may be called like the base fit


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(5)
    f = pd.DataFrame(rng.standard_t(2, size=(150, 3)), columns=NAMES)
    f.loc[1:, "y"] += 0.8 * f["x"].shift(1)[1:]
    made = engine.prepare(P.from_frames(spark, f), ["y", "base"], layout.LagConfiguration(max_lag=1), transformer=StationarityTransformer(max_order=0))
    rows = made.scaled.toPandas()
    return made, np.column_stack([np.ones(149), rows[made.layout.names]]), rows[["y", "base"]].to_numpy()


def plain(x, y, active, loss, rounds=50):
    b = np.zeros(x.shape[1])
    at = [0, *(k + 1 for k in active)]
    w = np.ones(len(y))
    for _ in range(rounds + 1):
        b[at] = np.linalg.lstsq(x[:, at] * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        w = loss.weights(y - x @ b)
    return b


@pytest.mark.parametrize("spec", ["huber", {"type": "huber", "delta": 0.3}, "mae"])
def test_a_table_of_robust_fits(prepared, spec):
    made, x, y = prepared
    r = engine.MultiTaskCausality().fit(prepared_data=made, model_config={"loss": spec, "max_iter": 12, "tol": 1e-13})
    loss = robust.Loss.of(spec)
    rss = {}
    for run, active in {"all": [0, 1, 2], "base": [1, 2], "x": [0, 2], "y": [0, 1]}.items():
        for i, e in enumerate(("y", "base")):
            b = plain(x, y[:, i], active, loss, 12)
            rss[run, e] = float(((y[:, i] - x @ b) ** 2).sum())
            if run in ("x", "y"):
                assert np.allclose(r.weights[run][i], b[1:], atol=1e-4)
    for row in r.table.collect():
        e0, e1 = rss["all", row["effect"]], rss[row["cause"], row["effect"]]
        assert row["base_error"] == pytest.approx(e0 / 298, rel=1e-4) and row["ref_error"] == pytest.approx(e1 / 298, rel=1e-4)
        assert row["n_restrictions"] == 1 and row["residual_df"] == 145
    assert 0 < r.extras["epochs"] <= 12 and r.extras["loss"] > 0
    p = {(row["effect"], row["cause"]): row["p_value"] for row in r.table.collect()}
    assert p["y", "x"] < 0.01


def test_loss_is_minimal(prepared):
    """No small change of the weights lowers a convex loss."""
    made, x, y = prepared
    rng = np.random.default_rng(1)
    for spec in ("huber", "mae"):
        r = engine.MultiTaskCausality().fit(prepared_data=made, tested_causes=["x"], model_config={"loss": spec, "max_iter": 60 if spec == "mae" else 25, "tol": 1e-9})
        b = np.column_stack([r.extras["intercept"], r.weights["base"]])
        loss = robust.Loss.of(spec)
        for i in range(2):
            best = loss.values(y[:, i] - x @ b[i]).sum()
            assert all(loss.values(y[:, i] - x @ (b[i] + rng.normal(0, 1e-3, 4))).sum() >= best - 1e-4 for _ in range(50))


def test_rules_penalties_and_callbacks(prepared):
    made, _, _ = prepared
    log = solvers.History()
    api = engine.MultiTaskCausality("torch")
    r = api.fit(prepared_data=made, tested_causes=["x"], relations={("y", "base"): "zero", ("y", "y"): 0.9}, regularizer=0.5, callbacks=[log], model_config={"loss": "huber", "epochs": 5})
    w = r.weights["base"]
    assert w[0, 0] == 0 and abs(w[0, 2]) == pytest.approx(0.9) and not r.weights["x"][:, 1].any()
    assert {row[0] for row in log.rows} == {"base", "without_x"} and max(row[1] for row in log.rows) <= 5
    heavy = api.fit(prepared_data=made, tested_causes=["x"], regularizer=1.0, model_config={"loss": "huber", "epochs": 1})
    free = api.fit(prepared_data=made, tested_causes=["x"], model_config={"loss": "huber", "epochs": 1})
    assert 0 < heavy.weights["base"][0, 1] < free.weights["base"][0, 1]
    with pytest.warns(UserWarning, match="batch"):
        api.fit(prepared_data=made, tested_causes=["x"], model_config={"loss": "mae", "epochs": 1, "batch_size": 10})
    for bad in ("nope", {"type": "huber", "delta": 0}):
        with pytest.raises(ConfigError):
            api.fit(prepared_data=made, model_config={"loss": bad})


def test_one_pass_serves_all_cells(prepared, monkeypatch):
    """Base and reference fits of all effects share a round's pass; settled cells leave it."""
    made, _, _ = prepared
    seen = []
    whole = robust.weighted

    def spy(rows, features, effects, runs, loss):
        seen.append(sum(len(run.moving) for run in runs))
        return whole(rows, features, effects, runs, loss)

    monkeypatch.setattr(robust, "weighted", spy)
    r = engine.MultiTaskCausality().fit(prepared_data=made, model_config={"loss": "huber", "tol": 1e-6})
    assert seen[0] == 8 and seen == sorted(seen, reverse=True) and seen[-1] < 8 and len(seen) < 50 and r.extras["epochs"] <= len(seen)
