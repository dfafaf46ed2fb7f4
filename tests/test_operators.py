import math

import numpy as np
import pandas as pd
import pytest

from tributary.errors import ColumnError, ConfigError, DataValidationError, EmptyDataError, LagConfigurationError, NotFittedError, SchemaMismatchError
from tributary.operators import gram as G
from tributary.operators import lagging, metrics, scaling
from tributary.operators.stationarity import StationarityTransformer
from tributary.sources import panel as P
from tributary.streaming.gram_stream import GramStream


def frames(rng, n=60, segments=2, names=("a", "b")):
    return [pd.DataFrame(rng.standard_normal((n, len(names))), columns=list(names)) for _ in range(segments)]


def test_differences(spark):
    p = P.from_frames(spark, pd.DataFrame({"x": [1.0, 4, 9, 16]}))
    rows = lambda d: [r["x"] for r in lagging.difference(p, d, dropna=False).df.orderBy("t").collect()]
    assert rows(1) == [None, 3, 5, 7] and rows(2) == [None, None, 2, 2]
    assert lagging.difference(p, 2).df.count() == 2 and lagging.difference(p, {"x": 0}).df.count() == 4


def test_lags_stay_in_segments_and_chunks_agree(spark):
    f = frames(np.random.default_rng(0))
    p = P.from_frames(spark, f)
    plain = lagging.lag_features(p, [0, 1], [2, 3], ["a"]).orderBy("segment_id", "t").toPandas()
    want = []
    for x in f:
        for t in range(3, len(x)):
            want.append([x.a[t], x.a[t], x.a[t - 1], x.a[t - 2], x.b[t - 1], x.b[t - 2], x.b[t - 3]])
    assert np.allclose(plain.drop(columns=["segment_id", "t"]).to_numpy(), want)
    cut = lagging.lag_features(P.dense_time(p), [0, 1], [2, 3], ["a"], chunk=7).orderBy("segment_id", "t").toPandas()
    assert np.allclose(plain.to_numpy(float), cut.to_numpy(float))
    with pytest.raises(LagConfigurationError):
        lagging.lag_features(p, [2, 1], [1, 1])
    with pytest.raises(LagConfigurationError):
        lagging.lag_features(p, [1, 1], [9, 1], chunk=9)


def test_dense_time(spark):
    df = spark.createDataFrame([(s, 10 * k + s, float(k)) for s in range(3) for k in range(50)], "segment_id int, t long, x double").repartition(7)
    out = P.dense_time(P.Panel(df, ("x",))).df.orderBy("segment_id", "t").toPandas()
    assert (out.t == out.x).all() and len(out) == 150


@pytest.mark.parametrize("kind", sorted(scaling.SCALERS))
def test_scalers(spark, kind):
    rng = np.random.default_rng(1)
    f = pd.DataFrame(rng.standard_normal((41, 2)) * 3 + 5, columns=["a", "b"]).assign(c=2.0)
    df = P.from_frames(spark, f).df
    s = scaling.scaler(kind)
    with pytest.raises(NotFittedError):
        s.transform(df)
    s.fit(df, ["a", "b", "c"])
    x = f.to_numpy()
    q = np.percentile(x, [25, 50, 75], axis=0)
    centre, scale = {"standard": (x.mean(0), x.std(0)), "zscore": (x.mean(0), x.std(0)), "minmax": (x.min(0), np.ptp(x, axis=0)), "robust": (q[1], q[2] - q[0]), "maxabs": (0, np.abs(x).max(0))}.get(kind, (0, np.ones(3)))
    scale = np.where(np.abs(scale) > 1e-12, scale, 1)
    got = s.transform(df).orderBy("t").select("a", "b", "c").toPandas().to_numpy()
    assert np.allclose(got, (x - centre) / scale)
    back = s.inverse_transform(s.transform(df)).orderBy("t").select("a", "b", "c").toPandas().to_numpy()
    assert np.allclose(back, x)
    a, b = s.affine()
    assert np.allclose(got, x * a + b)


def test_scaler_errors():
    with pytest.raises(ConfigError):
        scaling.scaler("nope")
    with pytest.raises(ConfigError):
        scaling.MinMax((1, 1))


def test_grams_agree(spark):
    rng = np.random.default_rng(2)
    names = [f"v{i}" for i in range(15)]
    f = pd.DataFrame(rng.standard_normal((200, 15)), columns=names)
    df = P.from_frames(spark, f).df.repartition(5)
    z = np.column_stack([np.ones(200), f.to_numpy()])
    wide, few = G.gram(df, names), G.gram(df, names[:4])
    assert np.allclose(wide.matrix, z.T @ z) and np.allclose(few.matrix, (z.T @ z)[:5, :5])
    a, b = rng.random(15), rng.random(15)
    s = np.column_stack([np.ones(200), f.to_numpy() * a + b])
    assert np.allclose(wide.affine(a, b).matrix, s.T @ s)


def test_gram_stream_counts_replays_once(spark, tmp_path):
    df = P.from_frames(spark, frames(np.random.default_rng(3), 20, 1)).df
    s = GramStream(["a", "b"], str(tmp_path / "sums"))
    s.add(df, 0)
    s.add(df, 0)
    s.add(df, 1)
    again = GramStream(["a", "b"], str(tmp_path / "sums"))  # after a restart
    assert {(r["a"], r["b"]): r["value"] for r in again.table(spark).collect()}["1", "1"] == 40


def test_gram_stream_runs(spark, tmp_path):
    df = P.from_frames(spark, frames(np.random.default_rng(3), 20, 1)).df
    df.write.parquet(str(tmp_path / "in"))
    s = GramStream(["a", "b"], str(tmp_path / "sums"))
    q = s.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(60)
    assert s.table(spark).where("a = '1' and b = '1'").first()["value"] == 20


def test_panels(spark, tmp_path):
    a, b = pd.DataFrame({"x": [1.0, 2], "y": [3.0, 4]}), pd.DataFrame({"y": [5.0], "z": [6.0]})
    with pytest.raises(SchemaMismatchError):
        P.from_frames(spark, [a, b])
    with pytest.raises(EmptyDataError):
        P.from_frames(spark, [])
    with pytest.raises(DataValidationError):
        P.from_frames(spark, [a, 3])
    p = P.from_frames(spark, [a, b], align=True)
    assert p.variables == ("x", "y", "z") and p.df.where("segment_id = 1").first()["x"] == 0.0
    (tmp_path / "a.csv").write_text("index;x;y\n0;1;2\n1;3;4\n")
    (tmp_path / "b.csv").write_text("index,x,q\n0,1,2\n")
    p = P.read_csv(spark, ["a.csv", "b.csv"], index_col=0, base=str(tmp_path))
    assert p.variables == ("x", "y", "q")
    assert [tuple(r) for r in p.df.select("segment_id", "x", "y", "q").orderBy("segment_id", "t").collect()] == [(0, 1, 2, 0), (0, 3, 4, 0), (1, 1, 0, 2)]
    with pytest.raises(FileNotFoundError):
        P.read_csv(spark, "none.csv", base=str(tmp_path))
    with pytest.raises(ColumnError):
        P.from_table(p.df, ["nope"])
    assert P.drop_nulls(P.from_frames(spark, pd.DataFrame({"x": [1.0, None, 2]}))).df.count() == 2


def test_head_by_numbering(spark, monkeypatch):
    monkeypatch.setattr(P, "TOP_ROWS", 0)
    df = P.from_frames(spark, frames(np.random.default_rng(4), 10, 2)).df.repartition(5)
    got = sorted((r["segment_id"], r["t"]) for r in P.head_sample(df, 0.6).collect())
    assert got == [(0, t) for t in range(10)] + [(1, 0), (1, 1)]


def test_roles_and_head(spark):
    assert P.check_roles(("a", "b"), [], "a", None) == (["a", "b"], ["a"], ["a", "b"])
    with pytest.raises(DataValidationError):
        P.check_roles(("a",), ["z"])
    df = P.from_frames(spark, frames(np.random.default_rng(4), 10, 2)).df
    head = lambda **k: [(r["segment_id"], r["t"]) for r in P.head_sample(df, **k).orderBy("segment_id", "t").collect()]
    assert head(fraction=0.6) == [(0, t) for t in range(10)] + [(1, 0), (1, 1)]
    assert head(fraction=0.01) == [(0, 0)] and head(most=3) == [(0, 0), (0, 1), (0, 2)] and len(head()) == 20


def test_metrics(spark):
    schema = "effect string, cause string, value int"
    gt = spark.createDataFrame([("a", "b", 1), ("b", "a", 0), ("a", "c", 0), ("c", "a", 1)], schema)
    pred = spark.createDataFrame([("a", "b", 0), ("b", "a", 1), ("a", "c", -1), ("c", "a", 1), ("q", "a", 1)], schema)
    assert metrics.confusion(gt, pred).first().asDict() == {"tp": 1, "fp": 1, "tn": 0, "fn": 1}
    assert metrics.shd(gt, pred).first()[0] == 1  # a-b is reversed and cancels, a-c is spurious
    assert metrics.shd(gt, pred, compat=False).first()[0] == 2 and metrics.shd(gt, pred, double_edges=True).first()[0] == 3
    row = metrics.evaluate(gt, pred).first()
    assert row["precision"] == 0.5 and row["f1"] == 0.5 and math.isclose(row["accuracy"], 1 / 3)
    loop = spark.createDataFrame([("a", "a", 1)], schema)
    none = spark.createDataFrame([("a", "a", 0)], schema)
    assert metrics.shd(none, loop).first()[0] == 0 and metrics.shd(loop, none).first()[0] == 1


def test_chunks_do_not_matter(spark):
    from tributary.operators import lagging
    from tributary.plans import selectors

    p = P.dense_time(P.from_frames(spark, frames(np.random.default_rng(8), 90, 2)))
    for order in (1, 2, {"a": 2, "b": 0}):
        for keep in (True, False):
            a, b = (sorted(map(tuple, lagging.difference(p, order, keep, chunk).df.collect()), key=repr) for chunk in (None, 7))
            assert a == b and len(a) > 100
    chosen = lambda: selectors.ICLagSelector(max_lag=3, min_lag=1)
    assert (selectors.lag_matrix(p, chosen(), [0, 1]) == selectors.lag_matrix(p, chosen(), [0, 1], 11)).all()
