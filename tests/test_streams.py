import numpy as np
import pandas as pd
import pytest

from tributary.operators import lagging
from tributary.sources import panel as P
from tributary.streaming.lag_stream import LagStream


def feed(spark, tmp_path, parts, lags, restart_after=None):
    """Each part a file; the stream is started anew after some of them. Rows that came out."""
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    schema = "segment_id int, t long, a double, b double"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        if restart_after is None or i in restart_after or i == len(parts) - 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = lags.features(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(out).toPandas()


def test_a_stream_that_restarts_gives_the_batch_features(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.normal()), float(rng.normal())) for t in range(30) for s in (0, 1) if not (s == 1 and t % 4 == 2)]
    parts = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 2), (2, 3), (3, 17), (17, 18), (18, 30))]
    for p in parts:
        rng.shuffle(p)
    parts = [[(int(s), int(t), float(a), float(b)) for s, t, a, b in p] for p in parts]
    lags = LagStream(["a", "b"], [1, 0], [3, 2], ["b"])
    got = feed(spark, tmp_path, parts, lags, restart_after=(1, 3))
    table = P.from_table(spark.createDataFrame(rows, "segment_id int, t long, a double, b double"), ["a", "b"], "segment_id")
    want = lagging.lag_features(table, [1, 0], [3, 2], ["b"]).toPandas()
    assert not got["late"].any()
    order = ["segment_id", "t"]
    pd.testing.assert_frame_equal(got.drop(columns="late").sort_values(order, ignore_index=True)[want.columns], want.sort_values(order, ignore_index=True), check_dtype=False)


def test_late_rows_come_out_once_and_change_nothing(spark, tmp_path):
    parts = [[(0, 1, 1.0, 1.0), (0, 3, 3.0, 3.0)], [(0, 2, 2.0, 2.0), (0, 4, 4.0, 4.0), (0, 3, 9.0, 9.0), (0, 4, 8.0, 8.0)], [(0, 5, 5.0, 5.0)]]
    got = feed(spark, tmp_path, parts, LagStream(["a", "b"], [1, 1], [1, 1], ["a"]))
    on_time = got[~got["late"]].sort_values("t")
    assert on_time["t"].tolist() == [3, 4, 5] and on_time["a_lag1"].tolist() == [1.0, 3.0, 4.0]
    late = got[got["late"]]
    assert sorted(zip(late["t"], late["a"], strict=True)) == [(2, 2.0), (3, 9.0), (4, 8.0)] and late["a_lag1"].isna().all()


@pytest.mark.parametrize("cut", range(1, 6))
def test_updates_by_hand(cut):
    """Any cut of the rows into batches gives the same features; gaps are filled."""
    lags = LagStream(["a"], [0], [2], fill=0.0)
    rows = pd.DataFrame({"t": [1, 2, 5, 6, 7, 9], "a": [1.0, 2, 5, 6, 7, 9]})
    held, out = (np.array([], np.int64), np.zeros((0, 1))), []
    for part in (rows[:cut], rows[cut:]):
        held, got = lags._update(held, part)
        out.append(got)
    got = pd.concat(out)
    assert got["t"].tolist() == [3, 4, 5, 6, 7, 8, 9] and got["a_lag0"].tolist() == [0, 0, 5, 6, 7, 0, 9] and got["a_lag2"].tolist() == [1, 2, 0, 0, 5, 6, 7]
    assert held[0].tolist() == [8, 9]
    zero, got = LagStream(["a"], [0], [0])._update((np.array([], np.int64), np.zeros((0, 1))), rows)
    assert len(got) == 6 and zero[0].tolist() == [9]


def test_files_of_many_splits_keep_their_order(spark, tmp_path):
    n = 4000
    (tmp_path / "long.csv").write_text("x;y\n" + "".join(f"{i};{(i * 7919) % 1000}\n" for i in range(n)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "2000")
    try:
        scan = spark.read.option("sep", ";").option("header", True).csv(f"file://{tmp_path}/long.csv")
        assert scan.rdd.getNumPartitions() > 10
        p = P.read_csv(spark, [f"file://{tmp_path}/long.csv", f"file://{tmp_path}/long.csv"])
        got = p.df.toPandas().sort_values(["segment_id", "t"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert p.index == "t"
    for s in (0, 1):
        own = got[got["segment_id"] == s]
        assert own["t"].tolist() == list(range(n)) and own["x"].tolist() == list(map(float, range(n)))
