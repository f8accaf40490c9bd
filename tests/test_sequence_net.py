"""The joint sequence learner: its gradient, its steps over blocks, early stop, saved weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import sequence_net as net
from tideline.operators.models import scored
from tideline.sources import tables


def test_gradient_by_finite_differences():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(13, 6)), np.column_stack([r.normal(size=13), r.integers(0, 2, 13)])
    w = net.first_weights(6, net.NetParams(hidden=5))
    _, gradient = net.loss_and_gradient(w, x, y)
    for name, g in gradient.items():
        for at in np.ndindex(g.shape):
            ends = []
            for e in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += e
                ends.append(net.loss_and_gradient(moved, x, y)[0])
            assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-5 * max(1, abs(g[at]))


@pytest.fixture(scope="module")
def windows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 4, 3))
    value = x[:, -1, 0] - x[:, 0, 1]
    up = (x[:, 1, 2] + 0.2 * r.normal(size=600) > 0).astype(int)
    rows = [("a", i, v.tolist(), float(a), int(b), "train" if i < 400 else "val" if i < 500 else "test") for i, (v, a, b) in enumerate(zip(x, value, up, strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts int, seq array<array<double>>, target_return double, target_direction int, block string").persist(), x, value, up


def _fit(df, **p):
    return net.fit_sequences(df, F.col("block") == "train", F.col("block") == "val", net.NetParams(hidden=8, rate=0.02, batches=3, **p))


def test_both_heads_learn_and_blocks_change_nothing(windows, monkeypatch, spark, tmp_path):
    df, x, value, up = windows
    model = _fit(df, epochs=25)
    out = model.transform(df.where("block = 'test'")).toPandas()
    assert ((out.predicted_return - out.target_return) ** 2).mean() < 0.3 * value.var() and (out.prediction == out.target_direction).mean() > 0.8
    monkeypatch.setattr(net, "ROWS", 50)
    many = _fit(df.repartition(4), epochs=25)
    assert np.allclose(many.history, model.history) and all(np.allclose(many.weights[k], model.weights[k]) for k in model.weights)
    tables.save_models(str(tmp_path), net=model)
    back = tables.load_models(spark, str(tmp_path), ["net"])["net"]
    assert scored(back, df).select("ts", "probability").exceptAll(scored(model, df).select("ts", "probability")).isEmpty()


def test_one_mini_batch_is_a_plain_step(windows):
    df, x, value, up = windows
    model = _fit(df, epochs=1)
    blocks = net.window_blocks(df, "seq", "target_return", "target_direction", {"train": F.col("block") == "train"}, ("symbol", "ts"))
    w = net.first_weights(12, net.NetParams(hidden=8))
    parts = [net.summed(blocks, "train", w, True, (42000, k, 3)) for k in range(3)]
    assert sum(p[0] for p in parts) == 400 and min(p[0] for p in parts) > 90
    flat = x[:400].reshape(400, -1).astype(np.float32).astype(float)
    loss, gradient = net.loss_and_gradient(w, flat, np.column_stack([value, up])[:400])
    assert np.isclose(sum(p[1] for p in parts), loss) and all(np.allclose(sum(p[2][k] for p in parts), gradient[k]) for k in gradient)
    assert len(model.history) == 1


def test_stops_early_and_keeps_the_best(windows):
    df, *_ = windows
    # Labels of the training block that tell nothing: the validation loss soon gets worse.
    noise = df.withColumn("target_return", F.when(F.col("block") == "train", F.rand(3) * 8 - 4).otherwise(F.col("target_return")))
    model = _fit(noise, epochs=60, patience=4)
    held = [v for _, v in model.history]
    assert len(held) < 60 and held.index(min(held)) == len(held) - 5
    blocks = net.window_blocks(noise, "seq", "target_return", "target_direction", {"val": F.col("block") == "val"}, ("symbol", "ts"), model.scale)
    n, loss, _ = net.summed(blocks, "val", model.weights, False)
    assert np.isclose(loss / n, min(held))


def test_gaps_nulls_and_no_rows(windows, spark):
    df, *_ = windows
    gaps = df.withColumn("seq", F.when(F.col("ts") % 50 == 0, F.lit(None)).when(F.col("ts") % 50 == 1, F.transform("seq", lambda s: F.transform(s, lambda v: F.lit(float("nan"))))).otherwise(F.col("seq")))
    gaps = gaps.withColumn("target_direction", F.when(F.col("ts") % 50 != 2, F.col("target_direction")))
    model = _fit(gaps, epochs=2)
    assert all(np.isfinite(v).all() for v in model.weights.values())
    out = model.transform(gaps)
    assert out.where("predicted_return is null").count() == 24 and out.count() == 600
    assert _fit(df.limit(0), epochs=2).history == []
