import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from gridsmith.operators.softmax import SoftmaxBoosting, SoftmaxBoostingModel, _stalled


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, b double, label double, scores string")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def chances(model, df):
    rows = model.transform(df).select("id", vector_to_array("probability").alias("p"), "prediction").orderBy("id").collect()
    return np.array([r["p"] for r in rows]), [r["prediction"] for r in rows]


def test_rounds_are_newton_steps(spark):
    """Stumps on one two-valued column have one possible cut, so every round can be worked out by hand."""
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 2), 1.0, float(rng.choice(3, p=[0.6, 0.3, 0.1] if i % 2 else [0.1, 0.2, 0.7])), "x") for i in range(300)]
    df = frame(spark, rows).repartition(5)
    found, guessed = chances(SoftmaxBoosting(rounds=4, learningRate=0.3, maxDepth=1).fit(df), df)
    x, y = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    f = np.tile(np.log([(y == k).mean() for k in range(3)]), (300, 1))
    for _ in range(4):
        p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
        for k in range(3):
            g, h = (y == k) - p[:, k], p[:, k] * (1 - p[:, k])
            for side in (0.0, 1.0):
                f[x == side, k] += 0.3 * 2 / 3 * g[x == side].sum() / h[x == side].sum()
    want = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
    assert np.allclose(found, want, atol=1e-9)
    assert guessed == list(want.argmax(axis=1))


def test_saved_and_loaded(spark, tmp_path):
    df = frame(spark, [(i, float(i % 7), float(i % 3), float((i % 7 > 3) + (i % 3 > 1)), "") for i in range(210)])
    model = SoftmaxBoosting(rounds=3, maxDepth=2, subsample=0.8).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = SoftmaxBoostingModel.load(str(tmp_path / "m"))
    assert np.array_equal(chances(model, df)[0], chances(again, df)[0])
    assert np.allclose(chances(model, df)[0].sum(axis=1), 1.0)
    assert np.isclose(sum(again.featureImportances.toArray()), 1.0)


def test_a_class_without_rows_and_unlabelled_rows(spark):
    rows = [(i, float(i % 2), 0.0, 2.0 * (i % 2), "") for i in range(60)]
    df = frame(spark, [*rows, (100, 0.0, 0.0, None, "")])
    p, guessed = chances(SoftmaxBoosting(rounds=2, learningRate=1.0).fit(df), df)
    assert p.shape == (61, 3) and (p[:, 1] < 0.05).all()
    assert guessed == [2.0 * (i % 2) for i in range(60)] + [0.0]


def test_stops_when_the_held_rows_gain_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), float(rng.normal()), float(rng.integers(3)), "") for i in range(400)]
    model = SoftmaxBoosting(rounds=12, learningRate=0.8, maxDepth=4, patience=2, validation=0.3).fit(frame(spark, rows))
    assert model.getOrDefault(model.state)["rounds"] < 9
    assert {len(s.treeWeights) for s in model.sides} == {model.getOrDefault(model.state)["rounds"]}


@pytest.mark.parametrize("losses, stalled", [([1.0], False), ([1.0, 0.5, 0.4], False), ([0.4, 0.5, 0.45], True), ([math.inf, 1, 1, 1], True), ([0.4, None, 0.6], False)])
def test_stalled(losses, stalled):
    assert _stalled(losses, 2, 1e-4) is stalled
