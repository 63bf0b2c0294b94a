import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from gridsmith.operators.calibration import CalibratedSVC, CalibratedSVCModel


def frame(spark, x, y):
    rows = [(i, *map(float, p), None if k is None else float(k)) for i, (p, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def chances(model, df):
    rows = model.transform(df).orderBy("id").select(vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("r"), "prediction").collect()
    return np.array([r["p"] for r in rows]), np.array([r["r"] for r in rows]), np.array([r["prediction"] for r in rows])


def test_chances_match_frequencies(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2.5 * x[:, 0]))).astype(int)
    df = frame(spark, x, y)
    model = CalibratedSVC(regParam=0.01, maxIter=50).fit(df)
    p, raw, guessed = chances(model, df)
    assert np.allclose(p.sum(axis=1), 1) and np.array_equal(guessed, (raw[:, 1] > 0).astype(float))
    assert np.array_equal(np.argsort(raw[:, 1], kind="stable"), np.argsort(p[:, 1], kind="stable"))
    for low in np.arange(0, 1, 0.2):
        inside = (p[:, 1] >= low) & (p[:, 1] < low + 0.2)
        assert abs(p[inside, 1].mean() - y[inside].mean()) < 0.08
    model.write().overwrite().save(str(tmp_path / "m"))
    assert np.array_equal(chances(CalibratedSVCModel.load(str(tmp_path / "m")), df)[0], p)


def test_many_classes_copies_and_missing_labels(spark):
    x = np.vstack([np.tile([[8.0 * k, 5.0 * (k == 1)]], (30, 1)) + np.arange(30)[:, None] % 3 for k in range(3)])
    y = [*np.repeat(range(3), 30)][:-1] + [None]
    df = frame(spark, x, y)
    p, raw, guessed = chances(CalibratedSVC(regParam=0.001, maxIter=60, folds=2).fit(df), df)
    assert p.shape == (90, 3) and np.allclose(p.sum(axis=1), 1)
    assert (guessed == np.repeat([0.0, 1.0, 2.0], 30)).all()
