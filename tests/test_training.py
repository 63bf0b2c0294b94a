import uuid

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridsmith.operators import metrics as M
from gridsmith.operators import sampling
from gridsmith.operators.fold_statistics import Numbers, fit_from, gather
from gridsmith.operators.stages import Preprocessor
from gridsmith.plans import training as T

ROLES = {"numeric": ["a", "b.c", "empty", "one"], "datetime": ["day"], "categorical": ["kind", "none"], "text_or_high_cardinality": ["word"]}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        gap = lambda v, share=0.2: None if rng.random() < share else v
        rows.append((i, gap(float(rng.normal(5, 3))), gap(float("nan") if i % 50 == 0 else float(rng.integers(9))), None, 4.0, gap("2024-01-%02d" % (1 + i % 28)),
                     gap(f"k{rng.integers(4)}"), None, gap(f"w{rng.integers(30)}"), float(i % 2), i % 3))
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, empty double, one double, day string, kind string, none string, word string, label double, side int")
    return df.withColumn("day", F.to_timestamp("day")).persist()


def vectors(model, df):
    return np.array([r["v"] for r in model.transform(df).orderBy("id").select(vector_to_array("features").alias("v")).collect()])


@pytest.mark.parametrize("config", [
    {}, {"numeric_imputation": "constant", "categorical_imputation": "constant"}, {"scaling_method": "minmax", "encoding_method": "ordinal"},
    {"scale_features": False, "drop_first": False},
])
def test_merged_states_prepare_like_the_rows(spark, table, config):
    states = gather(table, ROLES, config, F.col("side"))
    for left_out in range(3):
        train = table.filter(F.col("side") != left_out)
        want = Preprocessor(roles=ROLES, config={**config, "keys": ["id"]}).fit(train)
        found = fit_from(spark, [s for g, s in states.items() if g != left_out], ROLES, config)
        a, b = want.transform(table), found.transform(table)
        assert a.schema["features"].metadata == b.schema["features"].metadata
        assert np.allclose(vectors(want, table), vectors(found, table), atol=1e-9)


def test_what_needs_the_rows_is_told(spark, table):
    for config in ({"numeric_imputation": "median"}, {"scaling_method": "robust"}, {"pca_components": 2}, {"clean_columns": True}, {"numeric_imputation": "knn"}):
        assert gather(table, ROLES, config, F.col("side")) is None
    wide = table.withColumn("word", F.concat("word", F.col("id").cast("string"))).unionByName(spark.range(3000).select(F.col("id"), F.col("id").cast("string").alias("word")), allowMissingColumns=True)
    assert gather(wide, ROLES, {}, F.coalesce("side", F.lit(0))) is None


def test_numbers_merge():
    x = np.array([1.0, 5.0, 1e9, 1e9 + 1, -3.0])
    of = lambda v: Numbers(len(v), v.mean(), ((v - v.mean()) ** 2).sum(), v.min(), v.max())
    both = of(x[:2]) + of(x[2:]) + Numbers()
    assert both.n == 5 and np.isclose(both.mean, x.mean()) and np.isclose(both.m2, ((x - x.mean()) ** 2).sum()) and (both.low, both.high) == (-3.0, 1e9 + 1)


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_columns_add_no_jobs_to_a_fold(spark, table):
    few = T.Recipe("id", {"numeric": ["a"], "categorical": ["kind"]}, "classification", "naive_bayes")
    many = T.Recipe("id", {"numeric": ["a", "b.c", "one"], "categorical": ["kind", "word"]}, "classification", "naive_bayes")
    count = [jobs(spark, lambda r=r, k=k: T.cross_validate(table, "id", r, "classification", k, parallel=1)) for r in (few, many) for k in (2, 4)]
    assert abs(count[0] - count[2]) <= 2 and abs((count[1] - count[0]) - (count[3] - count[2])) <= 2


def test_shared_sides_score_like_separate_fits(spark, table):
    roles = {"numeric": ["a", "b.c"], "categorical": ["kind"]}
    recipe = T.Recipe("id", roles, "classification", "decision_tree", {"max_depth": 3})
    alone = lambda train: T.fit_model(train, "id", roles, "classification", "decision_tree", {"max_depth": 3})
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(T.cross_validate(table, "id", recipe, "classification", 3)) == rows(T.cross_validate(table, "id", alone, "classification", 3))
    assert rows(T.learning_curve(table, "id", recipe, "classification", [0.4, 0.9], 2)) == rows(T.learning_curve(table, "id", alone, "classification", [0.4, 0.9], 2))


def test_a_failing_candidate_leaves_the_others(spark, table):
    found = T.validate(table, "id", {"numeric": ["a"]}, "classification", [("decision_tree", {"max_depth": 99}), ("decision_tree", {"max_depth": 2})], 2)
    assert isinstance(found[0][0], ValueError) and len(found[1]) == 2


def test_runs_hold_reports_and_importance_is_found(spark, table):
    data = table.withColumn("target", F.when(F.col("a") > 5, "high").otherwise("low").cast("string"))
    roles = {"numeric": ["a", "b.c"], "categorical": ["kind"]}
    runs, models = T.train_models(data.drop("label"), "id", roles, "target", "classification", ["decision_tree", "logistic_regression", "discriminant"], {"decision_tree": {"max_depth": 3}})
    metrics = {r["model_name"]: r["metrics"] for r in runs.collect()}
    tree = metrics["decision_tree"]
    predicted = models["decision_tree"].transform(data.withColumn("label", F.when(F.col("target") == "high", 0.0).otherwise(1.0)))
    assert set(M.confusion_counts(predicted).columns) == {"label", "prediction", "n"}
    assert sum(v for k, v in tree.items() if k.startswith("confusion.")) == tree["n_samples"] == tree["class.high.support"] + tree["class.low.support"]
    assert {"class.low.precision", "class.high.f1_score", "roc_auc"} <= set(tree)
    for model in models.values():
        found = {r["feature"]: r["importance"] for r in T.feature_importance(model, model.stages[0].transform(data)).collect()}
        assert max(found, key=found.get) == "a"
    numbers, _ = T.train_models(table.drop("label"), "id", {"numeric": ["a"]}, "b.c", "regression", ["linear_regression"])
    assert {"mean_error", "median_error", "q95_error", "r2"} <= set(numbers.first()["metrics"])


def test_large_samples_take_no_single_task(spark, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "k")
    small = {r["k"] for r in sampling.sample_rows(df, ["k"], 0.2).collect()}
    monkeypatch.setattr(sampling, "ONE_TASK", 10)
    assert {r["k"] for r in sampling.sample_rows(df, ["k"], 0.2).collect()} == small


def test_learners_read_few_tasks_with_a_short_lineage(spark):
    rows = [(i, float(i % 50), float(i % 2)) for i in range(400)]
    data = spark.createDataFrame(rows, "id long, a double, label double").repartition(97, "id")
    side = T.TrainingSide(data, "id", {"numeric": ["a"]}, "classification")
    try:
        assert side.ready.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert "Shuffled" not in side.ready._jdf.queryExecution().toRdd().toDebugString()
        assert side.rows == side.ready.count() == 400
    finally:
        side.close()
