"""Edge cases and whole workflows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridsmith.functions import tails
from gridsmith.functions.scalars import interpret_score, to_number
from gridsmith.operators import checks, drift, preparation, profile, roles
from gridsmith.operators.columns import narrow_types, rename_valid
from gridsmith.operators.neighbors import smote, smote_targets
from gridsmith.operators.stages import ColumnCleaner, KnnImputationModel, Preprocessor
from gridsmith.plans import training
from gridsmith.plans.catalog import search_grid
from gridsmith.session import scratch_folder
from gridsmith.sources import tables
from gridsmith.sources.features import FeatureStore


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(42)
    rows = [
        (
            i, float(rng.normal(100, 15)), str(rng.choice(list("ABC"), p=[0.5, 0.3, 0.2])), int(rng.random() < 0.3),
            None if rng.random() < 0.1 else float(rng.integers(1, 4)), int(rng.choice(3, p=[0.6, 0.3, 0.1])),
        )
        for i in range(1000)
    ]
    return spark.createDataFrame(rows, "id bigint, numeric_col double, categorical_col string, binary_col int, missing_col double, target int").cache()


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string, t timestamp")
    assert roles.column_roles(df)["numeric"] == ["a"]
    got = {r["column"]: r for r in profile.table_profile(df).collect()}
    assert got["a"]["count"] == 0 and got["a"]["mean"] is None and got["b"]["distinct"] == 0
    assert {r["column"] for r in profile.constant_and_id_like(df).filter("constant").collect()} == {"a", "b", "t"}


def test_single_row(spark):
    df = spark.createDataFrame([(1, "x", 0)], "col1 int, col2 string, target int")
    assert profile.constant_and_id_like(df).filter("id_like").count() == 0
    row = profile.numeric_profile(df, ["col1"]).first()
    assert row["count"] == 1 and row["std"] is None and row["skewness"] is None and row["median"] == 1


def test_all_missing_and_nan(spark):
    df = spark.createDataFrame([(float("nan"), None, float(i)) for i in range(100)], "a double, b string, c double")
    row = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert row["a"]["count"] == 0 and row["a"]["median"] is None and row["c"]["median"] == 49.5
    assert roles.column_roles(df)["text_or_high_cardinality"] == ["b"]
    reasons = {r["column"]: r["reason"] for r in profile.useless_columns(df).collect()}
    assert reasons == {"a": "missing", "b": "missing"}


def test_mixed_column_and_long_name(spark):
    long = "n" * 1000
    df = spark.createDataFrame([("1", 1.0), ("a", 2.0), ("2.5", 3.0), ("b", 4.0), (None, 5.0)], f"mixed string, `{long}` double")
    assert roles.coercion_decisions(df) == [("mixed", "string", "string", None, 1.0)]
    assert profile.numeric_profile(df).first()["column"] == long


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (4.0, "x")], "`a.b` double, `my text` string")
    got = {r["column"]: r for r in profile.table_profile(df).collect()}
    assert got["a.b"]["median"] == 2.0 and got["my text"]["distinct"] == 2
    assert got["my text"]["top_values"] == {"x": 2, "y": 1}


def test_numbers_in_text(spark):
    cases = {"1": 1.0, " -2.5e1 ": -25.0, ".5": 0.5, "1d": None, "0x1p3": None, "": None, "nan": None, "1,5": None, "7.": 7.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", to_number("s").alias("n")).collect()} == cases


def test_rename_rules(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert rename_valid(df, {"a": "b", "b": "x y", "c": "ok", "z": "w"}).columns == ["a", "b", "ok"]


def test_narrowing_keeps_values(spark):
    df = spark.createDataFrame([(1, 300, 2**40, 0.5, 0.1), (-128, -5, 1, float("nan"), None)], "a bigint, b bigint, c bigint, d double, e double")
    assert [t for _, t in narrow_types(df).dtypes] == ["tinyint", "smallint", "bigint", "float", "double"]


def test_score_bands_first_fit(spark):
    df = spark.createDataFrame([("accuracy", 0.9), ("accuracy", 0.8), ("accuracy", -0.1), ("x", 0.5)], "m string, v double")
    assert [r[0] for r in df.select(interpret_score("m", "v")).collect()] == ["Excellent", "Très bon", "Non évalué", "Non évalué"]


def test_tail_probabilities():
    # Published values of the F, t and Kolmogorov distributions.
    assert tails.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_tail(3.0984, 3, 20) == pytest.approx(0.05, abs=1e-4)
    assert tails.correlation_p(0.576, 12) == pytest.approx(0.05, abs=1e-3)
    assert tails.kolmogorov_p(1.3581, 10**9, 10**18) == pytest.approx(0.0, abs=1e-9)
    assert tails.kolmogorov_p(1.3581 / np.sqrt(500), 1000, 1000) == pytest.approx(0.05, abs=1e-3)
    assert tails.kolmogorov_p(0.8276 / np.sqrt(500), 1000, 1000) == pytest.approx(0.5, abs=1e-3)


def test_drift_by_shift(spark, people):
    same = drift.drift_report(people, people.orderBy(F.rand(1)), columns=["numeric_col", "binary_col"]).collect()
    assert not any(r["drift_detected"] for r in same)
    moved = people.withColumn("numeric_col", F.col("numeric_col") + 50)
    assert [r["column"] for r in drift.drifted_columns(people, moved).collect()] == ["numeric_col"]


def test_feature_store(spark, people):
    store = FeatureStore(spark, scratch_folder(spark))
    data = people.select("numeric_col")
    version = store.register("f", data, "a feature", ["numeric"])
    assert store.versions().collect()[0]["versions"] == [version]
    assert store.get("f").exceptAll(data).count() == 0
    assert store.check("f", data).first()["is_valid"]
    assert not store.check("f", data.withColumn("numeric_col", F.col("numeric_col") * 2)).first()["is_valid"]
    assert not store.drift("f", data).first()["drift_detected"]
    moved = store.drift("f", data.select((F.col("numeric_col") + 50).alias("numeric_col"))).first()
    assert moved["drift_detected"] and moved["drift_score"] > moved["threshold"]


def test_feature_checks_read_summaries_alone(spark, people, monkeypatch):
    store = FeatureStore(spark, scratch_folder(spark))
    data = people.select("numeric_col", "categorical_col", (F.col("numeric_col") * 0).cast("string").alias("text"), F.lit(None).cast("double").alias("empty"))
    version = store.register("f", data)
    read = []
    table = store.get
    monkeypatch.setattr(store, "get", lambda *a: read.append(a) or table(*a))
    drifted = store.drift("f", data)
    assert drifted.first()["drift_score"] == 0 and not read
    assert not any("/data/" in f for f in drifted.inputFiles())
    schema_only = store.check("f", data)
    assert schema_only.first()["is_valid"] and not any("/data/" in f for f in schema_only.inputFiles())
    # A feature without summaries is compared all the same.
    bare = FeatureStore(spark, scratch_folder(spark))
    data.write.parquet(bare._folder("f", version))
    assert bare.check("f", data, version).first()["is_valid"] and bare.drift("f", data, version=version).first()["drift_score"] == 0


def test_load_refuses_bad_input(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "/tmp/x.xyz")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, "/tmp/absent.csv")
    path = scratch_folder(spark) + ".parquet"
    spark.createDataFrame([], "a int").write.parquet(path)
    with pytest.raises(ValueError):
        tables.load_table(spark, path)


def test_json_array_of_records(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    assert sorted(tuple(r) for r in tables.load_table(spark, str(path)).collect()) == [(1, "x"), (2, "y")]


def test_cleaner_keeps_all_when_nothing_remains(spark):
    df = spark.createDataFrame([(i, 1) for i in range(20)], "id bigint, one int")
    assert ColumnCleaner().fit(df).dropped() == []
    assert ColumnCleaner().fit(df.withColumn("x", F.col("id") % 5)).dropped() == ["id", "one"]


def test_clustering_needs_two_features(spark, people):
    checked = checks.clustering_features(people, ["numeric_col"])
    assert not checks.clustering_summary(checked).first()["is_valid"]


def test_smote_strategies():
    counts = {0: 100, 1: 40, 2: 10}
    assert smote_targets(counts) == {1: 60, 2: 90}
    assert smote_targets(counts, "minority") == {2: 90}
    assert smote_targets(counts, "not minority") == {1: 60}
    assert smote_targets(counts, "all") == {1: 60, 2: 90}


def test_smote_points_lie_between_neighbours(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=2)], 0) for i in range(60)]
    rows += [(100 + i, [float(i), float(2 * i)], 1) for i in range(9)]
    out = smote(spark.createDataFrame(rows, "id bigint, x array<double>, y int"), "id", "x", "y", 2)
    new = out.filter("synthetic").collect()
    assert len(new) == 51 and len({r["id"] for r in new}) == 51
    # The small class lies on a line, and so must everything between its rows.
    assert all(abs(r["x"][1] - 2 * r["x"][0]) < 1e-9 and 0 <= r["x"][0] <= 8 for r in new)


ROLES = {"numeric": ["numeric_col", "missing_col", "binary_col"], "categorical": ["categorical_col"]}


def test_preprocessor_ignores_unseen_levels(spark, people):
    model = Preprocessor(roles=ROLES).fit(people)
    strange = people.limit(1).withColumn("categorical_col", F.lit("Z"))
    vector = model.transform(strange).first()["features"]
    assert len(vector) == 5 and list(vector)[3:] == [0.0, 0.0]


def test_preprocessor_with_neighbours_and_pca(spark, people):
    config = {"numeric_imputation": "knn", "keys": ["id"], "pca_components": 2}
    model = Preprocessor(roles=ROLES, config=config).fit(people)
    path = scratch_folder(spark)
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert any(isinstance(s, KnnImputationModel) for s in again.stages)
    a = {r["id"]: r["features"] for r in model.transform(people).collect()}
    b = {r["id"]: r["features"] for r in again.transform(people).collect()}
    assert len(a) == 1000 and all(np.allclose(a[k], b[k]) for k in a)


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    for method in ("standard", "minmax", "robust"):
        assert [r["a"] for r in preparation.scale(df, preparation.scaling_values(df, ["a"], method)).collect()] == [0.0, 0.0]


def test_grid_is_cut_above_fifty():
    assert len(search_grid("classification", "random_forest")) == 36
    assert len(search_grid("regression", "xgboost", 50)) == 16
    assert len(search_grid("regression", "xgboost")) == 54
    assert len(search_grid("clustering", "dbscan")) == 36


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    rows = [(i, *map(float, p), "yes" if k else "no", float(3 * p[0] - p[2])) for i, (p, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, y string, z double").cache()


NUMERIC = {"numeric": ["a", "b", "c"]}


def test_batch_of_classifiers(spark, learnable):
    runs, models = training.train_models(
        learnable, "id", NUMERIC, "y", "classification", ["logistic_regression", "discriminant", "knn", "adaboost", "absent"], {"adaboost": {"n_estimators": 3}},
    )
    got = {r["model_name"]: r for r in runs.collect()}
    assert not got["absent"]["success"] and got["absent"]["error"]
    assert got["logistic_regression"]["metrics"]["accuracy"] > 0.93
    assert got["logistic_regression"]["metrics"]["roc_auc"] > 0.97
    assert got["discriminant"]["metrics"]["accuracy"] > 0.9
    assert got["knn"]["metrics"]["accuracy"] > 0.85
    assert got["adaboost"]["metrics"]["accuracy"] > 0.7
    path = scratch_folder(spark)
    models["adaboost"].write().overwrite().save(path)
    again = PipelineModel.load(path).transform(learnable.withColumn("label", F.lit(0.0)))
    assert again.select("prediction").distinct().count() == 2


def test_regressors_learn(spark, learnable):
    runs, _ = training.train_models(
        learnable, "id", NUMERIC, "z", "regression", ["linear_regression", "decision_tree", "adaboost"],
        {"decision_tree": {"max_depth": 8}, "adaboost": {"n_estimators": 3}},
    )
    got = {r["model_name"]: r["metrics"] for r in runs.collect()}
    assert got["linear_regression"]["r2"] == pytest.approx(1.0, abs=1e-6)
    assert got["decision_tree"]["r2"] > 0.8 and got["adaboost"]["r2"] > 0.6
