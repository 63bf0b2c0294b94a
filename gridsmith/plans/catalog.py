"""The models on offer per task, their settings and their search grids."""

from __future__ import annotations

import math

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)

from gridsmith.operators.boosting import AdaBoostClassifier, AdaBoostRegressor
from gridsmith.operators.calibration import CalibratedSVC
from gridsmith.operators.discriminant import LinearDiscriminant
from gridsmith.operators.linkage import Agglomerative
from gridsmith.operators.softmax import SoftmaxBoosting

SEED = 42
MAX_DEPTH = 30

# The settings searched per model. None is an unlimited depth.
GRIDS = {
    "regression": {
        "linear_regression": {"fit_intercept": [True, False]},
        "ridge": {"alpha": [0.1, 1.0, 10.0]},
        "lasso": {"alpha": [0.1, 1.0, 10.0]},
        "random_forest": {
            "n_estimators": [50, 100, 200], "max_depth": [10, 20, None], "min_samples_leaf": [1, 2],
        },
        "gradient_boosting": {
            "n_estimators": [50, 100], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7], "subsample": [0.8, 1.0],
        },
        "knn": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
        "decision_tree": {"max_depth": [5, 10, 20, None], "min_samples_leaf": [1, 2, 4]},
        "adaboost": {"n_estimators": [50, 100], "learning_rate": [0.5, 1.0, 1.5]},
        "xgboost": {
            "n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.05, 0.1, 0.2], "subsample": [0.8, 1.0],
        },
        "lightgbm": {
            "n_estimators": [50, 100, 200], "num_leaves": [31, 50, 100], "learning_rate": [0.05, 0.1, 0.2], "subsample": [0.8, 1.0],
        },
    },
    "classification": {
        "logistic_regression": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2", "elasticnet"]},
        "random_forest": {
            "n_estimators": [50, 100, 200], "max_depth": [10, 20, None], "min_samples_leaf": [1, 2], "class_weight": [None, "balanced"],
        },
        "gradient_boosting": {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7]},
        "svm": {"C": [0.1, 1.0, 10.0]},
        "knn": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
        "decision_tree": {
            "max_depth": [5, 10, 20, None], "min_samples_leaf": [1, 2, 4], "class_weight": [None, "balanced"],
        },
        "adaboost": {"n_estimators": [50, 100], "learning_rate": [0.5, 1.0, 1.5]},
        "naive_bayes": {},
        "discriminant": {},
        "neural_network": {"hidden_layer_sizes": [[50], [100], [50, 50]]},
        "xgboost": {
            "n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.05, 0.1, 0.2], "subsample": [0.8, 1.0],
        },
        "lightgbm": {
            "n_estimators": [50, 100, 200], "num_leaves": [31, 50, 100], "learning_rate": [0.05, 0.1, 0.2], "subsample": [0.8, 1.0],
        },
    },
    "clustering": {
        "kmeans": {"n_clusters": [2, 3, 4, 5, 6, 7, 8]},
        "dbscan": {"eps": [0.3, 0.5, 0.7, 1.0], "min_samples": [5, 10, 15], "metric": ["euclidean", "manhattan", "cosine"]},
        "hierarchical": {"n_clusters": [2, 3, 4, 5], "linkage": ["ward", "complete", "average", "single"]},
    },
}


def model_names(task: str) -> list[str]:
    return list(GRIDS[task])


def search_grid(task: str, name: str, limit: int | None = None) -> list[dict]:
    """Every setting of a model; with ``limit`` a larger grid keeps the first two values of each setting."""
    grid = GRIDS[task][name]
    if limit is not None and math.prod(len(v) for v in grid.values()) > limit:
        grid = {k: v[:2] for k, v in grid.items()}
    out = [{}]
    for name_, values in grid.items():
        out = [{**setting, name_: v} for setting in out for v in values]
    return out


def _tree_settings(p: dict) -> dict:
    # None asks for a tree as deep as this library grows one.
    depth = p.get("max_depth")
    if depth is not None and depth > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} deep here, not {depth}")
    out = {"maxDepth": MAX_DEPTH if depth is None else depth, "minInstancesPerNode": p.get("min_samples_leaf", 1), "seed": SEED}
    if p.get("class_weight") == "balanced":
        out["weightCol"] = "class_weight"
    return out


def _boost_settings(p: dict) -> dict:
    depth = p.get("max_depth", 3)
    if "num_leaves" in p:
        depth = math.ceil(math.log2(p["num_leaves"]))
    return {
        "maxIter": p.get("n_estimators", 100), "stepSize": p.get("learning_rate", 0.1), "maxDepth": depth,
        "subsamplingRate": p.get("subsample", 1.0), "seed": SEED,
    }


def build(task: str, name: str, params: dict | None = None, rows: int = 1, classes: int = 2, width: int = 1, spread: float = 1.0) -> Estimator:
    """An estimator with the usual names for its settings.

    Penalties are rescaled: the objective here is a mean over rows, the usual
    one for ridge and logistic regression a sum, and the squared penalty is
    divided by the label's deviation when fitting. ``rows``, ``classes``,
    ``width`` and ``spread`` (the label's population deviation) describe the
    training table.
    """
    p = dict(params or {})
    if task == "regression":
        if name == "linear_regression":
            return LinearRegression(regParam=0.0, fitIntercept=p.get("fit_intercept", True))
        if name == "ridge":
            return LinearRegression(regParam=p.get("alpha", 1.0) / rows * spread, elasticNetParam=0.0, standardization=False)
        if name == "lasso":
            return LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=1.0, standardization=False)
        if name == "random_forest":
            return RandomForestRegressor(numTrees=p.get("n_estimators", 100), **_tree_settings(p))
        if name in ("gradient_boosting", "xgboost", "lightgbm"):
            return GBTRegressor(**_boost_settings(p))
        if name == "decision_tree":
            return DecisionTreeRegressor(**_tree_settings(p))
        if name == "adaboost":
            return AdaBoostRegressor(rounds=p.get("n_estimators", 50), learningRate=p.get("learning_rate", 1.0))
    if task == "classification":
        if name == "logistic_regression":
            mix = {"l1": 1.0, "l2": 0.0, "elasticnet": p.get("l1_ratio", 0.5)}[p.get("penalty", "l2")]
            return LogisticRegression(
                regParam=1.0 / (p.get("C", 1.0) * rows), elasticNetParam=mix, standardization=False, maxIter=p.get("max_iter", 1000)
            )
        if name == "random_forest":
            return RandomForestClassifier(numTrees=p.get("n_estimators", 100), **_tree_settings(p))
        if name in ("gradient_boosting", "xgboost", "lightgbm"):
            if classes <= 2:
                return GBTClassifier(**_boost_settings(p))
            b = _boost_settings(p)
            return SoftmaxBoosting(
                rounds=b["maxIter"], learningRate=b["stepSize"], maxDepth=b["maxDepth"], subsample=b["subsamplingRate"], seed=b["seed"],
                patience=p.get("n_iter_no_change") or 0, validation=p.get("validation_fraction", 0.1), tolerance=p.get("tol", 1e-4),
            )
        if name == "svm":
            return CalibratedSVC(regParam=1.0 / (p.get("C", 1.0) * rows), maxIter=p.get("max_iter", 100), folds=p.get("calibration_folds", 3))
        if name == "decision_tree":
            return DecisionTreeClassifier(**_tree_settings(p))
        if name == "adaboost":
            return AdaBoostClassifier(rounds=p.get("n_estimators", 50), learningRate=p.get("learning_rate", 1.0))
        if name == "naive_bayes":
            return NaiveBayes(modelType="gaussian")
        if name == "discriminant":
            return LinearDiscriminant()
        if name == "neural_network":
            hidden = list(p.get("hidden_layer_sizes", [100]))
            return MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=p.get("max_iter", 200), seed=SEED)
    if task == "clustering":
        if name == "kmeans":
            return KMeans(k=p.get("n_clusters", 8), seed=SEED, maxIter=p.get("max_iter", 300), predictionCol="cluster")
        if name == "hierarchical" and "linkage" in p:
            return Agglomerative(
                k=p.get("n_clusters", 2), linkage=p["linkage"], metric=p.get("metric", "euclidean"), **({"micro": p["micro"]} if "micro" in p else {})
            )
        if name == "hierarchical":
            return BisectingKMeans(k=p.get("n_clusters", 2), seed=SEED, predictionCol="cluster")
    raise ValueError(f"no estimator {name} for {task}")
