"""Leak-free training, cross-validation, search, learning curves and batches of models.

The sides of a cross-validation share one scan of statistics, a training side is
prepared once for all models and settings, and fits that do not depend on each
other are submitted together, a bounded number at a time.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.operators import cluster_metrics as K
from gridsmith.operators import metrics as M
from gridsmith.operators.checks import training_data_check
from gridsmith.operators.codes import MAX_CLASSES, class_levels, encode_labels
from gridsmith.operators.density import dbscan
from gridsmith.operators.discriminant import LinearDiscriminantModel
from gridsmith.operators.fold_statistics import fit_from, gather
from gridsmith.operators.neighbors import knn_predict, smote
from gridsmith.operators.sampling import SEED, assign_folds, hash_order, train_test_split
from gridsmith.operators.stages import DecodeLabels, Preprocessor, RestoreLabels
from gridsmith.plans.catalog import build, search_grid
from gridsmith.session import cut_lineage
from gridsmith.sources.runs import RUN_SCHEMA

SCORES = {"classification": "accuracy", "regression": "r2"}
TRAIN_SHARES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
#: Fits that are submitted at once.
PARALLEL = 4
#: Numbers of training rows that one task reads at least, where there are more tasks than cores: 32 MB.
TASK_CELLS = 4_000_000
#: Classes up to which a run holds the report of each and the cells of the confusion matrix.
REPORTED_CLASSES = 100


def together(spark: SparkSession, work: Callable, items: list, parallel: int = PARALLEL) -> list:
    """``work`` of every item, a bounded number at a time, in order."""
    if len(items) < 2 or parallel < 2:
        return [work(x) for x in items]
    with ThreadPool(min(parallel, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


class NearestModel:
    """A k-NN model: the prepared training rows are the model, with their labels as they are."""

    def __init__(self, prepare: Transformer, train: DataFrame, key: str, params: dict, task: str, classes: list[str] | None = None):
        self.prepare, self.train, self.key, self.params, self.task, self.classes = prepare, train, key, params, task, classes

    def release(self) -> None:
        """Give the cached training rows back."""
        self.train.unpersist()

    def save(self, path: str) -> None:
        """The training rows as Parquet, the preparation as a pipeline, and the settings as one JSON row."""
        self.prepare.write().overwrite().save(f"{path}/prepare")
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        settings = json.dumps({"key": self.key, "params": self.params, "task": self.task, "classes": self.classes})
        self.train.sparkSession.createDataFrame([(settings,)], "value string").write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NearestModel:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        return cls(PipelineModel.load(f"{path}/prepare"), spark.read.parquet(f"{path}/train"), **settings)

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.prepare.transform(df)
        guesses = knn_predict(
            self.train, ready, self.key, "features", "label", self.params.get("n_neighbors", 5), self.params.get("weights", "uniform"), self.task
        )
        found = ready.join(guesses, self.key)
        return DecodeLabels(self.classes).transform(found) if self.classes else found


def release(model) -> None:
    """Free what a model holds in memory, if it does."""
    if isinstance(model, NearestModel):
        model.release()


@dataclass
class Recipe:
    """What ``fit_model`` is told besides the rows; calling it fits."""

    key: str
    roles: dict
    task: str
    name: str
    params: dict | None = None
    config: dict | None = None
    smote_options: dict | None = None
    classes: list[str] | None = None

    def __call__(self, train: DataFrame):
        return fit_model(train, self.key, self.roles, self.task, self.name, self.params, self.config, self.smote_options, self.classes)


def _prepared(train: DataFrame, key: str, roles: dict, config: dict | None) -> PipelineModel:
    """The fitted preparation, from one scan of statistics where they tell all it learns."""
    states = gather(train, roles, config, F.lit(0))
    if states:
        return fit_from(train.sparkSession, list(states.values()), roles, config)
    return Preprocessor(roles=roles, config={**(config or {}), "keys": [key]}).fit(train)


class TrainingSide:
    """Training rows prepared once for any number of models: the fitted preparation and the cached vectors with their labels."""

    def __init__(self, train: DataFrame, key: str, roles: dict, task: str, config=None, smote_options=None, names=None, prepare: PipelineModel | None = None):
        self.key, self.task, self.names, self.kept = key, task, names, False
        own = prepare is None and not train.is_cached
        if own:
            train = train.persist()
        try:
            self.prepare = prepare or _prepared(train, key, roles, config)
            ready = self.prepare.transform(train)
            if smote_options is not None and task == "classification":
                labelled = ready.select(key, "features", as_column("label").cast("double").alias("label"))
                grown = smote(labelled, key, "features", "label", **smote_options)
                ready = grown.select(as_column(key), array_to_vector("x").alias("features"), "label")
            ready = ready.select(as_column(key), "features", as_column("label").cast("double").alias("label")).dropna(subset=["label"])
            # Learners read these rows once an iteration, and each task of it answers the driver with counters of all
            # steps that made the rows: they are written once, and dealt to no more tasks than they need.
            self.ready = cut_lineage(ready)
            self._shape()
            cores = train.sparkSession.sparkContext.defaultParallelism
            self.ready = self.ready.coalesce(max(cores, math.ceil(self.rows * (self.width or 1) / TASK_CELLS))).persist()
        finally:
            if own:
                train.unpersist()

    def _shape(self) -> None:
        """Rows, width and the classes or the deviation of the labels, by one query."""
        width = F.max(F.size(vector_to_array("features")))
        if self.task == "classification":
            found = self.ready.groupBy("label").agg(F.count(F.lit(1)).alias("n"), width.alias("width")).limit(MAX_CLASSES + 1).collect()
            if len(found) > MAX_CLASSES:
                raise ValueError(f"label has more than {MAX_CLASSES} classes")
            self.counts = {r["label"]: r["n"] for r in sorted(found, key=lambda r: r["label"])}
            self.rows, self.spread = sum(self.counts.values()), 1.0
            self.width = max((r["width"] for r in found), default=0)
        else:
            self.rows, self.width, spread = self.ready.agg(F.count(F.lit(1)), width, F.stddev_pop("label")).first()
            self.counts, self.spread = {}, spread or 1.0

    def _coded(self) -> tuple[DataFrame, list, int]:
        """The rows with labels as places of an array, the stages that undo that, and the number of places."""
        if self.task != "classification":
            return self.ready, [], 0
        labels = list(self.counts)
        if labels == [float(i) for i in range(len(labels))]:
            return self.ready, [], max(len(labels), 1)
        # Learners take classes as places of an array, so gaps and negative labels are closed up and restored.
        places = F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, float(i))])
        return self.ready.withColumn("label", places[F.col("label")]), [RestoreLabels(labels)], len(labels)

    def fit(self, name: str, params: dict | None = None):
        """A model from raw rows to predictions."""
        if name == "knn":
            self.ready.count()  # held before the raw rows are let go
            self.kept = True
            return NearestModel(self.prepare, self.ready, self.key, params or {}, self.task, self.names)
        return PipelineModel([self.prepare, *self.learned(name, params)])

    def learned(self, name: str, params: dict | None = None) -> list:
        """The stages behind the preparation: a fitted learner, and what brings labels back."""
        rows, after, classes = self._coded()
        if (params or {}).get("class_weight") == "balanced":
            # Weight n / (K * n_class) of each row, as a literal map over the classes.
            weights = [F.lit(float(x)) for i, n in enumerate(self.counts.values()) for x in (i, self.rows / (len(self.counts) * n))]
            rows = rows.withColumn("class_weight", F.create_map(*weights)[F.col("label")])
        model = build(self.task, name, params, self.rows, classes, self.width, self.spread).fit(rows)
        return [model, *after, *([DecodeLabels(self.names)] if self.names else [])]

    def predictions(self, name: str, params: dict | None, ready: DataFrame, raw: DataFrame) -> DataFrame:
        """Predictions of a model that is not kept, for rows given prepared and raw."""
        if name == "knn":
            return NearestModel(self.prepare, self.ready, self.key, params or {}, self.task, self.names).transform(raw)
        return PipelineModel(self.learned(name, params)).transform(ready)

    def close(self) -> None:
        """Let the cached rows go, unless a k-NN model was made of them."""
        if not self.kept:
            self.ready.unpersist()


def fit_model(
    train: DataFrame,
    key: str,
    roles: dict,
    task: str,
    name: str,
    params: dict | None = None,
    config: dict | None = None,
    smote_options: dict | None = None,
    classes: list[str] | None = None,
):
    """Prepare, resample, fit: every step sees training rows only.

    ``train`` has a ``label`` column; classes may have any numbers as labels and
    are predicted by them. With the names ``classes`` of the codes, predictions
    are decoded too. The result maps raw rows to predictions and can be saved.
    """
    side = TrainingSide(train, key, roles, task, config, smote_options, classes)
    try:
        return side.fit(name, params)
    finally:
        side.close()


def score(predictions: DataFrame, task: str) -> float:
    """Accuracy or R2 of a prediction table."""
    if task == "classification":
        return M.classification_metrics(predictions).first()["accuracy"]
    return M.regression_metrics(predictions).first()["r2"]


def validate(
    df: DataFrame, key: str, roles: dict, task: str, candidates: list[tuple[str, dict | None]], k: int = 5, config: dict | None = None, smote_options: dict | None = None,
    seed: int = SEED, parallel: int = PARALLEL,
) -> list[list]:
    """Scores of every candidate ``(model, settings)`` on every fold; a candidate that fails has its error in their place.

    The rows are scanned once for what all k preparations learn, a fold's
    training side is prepared once for all candidates, and the fits of a fold
    are submitted together.
    """
    folded = assign_folds(df, [key], k, "label" if task == "classification" else None, seed).persist()
    scores: list[list] = [[] for _ in candidates]
    try:
        states = gather(folded, roles, config, F.col("fold"))
        for fold in range(k):
            train, test = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")
            prepare = None if states is None else fit_from(df.sparkSession, [s for f, s in states.items() if f != fold], roles, config)
            side = TrainingSide(train, key, roles, task, config, smote_options, None, prepare)
            ready = side.prepare.transform(test).persist()

            def work(candidate, side=side, ready=ready, test=test):
                try:
                    return score(side.predictions(*candidate, ready, test), task)
                except Exception as problem:  # told for this candidate, the others go on
                    return problem

            for i, found in enumerate(together(df.sparkSession, work, candidates, parallel)):
                scores[i].append(found)
            side.close()
            ready.unpersist()
    finally:
        folded.unpersist()
    return [next(([x] for x in found if isinstance(x, Exception)), found) for found in scores]


def cross_validate(df: DataFrame, key: str, fit: Callable, task: str, k: int = 5, seed: int = SEED, parallel: int = PARALLEL) -> DataFrame:
    """``fold, score`` of k fits, each scored on the rows it has not seen; a ``Recipe`` shares one scan of statistics."""
    spark = df.sparkSession
    if isinstance(fit, Recipe):
        (values,) = validate(df, key, fit.roles, task, [(fit.name, fit.params)], k, fit.config, fit.smote_options, seed, parallel)
        if values and isinstance(values[0], Exception):
            raise values[0]
        return spark.createDataFrame(list(enumerate(values)), "fold int, score double")
    folded = assign_folds(df, [key], k, "label" if task == "classification" else None, seed).persist()

    def one(fold):
        model = fit(folded.filter(F.col("fold") != fold).drop("fold"))
        value = score(model.transform(folded.filter(F.col("fold") == fold).drop("fold")), task)
        release(model)
        return fold, value

    try:
        rows = together(spark, one, list(range(k)), parallel)
    finally:
        folded.unpersist()
    return spark.createDataFrame(rows, "fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("folds"))


def _mean_and_deviation(values: list) -> tuple[float | None, float | None]:
    found = [v for v in values if v is not None]
    if not found:
        return None, None
    mean = sum(found) / len(found)
    return mean, (sum((v - mean) ** 2 for v in found) / len(found)) ** 0.5


def _best(rows: list[tuple]) -> int:
    """Place of the largest mean, the first of equals; without any mean the first setting."""
    return max(range(len(rows)), key=lambda i: (rows[i][2] is not None, rows[i][2] or 0.0, -i))


def grid_search(
    df: DataFrame, key: str, roles: dict, task: str, name: str, grid: list[dict] | None = None, k: int = 5, config: dict | None = None, smote_options: dict | None = None,
    classes: list[str] | None = None,
):
    """Cross-validate every setting and refit the best: (model, settings, table of scores)."""
    grid = grid if grid is not None else search_grid(task, name)
    found = validate(df, key, roles, task, [(name, p) for p in grid], k, config, smote_options)
    rows = []
    for i, (params, values) in enumerate(zip(grid, found, strict=True)):
        if values and isinstance(values[0], Exception):
            raise values[0]
        rows.append((i, str(params), *_mean_and_deviation(values)))
    best = grid[_best(rows)]
    table = df.sparkSession.createDataFrame(rows, "candidate int, params string, mean double, std double")
    return fit_model(df, key, roles, task, name, best, config, smote_options, classes), best, table


def fit_clusters(df: DataFrame, key: str, features: str, name: str, params: dict | None = None) -> DataFrame:
    """Add ``cluster`` by one clustering model; DBSCAN has no model beyond its labels."""
    p = params or {}
    if name == "dbscan":
        found = dbscan(df, key, features, p.get("eps", 0.5), p.get("min_samples", 5), p.get("metric", "euclidean"))
        return df.join(found, key)
    return build("clustering", name, p).fit(df).transform(df)


def cluster_search(df: DataFrame, key: str, features: str, name: str, grid: list[dict] | None = None, exact: bool = False):
    """The setting with the best silhouette: (settings, table of scores).

    The silhouette is the linear-cost one over squared distances; ``exact`` asks
    for the quadratic Euclidean one.
    """
    grid = grid if grid is not None else search_grid("clustering", name)
    rows = []
    data = df.persist()
    try:
        for i, params in enumerate(grid):
            labelled = fit_clusters(data, key, features, name, params).persist()
            n = K.cluster_sizes(labelled).count()
            value = None
            if n >= 2:
                one = K.silhouette(labelled, key, features) if exact else K.silhouette_sq_euclidean(labelled, features)
                value = one.first()[0]
            rows.append((i, str(params), n, value))
            labelled.unpersist()
    finally:
        data.unpersist()
    table = df.sparkSession.createDataFrame(rows, "candidate int, params string, n_clusters bigint, silhouette_score double")
    valid = [r for r in rows if r[3] is not None]
    if not valid:
        raise ValueError("no setting gave two clusters")
    return grid[max(valid, key=lambda r: r[3])[0]], table


def learning_curve(
    df: DataFrame, key: str, fit: Callable, task: str, shares: list[float] | None = None, k: int = 5, seed: int = SEED, parallel: int = PARALLEL,
) -> DataFrame:
    """``share, train_rows, train_mean, train_std, test_mean, test_std`` over growing training sets.

    A share is a prefix of the hash order, so smaller sets lie within larger ones.
    A ``Recipe`` reads what all preparations learn from one scan, grouped by fold
    and by the first share that a row belongs to.
    """
    shares, spark = shares or TRAIN_SHARES, df.sparkSession
    place = F.conv(F.substring(hash_order([key], seed + 1), 1, 8), 16, 10).cast("double") / float(16**8)
    band = F.array_position(F.transform(F.array(*[F.lit(s) for s in sorted(shares)]), lambda s: F.col("_place") < s), True)
    folded = assign_folds(df, [key], k, "label" if task == "classification" else None, seed).withColumn("_place", place).persist()
    try:
        states = None
        if isinstance(fit, Recipe):
            states = gather(folded, fit.roles, fit.config, F.struct("fold", band.alias("band")))

        def one(item):
            share, fold = item
            train = folded.filter((F.col("fold") != fold) & (F.col("_place") < share)).drop("fold", "_place")
            test = folded.filter(F.col("fold") == fold).drop("fold", "_place")
            if not isinstance(fit, Recipe):
                model = fit(train)
                found = (share, fold, train.count(), score(model.transform(train), task), score(model.transform(test), task))
                release(model)
                return found
            prepare = None
            if states is not None:
                # Band 0 lies beyond all shares.
                sides = [s for g, s in states.items() if g["fold"] != fold and g["band"] and sorted(shares)[g["band"] - 1] <= share]
                prepare = fit_from(spark, sides, fit.roles, fit.config)
            side = TrainingSide(train, key, fit.roles, task, fit.config, fit.smote_options, None, prepare)
            try:
                model = side.fit(fit.name, fit.params)
                rows = side.rows if fit.smote_options is None else train.count()
                return share, fold, rows, score(model.transform(train), task), score(model.transform(test), task)
            finally:
                side.kept = False
                side.close()

        rows = together(spark, one, [(s, f) for s in shares for f in range(k)], parallel)
    finally:
        folded.unpersist()
    table = spark.createDataFrame(rows, "share double, fold int, train_rows bigint, train_score double, test_score double")
    return table.groupBy("share").agg(
        F.avg("train_rows").alias("train_rows"),
        F.avg("train_score").alias("train_mean"), F.stddev_pop("train_score").alias("train_std"),
        F.avg("test_score").alias("test_mean"), F.stddev_pop("test_score").alias("test_std"),
    )


def train_models(
    df: DataFrame,
    key: str,
    roles: dict,
    target: str | None,
    task: str,
    names: list[str],
    params: dict[str, dict] | None = None,
    config: dict | None = None,
    smote_options: dict | None = None,
    test_share: float = 0.2,
    model_folder: str | None = None,
    optimize: bool = False,
    grids: dict[str, list[dict]] | None = None,
    folds: int = 5,
    parallel: int = PARALLEL,
) -> tuple[DataFrame, dict]:
    """Train several models on one split: (runs table, fitted models by name).

    A model that fails is a run with its error; the others go on. The models
    share one split, prepared once, and are fitted and evaluated together, up to
    ``parallel`` at a time. Classes of any type are coded for the learners and
    decoded in ``predicted_class``. With ``optimize`` the settings of all models
    are searched by one cross-validation (over ``grids`` where given), and its mean
    and deviation are metrics of the run; the settings used are its parameters.
    The metrics of a run also hold the error statistics, or for up to
    ``REPORTED_CLASSES`` classes each class's report (``class.<name>.recall``) and
    the confusion matrix (``confusion.<name>.<predicted>``).
    """
    spark, params = df.sparkSession, params or {}
    features = [c for names_ in roles.values() for c in names_]
    failed = training_data_check(df, features, target, task).filter("level = 'error' and not ok").collect()
    if failed:
        raise ValueError("training data refused: " + ", ".join(r["rule"] for r in failed))
    models, settings = {}, {n: {k: str(v) for k, v in p.items()} for n, p in params.items()}
    if task == "clustering":
        prepared = Preprocessor(roles=roles, config={**(config or {}), "keys": [key]}).fit(df).transform(df).persist()
        rows = together(spark, lambda name: _run(name, task, lambda: _cluster_run(prepared, key, name, params.get(name), models), settings), names, parallel)
        prepared.unpersist()
        return spark.createDataFrame(rows, RUN_SCHEMA), models
    classes = class_levels(df, target) if task == "classification" else None
    labelled = encode_labels(df, target, classes=classes).filter(F.col("label").isNotNull())
    train, test = train_test_split(labelled, [key], test_share, "label" if task == "classification" else None)
    train, test = train.persist(), test.persist()
    searched: dict[str, list] = {}
    if optimize:
        tried = {n: [{**(params.get(n) or {}), **p} for p in (grids or {}).get(n) or search_grid(task, n)] for n in names}
        found = validate(train, key, roles, task, [(n, p) for n in names for p in tried[n]], folds, config, smote_options, parallel=parallel)
        for n in names:
            searched[n] = [(p, found.pop(0)) for p in tried[n]]
    side = TrainingSide(train, key, roles, task, config, smote_options, classes)
    ready = side.prepare.transform(test).persist()
    ready.count()

    def work(name):
        used, extra = params.get(name) or {}, {}
        if optimize:
            rows = []
            for i, (p, values) in enumerate(searched[name]):
                if values and isinstance(values[0], Exception):
                    raise values[0]
                rows.append((i, str(p), *_mean_and_deviation(values)))
            best = _best(rows)
            used, extra = searched[name][best][0], {"cv_mean": rows[best][2], "cv_std": rows[best][3]}
        model = models[name] = side.fit(name, used)
        settings[name] = {k: str(v) for k, v in used.items()}
        if model_folder and isinstance(model, NearestModel):
            model.save(f"{model_folder}/{name}")
        elif model_folder:
            model.write().overwrite().save(f"{model_folder}/{name}")
        predicted = model.transform(test) if name == "knn" else PipelineModel(model.stages[1:]).transform(ready)
        return _evaluated(predicted, key, task, classes) | extra

    try:
        rows = together(spark, lambda name: _run(name, task, lambda: work(name), settings), names, parallel)
    finally:
        side.close()
        ready.unpersist()
    return spark.createDataFrame(rows, RUN_SCHEMA), models


def _evaluated(predicted: DataFrame, key: str, task: str, classes: list[str] | None) -> dict:
    """All metrics of a run: totals, and error statistics or the report of each class and the confusion matrix."""
    wanted = ["prediction", "label", key] + (["probability"] if "probability" in predicted.columns else [])
    predicted = predicted.select(*[as_column(c) for c in wanted]).persist()
    try:
        found = {r["metric"]: r["value"] for r in M.evaluate(predicted, task, details=len(classes or []) <= REPORTED_CLASSES, classes=classes).collect() if r["value"] is not None}
        if "probability" in wanted and task == "classification":
            width = predicted.select(F.size(vector_to_array("probability"))).first()[0]
            codes = [1.0] if width == 2 else [float(c) for c in range(width)]
            opened = predicted.withColumn("_p", vector_to_array("probability"))
            scores = {str(c): F.col("_p")[int(c)] for c in codes}
            found["roc_auc"] = M.roc_auc(M.score_counts_by_class(opened, "label", scores)).first()[0]
    finally:
        predicted.unpersist()
    return found


def _cluster_run(prepared: DataFrame, key: str, name: str, params: dict | None, models: dict) -> dict:
    labelled = fit_clusters(prepared, key, "features", name, params).select(key, "features", "cluster").persist()
    models[name] = labelled
    health = K.cluster_health(labelled, "features").first()
    out = {"n_clusters": float(health["n_clusters"]), "n_noise": float(health["n_noise"])}
    if health["n_clusters"] >= 2:
        # Prepared vectors, not raw columns, are what was clustered.
        out["silhouette_score"] = K.silhouette_sq_euclidean(labelled, "features").first()[0]
        out["davies_bouldin_score"] = K.davies_bouldin(labelled, "features").first()[0]
        out["calinski_harabasz_score"] = K.calinski_harabasz(labelled, "features").first()[0]
    return out


def _run(name: str, task: str, work: Callable, settings: dict[str, dict] | None = None) -> tuple:
    start, error, found = time.time(), None, {}
    try:
        found = work()
    except Exception as problem:  # a failed model is a result, not the end of the batch
        error = str(problem)[:500]
    status = "FAILED" if error else "FINISHED"
    metrics = {k: float(v) for k, v in found.items() if v is not None}
    return (uuid.uuid4().hex, name, task, status, error is None, time.time() - start, metrics, (settings or {}).get(name, {}), error, int(start * 1000))


def feature_importance(model: PipelineModel, prepared: DataFrame, features: str = "features", top: int | None = None) -> DataFrame:
    """``feature, importance``: tree importances, or absolute coefficients averaged over classes; with ``top`` the largest.

    The learner is the last stage that has either; what brings labels back may follow it.
    """
    values = next((v for v in map(_importances, reversed(model.stages)) if v is not None), None)
    if values is None:
        raise ValueError("the model has neither importances nor coefficients")
    rows = sorted(zip(feature_names(prepared, features, len(values)), map(float, values)), key=lambda r: (-r[1], r[0]))[:top]
    return prepared.sparkSession.createDataFrame(rows, "feature string, importance double")


def _importances(stage):
    import numpy as np

    if hasattr(stage, "featureImportances"):
        return stage.featureImportances.toArray()
    if hasattr(stage, "coefficientMatrix"):
        return np.abs(stage.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(stage, "coefficients"):
        return np.abs(np.array(stage.coefficients)).reshape(-1)
    if hasattr(stage, "models"):  # one of these per class
        each = [_importances(m) for m in stage.models]
        return None if any(v is None for v in each) else np.mean(each, axis=0)
    if isinstance(stage, LinearDiscriminantModel):
        weights = np.array(stage.value()["weights"])
        # What all classes share tells none apart.
        return np.abs(weights - weights.mean(axis=0)).mean(axis=0)
    return None


def feature_names(prepared: DataFrame, features: str, width: int) -> list[str]:
    """Names from the vector's metadata, by position."""
    attributes = prepared.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", f"f{a['idx']}") for kind in attributes.values() for a in kind}
    return [names.get(i, f"f{i}") for i in range(width)]


def linear_contributions(df: DataFrame, coefficients: dict[str, float], top: int | None = None) -> DataFrame:
    """``feature, contribution``: mean absolute share of each column in a linear prediction; with ``top`` the largest."""
    names = list(coefficients)
    means = df.agg(*[F.avg(as_column(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    parts = [
        F.avg(F.abs(F.lit(float(coefficients[c])) * (as_column(c) - F.lit(float(means[i]))))).alias(f"v{i}")
        for i, c in enumerate(names)
    ]
    one = df.agg(*parts)
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("contribution")) for i, c in enumerate(names)]
    found = one.select(F.inline(F.array(*structs))).orderBy(F.desc("contribution"), "feature")
    return found if top is None else found.limit(top)
