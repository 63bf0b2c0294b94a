"""Comparison, grading and summary of model runs.

A run is one row: ``run_id, model_name, task, status, success, training_time,
metrics`` with ``metrics`` a map from name to number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.operators.columns import keep_members

# What makes a result excellent or good, per task.
GRADES = {
    "classification": ("accuracy", 0.9, 0.7),
    "regression": ("r2", 0.8, 0.5),
    "clustering": ("silhouette_score", 0.7, 0.5),
}
SUMMARY_STATUS = ((0.8, "excellent"), (0.6, "bon"))
SUMMARY_ELSE = "à améliorer"

# Metric names and name parts that give a task away, first hit wins.
TASK_METRICS = {
    "classification": ["accuracy", "precision", "recall", "f1_score", "roc_auc"],
    "regression": ["r2", "mse", "mae", "rmse"],
    "clustering": ["silhouette_score", "calinski_harabasz_score", "davies_bouldin_score"],
}
TASK_WORDS = {
    "clustering": ["kmeans", "dbscan", "gmm", "gaussianmixture", "hierarchical", "agglomerative"],
    "regression": ["regression", "regressor", "linear", "lasso", "ridge"],
    "classification": ["classifier", "classification", "logistic", "randomforest", "xgboost"],
}
COMPARISON_METRICS = {
    "classification": ["accuracy", "f1_score", "precision", "recall", "roc_auc"],
    "regression": ["r2", "mae", "rmse", "mse"],
    "clustering": ["silhouette_score", "n_clusters", "davies_bouldin_score"],
}
PRIMARY = {"classification": "accuracy", "regression": "r2", "clustering": "silhouette_score"}
WIDE_SPREAD = 0.1
_FINITE = float("inf")


def _metric(name: str) -> Column:
    return F.try_element_at(F.col("metrics"), F.lit(name))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != _FINITE)


def long_metrics(runs: DataFrame) -> DataFrame:
    """``run_id, model_name, metric, value`` of the numbers that are not NaN."""
    return runs.select("run_id", "model_name", F.explode("metrics").alias("metric", "value")).filter(
        ~F.isnan("value")
    )


def metric_summary(runs: DataFrame) -> DataFrame:
    """Mean, population deviation, range and count per metric."""
    return long_metrics(runs).groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count(F.lit(1)).alias("count"),
    )


def rank_models(runs: DataFrame) -> DataFrame:
    """``rank, model_name, metric, score`` by the first of accuracy, R2, silhouette, MSE found.

    The runs table holds one row per trained model, so one window orders it.
    """
    order = ["accuracy", "r2", "silhouette_score", "mse"]
    present = F.array_compact(
        F.array(*[F.when(F.max(F.map_contains_key("metrics", m)), F.lit(m)) for m in order])
    )
    chosen = runs.agg(F.try_element_at(present, F.lit(1)).alias("metric")).first()[0]
    if chosen is None:
        return runs.sparkSession.createDataFrame([], "rank int, model_name string, metric string, score double")
    score = _metric(chosen)
    valid = runs.filter(_finite(score)).select("model_name", F.lit(chosen).alias("metric"), score.alias("score"))
    direction = F.asc("score") if chosen == "mse" else F.desc("score")
    by_score = Window.partitionBy("metric").orderBy(direction, F.asc("model_name"))
    return valid.withColumn("rank", F.row_number().over(by_score))


def best_model(runs: DataFrame) -> DataFrame:
    return rank_models(runs).filter(F.col("rank") == 1)


def best_by_task(runs: DataFrame, task: str) -> DataFrame:
    """The best run of a task; F1 breaks ties among classifiers."""
    first = F.coalesce(_metric(PRIMARY[task]), F.lit(0.0 if task == "classification" else -999.0))
    second = F.coalesce(_metric("f1_score"), F.lit(0.0)) if task == "classification" else F.lit(0.0)
    scored = runs.filter(F.col("task") == task).select("model_name", first.alias("score"), second.alias("_second"))
    return scored.orderBy(F.desc("score"), F.desc("_second"), "model_name").limit(1).drop("_second")


def grade_models(runs: DataFrame) -> DataFrame:
    """``run_id, model_name, task, primary_metric, primary_score, status``."""
    metric, score, grade = F.lit(None).cast("string"), F.lit(0.0), F.lit("UNKNOWN")
    for task, (name, high, good) in GRADES.items():
        mine = F.col("task") == task
        value = F.coalesce(_metric(name), F.lit(0.0))
        metric = F.when(mine, F.lit(name)).otherwise(metric)
        score = F.when(mine, value).otherwise(score)
        level = F.when(value > high, "EXCELLENT").when(value > good, "GOOD").otherwise("NEEDS_IMPROVEMENT")
        grade = F.when(mine, level).otherwise(grade)
    grade = F.when(~F.col("success"), F.lit("FAILED")).otherwise(grade)
    return runs.select(
        "run_id", "model_name", "task", metric.alias("primary_metric"), score.alias("primary_score"), grade.alias("status")
    )


def report_status(runs: DataFrame) -> DataFrame:
    """The three-step status of the printed report."""
    graded = grade_models(runs).select("run_id", "primary_metric", "primary_score")
    (high, top), (good, middle) = SUMMARY_STATUS
    v = F.col("primary_score")
    return graded.withColumn("status", F.when(v > high, top).when(v > good, middle).otherwise(SUMMARY_ELSE))


def infer_task(runs: DataFrame, distinct_labels: str | None = None, has_clusters: str | None = None) -> DataFrame:
    """Add ``inferred_task``: by metric names, else model name, else what labels came with it."""
    cases = None
    names = F.map_keys("metrics")
    for task, metrics in TASK_METRICS.items():
        hit = F.arrays_overlap(names, F.array(*[F.lit(m) for m in metrics]))
        cases = F.when(hit, task) if cases is None else cases.when(hit, task)
    lowered = F.lower("model_name")
    for task, words in TASK_WORDS.items():
        cases = cases.when(lowered.rlike("|".join(words)), task)
    if distinct_labels:
        few = as_column(distinct_labels)
        clustered = as_column(has_clusters) if has_clusters else F.lit(False)
        cases = cases.when(few.isNotNull() & ~clustered & (few <= 20), "classification")
        cases = cases.when(few.isNotNull() & ~clustered, "regression")
        cases = cases.when(few.isNull() & clustered, "clustering")
    return runs.withColumn("inferred_task", cases.otherwise("unknown"))


def vote_task(runs: DataFrame) -> DataFrame:
    """The most frequent known task over the runs; ties by name."""
    return (
        infer_task(runs)
        .filter(F.col("inferred_task") != "unknown")
        .groupBy("inferred_task")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "inferred_task")
        .limit(1)
    )


def runs_wide(
    runs: DataFrame,
    metrics: list[str],
    statuses: list[str] | None = None,
    models: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Runs filtered by status and model with one column per metric; with ``limit`` the first so many."""
    if statuses is not None:
        runs = keep_members(runs, "status", statuses)
    if models is not None:
        runs = keep_members(runs, "model_name", models)
    picked = runs.select("run_id", "model_name", "status", *[_metric(m).alias(m) for m in metrics])
    return picked.orderBy("run_id").limit(limit) if limit else picked


def comparison_table(runs: DataFrame, task: str) -> DataFrame:
    """One row per run of a task: state, time and the task's metrics."""
    return runs.filter(F.col("task") == task).select(
        "model_name",
        "success",
        "training_time",
        *[F.when(F.col("success"), _metric(m)).alias(m) for m in COMPARISON_METRICS[task]],
    )


def success_rate(runs: DataFrame) -> DataFrame:
    """``total, failed, success_rate`` in percent."""
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.avg(F.col("success").cast("int")) * 100, F.lit(0.0)).alias("success_rate"),
    )


def split_results(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return runs.filter(F.col("success")), runs.filter(~F.col("success"))


def results_advice(runs: DataFrame, task: str) -> DataFrame:
    """``successful, failed, best_model, primary_std, wide_spread, advise_tuning``; one row."""
    score = F.when(F.col("success"), _metric(PRIMARY[task]))
    value = F.when(_finite(score), score)
    stats = runs.agg(
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.min(F.when(value.isNotNull(), F.struct((-value).alias("s"), F.col("model_name").alias("m")))).alias("_best"),
        F.stddev_pop(value).alias("primary_std"),
    )
    return stats.select(
        "successful",
        "failed",
        F.col("_best.m").alias("best_model"),
        "primary_std",
        F.coalesce(F.col("primary_std") > WIDE_SPREAD, F.lit(False)).alias("wide_spread"),
        (F.col("successful") < (F.col("successful") + F.col("failed")) / 2).alias("advise_tuning"),
    )
