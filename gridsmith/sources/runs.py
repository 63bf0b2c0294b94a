"""An append-only table of model runs, and its exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, model_name string, task string, status string, success boolean, training_time double, "
    "metrics map<string, double>, params map<string, string>, error string, start_time bigint"
)


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs with an id, a status and a start time; NaN metrics are left out."""
    kept = runs.filter(
        (F.coalesce(F.length("run_id"), F.lit(0)) > 0) & (F.coalesce(F.length("status"), F.lit(0)) > 0) & F.col("start_time").isNotNull()
    )
    return kept.withColumn("metrics", F.map_filter("metrics", lambda k, v: v.isNotNull() & ~F.isnan(v)))


def append_runs(runs: DataFrame, path: str) -> None:
    valid_runs(runs).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON record per run or metric."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
