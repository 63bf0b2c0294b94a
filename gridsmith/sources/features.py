"""A store of versioned features: Parquet folders, their summaries and a registry table.

Registering writes the data, then what later comparisons need of it (the profile
of its columns and the counts of its numeric values), and the registry row last,
so a feature that is listed is complete. Checks and drift read the summaries and
scan the new table only.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.operators.columns import numeric_columns
from gridsmith.operators.drift import ks_from_counts, numeric_counts
from gridsmith.operators.profile import table_profile

REGISTRY_SCHEMA = "name string, version string, description string, tags array<string>, columns array<string>, created bigint"
DRIFT_THRESHOLD = 0.1
_COMPARED = ["column", "kind", "count", "missing", "mean", "std", "min", "max", "distinct", "min_date", "max_date"]


class FeatureStore:
    """Register, list, read, compare and check named features."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _registry(self) -> DataFrame:
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.path}/registry")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def _folder(self, name: str, version: str, kind: str = "data") -> str:
        return f"{self.path}/{kind}/name={name}/version={version}"

    def _summary(self, kind: str, name: str, version: str | None) -> DataFrame:
        """What was written beside the data; made from the data where it was registered without."""
        version = version or self.latest(name)
        try:
            return self.spark.read.parquet(self._folder(name, version, kind))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return _SUMMARIES[kind](self.get(name, version))

    def register(self, name: str, data: DataFrame, description: str = "", tags: list[str] | None = None) -> str:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        data.write.parquet(self._folder(name, version))
        stored = self.spark.read.schema(data.schema).parquet(self._folder(name, version))
        for kind, make in _SUMMARIES.items():
            make(stored).write.parquet(self._folder(name, version, kind))
        row = [(name, version, description, tags or [], data.columns, time.time_ns())]
        self.spark.createDataFrame(row, REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/registry")
        return version

    def versions(self) -> DataFrame:
        """``name, versions`` in order of registration."""
        return self._registry().groupBy("name").agg(F.sort_array(F.collect_list("version")).alias("versions"))

    def latest(self, name: str) -> str:
        found = self._registry().filter(F.col("name") == name).agg(F.max("version")).first()[0]
        if found is None:
            raise KeyError(name)
        return found

    def get(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self._folder(name, version or self.latest(name)))

    def check(self, name: str, data: DataFrame, version: str | None = None) -> DataFrame:
        """``feature_name, is_valid, same_schema, differing_columns``: schema and profile against the stored feature."""
        stored = self.get(name, version)
        same_schema = [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in data.schema]
        if not same_schema:
            return self.spark.createDataFrame(
                [(name, False, False, None)], "feature_name string, is_valid boolean, same_schema boolean, differing_columns bigint"
            )

        # One row per column on each side.
        differing = self._summary("profile", name, version).exceptAll(_profile(data)).select("column").distinct()
        return differing.agg(F.count(F.lit(1)).alias("differing_columns")).select(
            F.lit(name).alias("feature_name"),
            (F.col("differing_columns") == 0).alias("is_valid"),
            F.lit(True).alias("same_schema"),
            "differing_columns",
        )

    def drift(self, name: str, data: DataFrame, threshold: float = DRIFT_THRESHOLD, version: str | None = None) -> DataFrame:
        """``feature_name, drift_score, threshold, drift_detected``: the largest distance over the columns."""
        counts = self._summary("counts", name, version)
        shared = sorted({r["column"] for r in counts.select("column").distinct().collect()} & set(numeric_columns(data)))  # one row per column
        distances = ks_from_counts(counts.filter(F.col("column").isin(shared)), numeric_counts(data, shared))
        score = F.coalesce(F.max("statistic"), F.lit(0.0))
        return distances.agg(score.alias("drift_score")).select(
            F.lit(name).alias("feature_name"), "drift_score", F.lit(float(threshold)).alias("threshold"), (F.col("drift_score") > threshold).alias("drift_detected")
        )


def _profile(df: DataFrame) -> DataFrame:
    """What is compared of every column, to nine places."""
    p = table_profile(df).drop("top_values")
    kept = [c for c in _COMPARED if c in p.columns]
    return p.select(*[F.round(c, 9).alias(c) if dict(p.dtypes)[c] == "double" else F.col(c) for c in kept])


_SUMMARIES = {"profile": _profile, "counts": lambda df: numeric_counts(df, numeric_columns(df))}
