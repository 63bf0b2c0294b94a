"""Two-sample Kolmogorov-Smirnov drift between tables, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column, missing_to_null
from gridsmith.functions.tails import kolmogorov_p
from gridsmith.operators.columns import numeric_columns
from gridsmith.operators.cumulate import running_totals


def ks_distances(base: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, statistic, n_base, n_current`` of the numeric columns both tables share.

    Values are counted per side before anything is sorted, so repeated values
    cost one row each.
    """
    if columns is None:
        shared = set(numeric_columns(current))
        columns = [c for c in numeric_columns(base) if c in shared]
    return ks_from_counts(numeric_counts(base, columns), numeric_counts(current, columns))


def numeric_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n``: how often each present value of the numeric columns occurs; tables of disjoint rows add up."""
    wide = missing_to_null(df.select(*[as_column(c).cast("double").alias(c) for c in columns]))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value double, n bigint")
    long = wide.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def ks_from_counts(base: DataFrame, current: DataFrame) -> DataFrame:
    """``column, statistic, n_base, n_current`` of two tables given as ``numeric_counts``."""
    none = F.lit(0).cast("bigint")
    sides = base.select("column", "value", F.col("n").alias("n_base"), none.alias("n_current")).unionByName(
        current.select("column", "value", none.alias("n_base"), F.col("n").alias("n_current"))
    )
    counts = sides.groupBy("column", "value").agg(F.sum("n_base").alias("n_base"), F.sum("n_current").alias("n_current"))
    totals = running_totals(counts, "column", "value", ["n_base", "n_current"])
    gap = F.abs(
        (F.col("n_base_below") + F.col("n_base")) / F.nullif(F.col("n_base_total"), F.lit(0))
        - (F.col("n_current_below") + F.col("n_current")) / F.nullif(F.col("n_current_total"), F.lit(0))
    )
    return totals.groupBy("column").agg(
        F.max(gap).alias("statistic"), F.sum("n_base").alias("n_base"), F.sum("n_current").alias("n_current")
    )


def drift_report(
    base: DataFrame, current: DataFrame, threshold: float = 0.05, columns: list[str] | None = None
) -> DataFrame:
    """Every shared numeric column with its distance, p-value and verdict."""
    rows = [
        (r["column"], r["statistic"], p := kolmogorov_p(r["statistic"], r["n_base"], r["n_current"]),
         p is not None and p < threshold)
        for r in ks_distances(base, current, columns).collect()  # one row per column
    ]
    return base.sparkSession.createDataFrame(
        rows, "column string, statistic double, p_value double, drift_detected boolean"
    )


def drifted_columns(base: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    return drift_report(base, current, threshold).filter(F.col("drift_detected"))
