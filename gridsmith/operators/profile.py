"""Column profiles, distributions and column quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column, missing_to_null, nan_to_null
from gridsmith.operators.columns import (
    INTEGRALS,
    keep_top_categories,
    numeric_columns,
    other_columns,
    rows_from,
    simple_columns,
    stacked,
    time_columns,
)
from gridsmith.operators.counting import (
    distinct_counts,
    distinct_within,
    missing_counts,
    value_counts,
)
from gridsmith.operators.cumulate import exact_quantiles, grouped_quantiles

QUARTILES = [0.25, 0.5, 0.75]
# Aggregates per job are cut at this many columns to bound the generated code.
COLUMNS_PER_JOB = 24
TOP_VALUES_LIMIT = 20


def _chunks(columns: list[str]) -> list[list[str]]:
    return [columns[i : i + COLUMNS_PER_JOB] for i in range(0, len(columns), COLUMNS_PER_JOB)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numeric_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, missing, mean, sample deviation, range and skewness per numeric column.

    The columns are stacked, so one small aggregate serves any number of them
    in one scan, and each task sends one row per column to the shuffle.
    """
    columns = columns if columns is not None else numeric_columns(df)
    wide = df.select(*[nan_to_null(as_column(c).cast("double")).alias(f"{i}") for i, c in enumerate(columns)])
    v = F.col("v")
    stats = stacked(wide).groupBy("i").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("g"),
    )
    # A table without rows still has its columns.
    labels = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column")) for i, c in enumerate(columns)]
    named = df.sparkSession.range(1).select(F.inline(F.array(*labels)))
    n = F.col("count").cast("double")
    missing = F.col("rows") - F.col("count")
    return named.join(stats, "i", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce(missing, F.lit(0)).alias("missing"),
        (missing / F.nullif(F.col("rows"), F.lit(0)) * 100).alias("missing_percentage"),
        "mean",
        "std",
        "min",
        "max",
        # Spark gives the biased moment ratio; scale it to the sample skewness.
        F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
    )


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments and exact quartiles of each numeric column."""
    columns = columns if columns is not None else numeric_columns(df)
    clean = missing_to_null(df.select(*[as_column(c) for c in columns]))
    quartiles = exact_quantiles(clean, columns, QUARTILES)
    # Both sides hold one row per column.
    return (
        numeric_moments(clean, columns)
        .join(quartiles, "column", "left")
        .withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})
    )


def time_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Range, distinct values and whole days covered of each date column."""
    columns = columns if columns is not None else time_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        v = as_column(name).cast("timestamp")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    long = rows_from(
        df.agg(*aggs),
        columns,
        {
            "count": lambda i, c: F.col(f"n{i}"),
            "missing": lambda i, c: F.col("rows") - F.col(f"n{i}"),
            "missing_percentage": lambda i, c: (F.col("rows") - F.col(f"n{i}"))
            / F.nullif(F.col("rows"), F.lit(0))
            * 100,
            "min_date": lambda i, c: F.col(f"min{i}"),
            "max_date": lambda i, c: F.col(f"max{i}"),
        },
    )
    days = F.floor((F.unix_micros("max_date") - F.unix_micros("min_date")) / F.lit(86_400_000_000))
    return (
        long.join(distinct_counts(df, columns), "column", "left")
        .withColumn("distinct", F.coalesce("distinct", F.lit(0)))
        .withColumn("range_days", days)
    )


def category_profile(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """Distinct values, their ratio and, for few values, the most frequent ones."""
    columns = columns if columns is not None else other_columns(df)
    tops = (
        category_top_values(df, columns, top)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("_tops"))
        .select("column", F.map_from_arrays(F.col("_tops.value"), F.col("_tops.n")).alias("top_values"))
    )
    base = missing_counts(df, columns).withColumn("count", F.col("rows") - F.col("missing"))
    # Every side holds one row per column.
    return (
        base.join(distinct_counts(df, columns), "column", "left")
        .join(tops, "column", "left")
        .select(
            "column",
            "count",
            "missing",
            (F.col("missing_ratio") * 100).alias("missing_percentage"),
            F.coalesce("distinct", F.lit(0)).alias("distinct"),
            (F.col("distinct") / F.col("count")).alias("distinct_ratio"),
            "top_values",
        )
    )


def category_top_values(
    df: DataFrame, columns: list[str] | None = None, top: int = 10
) -> DataFrame:
    """``column, value, n, rank`` for columns with at most 20 distinct values.

    Only those columns are counted by value, so the shuffle stays small.
    """
    columns = columns if columns is not None else other_columns(df)
    few = [c for c, d in distinct_within(df, columns, TOP_VALUES_LIMIT).items() if d]
    ranking = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    if not few:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, rank int")
    return (
        value_counts(df, few)
        .withColumn("rank", F.row_number().over(ranking))
        .filter(F.col("rank") <= top)
    )


def table_profile(df: DataFrame) -> DataFrame:
    """One typed row per column; fields that do not apply to its kind are NULL."""
    df = missing_to_null(df)
    parts = []
    numeric, times, others = numeric_columns(df), time_columns(df), other_columns(df)
    if numeric:
        parts.append(numeric_profile(df, numeric).withColumn("kind", F.lit("numeric")))
    if times:
        parts.append(time_profile(df, times).withColumn("kind", F.lit("datetime")))
    if others:
        parts.append(category_profile(df, others).withColumn("kind", F.lit("category")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def constant_and_id_like(df: DataFrame) -> DataFrame:
    """``column, distinct, constant, id_like`` over all rows.

    Ranges and counts settle most columns in one scan: equal ends mean
    constant, a gap or too narrow an integer range rules out an identifier.
    Exact distinct counts are taken only for the columns left open.
    """
    df = missing_to_null(df)
    columns = simple_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c = as_column(name)
        aggs += [F.count(c).alias(f"n{i}"), (F.count(c) == 0).alias(f"empty{i}")]
        aggs.append((F.min(c) == F.max(c)).alias(f"same{i}"))
        if isinstance(types[name], INTEGRALS):
            aggs.append((F.max(c).cast("decimal(38,0)") - F.min(c) + 1).alias(f"span{i}"))
    row = df.agg(*aggs).first()
    rows = row["rows"]
    constant, open_columns = [], []
    for i, name in enumerate(columns):
        if row[f"empty{i}"] or row[f"same{i}"]:
            constant.append(name)
        elif rows > 10 and row[f"n{i}"] == rows:
            if not isinstance(types[name], INTEGRALS) or row[f"span{i}"] >= rows:
                open_columns.append(name)
    flags = [
        F.struct(F.lit(c).alias("column"), F.lit(c in constant).alias("constant"))
        for c in columns
    ]
    spark = df.sparkSession
    base = spark.range(1).select(F.inline(F.array(*flags)))
    if not open_columns:
        return base.withColumn("id_like", F.lit(False))
    counted = distinct_counts(df, open_columns)
    return base.join(counted, "column", "left").select(
        "column",
        "constant",
        F.coalesce(F.col("distinct") == rows, F.lit(False)).alias("id_like"),
    )


def useless_columns(
    df: DataFrame, max_missing: float = 0.6, min_variation: float = 1e-4
) -> DataFrame:
    """``column, reason`` of columns that are mostly missing, constant or nearly so."""
    df = missing_to_null(df)
    columns = simple_columns(df)
    numeric = set(numeric_columns(df))
    parts = []
    for names in _chunks(columns):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(names):
            c = as_column(name)
            aggs += [F.count(c).alias(f"n{i}"), F.min(c).eqNullSafe(F.max(c)).alias(f"same{i}")]
            if name in numeric:
                aggs += [
                    F.avg(c.cast("double")).alias(f"mean{i}"),
                    F.stddev_samp(c.cast("double")).alias(f"std{i}"),
                ]

        def reason(i, name):
            missing = (F.col("rows") - F.col(f"n{i}")) / F.col("rows")
            out = F.when(missing > max_missing, "missing").when(F.col(f"same{i}"), "constant")
            if name in numeric:
                std = F.coalesce(F.col(f"std{i}"), F.lit(0.0))
                mean = F.nullif(F.col(f"mean{i}"), F.lit(0.0))
                low = F.coalesce(F.abs(F.col(f"std{i}") / mean) < min_variation, F.lit(False))
                out = out.when((std == 0) | low, "low_variance")
            return out

        parts.append(rows_from(df.agg(*aggs), names, {"reason": reason}))
    return _union(parts).filter(F.col("reason").isNotNull())


def univariate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation and distinct values of numeric columns."""
    columns = columns if columns is not None else numeric_columns(df)
    profile = numeric_profile(df, columns).select("column", "mean", "median", "std")
    counts = distinct_counts(missing_to_null(df), columns)
    return profile.join(counts, "column", "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0))
    )


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, exact."""
    return numeric_profile(df, columns).select(
        "column", "count", "mean", "std", "min", "q25", "median", "q75", "max"
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bin, low, high, n`` of equal-width bins between the extremes; empty bins left out."""
    v = as_column(column).cast("double")
    slim = missing_to_null(df.select(v.alias("x"))).filter(F.col("x").isNotNull())
    low, high = slim.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return slim.sparkSession.createDataFrame([], "bin bigint, low double, high double, n bigint")
    if low == high:
        number = F.lit(1).cast("bigint")
    else:
        number = F.least(F.width_bucket("x", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    width = (high - low) / bins
    return (
        slim.groupBy(number.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("high"),
            "n",
        )
    )


def _box(slim: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Whiskers at the furthest values within 1.5 interquartile ranges."""
    joined = slim.join(quartiles, "group")
    fence = (F.col("q2") - F.col("q0")) * 1.5
    low, high = F.col("q0") - fence, F.col("q2") + fence
    inside = F.col("x").between(low, high)
    return joined.groupBy("group").agg(
        F.count(F.lit(1)).alias("count"),
        F.first("q0").alias("q25"),
        F.first("q1").alias("median"),
        F.first("q2").alias("q75"),
        F.min(F.when(inside, F.col("x"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("x"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


def _column_boxes(df: DataFrame, columns: list[str]) -> DataFrame:
    clean = missing_to_null(df.select(*[as_column(c).cast("double").alias(c) for c in columns]))
    # One row per column comes back, never data rows.
    fences = {r["column"]: r for r in exact_quantiles(clean, columns, QUARTILES).collect()}
    names = [c for c in columns if c in fences]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        q = fences[c]
        fence = (q["q2"] - q["q0"]) * 1.5
        v = as_column(c)
        inside = v.between(F.lit(q["q0"] - fence), F.lit(q["q2"] + fence))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.min(F.when(inside, v)).alias(f"low{i}"),
            F.max(F.when(inside, v)).alias(f"high{i}"),
            F.count_if(~inside).alias(f"out{i}"),
        ]
    return rows_from(
        clean.agg(*aggs),
        names,
        {
            "rows": lambda i, c: F.col("rows"),
            "count": lambda i, c: F.col(f"n{i}"),
            "q25": lambda i, c: F.lit(fences[c]["q0"]),
            "median": lambda i, c: F.lit(fences[c]["q1"]),
            "q75": lambda i, c: F.lit(fences[c]["q2"]),
            "lower_whisker": lambda i, c: F.col(f"low{i}"),
            "upper_whisker": lambda i, c: F.col(f"high{i}"),
            "outliers": lambda i, c: F.col(f"out{i}"),
        },
    )


def box_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Box-plot numbers of numeric columns, one row per column."""
    return _column_boxes(df, columns).drop("rows")


def box_by_category(df: DataFrame, column: str, category: str, top: int | None = None) -> DataFrame:
    """Box-plot numbers of one column per category; with ``top`` only the most frequent ones."""
    pair = missing_to_null(
        df.select(as_column(category).alias("group"), as_column(column).cast("double").alias("x"))
    ).dropna()
    if top is not None:
        pair = keep_top_categories(pair, "group", top)
        # At most ``top`` groups, so the quartile side is a handful of rows.
        return _box(pair, F.broadcast(grouped_quantiles(pair, "group", "x", QUARTILES, few_groups=True)))
    return _box(pair, grouped_quantiles(pair, "group", "x", QUARTILES))


def outlier_counts(df: DataFrame, columns: list[str], max_share: float = 0.05) -> DataFrame:
    """Values outside the 1.5 interquartile fences, flagged above a share of all rows."""
    return _column_boxes(df, columns).select(
        "column", "outliers", (F.col("outliers") > F.col("rows") * max_share).alias("flagged")
    )
