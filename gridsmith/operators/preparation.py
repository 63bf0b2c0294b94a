"""Column cleaning, imputation, encoding and scaling: fitted values and their use.

Each operator has a fit function that returns a small Python value and an
apply function that is one projection; ``gridsmith.operators.stages`` wraps
them as ML pipeline stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions.scalars import as_column, date_parts, missing_to_null, nan_to_null
from gridsmith.operators.codes import code_table, with_lookup
from gridsmith.operators.columns import is_numeric, numeric_columns, simple_columns, stacked
from gridsmith.operators.counting import distinct_near
from gridsmith.operators.cumulate import exact_quantiles
from gridsmith.session import cut_lineage

#: Longer texts are counted as digests.
WHOLE_TEXT = 64


def columns_to_drop(
    df: DataFrame,
    missing_threshold: float = 0.8,
    min_unique_ratio: float = 0.01,
    remove_constant: bool = True,
    remove_identifiers: bool = True,
) -> list[tuple[str, str]]:
    """(column, reason) in the order of the rules; empty when nothing would remain."""
    df = missing_to_null(df)
    columns = simple_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = as_column(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).eqNullSafe(F.max(v)).alias(f"same{i}")]
    row = df.agg(*aggs).first()
    rows, present = row["rows"], {c: row[f"n{i}"] for i, c in enumerate(columns)}
    constant = {c for i, c in enumerate(columns) if row[f"same{i}"]}
    numeric = set(numeric_columns(df))
    marks = {}
    for c in columns:
        wanted = []
        if remove_identifiers and present[c] == rows and c not in constant:
            wanted.append(float(rows))
        if c in numeric and min_unique_ratio > 0 and c not in constant:
            wanted.append(present[c] * min_unique_ratio)
        if wanted:
            marks[c] = wanted
    distinct = distinct_near(df, marks)
    out = []
    for c in columns:
        if remove_constant and c in constant:
            out.append((c, "constant"))
        elif remove_identifiers and present[c] == rows and distinct.get(c) == rows:
            out.append((c, "identifier"))
        elif missing_threshold < 1.0 and rows and 1 - present[c] / rows > missing_threshold:
            out.append((c, "missing"))
        elif c in numeric and min_unique_ratio > 0 and present[c] and distinct.get(c, 1) / present[c] < min_unique_ratio:
            out.append((c, "few_values"))
    return [] if len(out) == len(columns) else out


def zero_variance_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose values are all equal."""
    df = missing_to_null(df)
    columns = numeric_columns(df)
    if not columns:
        return []
    row = df.agg(
        *[F.min(as_column(c)).eqNullSafe(F.max(as_column(c))).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if row[i]]


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties; one shuffle for all.

    Long texts are counted as digests. Only if one of them is as frequent as any
    value is it looked up, by a second scan.
    """
    if not columns:
        return {}
    values = stacked(df.select(*[as_column(c).cast("string").alias(f"{i}") for i, c in enumerate(columns)])).filter(F.col("v").isNotNull())
    is_long = F.length("v") > WHOLE_TEXT
    keyed = values.select("i", is_long.alias("is_long"), F.when(is_long, F.sha2("v", 256)).otherwise(F.col("v")).alias("key"), "v")
    counts = cut_lineage(keyed.groupBy("i", "is_long", "key").agg(F.count(F.lit(1)).alias("n")))
    most = counts.groupBy("i").agg(F.max("n").alias("n"))
    tied = counts.join(F.broadcast(most), ["i", "n"])  # one row per column
    best = {r["i"]: r["v"] for r in tied.filter("not is_long").groupBy("i").agg(F.min("key").alias("v")).collect()}
    wanted = tied.filter("is_long").select("i", "is_long", "key")
    if not wanted.isEmpty():
        found = keyed.filter("is_long").join(wanted, ["i", "is_long", "key"], "left_semi").groupBy("i").agg(F.min("v").alias("v"))
        for r in found.collect():
            best[r["i"]] = min(r["v"], best.get(r["i"], r["v"]))
    return {columns[i]: v for i, v in sorted(best.items())}


def imputation_values(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    numeric_strategy: str = "mean",
    categorical_strategy: str = "most_frequent",
    numeric_constant: float = 0.0,
    text_constant: str = "missing",
) -> dict[str, float | str]:
    """The value each column is filled with."""
    df = missing_to_null(df)
    fills: dict[str, float | str] = {}
    if numeric:
        if numeric_strategy == "mean":
            row = df.agg(*[F.avg(as_column(c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
            fills |= {c: row[i] for i, c in enumerate(numeric) if row[i] is not None}
        elif numeric_strategy == "median":
            fills |= {r["column"]: r["q0"] for r in exact_quantiles(df, numeric, [0.5]).collect()}
        elif numeric_strategy == "constant":
            fills |= dict.fromkeys(numeric, float(numeric_constant))
        else:
            raise ValueError(f"unknown numeric strategy {numeric_strategy}")
    if categorical_strategy == "most_frequent":
        fills |= most_frequent(df, categorical)
    elif categorical_strategy == "constant":
        fills |= dict.fromkeys(categorical, text_constant)
    else:
        raise ValueError(f"unknown categorical strategy {categorical_strategy}")
    return fills


def fill_missing(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    casts = {}
    for c, value in fills.items():
        if isinstance(value, str):
            casts[c] = F.coalesce(as_column(c), F.lit(value))
        else:
            casts[c] = F.coalesce(nan_to_null(as_column(c).cast("double")), F.lit(float(value)))
    return df.withColumns(casts) if casts else df


def impute(df: DataFrame, numeric_strategy: str = "mean", categorical_strategy: str = "most_frequent") -> DataFrame:
    """Fill every numeric and text column that has missing values."""
    numeric = numeric_columns(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return fill_missing(df, imputation_values(df, numeric, texts, numeric_strategy, categorical_strategy))


def ordinal_encode(df: DataFrame, column: str, out: str, levels: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Code of each value among the fitted sorted values, -1 when unseen or missing."""
    if levels is not None:
        return with_lookup(df, column, out, levels).withColumn(out, F.coalesce(as_column(out), F.lit(-1)).cast("double"))
    pairs = (table if table is not None else code_table(df, column)).select(
        F.col("value").alias("_value"), F.col("code").alias("_code")
    )
    joined = df.join(pairs, as_column(column).cast("string") == F.col("_value"), "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(-1)).cast("double")).drop("_value", "_code")


def onehot_columns(column: str, levels: list[str], drop_first: bool = True, prefix: str | None = None) -> dict[str, Column]:
    """0/1 columns per level, the first level left out; an unseen value is all zeros."""
    c = as_column(column).cast("string")
    kept = levels[1:] if drop_first else levels
    name = prefix or column
    return {f"{name}_{v}": F.when(c == F.lit(v), 1.0).otherwise(0.0) for v in kept}


def scaling_values(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(centre, width) per column: population deviation, range or interquartile range."""
    df = missing_to_null(df)
    if method == "robust":
        rows = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).collect()
        found = {r["column"]: (r["q1"], r["q2"] - r["q0"]) for r in rows}
    else:
        aggs = []
        for i, c in enumerate(columns):
            v = as_column(c).cast("double")
            pair = (F.avg(v), F.stddev_pop(v)) if method == "standard" else (F.min(v), F.max(v) - F.min(v))
            aggs += [pair[0].alias(f"c{i}"), pair[1].alias(f"w{i}")]
        row = df.agg(*aggs).first()
        found = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns) if row[2 * i] is not None}
    return {c: (centre, width if width else 1.0) for c, (centre, width) in found.items()}


def scale(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (as_column(c).cast("double") - F.lit(float(a))) / F.lit(float(w)) for c, (a, w) in values.items()}
    )


def add_date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    parts: dict[str, Column] = {}
    for c in columns:
        parts |= date_parts(c)
    return df.withColumns(parts) if parts else df


def is_numeric_column(df: DataFrame, name: str) -> bool:
    return is_numeric(df.schema[name].dataType)
