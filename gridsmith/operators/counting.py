"""Counts shared by the profile, role and rule operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions.scalars import as_column
from gridsmith.operators.columns import INTEGRALS, is_numeric, rows_from, simple_columns


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long table ``column, value, n`` of the non-missing values of text-like columns.

    One shuffle for all columns. Rows are combined before the shuffle, so a
    value that fills the table costs one row per task.
    """
    columns = columns if columns is not None else simple_columns(df)
    wide = df.select(*[as_column(c).cast("string").alias(c) for c in columns])
    return (
        wide.unpivot([], columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _distinct_key(c, kind: str):
    if kind != "string":
        return as_column(c).cast(kind)
    text = as_column(c).cast("string")
    # Long texts go through the shuffle as a 256-bit digest instead of whole.
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct non-missing values per column: ``column, distinct``.

    Numbers stay numbers in the shuffle; only other types travel as text.
    Columns without any value give no row.
    """
    columns = columns if columns is not None else simple_columns(df)
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in columns:
            if isinstance(f.dataType, INTEGRALS):
                kind = "bigint"
            elif is_numeric(f.dataType):
                kind = "double"
            else:
                kind = "string"
            kinds.setdefault(kind, []).append(f.name)
    parts = []
    for kind, names in kinds.items():
        wide = df.select(*[_distinct_key(c, kind).alias(c) for c in names])
        parts.append(
            wide.unpivot([], names, "column", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.lit(1).alias("one"))
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("distinct"))
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, distinct bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_near(df: DataFrame, marks: dict[str, list[float]]) -> dict[str, int]:
    """Distinct counts good enough to compare with the marks given per column.

    One sketch scan (5 % standard error) settles the columns at least a factor
    of two, ten standard errors or more, away from each of their marks. The
    others are counted exactly, so no shuffle carries a column whose answer is
    already plain.
    """
    if not marks:
        return {}
    columns = list(marks)
    row = df.agg(
        *[F.approx_count_distinct(as_column(c), 0.05).alias(f"d{i}") for i, c in enumerate(columns)]
    ).first()
    counts = {c: row[i] for i, c in enumerate(columns)}
    close = [c for c in columns if any(m / 2 - 10 <= counts[c] <= m * 2 + 10 for m in marks[c])]
    if close:
        counts |= dict.fromkeys(close, 0)
        counts |= {r["column"]: r["distinct"] for r in distinct_counts(df, close).collect()}
    return counts


def distinct_within(df: DataFrame, columns: list[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts of the columns with at most ``limit`` values, else None."""
    # Marks at zero, at a quarter of the limit and so on make every count up to the limit exact.
    steps = [limit / 4**i for i in range(12) if limit / 4**i >= 1] + [0]
    counts = distinct_near(df, {c: steps for c in columns})
    return {c: n if n <= limit else None for c, n in counts.items()}


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, position, rows, missing, missing_ratio`` for every column, in one scan."""
    columns = columns if columns is not None else df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(as_column(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    long = rows_from(
        one,
        columns,
        {
            "position": lambda i, c: F.lit(i),
            "rows": lambda i, c: F.col("rows"),
            "missing": lambda i, c: F.col(f"m{i}"),
        },
    )
    return long.withColumn("missing_ratio", F.col("missing") / F.nullif(F.col("rows"), F.lit(0)))


def missing_overview(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first."""
    return (
        missing_counts(df)
        .filter(F.col("missing") > 0)
        .select("column", "missing")
        .orderBy(F.desc("missing"), "column")
    )


def cardinality_overview(df: DataFrame, limit: int = 100) -> DataFrame:
    """Non-numeric columns with at most ``limit`` distinct values, largest first."""
    texts = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.BooleanType))
    ]
    return (
        distinct_counts(df, texts)
        .filter(F.col("distinct") <= limit)
        .orderBy(F.desc("distinct"), "column")
    )


def least_missing(df: DataFrame, k: int, columns: list[str] | None = None) -> DataFrame:
    """The k columns with the lowest missing share, ties in column order."""
    return (
        missing_counts(df, columns)
        .orderBy("missing_ratio", "position")
        .limit(k)
        .select("column", "missing_ratio")
    )


def row_digest(df: DataFrame) -> list[Column]:
    """Three 64-bit hashes of a whole row, missing cells told apart: what stands for the row in a shuffle."""
    cells = [x for c in df.columns for x in (as_column(c).isNull(), as_column(c))]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"_d{seed}") for seed in (1, 2, 3)]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one: ``duplicate_rows``."""
    return (
        df.select(*row_digest(df)).groupBy("_d1", "_d2", "_d3")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def table_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns, share of missing cells in percent and duplicate rows.

    One shuffle of row digests: the missing cells of each distinct row are
    weighted with its count.
    """
    cells = None
    for c in df.columns:
        gap = as_column(c).isNull().cast("int")
        cells = gap if cells is None else cells + gap
    gaps = F.lit(0) if cells is None else cells
    digests = df.select(*row_digest(df), gaps.alias("_gaps"))
    grouped = digests.groupBy("_d1", "_d2", "_d3").agg(F.count(F.lit(1)).alias("_n"), F.first("_gaps").alias("_gaps"))
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.coalesce(
            F.sum(F.col("_gaps") * F.col("_n")) / F.nullif(F.sum("_n") * len(df.columns), F.lit(0)) * 100, F.lit(0.0)
        ).alias("missing_percentage"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def mean_missing_share(df: DataFrame) -> DataFrame:
    """Mean over columns of the missing share, in percent."""
    return missing_counts(df).agg((F.avg("missing_ratio") * 100).alias("missing_percentage"))


def schema_table(df: DataFrame) -> DataFrame:
    """``column, type, non_null, null_percentage`` in column order."""
    types = dict(df.dtypes)
    pairs = [F.lit(x) for c in df.columns for x in (c, types[c])]
    return (
        missing_counts(df)
        .select(
            "column",
            F.create_map(*pairs)[F.col("column")].alias("type"),
            (F.col("rows") - F.col("missing")).alias("non_null"),
            (F.col("missing_ratio") * 100).alias("null_percentage"),
            "position",
        )
        .orderBy("position")
        .drop("position")
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per class, missing targets left out."""
    c = as_column(target)
    return df.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values of a column, ties by value."""
    return class_distribution(df, column).orderBy(F.desc("n"), F.asc("value")).limit(k)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs, long form."""
    return (
        df.dropna(subset=[a, b])
        .groupBy(as_column(a).alias("a"), as_column(b).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def contingency_wide(df: DataFrame, a: str, b: str, levels: list | None = None) -> DataFrame:
    """Counts of value pairs with one column per value of ``b``."""
    pairs = contingency(df, a, b)
    grouped = pairs.groupBy("a")
    grouped = grouped.pivot("b", levels) if levels else grouped.pivot("b")
    return grouped.agg(F.sum("n")).fillna(0)
