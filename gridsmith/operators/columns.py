"""Projections, row filters and column typing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions.scalars import as_column, quoted, shorten

# Fixed value: what a new column name may look like.
NAME_PATTERN = r"^[a-zA-Z][a-zA-Z0-9_-]*$"
INTEGRALS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


# A table of at most this many rows may sit in one file chunk and keep one core busy.
SPREAD_ROWS = 5_000_000


def row_count(df: DataFrame) -> int:
    """The number of rows: one number from each task, no column read, no row moved."""
    return df.select(F.lit(1)).count()


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal the rows of a small table out over all cores; a large one has chunks enough."""
    rows = rows if rows is not None else row_count(df)
    if rows > SPREAD_ROWS or not df.columns:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *[as_column(c) for c in df.columns])


def stacked(wide: DataFrame) -> DataFrame:
    """``i, v``: the values of columns of one type with the position of their column."""
    return wide.select(F.posexplode(F.array(*[as_column(c) for c in wide.columns])).alias("i", "v"))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_simple(t: T.DataType) -> bool:
    """Types that compare and group; arrays, maps and structs are left out of profiles."""
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_time(f.dataType)]


def other_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns."""
    return [
        f.name
        for f in df.schema.fields
        if is_simple(f.dataType) and not is_numeric(f.dataType) and not is_time(f.dataType)
    ]


def simple_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_simple(f.dataType)]


def rows_from(df: DataFrame, columns: list[str], fields: dict[str, callable]) -> DataFrame:
    """Turn a one-row frame into one row per column name.

    ``fields`` maps an output name to a function of (position, column name)
    giving the expression that holds that value in the one-row frame.
    """
    structs = [
        F.struct(
            F.lit(name).alias("column"),
            *[make(i, name).alias(field) for field, make in fields.items()],
        )
        for i, name in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*structs)))


def select_features(df: DataFrame, features: list[str], limit: int | None = None) -> DataFrame:
    """The listed columns that exist; with ``limit`` the first so many."""
    return df.select(*[as_column(c) for c in features if c in df.columns][:limit])


def drop_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def rename_valid(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Apply the renames whose source exists and whose target is free and well formed."""
    taken = set(df.columns)
    accepted = {}
    for old, new in renames.items():
        well_formed = 1 <= len(new) <= 50 and re.match(NAME_PATTERN, new)
        if old in df.columns and new not in taken and well_formed:
            accepted[old] = new
            taken = (taken - {old}) | {new}
    return df.withColumnsRenamed(accepted)


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the narrowest type that holds every value unchanged."""
    integral = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRALS)]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not integral and not doubles:
        return df
    checks = []
    for name in integral:
        checks += [F.min(as_column(name)), F.max(as_column(name))]
    for name in doubles:
        c = as_column(name)
        same = F.isnan(c) | (c.cast("float").cast("double") == c)
        checks.append(F.bool_and(F.coalesce(same, F.lit(True))))
    row = list(df.agg(*[c.alias(f"x{i}") for i, c in enumerate(checks)]).first())
    casts: dict[str, Column] = {}
    for i, name in enumerate(integral):
        low, high = row[2 * i], row[2 * i + 1]
        if low is None:
            continue
        for bits, spark_type in ((8, "tinyint"), (16, "smallint"), (32, "int")):
            if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1):
                casts[name] = as_column(name).cast(spark_type)
                break
    for i, name in enumerate(doubles):
        if row[2 * len(integral) + i]:
            casts[name] = as_column(name).cast("float")
    return df.withColumns(casts) if casts else df


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows where every listed column has a value."""
    return df.dropna(subset=columns)


def keep_top_categories(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Rows whose category is among the k most frequent (ties by value)."""
    top = (
        df.filter(as_column(column).isNotNull())
        .groupBy(as_column(column).alias("_top"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc("_top"))
        .limit(k)
        .select("_top")
    )
    # k rows at most, so the broadcast is bounded by k whatever the input size.
    return df.join(F.broadcast(top), as_column(column) == F.col("_top"), "left_semi")


def keep_members(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(as_column(column).isin(values))


def clustered_rows(df: DataFrame, label: str) -> DataFrame:
    return df.filter(as_column(label) >= 0)


def noise_rows(df: DataFrame, label: str) -> DataFrame:
    return df.filter(as_column(label) == -1)


def split_noise(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(clustered rows, noise rows) by the sign of the label."""
    return clustered_rows(df, label), noise_rows(df, label)


def shorten_texts(df: DataFrame, limit: int = 50) -> DataFrame:
    """Long texts cut for display, one projection for all text columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(
        *[shorten(c, limit).alias(c) if c in texts else F.col(quoted(c)) for c in df.columns]
    )
