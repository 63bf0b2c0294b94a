"""Integer codes of text values in sorted order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.operators.columns import is_numeric
from gridsmith.operators.counting import distinct_within
from gridsmith.operators.cumulate import running_totals

# Up to this many values the mapping becomes part of the plan; above it a table.
CODES_IN_PLAN = 1000
MAX_CLASSES = 10_000
# Up to this many values a literal map is quicker than a join.
LITERAL_LEVELS = 64


def code_table(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: 0..K-1 in sorted order of the non-missing values."""
    values = (
        df.select(as_column(column).cast("string").alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
        .select(F.lit(0).alias("_all"), "value", F.lit(1).alias("_one"))
    )
    ranked = running_totals(values, "_all", "value", ["_one"])
    return ranked.select("value", F.col("_one_below").cast("bigint").alias("code"))


def few_levels(df: DataFrame, columns: list[str], limit: int = CODES_IN_PLAN) -> dict[str, list[str]]:
    """Sorted values of the columns with at most ``limit`` of them."""
    few = [c for c, n in distinct_within(df, columns, limit).items() if n is not None]
    if not few:
        return {}
    wide = df.select(*[as_column(c).cast("string").alias(c) for c in few])
    rows = (
        wide.unpivot([], few, "column", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
        .collect()  # at most limit rows per column, checked above
    )
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in few}


def code_lookup(column: Column | str, levels: list[str]) -> Column:
    """Code of a value by a literal map; NULL when the value is not among the levels."""
    if not levels:
        return F.lit(None).cast("bigint")
    pairs = [F.lit(x) for i, v in enumerate(levels) for x in (v, i)]
    return F.create_map(*pairs)[as_column(column).cast("string")].cast("bigint")


def with_lookup(df: DataFrame, column: str, out: str, levels: list[str]) -> DataFrame:
    """Add the code of a value among ``levels``, NULL when it is none of them.

    A literal map is searched entry by entry for every row, so above
    ``LITERAL_LEVELS`` a broadcast table of the levels is joined by hash.
    """
    if len(levels) <= LITERAL_LEVELS:
        return df.withColumn(out, code_lookup(column, levels))
    rows = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(levels)], "_value string, _place bigint")
    joined = df.join(F.broadcast(rows), as_column(column).cast("string") == F.col("_value"), "left")
    return joined.withColumn(out, F.col("_place")).drop("_value", "_place")


def with_code(df: DataFrame, column: str, out: str, table: DataFrame | None = None) -> DataFrame:
    """Add the sorted code of a column, missing kept; many values go through a join."""
    if table is None:
        levels = few_levels(df, [column])
        if column in levels:
            return with_lookup(df, column, out, levels[column])
        table = code_table(df, column)
    renamed = table.select(F.col("value").alias("_value"), F.col("code").alias(out))
    return df.join(renamed, as_column(column).cast("string") == F.col("_value"), "left").drop("_value")


def class_levels(df: DataFrame, target: str, limit: int = MAX_CLASSES) -> list[str]:
    """The classes of a target as text, in the order of their own type; more than ``limit`` are refused."""
    found = df.select(as_column(target).alias("v")).filter(F.col("v").isNotNull()).distinct()
    rows = found.orderBy("v").select(F.col("v").cast("string").alias("v")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{target} has more than {limit} classes")
    return [r["v"] for r in rows]


def encode_labels(df: DataFrame, target: str, out: str = "label", classes: list[str] | None = None) -> DataFrame:
    """Labels 0..K-1 as doubles, in the order of ``classes`` or else sorted.

    Without ``classes`` numeric targets pass through, as values to predict.
    """
    if classes is not None:
        return with_lookup(df, target, out, classes).withColumn(out, as_column(out).cast("double"))
    if is_numeric(df.schema[target].dataType):
        return df.withColumn(out, as_column(target).cast("double"))
    return with_code(df, target, out).withColumn(out, F.col(out).cast("double"))
