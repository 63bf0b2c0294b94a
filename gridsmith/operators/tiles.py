"""Block-by-block comparison of two sets of rows, for measures that need every pair.

Rows are hashed into blocks of bounded size and each pair of blocks is one
task, which returns per-row summaries, never pairs. No task holds more than
two blocks, whatever the labels or the copies of a value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column

ROWS_PER_BLOCK = 4096


def as_array(df: DataFrame, features: str | list[str]) -> Column:
    """A vector column, array column or list of numeric columns as array<double>."""
    if isinstance(features, list):
        return F.array(*[as_column(c).cast("double") for c in features])
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(as_column(features))
    return as_column(features).cast("array<double>")


def block_count(rows: int, per_block: int = ROWS_PER_BLOCK) -> int:
    return max(1, math.ceil(rows / per_block))


def compare_blocks(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_blocks: int,
    right_blocks: int,
    compare: Callable,
    schema: str,
    once: bool = False,
) -> DataFrame:
    """Apply ``compare(left block, right block)`` to every pair of blocks.

    With ``once`` both sides are the same rows in as many blocks, and of blocks
    ``_i`` and ``_j`` only those with ``_i <= _j`` meet.
    """
    def numbers(n: int, low: Column | None = None, high: Column | None = None) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint") if low is None else low, F.lit(n - 1).cast("bigint") if high is None else high))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n).cast("bigint"))

    a = left.withColumn("_i", block(left_blocks)).withColumn("_j", numbers(right_blocks, F.col("_i") if once else None))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    b = right.withColumn("_j", block(right_blocks)).withColumn("_i", numbers(left_blocks, None, F.col("_j") if once else None))
    # Blocks are few bytes but much work, which the planner cannot know.
    pairs = left_blocks * right_blocks
    tasks = min(4 * pairs, max(16 * left.sparkSession.sparkContext.defaultParallelism, pairs))
    return (
        a.repartition(tasks, "_i", "_j").groupBy("_i", "_j")
        .cogroup(b.repartition(tasks, "_i", "_j").groupBy("_i", "_j"))
        .applyInPandas(compare, schema)
    )
