"""Repeatable samples, splits and folds by the order of a hash of the row key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.session import cut_lineage

SEED = 42
# Leading hex digits that place a row in one of 65 536 equally likely buckets.
BUCKET_DIGITS = 4
# A sample's hashes up to this many are put in order by one task; larger samples are cut by bucket counts.
ONE_TASK = 1_000_000
# More strata than this and their thresholds are joined from a table, not broadcast.
BROADCAST_STRATA = 100_000


def hash_order(keys: list[str], seed: int = SEED) -> Column:
    """A fixed pseudo-random order of the rows; the keys must identify a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_column(k).cast("string") for k in keys]))


def head(df: DataFrame, n: int = 100, order: list[str] | None = None) -> DataFrame:
    """A preview of n rows, in key order when keys are given."""
    return (df.orderBy(*[as_column(c) for c in order]) if order else df).limit(n)


def sample_size(rows: int, fraction: float, max_rows: int, min_rows: int) -> int:
    if rows < min_rows:
        return rows
    return min(rows, max_rows, max(min_rows, int(rows * fraction)))


def sample_rows(
    df: DataFrame,
    keys: list[str],
    fraction: float = 0.01,
    max_rows: int = 10_000,
    min_rows: int = 100,
    seed: int = SEED,
) -> DataFrame:
    """An exact-size repeatable sample: the first rows in hash order.

    Sampling is a feature to ask for; no other operator samples its input.
    """
    rows = df.count()
    target = sample_size(rows, fraction, max_rows, min_rows)
    if target >= rows:
        return df
    h = hash_order(keys, seed)
    # The wanted hashes lie below their expected share plus eight deviations; few others do.
    share = (target + 8 * target**0.5 + 50) / rows
    if share < 1 and target <= ONE_TASK:
        low = F.lit(f"{int(share * 16**8):08x}")
        picked = df.select(h.alias("h")).filter(F.substring("h", 1, 8) <= low)
        last = picked.orderBy("h").limit(target).agg(F.count(F.lit(1)), F.max("h")).first()
        if last[0] == target:
            return df.filter(h <= F.lit(last[1]))
    labelled = hash_segments(df, keys, [lambda n: F.lit(target)], seed=seed)
    return labelled.filter(F.col("segment") == 0).drop("segment")


def cap_rows(df: DataFrame, keys: list[str], max_rows: int = 15_000, seed: int = SEED) -> DataFrame:
    return sample_rows(df, keys, 1.0, max_rows, max_rows, seed)


def evaluation_cap(
    df: DataFrame, keys: list[str], max_rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """Evaluate on everything, or on at most ``max_rows`` rows when asked to."""
    return df if max_rows is None else cap_rows(df, keys, max_rows, seed)


def hash_segments(
    df: DataFrame,
    keys: list[str],
    cuts: list[Callable[[Column], Column]],
    strata: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Add ``segment``: how many of the cut ranks a row lies beyond in hash order.

    Each cut maps the size of a stratum to a rank. No full sort: bucket counts
    locate the bucket holding a cut, only that bucket (1/65536 of a stratum) is
    sorted to find the exact hash, and the rows are then labelled by comparing
    hashes, without a shuffle.
    """
    stratum = as_column(strata) if strata else F.lit(0)
    slim = df.select(stratum.alias("_s"), hash_order(keys, seed).alias("_h"))
    slim = slim.withColumn("_b", F.conv(F.substring("_h", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    per_bucket = slim.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_s")
    located = per_bucket.withColumns(
        {"_end": F.sum("_c").over(upto), "_n": F.sum("_c").over(whole)}
    ).withColumn("_start", F.col("_end") - F.col("_c"))
    marks = (
        located.withColumn(
            "_cut",
            F.explode(F.array(*[F.struct(F.lit(i).alias("i"), cut(F.col("_n")).cast("bigint").alias("rank")) for i, cut in enumerate(cuts)])),
        )
        .filter((F.col("_start") < F.col("_cut.rank")) & (F.col("_cut.rank") <= F.col("_end")))
        .select(
            F.col("_s").alias("_ms"), F.col("_b").alias("_mb"),
            F.col("_cut.i").alias("_i"), (F.col("_cut.rank") - F.col("_start")).alias("_rank"),
        )
    )
    # One mark per stratum and cut; known ones need no second count of the table.
    known = marks.limit(BROADCAST_STRATA + 1).collect()
    if len(known) <= BROADCAST_STRATA:
        marks = F.broadcast(df.sparkSession.createDataFrame(known, marks.schema))
    else:
        marks = cut_lineage(marks)
    buckets = marks.select("_ms", "_mb").distinct()
    in_bucket = Window.partitionBy("_s", "_b").orderBy("_h")
    ranked = (
        slim.join(buckets, F.col("_s").eqNullSafe(F.col("_ms")) & (F.col("_b") == F.col("_mb")), "left_semi")
        .withColumn("_r", F.row_number().over(in_bucket))
    )
    limits = (
        ranked.join(
            marks, F.col("_s").eqNullSafe(F.col("_ms")) & (F.col("_b") == F.col("_mb")) & (F.col("_r") == F.col("_rank"))
        )
        .groupBy("_s")
        .agg(*[F.max(F.when(F.col("_i") == i, F.col("_h"))).alias(f"_t{i}") for i in range(len(cuts))])
    )
    # A stratum too small for a cut has no hash there: all its rows lie beyond it.
    taken = limits.limit(BROADCAST_STRATA + 1).collect()
    h = hash_order(keys, seed)
    if not strata:
        row = taken[0] if taken else [None] * (len(cuts) + 1)
        beyond = [F.when(h <= F.lit(row[i + 1]), 0).otherwise(1) if row[i + 1] else F.lit(1) for i in range(len(cuts))]
        return df.withColumn("segment", _total(beyond))
    schema = "_s " + df.schema[strata].dataType.simpleString() + "".join(f", _t{i} string" for i in range(len(cuts)))
    if len(taken) <= BROADCAST_STRATA:
        limits = F.broadcast(df.sparkSession.createDataFrame(taken, schema))
    else:
        limits = cut_lineage(limits)
    joined = df.join(limits, stratum.eqNullSafe(F.col("_s")), "left")
    beyond = [F.when(h <= F.col(f"_t{i}"), 0).otherwise(1) for i in range(len(cuts))]
    return joined.withColumn("segment", _total(beyond)).select(*[as_column(c) for c in df.columns], "segment")


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def split_rows(
    df: DataFrame,
    keys: list[str],
    test_share: float = 0.2,
    strata: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Add ``part``: 'test' for the rounded share of each stratum, else 'train'."""
    cut = lambda n: F.floor(n * F.lit(test_share) + F.lit(0.5))
    labelled = hash_segments(df, keys, [cut], strata, seed)
    return labelled.withColumn("part", F.when(F.col("segment") == 0, "test").otherwise("train")).drop("segment")


def train_test_split(
    df: DataFrame,
    keys: list[str],
    test_share: float = 0.2,
    strata: str | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    parts = split_rows(df, keys, test_share, strata, seed)
    return (
        parts.filter(F.col("part") == "train").drop("part"),
        parts.filter(F.col("part") == "test").drop("part"),
    )


def assign_folds(
    df: DataFrame, keys: list[str], k: int = 5, strata: str | None = None, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` 0..k-1, even within each stratum."""

    def cut(j: int) -> Callable[[Column], Column]:
        return lambda n: F.floor(n * j / k)

    labelled = hash_segments(df, keys, [cut(j) for j in range(1, k)], strata, seed)
    return labelled.withColumnRenamed("segment", "fold")
