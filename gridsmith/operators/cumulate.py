"""Running totals and exact quantiles that never put a whole column in one task."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions.scalars import as_column
from gridsmith.operators.columns import SPREAD_ROWS, row_count, spread, stacked
from gridsmith.session import cut_lineage

# Above this many distinct values per group the running total is taken in
# range buckets; below it one sorted window per group is cheaper.
ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 2048
# Characters of a text range end, behind what all values begin with.
END_CHARACTERS = 64
ACCURACY = 10_000
# A coarser sketch is quicker and keeps few enough values of a small table.
SMALL_ACCURACY = 2_000
# Up to this many values, a quantile keeps every distinct value.
SMALL = 2 * ACCURACY
# Up to this many rows, a table skips the sketch altogether.
DIRECT_ROWS = 100_000
# Above so many rows the values a quantile keeps are added up in ranges.
MANY_ROWS = 200_000_000


def running_totals(
    df: DataFrame,
    group: str,
    order: str,
    sums: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``<name>_below`` (total before this value) and ``<name>_total`` per group.

    ``df`` holds one row per (group, order value): pre-aggregate first. The
    number of groups must be small (column names, class labels); the number of
    values per group may be anything. Large groups are cut into value ranges,
    range totals are summed up first and each range is then scanned alone.
    """
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
    )
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    buckets = min(MAX_BUCKETS, math.ceil(largest / rows_per_bucket))
    if buckets > 1:
        df = cut_lineage(df)  # read several times from here on
    if buckets <= 1:
        before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(group)
        return df.withColumns(
            {f"{s}_below": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums}
            | {f"{s}_total": F.sum(s).over(whole) for s in sums}
        )
    value = F.col(order)
    if isinstance(df.schema[order].dataType, T.StringType):
        shared, ends = _text_bounds(df, order, buckets, largest)
        value = F.substr(F.col(order), F.lit(shared + 1))
        placed = df.withColumn("_bounds", F.lit(ends).cast("array<string>"))
    else:
        cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        bounds = df.groupBy(F.col(group).alias("_g")).agg(
            F.percentile_approx(order, cuts, F.lit(max(100, 4 * buckets))).alias("_bounds")
        )
        # One array of at most MAX_BUCKETS numbers per group, and few groups.
        placed = df.join(F.broadcast(bounds), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    placed = placed.withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b < value))
    ).drop("_bounds")
    totals = placed.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(
        *[F.sum(s).alias(f"_{s}") for s in sums]
    )
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    totals = totals.select(
        "_g",
        "_b",
        *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    local = (
        Window.partitionBy(group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.withColumns(
        {f"{s}_below": F.coalesce(F.sum(s).over(local), F.lit(0)) for s in sums}
    )
    # At most MAX_BUCKETS rows per group.
    joined = placed.join(
        F.broadcast(totals), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b"))
    )
    return joined.withColumns(
        {f"{s}_below": F.col(f"{s}_below") + F.col(f"_{s}_before") for s in sums}
    ).drop("_g", "_b", "_bucket", *[f"_{s}_before" for s in sums])


def _text_bounds(df: DataFrame, order: str, buckets: int, rows: int) -> tuple[int, list[str]]:
    """Characters that all values begin with, and range ends of what follows, from a sample of about fifty values per bucket.

    The ends only balance the work; any choice gives the same totals. Values such
    as paths or addresses differ behind a long common beginning, so an end is
    ``END_CHARACTERS`` of what comes behind it.
    """
    shared = len(os.path.commonprefix([v or "" for v in df.agg(F.min(order), F.max(order)).first()]))
    picked = df.select(F.substring(order, shared + 1, END_CHARACTERS).alias(order)).sample(min(1.0, 50 * buckets / rows), 7)
    values = sorted((r[0] for r in picked.limit(100 * MAX_BUCKETS).collect() if r[0] is not None), key=str.encode)
    return shared, [values[len(values) * i // buckets] for i in range(1, buckets)] if values else []


def _bracket_probs(probs: list[float], accuracy: int = ACCURACY) -> list[float]:
    out = []
    for p in probs:
        out += [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    return out


def _brackets(n: Column, cuts: Column, probs: list[float]) -> list[tuple[Column, Column]]:
    """Value ranges sure to hold each asked rank; everything when n is small."""
    out = []
    for i, p in enumerate(probs):
        everything = n <= SMALL
        low = F.when(everything | F.lit(p - 2 / ACCURACY <= 0), F.lit(-math.inf)).otherwise(cuts[2 * i])
        high = F.when(everything | F.lit(p + 2 / ACCURACY >= 1), F.lit(math.inf)).otherwise(cuts[2 * i + 1])
        out.append((low, high))
    return out


def _thin(value: Column, brackets: list[tuple[Column, Column]]) -> Column:
    """Keep a value inside a bracket; pool the rest at the next bracket's lower end."""
    inside = None
    for low, high in brackets:
        hit = value.between(low, high)
        inside = hit if inside is None else inside | hit
    lows = [F.when(low > value, low) for low, _ in brackets]
    pooled = lows[0] if len(lows) == 1 else F.least(*lows)
    return F.when(inside, F.struct(value.alias("v"), F.lit(1).alias("kept"))).otherwise(
        F.struct(pooled.alias("v"), F.lit(0).alias("kept"))
    )


def _read_ranks(counts: DataFrame, keys: list[str], probs: list[float], many: bool = False) -> DataFrame:
    """``_v, _kept, _c, _n`` per value to interpolated quantiles, one row per key.

    With ``many`` values to a single key they are added up in ranges, so none of
    the few keys has its kept values sorted in one task.
    """
    if many:
        (key,) = keys
        kept = F.when(F.col("_kept") == 1, F.col("_c")).otherwise(F.lit(0))
        merged = counts.groupBy(key, "_v").agg(F.sum("_c").alias("_all"), F.sum(kept).alias("_c"), F.first("_n").alias("_n"))
        below = running_totals(merged, key, "_v", ["_all"])
        # Pooled values stand in front of the kept ones of the same value.
        ranked = below.filter("_c > 0").select(
            key, "_v", F.lit(1).alias("_kept"), "_c", "_n", (F.col("_all_below") + F.col("_all")).alias("_end"), (F.col("_all_below") + F.col("_all") - F.col("_c")).alias("_start"),
        )
    else:
        upto = Window.partitionBy(*keys).orderBy("_v", "_kept").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    aggs = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("_kept") == 1) & (F.col("_start") <= rank) & (rank < F.col("_end"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    picked = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("_n") - 1)
        share = position - F.floor(position)
        low = F.coalesce(F.col(f"_lo{i}"), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        high = F.coalesce(F.col(f"_hi{i}"), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        out.append((low + (high - low) * share).alias(f"q{i}"))
    return picked.select(*keys, *out)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Interpolated quantiles of numeric columns: ``column, q0, q1, ...``.

    A large table is scanned twice: a bounded sketch brackets every rank, then
    only the values inside the brackets are kept and all others pooled into
    counts, so the sort at the end sees a few ten-thousandths of a column. A
    table of at most ``DIRECT_ROWS`` rows skips the sketch and keeps all values.
    Columns without any value give no row.
    """
    wide = df.select(*[as_column(c).cast("double").alias(f"{i}") for i, c in enumerate(columns)])
    names = wide.columns
    rows = row_count(df)
    if rows <= DIRECT_ROWS:
        long = stacked(wide).filter(F.col("v").isNotNull())
        counts = long.groupBy("i", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        counts = counts.withColumns({"_kept": F.lit(1), "_n": F.sum("_c").over(Window.partitionBy("i"))})
    else:
        accuracy = ACCURACY if rows > SPREAD_ROWS else SMALL_ACCURACY
        array = F.array(*[F.lit(p) for p in _bracket_probs(probs, accuracy)])
        wide = spread(wide, rows)
        sketch = wide.agg(
            *[F.count(c).alias(f"n{c}") for c in names],
            *[F.percentile_approx(c, array, F.lit(accuracy)).alias(f"b{c}") for c in names],
        ).first()
        sizes = [sketch[f"n{c}"] or 0 for c in names]
        ends = [_literal_brackets(n, sketch[f"b{c}"], probs, accuracy) for n, c in zip(sizes, names)]
        # Narrow rows and small lookups keep the second scan in compiled code for any width.
        place = F.col("i") + 1
        brackets = [
            tuple(F.element_at(F.array(*[F.lit(e[q][side]) for e in ends]), place) for side in (0, 1))
            for q in range(len(probs))
        ]
        long = stacked(wide).filter(F.col("v").isNotNull())
        thinned = long.select("i", _thin(F.col("v"), brackets).alias("t"))
        counts = (
            thinned.filter(F.col("t.v").isNotNull())
            .groupBy("i", F.col("t.v").alias("_v"), F.col("t.kept").alias("_kept"))
            .agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_n", F.element_at(F.array(*[F.lit(n) for n in sizes]), place).cast("bigint"))
        )
    picked = _read_ranks(counts, ["i"], probs, rows > MANY_ROWS)
    labels = F.array(*[F.lit(c) for c in columns])
    return picked.select(
        F.element_at(labels, F.col("i") + 1).alias("column"), *[f"q{i}" for i in range(len(probs))]
    )


def _literal_brackets(n: int, cuts: list[float] | None, probs: list[float], accuracy: int) -> list[tuple[float, float]]:
    out = []
    for i, p in enumerate(probs):
        low = -math.inf if n <= SMALL or p - 2 / accuracy <= 0 else float(cuts[2 * i])
        high = math.inf if n <= SMALL or p + 2 / accuracy >= 1 else float(cuts[2 * i + 1])
        out.append((low, high))
    return out


def grouped_quantiles(
    df: DataFrame, group: str, value: str, probs: list[float], few_groups: bool = False
) -> DataFrame:
    """Interpolated quantiles of one column per group: ``group, q0, q1, ...``.

    ``few_groups`` says the caller knows the groups to be a handful, so that
    their brackets may be broadcast.
    """
    array = F.array(*[F.lit(p) for p in _bracket_probs(probs)])
    slim = df.select(as_column(group).alias("_g"), as_column(value).cast("double").alias("_x")).filter(
        F.col("_x").isNotNull()
    )
    sketch = slim.groupBy(F.col("_g").alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", array, F.lit(ACCURACY)).alias("_cuts")
    )
    joined = slim.join(F.broadcast(sketch) if few_groups else sketch, F.col("_g").eqNullSafe(F.col("_k")))
    brackets = _brackets(F.col("_n"), F.col("_cuts"), probs)
    thinned = joined.select("_g", "_n", _thin(F.col("_x"), brackets).alias("t"))
    counts = (
        thinned.filter(F.col("t.v").isNotNull())
        .groupBy("_g", F.col("t.v").alias("_v"), F.col("t.kept").alias("_kept"), "_n")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    many = few_groups and row_count(df) > MANY_ROWS
    return _read_ranks(counts, ["_g"], probs, many).withColumnRenamed("_g", group)
