"""Correlation, association between categories, and feature relevance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column, missing_to_null, nan_to_null
from gridsmith.functions.tails import correlation_p, f_tail
from gridsmith.operators.codes import few_levels, with_code
from gridsmith.operators.columns import is_numeric, numeric_columns, other_columns, rows_from
from gridsmith.operators.counting import (
    contingency,
    contingency_wide,
    distinct_within,
    least_missing,
)
from gridsmith.operators.profile import box_by_category
from gridsmith.session import cut_lineage

# The limits of the usual views, for callers who want them.
VIEW_CATEGORIES = 100
VIEW_COLUMNS = 30
VIEW_DISTINCT = 1000
IDENTIFIER_WORDS = ["id", "product", "sku", "code", "index", "unique"]
LOW_CORRELATION = 0.3
# Up to this many pairs are plain aggregates of one job.
FEW_PAIRS = 6


def pair_correlation(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are known; NULL when either is constant."""
    a, b = a.cast("double"), b.cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pair_rows(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, r`` per pair, from one scan.

    A few pairs are plain aggregates. Many would make one huge generated
    method, so there each task multiplies its own columns as matrices and
    sends one row per pair to the shuffle.
    """
    if len(pairs) > FEW_PAIRS:
        return _pair_rows_by_blocks(df, pairs)
    one = df.agg(
        *[pair_correlation(as_column(a), as_column(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    return rows_from(
        one,
        [f"{i}" for i in range(len(pairs))],
        {
            "a": lambda i, _: F.lit(pairs[i][0]),
            "b": lambda i, _: F.lit(pairs[i][1]),
            "r": lambda i, _: nan_to_null(F.col(f"r{i}")),
        },
    ).drop("column")


def _pair_rows_by_blocks(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    columns = sorted({c for pair in pairs for c in pair})
    place = {c: i for i, c in enumerate(columns)}
    wide = df.select(*[as_column(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    stats = wide.agg(*[F.avg(c) for c in wide.columns], *[F.min(c) == F.max(c) for c in wide.columns]).first()
    # Sums are taken around the means so that large offsets do not cancel digits.
    centre = [float(v or 0.0) for v in stats[: len(columns)]]
    constant = {c for i, c in enumerate(columns) if stats[len(columns) + i] in (None, True)}
    left = [place[a] for a, _ in pairs]
    right = [place[b] for _, b in pairs]
    # Only the rows of the matrix that are asked for are multiplied.
    asked = sorted(set(left))
    number = {i: n for n, i in enumerate(asked)}
    row = [number[i] for i in left]

    def products(batches):
        import numpy as np
        import pandas as pd

        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - np.array(centre)
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            a, has = x[:, asked], known[:, asked]
            part = np.stack([has.T @ known, a.T @ known, has.T @ x, (a * a).T @ known, has.T @ (x * x), a.T @ x])[:, row, right]
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"pair": np.arange(len(left)), **{f"s{i}": total[i] for i in range(6)}})

    fields = ", ".join(f"s{i} double" for i in range(6))
    sums = wide.mapInPandas(products, f"pair int, {fields}").groupBy("pair").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)])
    n, x, y, xx, yy, xy = (F.col(f"s{i}") for i in range(6))
    wide_x, wide_y = n * xx - x * x, n * yy - y * y
    # What is left of a column constant over the shared rows is rounding, not spread.
    varies = (wide_x > n * xx * 1e-12) & (wide_y > n * yy * 1e-12)
    r = F.when(varies, F.try_divide(n * xy - x * y, F.sqrt(wide_x * wide_y)))
    # Names are looked up by number: the plan holds one list of columns, not one of pairs.
    scored = sums.withColumn("r", r)
    names, flat = _strings(columns), F.array(*[F.lit(c in constant) for c in columns])
    first, second = (F.element_at(_numbers(side), F.col("pair") + 1) + 1 for side in (left, right))
    told = scored.select(first.alias("i"), second.alias("j"), "r")
    is_flat = F.element_at(flat, F.col("i")) | F.element_at(flat, F.col("j"))
    return told.select(
        F.element_at(names, F.col("i")).alias("a"), F.element_at(names, F.col("j")).alias("b"), F.when(~is_flat, F.col("r")).alias("r")
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _numbers(values: list[int]) -> Column:
    """An array of many numbers as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _full_matrix(half: DataFrame) -> DataFrame:
    """Both triangles from one; the diagonal is listed once."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "r"))).otherwise(
        F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    )
    return half.select(F.inline(both))


def pearson_matrix(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Correlation of every pair of numeric columns over the rows where both are known.

    With ``limit`` only so many columns, those with the fewest gaps.
    """
    df = missing_to_null(df)
    columns = columns if columns is not None else numeric_columns(df)
    if limit is not None and len(columns) > limit:
        columns = [r["column"] for r in least_missing(df, limit, columns).collect()]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return _full_matrix(_pair_rows(df.select(*[as_column(c) for c in columns]), pairs))


def matrix_columns(df: DataFrame, max_distinct: int | None = None) -> list[str]:
    """Numeric columns without identifier names; with ``max_distinct`` those of at most so many values."""
    named = [c for c in numeric_columns(df) if not any(w in c.lower() for w in IDENTIFIER_WORDS)]
    if max_distinct is None:
        return named
    few = distinct_within(df, named, max_distinct)
    return [c for c in named if few.get(c) is not None]


def correlation_matrix(
    df: DataFrame, target: str | None = None, task: str = "classification", limit: int | None = None, max_distinct: int | None = None,
) -> DataFrame | None:
    """Correlation over complete rows of the fit columns, undefined values as 0.

    ``limit`` and ``max_distinct`` narrow the columns for a view. A classification target that is not among them joins as its sorted code,
    missing as -1. None when fewer than 2 columns or 10 complete rows remain.
    """
    df = missing_to_null(df)
    columns = matrix_columns(df, max_distinct)
    if target and target in df.columns and target not in columns and task == "classification":
        df = with_code(df.withColumn("_target", as_column(target).cast("string")), "_target", "_code")
        df = df.withColumn(target, F.coalesce(F.col("_code"), F.lit(-1))).drop("_target", "_code")
        columns.append(target)
    if limit is not None and len(columns) > limit:
        columns = [r["column"] for r in least_missing(df, limit, columns).collect()]
    if len(columns) < 2:
        return None
    complete = df.select(*[as_column(c) for c in columns]).dropna()
    if len(complete.take(10)) < 10:
        return None
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    full = _full_matrix(_pair_rows(complete, pairs))
    return full.withColumn("r", F.coalesce("r", F.lit(0.0)))


def _score_row(df: DataFrame, a: str, b: str, score: float | None) -> DataFrame:
    return df.sparkSession.createDataFrame([(a, b, score)], "a string, b string, score double")


def cramers_v(df: DataFrame, a: str, b: str, limit: int | None = None) -> DataFrame:
    """``a, b, score`` without correction, for any number of values; 0 where one column has a single value.

    With ``limit``, columns of more values are not scored and give NULL.
    """
    if limit is not None and a != b and any(n is None for n in distinct_within(df, [a, b], limit).values()):
        return _score_row(df, a, b, None)
    return _cramers(_contingency_pairs(df, [a, b]), [a, b])


def cramers_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, score`` of every pair of the columns, in their order, from one scan."""
    return _cramers(_contingency_pairs(df, columns), columns)


def _contingency_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``i, j, a, b, n``: how often two values of columns i < j stand in one row; only combinations that occur."""
    values = F.array(*[as_column(c).cast("string") for c in columns])
    first = df.select(values.alias("vs")).select("vs", F.posexplode("vs").alias("i", "a")).filter(F.col("a").isNotNull())
    behind = F.slice("vs", F.col("i") + 2, F.lit(len(columns)))
    both = first.select("i", "a", F.posexplode(behind).alias("k", "b")).filter(F.col("b").isNotNull())
    return both.groupBy("i", (F.col("i") + 1 + F.col("k")).alias("j"), "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _cramers(cells: DataFrame, columns: list[str]) -> DataFrame:
    # Written once, as it is summed along both sides and joined to the sums.
    cells = cut_lineage(cells)
    rows = cells.groupBy("i", "j", "a").agg(F.sum("n").alias("row"))
    cols = cells.groupBy("i", "j", "b").agg(F.sum("n").alias("col"))
    told = cells.join(rows, ["i", "j", "a"]).join(cols, ["i", "j", "b"])
    share = told.groupBy("i", "j").agg(F.sum(F.col("n") * F.col("n") / (F.col("row") * F.col("col"))).alias("s"))
    sizes = rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("r")).join(cols.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c")), ["i", "j"])
    small = F.least("r", "c") - 1
    # chi2 / n is the sum over cells of n^2 / (row * col), minus one.
    score = F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / F.nullif(small, F.lit(0)))
    scored = share.join(sizes, ["i", "j"]).select("i", "j", score.alias("score"))
    names, last = _strings(columns), len(columns) - 1
    first = cells.sparkSession.range(last).select(F.col("id").cast("int").alias("i"))
    pairs = first.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(last))).alias("j"))
    return pairs.join(scored, ["i", "j"], "left").select(
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def _anova(df: DataFrame, values: list[str], categories: list[str], smallest_group: int) -> DataFrame:
    """``category, value, groups, n, f`` of every numeric column against every category, in one scan."""
    numbers = [as_column(v).cast("double").alias(f"x{i}") for i, v in enumerate(values)]
    levels = F.posexplode(F.array(*[as_column(c).cast("string") for c in categories])).alias("_c", "_g")
    aggs = []
    for i in range(len(values)):
        aggs += [F.count(f"x{i}").alias(f"n{i}"), F.avg(f"x{i}").alias(f"m{i}"), F.var_pop(f"x{i}").alias(f"v{i}")]
    per_group = df.select(levels, *numbers).filter(F.col("_g").isNotNull()).groupBy("_c", "_g").agg(*aggs)
    stacked = F.array(*[
        F.struct(F.lit(i).alias("_v"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i in range(len(values))
    ])
    long = per_group.select("_c", F.inline(stacked)).filter(F.col("n") >= smallest_group)
    means = long.groupBy("_c", "_v").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    sums = (
        long.join(F.broadcast(means), ["_c", "_v"])  # one row per category and value column
        .groupBy("_c", "_v")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"),
            F.sum(F.col("n") * F.col("v")).alias("within"),
        )
    )
    between = F.col("between") / (F.col("groups") - 1)
    within = F.col("within") / (F.col("n") - F.col("groups"))
    f = F.when(
        (F.col("groups") > 1) & (F.col("n") > F.col("groups")) & (F.col("within") > 0), between / within
    )
    named = lambda names, c: F.element_at(_strings(names), F.col(c) + 1)
    return sums.select(named(categories, "_c").alias("category"), named(values, "_v").alias("value"), "groups", "n", f.alias("f"))


def anova_scores(df: DataFrame, values: list[str], category: str, limit: int | None = None) -> DataFrame:
    """``a, b, score`` with F/(F+1) for each numeric column, for any number of categories; 0 where undefined.

    With ``limit``, a category of more values is not scored and gives NULL.
    """
    df = missing_to_null(df)
    if limit is not None and distinct_within(df, [category], limit)[category] is None:
        base = df.sparkSession.range(1).select(F.explode(_strings(values)).alias("a"))
        return base.select("a", F.lit(category).alias("b"), F.lit(None).cast("double").alias("score"))
    return anova_matrix(df, values, [category])


def anova_matrix(df: DataFrame, values: list[str], categories: list[str]) -> DataFrame:
    """``a, b, score`` with F/(F+1) of every numeric column and category, from one scan; 0 where undefined."""
    base = df.sparkSession.range(1).select(F.explode(_strings(values)).alias("value")).select("value", F.explode(_strings(categories)).alias("category"))
    scored = base.join(_anova(missing_to_null(df), values, categories, 2), ["value", "category"], "left")
    return scored.select(
        F.col("value").alias("a"), F.col("category").alias("b"), F.coalesce(F.col("f") / (F.col("f") + 1), F.lit(0.0)).alias("score")
    )


def mixed_association(
    df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None
) -> DataFrame:
    """Association of every ordered pair: Pearson, F/(F+1) or Cramér's V by kind, with one scan for each kind."""
    df = missing_to_null(df)
    numeric = numeric if numeric is not None else numeric_columns(df)
    categorical = categorical if categorical is not None else other_columns(df)
    parts = []
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    if pairs:
        parts.append(_pair_rows(df, pairs).select("a", "b", F.coalesce("r", F.lit(0.0)).alias("r")))
    if numeric and categorical:
        parts.append(anova_matrix(df, numeric, categorical).withColumnRenamed("score", "r"))
    if len(categorical) > 1:
        parts.append(cramers_matrix(df, categorical).withColumnRenamed("score", "r"))
    ones = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in numeric + categorical])).alias("a")
    )
    parts.append(ones.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _full_matrix(out)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x: slope, intercept, r2 and pairs used."""
    df = missing_to_null(df)
    a, b = as_column(x).cast("double"), as_column(y).cast("double")
    return df.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
        F.regr_count(b, a).alias("n"),
    )


def bivariate(df: DataFrame, a: str, b: str, role_a: str, role_b: str, top: int | None = None) -> DataFrame | None:
    """The table behind a two-column view: line, boxes or contingency, by roles.

    With ``top`` boxes are drawn for so many of the most frequent categories only.
    """
    pair = (role_a, role_b)
    if pair == ("numeric", "numeric"):
        return trend_line(df, a, b)
    if pair == ("numeric", "categorical"):
        return box_by_category(df, a, b, top)
    if pair == ("categorical", "numeric"):
        return box_by_category(df, b, a, top)
    if pair == ("categorical", "categorical"):
        return contingency(df, a, b)
    return None


def bivariate_wide(df: DataFrame, a: str, b: str) -> DataFrame:
    levels = few_levels(df, [b], VIEW_CATEGORIES).get(b)
    return contingency_wide(df, a, b, levels)


def correlation_with_codes(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``feature, r, n, p`` of numeric features against the sorted code of a target."""
    df = missing_to_null(df)
    coded = with_code(df, target, "_code")
    aggs = []
    for i, f in enumerate(features):
        x = F.when(F.col("_code").isNotNull(), as_column(f).cast("double"))
        aggs += [pair_correlation(F.col("_code"), x).alias(f"r{i}"), F.count(x).alias(f"n{i}")]
    row = coded.agg(*aggs).first()
    rows = []
    for i, f in enumerate(features):
        r = row[f"r{i}"]
        r = None if r is None or math.isnan(r) else r
        rows.append((f, r, row[f"n{i}"], correlation_p(r, row[f"n{i}"])))
    return df.sparkSession.createDataFrame(rows, "feature string, r double, n bigint, p double")


def anova_test(df: DataFrame, target: str, categories: list[str]) -> DataFrame:
    """``feature, groups, n, f, p`` of a numeric target across each category column."""
    df = missing_to_null(df)
    found = _anova(df, [target], categories, 1).collect() if categories else []  # one row per category column
    order = {c: i for i, c in enumerate(categories)}
    rows = [
        (r["category"], r["groups"], r["n"], r["f"], f_tail(r["f"], r["groups"] - 1, r["n"] - r["groups"])) for r in sorted(found, key=lambda r: order[r["category"]])
    ]
    schema = "feature string, groups bigint, n bigint, f double, p double"
    return df.sparkSession.createDataFrame(rows, schema)


def relevant_features(
    df: DataFrame, target: str, min_correlation: float = 0.1, max_p: float = 0.05, max_levels: int | None = None,
) -> DataFrame:
    """``feature, role, score, p, keep`` of every feature against the target.

    A category column needs two values or more, each on two rows on average; with
    ``max_levels`` those of more values are left out.
    """
    schema = "feature string, role string, score double, p double, keep boolean"
    df = missing_to_null(df).filter(nan_safe_not_null(df, target))
    numeric_target = is_numeric(df.schema[target].dataType)
    numeric = [c for c in numeric_columns(df) if c != target]
    texts = [c for c in other_columns(df) if c != target and df.schema[c].dataType.typeName() == "string"]
    coded = df.withColumn("_y", as_column(target).cast("double")) if numeric_target else with_code(df, target, "_y")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(numeric):
        x = F.coalesce(as_column(c).cast("double"), F.lit(0.0))
        aggs += [pair_correlation(F.col("_y"), x).alias(f"r{i}"), (F.min(x) < F.max(x)).alias(f"varies{i}")]
    aggs += [F.count(as_column(c)).alias(f"t{i}") for i, c in enumerate(texts)]
    row = coded.agg(*aggs).first()
    rows = []
    if row["rows"] < 10:
        return df.sparkSession.createDataFrame([], schema)
    for i, c in enumerate(numeric):
        r = row[f"r{i}"]
        if not row[f"varies{i}"] or r is None or math.isnan(r):
            continue
        p = None if numeric_target else correlation_p(r, row["rows"])
        keep = abs(r) > min_correlation and (numeric_target or p < max_p)
        rows.append((c, "numeric", r, p, keep))
    filled = [c for i, c in enumerate(texts) if row[f"t{i}"] >= 10]
    present = {c: row[f"t{i}"] for i, c in enumerate(texts)}
    most = max([2, *(int(present[c] * 0.5) for c in filled)])
    levels = distinct_within(df, filled, most if max_levels is None else max_levels)
    fit = [c for c in filled if levels[c] and 1 < levels[c] <= present[c] * 0.5]
    if numeric_target and fit:
        for r in anova_test(df, target, fit).collect():
            rows.append((r["feature"], "categorical", r["f"], r["p"], r["p"] is not None and r["p"] < max_p))
    else:
        rows += [(c, "categorical", float(levels[c]), None, True) for c in fit]
    return df.sparkSession.createDataFrame(rows, schema)


def nan_safe_not_null(df: DataFrame, column: str):
    c = as_column(column)
    if df.schema[column].dataType.typeName() in ("double", "float"):
        return nan_to_null(c).isNotNull()
    return c.isNotNull()


def mean_correlation(df: DataFrame, features: list[str] | None = None, suggest: int | None = None) -> DataFrame:
    """``feature, mean_abs_r, suggested``: mean absolute correlation with the others.

    Suggested are those of low correlation; with ``suggest`` at most so many, the lowest.
    """
    df = missing_to_null(df)
    numeric = numeric_columns(df)
    features = features if features is not None else numeric
    # Rows of the matrix for the features asked about, not the whole of it.
    pairs = [(a, b) for a in numeric if a in set(features) for b in numeric if a != b]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, mean_abs_r double, suggested boolean")
    means = _pair_rows(df, pairs).groupBy(F.col("a").alias("feature")).agg(F.avg(F.abs("r")).alias("mean_abs_r"))
    low = F.coalesce(F.col("mean_abs_r") < LOW_CORRELATION, F.lit(False))
    if suggest is None:
        return means.withColumn("suggested", low)
    # One row per feature: a single small window.
    best = Window.partitionBy(F.col("mean_abs_r") < LOW_CORRELATION).orderBy("mean_abs_r", "feature")
    return means.withColumn("suggested", low & (F.row_number().over(best) <= suggest))


def overall_correlation(df: DataFrame) -> DataFrame:
    """Mean absolute correlation over the whole matrix, diagonal included."""
    numeric = numeric_columns(df)
    return pearson_matrix(df, numeric).agg(F.avg(F.abs("r")).alias("avg_correlation"))
