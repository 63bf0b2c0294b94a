"""Decision rules: task type, class balance, fitness of data, labels and vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions.scalars import as_column, missing_to_null
from gridsmith.operators.association import mean_correlation
from gridsmith.operators.columns import is_numeric, numeric_columns, simple_columns
from gridsmith.operators.counting import class_distribution, distinct_near, distinct_within
from gridsmith.operators.profile import outlier_counts
from gridsmith.operators.roles import column_roles

# Fixed values.
FEW_VALUES = 20
LOW_RATIO = 0.05
MAX_CLASSES = 100
MIN_ROWS = 50
MIN_COLUMNS = 2
MAX_MISSING = 0.5
MISSING_WARNING = 0.35
MIN_REGRESSION_VALUES = 10
MAX_FEATURES = 100
MIN_CLUSTER_ROWS = 5

RULE_SCHEMA = "rule string, level string, value double, bound double, ok boolean"


def _numeric(df: DataFrame, column: str) -> bool:
    return is_numeric(df.schema[column].dataType)


def task_type(df: DataFrame, target: str | None) -> DataFrame:
    """``target, task, n_values, n_distinct`` by the kind and spread of the target."""
    if target is None:
        return df.sparkSession.createDataFrame(
            [(None, "clustering", None, None)], "target string, task string, n_values bigint, n_distinct bigint"
        )
    c = as_column(target)
    df = missing_to_null(df.select(c))
    stats = df.agg(F.count(c).alias("n_values"), F.count_distinct(c).alias("n_distinct"))
    if _numeric(df, target):
        few = (F.col("n_distinct") <= FEW_VALUES) | (F.col("n_distinct") / F.col("n_values") < LOW_RATIO)
        task = F.when(few, "classification").otherwise("regression")
    else:
        task = F.lit("classification")
    task = F.when(F.col("n_values") == 0, "unknown").otherwise(task)
    return stats.select(F.lit(target).alias("target"), task.alias("task"), "n_values", "n_distinct")


def guarded_task_type(df: DataFrame, target: str) -> DataFrame:
    """Task type with identifiers and too many classes refused: ``target, task, n_classes, error, warning``."""
    rows = df.select(F.count(F.lit(1))).first()[0]
    found = task_type(df, target)
    identifier = F.col("n_distinct") == rows
    classes = F.when(~identifier & (F.col("task") == "classification"), F.col("n_distinct")).otherwise(F.lit(0))
    error = F.when(identifier, "identifier").when(classes > MAX_CLASSES, "too_many_classes")
    return found.select(
        "target",
        F.when(error.isNotNull(), "unknown").otherwise(F.col("task")).alias("task"),
        classes.cast("bigint").alias("n_classes"),
        error.alias("error"),
        F.when(error.isNull() & (F.col("task") == "classification") & (classes < 2), "single_class").alias("warning"),
    )


def class_imbalance(df: DataFrame, target: str, threshold: float = 0.8) -> DataFrame:
    """Shares of the largest and smallest class, ties by value; one row."""
    counts = class_distribution(missing_to_null(df.select(as_column(target))), target).withColumn(
        "value", F.col("value").cast("string")
    )
    largest = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    smallest = F.min(F.struct("n", "value"))
    stats = counts.agg(
        F.count(F.lit(1)).alias("total_classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"),
        largest.alias("_big"),
        smallest.alias("_small"),
    )
    big, small, total = -F.col("_big.n"), F.col("_small.n"), F.col("total_samples")
    several = F.col("total_classes") > 1
    return stats.select(
        (several & (big / total > threshold)).alias("is_imbalanced"),
        F.when(several, big / total).otherwise(F.lit(1.0)).alias("imbalance_ratio"),
        F.when(several, small / big).alias("balance_ratio"),
        "total_samples",
        "total_classes",
        F.when(several, F.col("_big.value")).alias("majority_class"),
        F.when(several, big).alias("majority_count"),
        F.when(several, big / total * 100).alias("majority_percentage"),
        F.when(several, F.col("_small.value")).alias("minority_class"),
        F.when(several, small).alias("minority_count"),
        F.when(several, small / total * 100).alias("minority_percentage"),
    )


def _flag_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def eligible_targets(df: DataFrame) -> DataFrame:
    """``column, classification, regression``: what each column can be a target of."""
    df = missing_to_null(df)
    columns = simple_columns(df)
    numeric = [c for c in columns if _numeric(df, c)]
    counts = distinct_near(df, {c: [MAX_CLASSES, MIN_REGRESSION_VALUES] for c in numeric})
    rows = [
        (c, c not in counts or counts[c] <= MAX_CLASSES, c in counts and counts[c] > MIN_REGRESSION_VALUES)
        for c in columns
    ]
    return _flag_table(df, rows, "column string, classification boolean, regression boolean")


def recommended_features(df: DataFrame, target: str | None = None, limit: int | None = None) -> DataFrame:
    """Numeric columns, then categorical ones with at most 20 values: ``position, feature, role``; with ``limit`` the first so many."""
    df = missing_to_null(df)
    roles = column_roles(df)
    few = distinct_within(df, roles["categorical"], FEW_VALUES)
    chosen = [(c, "numeric") for c in roles["numeric"]]
    chosen += [(c, "categorical") for c in roles["categorical"] if few[c] is not None]
    chosen = [x for x in chosen if x[0] != target][:limit]
    rows = [(i, c, role) for i, (c, role) in enumerate(chosen)]
    return _flag_table(df, rows, "position int, feature string, role string")


def _rules(one: DataFrame, rules: list[tuple[str, str, Column, float, Column]]) -> DataFrame:
    """One row per rule from a one-row frame of measurements."""
    structs = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(level).alias("level"),
            value.cast("double").alias("value"),
            F.lit(float(bound)).alias("bound"),
            F.coalesce(ok, F.lit(False)).alias("ok"),
        )
        for name, level, value, bound, ok in rules
    ]
    return one.select(F.inline(F.array(*structs)))


def ml_readiness(df: DataFrame) -> DataFrame:
    """Size, missing share and constancy rules of a table: ``rule, level, value, bound, ok``."""
    df = missing_to_null(df)
    numeric = numeric_columns(df)
    worst = [F.count_if(as_column(c).isNull()) for c in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [w.alias(f"m{i}") for i, w in enumerate(worst)]
    aggs += [F.min(as_column(c)).eqNullSafe(F.max(as_column(c))).alias(f"c{i}") for i, c in enumerate(numeric)]
    one = df.agg(*aggs)
    missing = [F.col(f"m{i}") for i in range(len(df.columns))]
    most = F.greatest(*missing) if len(missing) > 1 else missing[0]
    share = most / F.nullif(F.col("rows"), F.lit(0))
    constant = F.lit(0)
    for i in range(len(numeric)):
        constant = constant + F.col(f"c{i}").cast("int")
    rules = [
        ("min_rows", "error", F.col("rows"), MIN_ROWS, F.col("rows") >= MIN_ROWS),
        ("min_columns", "error", F.lit(len(df.columns)), MIN_COLUMNS, F.lit(len(df.columns) >= MIN_COLUMNS)),
        ("max_missing", "error", share, MAX_MISSING, share <= MAX_MISSING),
        ("high_missing", "warning", share, MISSING_WARNING, (share <= MISSING_WARNING) | (share > MAX_MISSING)),
    ]
    if numeric:
        rules.append(("constant_numerics", "warning", constant, len(numeric), constant < len(numeric)))
    return _rules(one, rules)


def training_data_check(df: DataFrame, features: list[str], target: str | None, task: str) -> DataFrame:
    """Rules for a feature table and its target before training."""
    df = missing_to_null(df)
    used = [c for c in features if c in df.columns]
    cells = F.lit(0).cast("bigint")
    for c in used:
        cells = cells + F.count_if(as_column(c).isNull())
    aggs = [F.count(F.lit(1)).alias("rows"), cells.alias("missing")]
    supervised = task != "clustering" and target is not None
    if supervised:
        aggs.append(F.count(as_column(target)).alias("valid"))
        aggs.append((F.min(as_column(target)) < F.max(as_column(target))).alias("varied"))
    one = df.agg(*aggs)
    rows, share = F.col("rows"), F.col("missing") / F.nullif(F.col("rows") * len(used), F.lit(0))
    rules = [
        ("min_rows", "error", rows, MIN_ROWS, rows >= MIN_ROWS),
        ("has_features", "error", F.lit(len(used)), 1, F.lit(len(used) > 0)),
        ("max_missing", "warning", share, MAX_MISSING, share <= MAX_MISSING),
    ]
    if supervised:
        valid = F.col("valid")
        rules.append(("valid_targets", "error", valid, MIN_ROWS, valid >= MIN_ROWS))
        if task == "classification":
            # Two classes exist exactly when the extremes differ; no distinct count is needed.
            rules.append(("two_classes", "error", F.col("varied").cast("int") + 1, 2, F.col("varied")))
    elif target is not None:
        rules.append(("target_ignored", "warning", F.lit(1), 0, F.lit(False)))
    return _rules(one, rules)


def clustering_features(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, valid, reason, missing_ratio, outliers, many_outliers, suggested``."""
    df = missing_to_null(df)
    present = [f for f in features if f in df.columns and _numeric(df, f)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(present):
        c = as_column(f)
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}")]
    row = df.agg(*aggs).first()
    facts = []
    for f in features:
        if f not in df.columns:
            facts.append((f, False, "absent", None))
            continue
        if f not in present:
            facts.append((f, False, "not_numeric", None))
            continue
        i = present.index(f)
        n, missing = row[f"n{i}"], 1 - row[f"n{i}"] / row["rows"] if row["rows"] else 1.0
        same = n > 0 and row[f"low{i}"] == row[f"high{i}"]
        reason = "constant" if same and n > 1 else "missing" if missing > MAX_MISSING else "single_value" if same else None
        facts.append((f, reason is None, reason, missing))
    base = _flag_table(df, facts, "feature string, valid boolean, reason string, missing_ratio double")
    valid = [f[0] for f in facts if f[1]]
    if not valid:
        return base.selectExpr("*", "cast(null as bigint) outliers", "false many_outliers", "false suggested")
    outliers = outlier_counts(df, valid).withColumnsRenamed({"column": "feature", "flagged": "many_outliers"})
    out = base.join(outliers, "feature", "left")
    if len(numeric_columns(df)) > 1:
        out = out.join(mean_correlation(df, features).select("feature", "suggested"), "feature", "left")
    else:
        out = out.withColumn("suggested", F.lit(False))
    return out.fillna(False, ["many_outliers", "suggested"])


def clustering_summary(checked: DataFrame) -> DataFrame:
    """``n_features, n_valid, quality, is_valid`` of a checked feature list."""
    return checked.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("valid")).alias("n_valid")
    ).select(
        "n_features",
        "n_valid",
        (F.col("n_valid") / F.col("n_features")).alias("quality"),
        (F.col("n_valid") >= MIN_COLUMNS).alias("is_valid"),
    )


def _gaps(df: DataFrame, c: str) -> Column:
    col = as_column(c)
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def prediction_check(df: DataFrame, label: str, prediction: str, task: str) -> DataFrame:
    """Rules for a label and prediction pair before metrics are taken."""
    y, p = as_column(label), as_column(prediction)
    rows = F.col("rows")
    aggs = [F.count(F.lit(1)).alias("rows")]
    if task == "classification":
        known = F.when(~_gaps(df, label), y)
        guess = F.when(~_gaps(df, prediction), p)
        aggs += [F.count_distinct(known).alias("classes"), F.count_distinct(guess).alias("guessed")]
    elif task == "regression":
        aggs += [
            F.count_if((F.abs(y) == float("inf")) | (F.abs(p) == float("inf"))).alias("infinite"),
            (F.count_if(_gaps(df, label)) + F.count_if(_gaps(df, prediction))).alias("gaps"),
        ]
    else:
        guess = F.when(~_gaps(df, prediction), p)
        aggs += [F.count_distinct(guess).alias("clusters"), F.count_if(p == -1).alias("noise")]
    rules = [
        ("not_empty", "error", rows, 1, rows > 0),
        ("min_rows", "warning", rows, MIN_ROWS, rows >= MIN_ROWS),
    ]
    if task == "classification":
        rules += [
            ("true_classes", "error", F.col("classes"), 2, F.col("classes") >= 2),
            ("predicted_classes", "warning", F.col("guessed"), 2, F.col("guessed") >= 2),
            ("max_classes", "warning", F.col("classes"), MAX_CLASSES, F.col("classes") <= MAX_CLASSES),
        ]
    elif task == "regression":
        rules += [
            ("finite", "warning", F.col("infinite"), 0, F.col("infinite") == 0),
            ("max_missing", "warning", F.col("gaps") / rows, MAX_MISSING, F.col("gaps") <= rows * MAX_MISSING),
        ]
    else:
        enough = (F.col("clusters") >= 2) | (F.col("noise") > 0)
        rules.append(("clusters", "warning", F.col("clusters"), 2, enough))
    return _rules(df.agg(*aggs), rules)


def vector_check(df: DataFrame, features: str = "features") -> DataFrame:
    """NaN, infinite cells and zero-variance features of a vector column, one row.

    The vector is opened once per row and aggregated per position, so its width
    costs rows in the partial aggregate, not columns in the plan.
    """
    cells = df.select(F.posexplode(vector_to_array(as_column(features))).alias("position", "x"))
    per_feature = cells.groupBy("position").agg(
        F.count_if(F.isnan("x")).alias("nans"),
        F.count_if(F.abs("x") == float("inf")).alias("infs"),
        F.var_pop("x").alias("variance"),
    )
    one = per_feature.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.coalesce(F.sum("nans"), F.lit(0)).alias("nan_count"),
        F.coalesce(F.sum("infs"), F.lit(0)).alias("inf_count"),
        F.count_if(F.col("variance") == 0).alias("zero_variance_features"),
    )
    return one.withColumn("is_valid", (F.col("n_features") > 0) & (F.col("inf_count") == 0))
