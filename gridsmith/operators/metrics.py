"""Classification and regression metrics as aggregations of a prediction table."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalars import absolute_error, as_column, missing_to_null, residual
from gridsmith.operators.cumulate import exact_quantiles, running_totals
from gridsmith.session import cut_lineage


def _share(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, n`` of the pairs that occur."""
    return (
        df.dropna(subset=[label, prediction])
        .groupBy(as_column(label).alias("label"), as_column(prediction).alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every cell over the union of labels and predictions, zeros included."""
    counts = confusion_counts(df, label, prediction)
    values = counts.select(F.explode(F.array("label", "prediction")).alias("v")).distinct()
    # Rows and columns of the matrix asked for: the label set squared, like the answer itself.
    rows = values.agg(F.sort_array(F.collect_set("v")).alias("vs"))
    grid = rows.select(F.explode("vs").alias("label"), "vs").select("label", F.explode("vs").alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").fillna(0, ["n"])


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction", with_accuracy: bool = False) -> DataFrame:
    """``class, precision, recall, f1_score, support`` per class plus macro and weighted means.

    ``with_accuracy`` adds the share of hits as the ``f1_score`` of a row ``accuracy``, over all rows.
    """
    per_class = _per_class(confusion_counts(df, label, prediction))
    weight = F.col("support") / F.sum("support").over(Window.partitionBy(F.lit(1)))
    # One row per class: a label set, not data rows.
    weighted = per_class.withColumn("_w", weight)
    names = ["precision", "recall", "f1_score"]
    macro = per_class.agg(
        F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")
    )
    average = weighted.agg(
        F.lit("weighted avg").alias("class"),
        *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    report = per_class.select("class", *names, "support").unionByName(macro).unionByName(average)
    if not with_accuracy:
        return report
    nothing = F.lit(None).cast("double")
    share = _share(F.sum("hit"), F.sum("support"))
    hits = per_class.agg(F.lit("accuracy").alias("class"), nothing.alias("precision"), nothing.alias("recall"), share.alias("f1_score"), F.sum("support").alias("support"))
    return report.unionByName(hits)


def _per_class(counts: DataFrame) -> DataFrame:
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").cast("string").alias("class"),
                    F.col("n").alias("true"),
                    F.lit(0).cast("bigint").alias("guessed"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("prediction").cast("string").alias("class"),
                    F.lit(0).cast("bigint").alias("true"),
                    F.col("n").alias("guessed"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("true").alias("support"), F.sum("guessed").alias("guessed")
    )
    precision, recall = _share(F.col("hit"), F.col("guessed")), _share(F.col("hit"), F.col("support"))
    return sums.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        _share(2 * precision * recall, precision + recall).alias("f1_score"),
        "support",
        "hit",
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; one row."""
    return _weighted_metrics(confusion_counts(df, label, prediction))


def _weighted_metrics(counts: DataFrame) -> DataFrame:
    per_class = _per_class(counts)
    total = F.sum("support")
    return per_class.agg(
        _share(F.sum("hit"), total).alias("accuracy"),
        *[_share(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1_score")],
        total.alias("n_samples"),
    )


def score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """``class, score, pos, neg`` pre-aggregated by score value, for one positive class."""
    hit = (as_column(label) == F.lit(positive)).cast("bigint")
    return (
        df.dropna(subset=[label, score])
        .select(F.lit(str(positive)).alias("class"), as_column(score).cast("double").alias("score"), hit.alias("hit"))
        .groupBy("class", "score")
        .agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    )


def score_counts_by_class(df: DataFrame, label: str, scores: dict[str, Column]) -> DataFrame:
    """One-versus-rest counts from one scan: ``scores`` maps a class to its score column."""
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("class"),
                c.cast("double").alias("score"),
                (as_column(label).cast("string") == F.lit(k)).cast("bigint").alias("hit"),
            )
            for k, c in scores.items()
        ]
    )
    return (
        df.dropna(subset=[label])
        .select(F.inline(cells))
        .groupBy("class", "score")
        .agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    )


def roc_auc_by_class(counts: DataFrame) -> DataFrame:
    """``class, auc, support``: the chance that a positive outranks a negative, ties half."""
    below = running_totals(counts, "class", "score", ["neg"])
    return below.groupBy("class").agg(
        (
            F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
            / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
        ).alias("auc"),
        F.sum("pos").alias("support"),
    )


def roc_auc(counts: DataFrame) -> DataFrame:
    """One number: the AUC of the only class, or the support-weighted mean over classes."""
    return roc_auc_by_class(counts).agg(
        (F.sum(F.col("auc") * F.col("support")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("support")))).alias(
            "roc_auc"
        )
    )


def roc_curve(counts: DataFrame) -> DataFrame:
    """``class, threshold, fpr, tpr`` at every score value, from (0, 0) at infinity on."""
    below = running_totals(counts, "class", "score", ["pos", "neg"])
    points = below.select(
        "class",
        F.col("score").alias("threshold"),
        ((F.col("neg_total") - F.col("neg_below")) / F.nullif(F.col("neg_total"), F.lit(0))).alias("fpr"),
        ((F.col("pos_total") - F.col("pos_below")) / F.nullif(F.col("pos_total"), F.lit(0))).alias("tpr"),
    )
    start = counts.select("class").distinct().select(
        "class", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def probability_scores(df: DataFrame, classes: list, probability: str = "probability") -> tuple[DataFrame, dict]:
    """Open a probability vector into one score column per class."""
    opened = df.withColumn("_p", vector_to_array(as_column(probability)))
    return opened, {str(c): F.col("_p")[i] for i, c in enumerate(classes)}


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MSE, MAE, RMSE, R2, explained variance and, for positive values, MSLE; one row."""
    y, p = as_column(label).cast("double"), as_column(prediction).cast("double")
    pairs = missing_to_null(df.select(y.alias("y"), p.alias("p"))).dropna()
    e = F.col("y") - F.col("p")
    log_gap = F.log1p(F.col("y")) - F.log1p(F.col("p"))
    fits = F.bool_and((F.col("y") > 0) & (F.col("p") > 0) & (F.abs("y") != float("inf")) & (F.abs("p") != float("inf")))
    stats = pairs.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop("y").alias("_vy"),
        F.var_pop(e).alias("_ve"),
        fits.alias("_fits"),
        # Only read when every value is positive.
        F.avg(F.when((F.col("y") > 0) & (F.col("p") > 0), log_gap * log_gap)).alias("_msle"),
    )
    spread = F.nullif(F.col("_vy"), F.lit(0.0))
    return stats.select(
        "mse",
        "mae",
        F.sqrt("mse").alias("rmse"),
        # A constant label is explained by a perfect fit alone.
        F.coalesce(1 - F.col("mse") / spread, F.when(F.col("_vy") == 0, (F.col("mse") == 0).cast("double"))).alias("r2"),
        F.coalesce(1 - F.col("_ve") / spread, F.when(F.col("_vy") == 0, (F.col("_ve") == 0).cast("double"))).alias("explained_variance"),
        F.when(F.col("_fits"), F.col("_msle")).alias("msle"),
        "n_samples",
    )


def error_statistics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean, population deviation, maximum, median and 95 % quantile of the absolute error."""
    errors = missing_to_null(df.select(absolute_error(label, prediction).cast("double").alias("error"))).dropna()
    quantiles = exact_quantiles(errors, ["error"], [0.5, 0.95])
    moments = errors.agg(
        F.lit("error").alias("column"),
        F.avg("error").alias("mean_error"),
        F.stddev_pop("error").alias("std_error"),
        F.max("error").alias("max_error"),
    )
    return moments.join(quantiles, "column", "left").select(
        "mean_error", "std_error", "max_error", F.col("q0").alias("median_error"), F.col("q1").alias("q95_error")
    )


def residual_table(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("residual", residual(label, prediction))


def prediction_range(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Ends of the line of perfect prediction: ``low, high``."""
    y, p = as_column(label), as_column(prediction)
    return df.agg(F.least(F.min(y), F.min(p)).alias("low"), F.greatest(F.max(y), F.max(p)).alias("high"))


def evaluate(
    df: DataFrame, task: str, label: str = "label", prediction: str = "prediction", scores: dict | None = None, details: bool = False, classes: list[str] | None = None
) -> DataFrame:
    """The metrics of a prediction table in long form: ``metric, value``.

    ``details`` adds the error statistics of a regression, or for each class its
    report (``class.<name>.precision`` and so on) and the cells of the confusion
    matrix that occur; ``classes`` are the names of the codes.
    """
    if task == "regression":
        long = _long(regression_metrics(df, label, prediction))
        return long.unionByName(_long(error_statistics(df, label, prediction))) if details else long
    counts = confusion_counts(df, label, prediction)
    if details:
        # A label set squared at most, told by one scan and read several times.
        counts = cut_lineage(counts)
    long = _long(_weighted_metrics(counts))
    if scores:
        long = long.unionByName(_long(roc_auc(score_counts_by_class(df, label, scores))))
    if not details:
        return long
    names = F.array(*[F.lit(c) for c in classes]) if classes else None
    named = (lambda c: F.get(names, c.cast("int"))) if classes else (lambda c: c.cast("string"))
    cells = counts.select(F.concat_ws(".", F.lit("confusion"), named(F.col("label")), named(F.col("prediction"))).alias("metric"), F.col("n").cast("double").alias("value"))
    report = _per_class(counts.select(named(F.col("label")).alias("label"), named(F.col("prediction")).alias("prediction"), "n"))
    measures = ["precision", "recall", "f1_score", "support"]
    rows = report.select("class", *[F.col(c).cast("double") for c in measures]).unpivot(["class"], measures, "measure", "value")
    return long.unionByName(cells).unionByName(rows.select(F.concat_ws(".", F.lit("class"), "class", "measure").alias("metric"), "value"))


def _long(wide: DataFrame) -> DataFrame:
    casts = wide.select(*[F.col(c).cast("double") for c in wide.columns])
    return casts.unpivot([], wide.columns, "metric", "value")
