"""Column expressions: parsing, text, dates, error terms and score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that counts as a number.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# The date formats tried, in order, with the text each accepts.
DATE_FORMATS = {
    "yyyy-M-d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "yyyy-M-d H:m:s": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
    "d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "M/d/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "yyyy/M/d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
    "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
}

# Score bands, closed at both ends, the first that fits wins.
SCORE_BANDS = {
    "accuracy": [
        (0.9, 1.0, "Excellent"),
        (0.8, 0.9, "Très bon"),
        (0.7, 0.8, "Bon"),
        (0.6, 0.7, "Moyen"),
        (0.0, 0.6, "À améliorer"),
    ],
    "f1_score": [
        (0.9, 1.0, "Excellent"),
        (0.8, 0.9, "Très bon"),
        (0.7, 0.8, "Bon"),
        (0.6, 0.7, "Moyen"),
        (0.0, 0.6, "À améliorer"),
    ],
    "r2": [
        (0.9, 1.0, "Excellente explication"),
        (0.7, 0.9, "Bonne explication"),
        (0.5, 0.7, "Explication modérée"),
        (0.3, 0.5, "Faible explication"),
        (0.0, 0.3, "Très faible explication"),
    ],
    "silhouette_score": [
        (0.7, 1.0, "Clusters excellents"),
        (0.5, 0.7, "Clusters raisonnables"),
        (0.3, 0.5, "Clusters faibles"),
        (0.0, 0.3, "Clusters douteux"),
        (-1.0, 0.0, "Clusters inadéquats"),
    ],
}
NO_BAND = "Non évalué"


def as_column(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name safe to use where dots or spaces would be parsed."""
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_column(c), F.lit(None).cast("double"))


def inf_to_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(F.abs(c) != F.lit(float("inf")), c)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to NULL in every float column: from here on only NULL is missing."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    if not floats:
        return df
    return df.withColumns({name: nan_to_null(name) for name in floats})


def to_number(c: Column | str) -> Column:
    """Text to double; what is not a plain decimal number is missing."""
    c = as_column(c)
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def to_time(c: Column | str, fmt: str) -> Column:
    """Text to timestamp in one of ``DATE_FORMATS``; failures are missing."""
    c = as_column(c)
    return F.when(c.rlike(DATE_FORMATS[fmt]), F.try_to_timestamp(c, F.lit(fmt)))


def to_time_inferred(c: Column | str) -> Column:
    """ISO text to timestamp, the fallback when no fixed format fits."""
    c = as_column(c)
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(c))


def looks_like_date(c: Column | str) -> Column:
    c = as_column(c)
    return c.rlike("[0-9]") & c.rlike("[-/T ]")


def shorten(c: Column | str, limit: int = 50) -> Column:
    c = as_column(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def date_parts(name: str) -> dict[str, Column]:
    """Year, month, day and day of week (Monday = 0), keyed by the new column name."""
    c = as_column(name)
    return {
        f"{name}_year": F.year(c),
        f"{name}_month": F.month(c),
        f"{name}_day": F.dayofmonth(c),
        f"{name}_dayofweek": F.weekday(c),
    }


def clean_model_name(c: Column | str) -> Column:
    c = F.lower(F.translate(as_column(c), " -", "__"))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")
    return F.trim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def residual(label: Column | str, prediction: Column | str) -> Column:
    return as_column(label) - as_column(prediction)


def absolute_error(label: Column | str, prediction: Column | str) -> Column:
    return F.abs(residual(label, prediction))


def squared_error(label: Column | str, prediction: Column | str) -> Column:
    gap = residual(label, prediction)
    return gap * gap


def interpret_score(metric: Column | str, value: Column | str) -> Column:
    """The band a metric value falls in."""
    metric, value = as_column(metric), as_column(value)
    text = F.lit(None).cast("string")
    cases = None
    for name, bands in SCORE_BANDS.items():
        for low, high, label in bands:
            hit = (metric == name) & value.between(F.lit(low), F.lit(high))
            cases = F.when(hit, label) if cases is None else cases.when(hit, label)
    return F.coalesce(cases.otherwise(text), F.lit(NO_BAND))
