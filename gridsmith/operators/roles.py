"""Type coercion of text columns and the logical role of every column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions.scalars import (
    DATE_FORMATS,
    as_column,
    looks_like_date,
    to_number,
    to_time,
    to_time_inferred,
)
from gridsmith.operators.columns import is_numeric, is_simple, is_time, spread
from gridsmith.operators.counting import distinct_within

# Shares above which a column changes type or role.
NUMERIC_SHARE = 0.95
DATE_LIKE_SHARE = 0.8
DATE_SHARE = 0.9
ROLE_DATE_SHARE = 0.8
CATEGORY_RATIO = 0.5
CATEGORY_LIMIT = 1000
ROLE_CATEGORY_LIMIT = 100

REPORT_SCHEMA = "column string, from_type string, to_type string, format string, success_rate double"
ROLES = ("numeric", "categorical", "text_or_high_cardinality", "datetime")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _parse_rates(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Share of values each parser accepts, per text column, in one scan."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = as_column(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        aggs.append(F.count(to_number(c)).alias(f"num{i}"))
        aggs.append(F.count_if(looks_like_date(c)).alias(f"like{i}"))
        aggs.append(F.count(to_time_inferred(c)).alias(f"iso{i}"))
        for j, fmt in enumerate(DATE_FORMATS):
            aggs.append(F.count(to_time(c, fmt)).alias(f"f{j}_{i}"))
    # Parsing is all work and no data: worth spreading when the table is one chunk.
    row = spread(df.select(*[as_column(c) for c in columns])).agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        out[c] = {
            "rows": row["rows"],
            "n": row[f"n{i}"],
            "numeric": row[f"num{i}"],
            "like": row[f"like{i}"],
            "inferred": row[f"iso{i}"],
            "formats": {fmt: row[f"f{j}_{i}"] for j, fmt in enumerate(DATE_FORMATS)},
        }
    return out


def coercion_decisions(df: DataFrame, columns: list[str] | None = None) -> list[tuple]:
    """What each text column becomes: numeric, datetime, category or string.

    Two jobs at most: one scan with every parser, then the distinct values of
    the columns no parser claimed. All rows are read, not a sample.
    """
    columns = columns if columns is not None else text_columns(df)
    if not columns:
        return []
    decided, open_columns = {}, []
    rates = _parse_rates(df, columns)
    for c in columns:
        r = rates[c]
        n = r["n"]
        if n == 0:
            continue
        if r["numeric"] / n > NUMERIC_SHARE:
            decided[c] = ("numeric", None, r["numeric"] / n)
            continue
        if r["like"] / n > DATE_LIKE_SHARE:
            fits = [(f, k / n) for f, k in r["formats"].items() if k / n > DATE_SHARE]
            if fits:
                decided[c] = ("datetime", *fits[0])
                continue
            if r["inferred"] / n > DATE_SHARE:
                decided[c] = ("datetime", "inferred", r["inferred"] / n)
                continue
        open_columns.append(c)
    for c, distinct in distinct_within(df, open_columns, CATEGORY_LIMIT - 1).items():
        category = distinct is not None and distinct / rates[c]["n"] < CATEGORY_RATIO
        decided[c] = ("category" if category else "string", None, 1.0)
    return [(c, "string", *decided[c]) for c in columns if c in decided]


def coercion_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    rows = coercion_decisions(df, columns)
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def coerce_types(df: DataFrame, decisions: list[tuple] | None = None) -> DataFrame:
    """Apply the decisions as one projection; missing stays missing.

    Category columns stay text and carry their role in the column metadata.
    """
    decisions = decisions if decisions is not None else coercion_decisions(df)
    by_name = {d[0]: d for d in decisions}
    out = []
    for name in df.columns:
        c = as_column(name)
        kind, fmt = (by_name[name][2], by_name[name][3]) if name in by_name else (None, None)
        if kind == "numeric":
            c = to_number(name).alias(name)
        elif kind == "datetime":
            c = (to_time_inferred(name) if fmt == "inferred" else to_time(name, fmt)).alias(name)
        elif kind == "category":
            c = c.alias(name, metadata={"role": "category"})
        out.append(c)
    return df.select(*out)


def column_roles(df: DataFrame, limit: int = ROLE_CATEGORY_LIMIT) -> dict[str, list[str]]:
    """Columns by role: numeric, datetime, categorical, text or high cardinality."""
    roles: dict[str, list[str]] = {r: [] for r in ROLES}
    texts = text_columns(df)
    rates = _parse_rates(df, texts) if texts else {}
    dated = {
        c
        for c in texts
        if rates[c]["rows"]
        and max(rates[c]["inferred"], *rates[c]["formats"].values()) / rates[c]["rows"] > ROLE_DATE_SHARE
    }
    few = distinct_within(df, [c for c in texts if c not in dated and rates[c]["n"]], limit)
    for f in df.schema.fields:
        name = f.name
        if not is_simple(f.dataType):
            continue
        if is_numeric(f.dataType):
            roles["numeric"].append(name)
        elif is_time(f.dataType) or name in dated:
            roles["datetime"].append(name)
        elif isinstance(f.dataType, T.BooleanType):
            roles["categorical"].append(name)
        elif few.get(name) is not None and few[name] / rates[name]["n"] < CATEGORY_RATIO:
            roles["categorical"].append(name)
        else:
            roles["text_or_high_cardinality"].append(name)
    return roles


def role_table(df: DataFrame, limit: int = ROLE_CATEGORY_LIMIT) -> DataFrame:
    """``column, spark_type, role``."""
    types = dict(df.dtypes)
    rows = [(c, types[c], role) for role, names in column_roles(df, limit).items() for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, spark_type string, role string")
