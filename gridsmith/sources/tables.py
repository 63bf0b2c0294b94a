"""Reading tables, checking files, and the report of a load."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions.scalars import as_column, missing_to_null
from gridsmith.operators.roles import REPORT_SCHEMA, coerce_types, coercion_decisions

# File kinds by extension.
FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json"}
CORRUPT = "_corrupt_record"


def table_format(path: str, fmt: str | None = None) -> str:
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported file type {kind!r}: one of {', '.join(FORMATS)}")
    return FORMATS[kind]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return bool(found)


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: str | T.StructType | None = None, types: dict[str, str] | None = None
) -> DataFrame:
    """A lazy table. ``schema`` skips inference; ``types`` forces single columns, bad values becoming missing."""
    kind = table_format(path, fmt)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        df = reader.option("header", True).option("inferSchema", schema is None).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    elif kind == "json":
        df = reader.option("multiLine", _is_array(spark, path)).json(path)
    else:
        df = reader.parquet(path)
    return force_types(df, types or {})


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one array of records; line-delimited files stay splittable."""
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).first()
    return first is not None and first["value"].lstrip().startswith("[")


def force_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    casts = {c: as_column(c).try_cast(t) for c, t in types.items() if c in df.columns}
    return df.withColumns(casts) if casts else df


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a table and refuse an empty one."""
    df = read_table(spark, path, fmt, **options)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


@dataclass
class LoadResult:
    table: DataFrame
    raw: DataFrame
    report: DataFrame
    conversions: DataFrame


def load(spark: SparkSession, path: str, fmt: str | None = None, sanitize: bool = True, coerce: bool = True, **options) -> LoadResult:
    """Read, de-duplicate and coerce; the raw table is kept beside the result, both lazy."""
    raw = load_table(spark, path, fmt, **options)
    return prepare_loaded(raw, sanitize, coerce)


def prepare_loaded(raw: DataFrame, sanitize: bool = True, coerce: bool = True) -> LoadResult:
    table = missing_to_null(raw)
    if sanitize:
        table = table.dropDuplicates()
    decisions = coercion_decisions(table) if coerce else []
    typed = coerce_types(table, decisions)
    spark = raw.sparkSession
    conversions = spark.createDataFrame(decisions, REPORT_SCHEMA)
    return LoadResult(typed, raw, load_report(raw, typed, sanitize, len(decisions)), conversions)


def load_report(raw: DataFrame, table: DataFrame, sanitized: bool, conversions: int) -> DataFrame:
    """``rows_read, rows, columns, duplicates_removed, conversions``; one row."""
    before = raw.agg(F.count(F.lit(1)).alias("rows_read")).withColumn("k", F.lit(0))
    after = table.agg(F.count(F.lit(1)).alias("rows")).withColumn("k", F.lit(0))
    # Two one-row frames.
    return before.join(after, "k").select(
        "rows_read",
        "rows",
        F.lit(len(table.columns)).alias("columns"),
        (F.col("rows_read") - F.col("rows")).alias("duplicates_removed"),
        F.lit(sanitized).alias("sanitized"),
        F.lit(conversions).alias("conversions"),
    )


def text_quality(spark: SparkSession, path: str) -> DataFrame:
    """``lines, blank_lines, bad_utf8_lines, is_valid`` over every line of a text file."""
    lines = spark.read.text(path)
    return line_quality(lines)


def line_quality(lines: DataFrame, column: str = "value") -> DataFrame:
    c = as_column(column)
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.length(F.trim(c)) == 0).alias("blank_lines"),
        F.count_if(~F.is_valid_utf8(c)).alias("bad_utf8_lines"),
    ).withColumn("is_valid", F.col("lines") > F.col("blank_lines"))


def ragged_rows(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """``rows, corrupt_rows``: CSV records that do not fit the schema."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType(fields.fields + [T.StructField(CORRUPT, T.StringType())])
    # Without pruning every field is parsed, so short and long records are noticed.
    df = (
        spark.read.schema(wide)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(path)
    )
    first = as_column(fields.fields[0].name)
    rows = F.count_if(first.isNull()) + F.count_if(first.isNotNull())
    return df.agg(rows.alias("rows"), F.count_if(as_column(CORRUPT).isNotNull()).alias("corrupt_rows"))


def parquet_readable(spark: SparkSession, path: str) -> bool:
    """Whether the footer of a Parquet table can be read."""
    try:
        spark.read.parquet(path).schema
        return True
    except Exception:
        return False
