"""Inputs the queries share: the given tables and what is derived from them.

Each derived input is given twice, as a DataFrame and as the same SELECT for
the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing cells, a NaN, a constant, a sparse and an empty column."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_orderstatus",
        "o_orderdate",
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_custkey").cast("double")).alias("nan_col"),
        F.lit(1).alias("constant_col"),
        F.when(k % 10 < 3, k.cast("double")).alias("sparse_col"),
        F.lit(None).cast("double").alias("empty_col"),
    )


ORDERS_GAPS = """(SELECT o_orderkey,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority,
    o_orderstatus, o_orderdate,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS nan_col,
    1 AS constant_col,
    CASE WHEN o_orderkey % 10 < 3 THEN CAST(o_orderkey AS DOUBLE) END AS sparse_col,
    CAST(NULL AS DOUBLE) AS empty_col
  FROM orders)"""
ORDERS_GAPS_COLUMNS = [
    "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate",
    "nan_col", "constant_col", "sparse_col", "empty_col",
]
ORDERS_GAPS_NUMERIC = ["o_orderkey", "o_totalprice", "nan_col", "constant_col", "sparse_col", "empty_col"]


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text, some cells dirtied, for the type coercion operators."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate")
    return o.select(
        "o_orderkey",
        F.when(k % 25 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("number_text"),
        F.when(k % 10 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mixed_text"),
        F.when(k % 25 == 0, "n/a").otherwise(F.date_format(day, "dd/MM/yyyy")).alias("date_text"),
        F.when(k % 5 == 0, "n/a").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("broken_date"),
        F.when(k % 9 != 0, F.date_format(day, "yyyy-MM-dd")).alias("iso_text"),
        F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("iso_t_text"),
        "o_orderpriority",
        F.concat(F.lit("order "), k.cast("string")).alias("label_text"),
        F.lit(None).cast("string").alias("empty_text"),
    )


ORDERS_TEXT = """(SELECT o_orderkey,
    CASE WHEN o_orderkey % 25 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS number_text,
    CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mixed_text,
    CASE WHEN o_orderkey % 25 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_text,
    CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS broken_date,
    CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_text,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso_t_text,
    o_orderpriority,
    'order ' || CAST(o_orderkey AS VARCHAR) AS label_text,
    CAST(NULL AS VARCHAR) AS empty_text
  FROM orders)"""
ORDERS_TEXT_COLUMNS = [
    "number_text", "mixed_text", "date_text", "broken_date", "iso_text", "iso_t_text",
    "o_orderpriority", "label_text", "empty_text",
]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule-made prediction table with score ties: two classes and three classes."""
    li = table(spark, sf_dir, "lineitem")
    score = F.round(F.col("l_extendedprice") / 105000.0, 3)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("label"),
        F.when(score > 0.45, 1).otherwise(0).alias("prediction"),
        score.alias("score"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_tax") < 0.03, "A").when(F.col("l_discount") < 0.05, "N").otherwise("R").alias("flag_guess"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 2000.0).alias("p"),
    )


PREDICTIONS = """(SELECT l_orderkey, l_linenumber,
    CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label,
    CASE WHEN round(l_extendedprice / CAST(105000 AS DOUBLE), 3) > 0.45 THEN 1 ELSE 0 END AS prediction,
    round(l_extendedprice / CAST(105000 AS DOUBLE), 3) AS score,
    l_returnflag AS flag,
    CASE WHEN l_tax < 0.03 THEN 'A' WHEN l_discount < 0.05 THEN 'N' ELSE 'R' END AS flag_guess,
    l_extendedprice AS y,
    l_quantity * CAST(2000 AS DOUBLE) AS p
  FROM lineitem)"""


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double column, so that summation order cannot show."""
    return df.select(
        *[
            F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
