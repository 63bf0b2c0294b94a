"""Projections, filters, column typing and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import (
    ORDERS_GAPS, ORDERS_TEXT, PREDICTIONS, orders_gaps, orders_text, predictions, rounded, table,
)
from gridsmith.functions import scalars as S
from gridsmith.operators import columns as C

QUERIES = {}

QUERIES["select_features"] = (
    lambda s, d: C.select_features(
        table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "absent"], 2
    ),
    "SELECT l_quantity, l_extendedprice FROM lineitem",
)
QUERIES["drop_columns"] = (
    lambda s, d: C.drop_existing(table(s, d, "part"), ["p_name", "p_type", "absent"]),
    "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part",
)
QUERIES["rename_columns"] = (
    lambda s, d: C.rename_valid(
        table(s, d, "customer"),
        {
            "c_custkey": "customer-key",
            "c_name": "1bad",
            "c_acctbal": "balance",
            "c_mktsegment": "balance",
            "absent": "x",
            "c_nationkey": "n" * 51,
        },
    ),
    'SELECT c_custkey AS "customer-key", c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer',
)


def _narrowed(s, d):
    li = table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity"), F.col("l_extendedprice"),
        F.col("l_suppkey"), (F.col("l_linenumber") * 300).cast("bigint").alias("wide"),
    )
    out = C.narrow_types(li)
    types = dict(out.dtypes)
    names = ["l_linenumber", "l_quantity", "l_extendedprice", "wide"]
    aggs = [F.sum(F.col(c).cast("double")).alias(c) for c in names]
    row = C.rows_from(out.agg(*aggs), names, {
        "type": lambda i, c: F.lit(types[c]), "total": lambda i, c: F.round(F.col(c), 2),
    })
    return row


QUERIES["narrow_types"] = (
    _narrowed,
    """SELECT 'l_linenumber' AS "column", 'tinyint' AS type, round(CAST(sum(l_linenumber) AS DOUBLE), 2) AS total FROM lineitem
UNION ALL SELECT 'l_quantity', CASE WHEN bool_and(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) = l_quantity) THEN 'float' ELSE 'double' END, round(sum(l_quantity), 2) FROM lineitem
UNION ALL SELECT 'l_extendedprice', CASE WHEN bool_and(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) = l_extendedprice) THEN 'float' ELSE 'double' END, round(sum(l_extendedprice), 2) FROM lineitem
UNION ALL SELECT 'wide', CASE WHEN max(l_linenumber * 300) <= 127 THEN 'tinyint' WHEN max(l_linenumber * 300) <= 32767 THEN 'smallint' ELSE 'int' END, round(CAST(sum(l_linenumber * 300) AS DOUBLE), 2) FROM lineitem""",
)
QUERIES["drop_missing_rows"] = (
    lambda s, d: C.drop_missing(
        S.missing_to_null(orders_gaps(s, d)), ["o_totalprice", "nan_col"]
    ).select("o_orderkey", "o_totalprice", "nan_col"),
    f"SELECT o_orderkey, o_totalprice, nan_col FROM {ORDERS_GAPS} WHERE o_totalprice IS NOT NULL AND nan_col IS NOT NULL",
)
QUERIES["infinity_to_missing"] = (
    lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        S.inf_to_null(
            F.when(F.col("l_linenumber") == 3, F.lit(float("inf")))
            .when(F.col("l_linenumber") == 5, F.lit(float("-inf")))
            .otherwise(F.col("l_tax"))
        ).alias("tax"),
    ),
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (3, 5) THEN l_tax END AS tax FROM lineitem",
)
QUERIES["keep_top_categories"] = (
    lambda s, d: C.keep_top_categories(table(s, d, "part"), "p_name", 20).select("p_partkey", "p_name"),
    """SELECT p_partkey, p_name FROM part WHERE p_name IN
    (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 20)""",
)
QUERIES["keep_members"] = (
    lambda s, d: C.keep_members(table(s, d, "events"), "event_type", ["click", "purchase"]).select("event_id", "event_type"),
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
)


def _labelled(s, d):
    return table(s, d, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster"))


QUERIES["clustered_rows"] = (
    lambda s, d: C.split_noise(_labelled(s, d), "cluster")[0],
    "SELECT vec_id, label - 1 AS cluster FROM embeddings WHERE label - 1 >= 0",
)
QUERIES["noise_rows"] = (
    lambda s, d: C.split_noise(_labelled(s, d), "cluster")[1],
    "SELECT vec_id, label - 1 AS cluster FROM embeddings WHERE label - 1 = -1",
)
QUERIES["parse_numbers"] = (
    lambda s, d: orders_text(s, d).select(
        "o_orderkey",
        S.to_number("mixed_text").alias("number"),
        S.to_number(
            F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("mixed_text"), F.lit("d")))
            .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" -"), F.col("mixed_text"), F.lit(".5e1 ")))
            .otherwise(F.col("mixed_text"))
        ).alias("tricky"),
    ),
    f"""SELECT o_orderkey, TRY_CAST(mixed_text AS DOUBLE) AS number,
    CASE WHEN regexp_full_match(t, '\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN TRY_CAST(trim(t) AS DOUBLE) END AS tricky
  FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN mixed_text || 'd'
      WHEN o_orderkey % 4 = 1 THEN ' -' || mixed_text || '.5e1 ' ELSE mixed_text END AS t FROM {ORDERS_TEXT})""",
)
QUERIES["parse_dates"] = (
    lambda s, d: orders_text(s, d).select(
        "o_orderkey",
        S.to_time("date_text", "d/M/yyyy").alias("day_first"),
        S.to_time("date_text", "M/d/yyyy").alias("month_first"),
        S.to_time("broken_date", "yyyy-M-d").alias("iso"),
        S.to_time(F.concat("broken_date", F.lit(" 7:05:09")), "yyyy-M-d H:m:s").alias("iso_time"),
        S.to_time(F.translate("broken_date", "-", "/"), "yyyy/M/d").alias("slashed"),
        S.to_time(F.translate("date_text", "/", "-"), "d-M-yyyy").alias("dashed"),
    ),
    f"""SELECT o_orderkey,
    try_strptime(date_text, '%d/%m/%Y') AS day_first,
    try_strptime(date_text, '%m/%d/%Y') AS month_first,
    try_strptime(broken_date, '%Y-%m-%d') AS iso,
    try_strptime(broken_date || ' 7:05:09', '%Y-%m-%d %H:%M:%S') AS iso_time,
    try_strptime(replace(broken_date, '-', '/'), '%Y/%m/%d') AS slashed,
    try_strptime(replace(date_text, '/', '-'), '%d-%m-%Y') AS dashed
  FROM {ORDERS_TEXT}""",
)
QUERIES["date_like_text"] = (
    lambda s, d: orders_text(s, d).select(
        "o_orderkey", S.looks_like_date("date_text").alias("date_like"), S.looks_like_date("label_text").alias("label_like"),
        S.looks_like_date("o_orderpriority").alias("priority_like"),
    ),
    f"""SELECT o_orderkey, regexp_matches(date_text, '[0-9]') AND regexp_matches(date_text, '[-/T ]') AS date_like,
    regexp_matches(label_text, '[0-9]') AND regexp_matches(label_text, '[-/T ]') AS label_like,
    regexp_matches(o_orderpriority, '[0-9]') AND regexp_matches(o_orderpriority, '[-/T ]') AS priority_like
  FROM {ORDERS_TEXT}""",
)
QUERIES["shorten_text"] = (
    lambda s, d: C.shorten_texts(table(s, d, "documents").select("doc_id", "text", "lang")),
    "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS text, lang FROM documents",
)
QUERIES["date_parts"] = (
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in S.date_parts("o_orderdate").items()]
    ),
    """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
    day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_dayofweek FROM orders""",
)
QUERIES["clean_model_names"] = (
    lambda s, d: table(s, d, "part").select(
        "p_partkey",
        S.clean_model_name(F.concat(F.lit("-- "), "p_name", F.lit(" - "), "p_brand", F.lit("!#  v2-"), "p_type", F.lit(" "))).alias("name"),
    ),
    """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(translate('-- ' || p_name || ' - ' || p_brand || '!#  v2-' || p_type || ' ', ' -', '__')),
    '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS name FROM part""",
)
QUERIES["error_terms"] = (
    lambda s, d: rounded(predictions(s, d).select(
        "l_orderkey", "l_linenumber",
        S.residual("y", "p").alias("residual"),
        S.absolute_error("y", "p").alias("absolute_error"),
        S.squared_error("y", "p").alias("squared_error"),
    ), 5),
    f"""SELECT l_orderkey, l_linenumber, round(y - p, 5) AS residual, round(abs(y - p), 5) AS absolute_error,
    round((y - p) * (y - p), 5) AS squared_error FROM {PREDICTIONS}""",
)


def _bands(metric: str, column: str) -> str:
    cases = " ".join(
        f"WHEN {column} BETWEEN {low} AND {high} THEN '{text}'" for low, high, text in S.SCORE_BANDS[metric]
    )
    return f"CASE {cases} ELSE '{S.NO_BAND}' END"


def _scores(s, d):
    score = (F.col("l_extendedprice") - 20000.0) / 90000.0
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))
    return li.select(
        "l_orderkey", "l_linenumber",
        *[S.interpret_score(F.lit(m), "score").alias(m) for m in (*S.SCORE_BANDS, "other")],
    )


QUERIES["interpret_scores"] = (
    _scores,
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{_bands(m, 'score')} AS {m}" for m in S.SCORE_BANDS)
    + f", '{S.NO_BAND}' AS other FROM (SELECT *, (l_extendedprice - 20000) / CAST(90000 AS DOUBLE) AS score FROM lineitem)",
)
