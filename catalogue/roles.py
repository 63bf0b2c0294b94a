"""Coercion, roles, samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import ORDERS_GAPS, ORDERS_TEXT, ORDERS_TEXT_COLUMNS, orders_gaps, orders_text, rounded, table, union_sql
from gridsmith.operators import roles as R
from gridsmith.operators import sampling as K

QUERIES = {}
STRPTIME = {
    "yyyy-M-d": "%Y-%m-%d", "yyyy-M-d H:m:s": "%Y-%m-%d %H:%M:%S", "d/M/yyyy": "%d/%m/%Y",
    "M/d/yyyy": "%m/%d/%Y", "yyyy/M/d": "%Y/%m/%d", "d-M-yyyy": "%d-%m-%Y",
}


def parse_counts_sql(c: str, source: str = ORDERS_TEXT) -> str:
    formats = ", ".join(
        f"count(try_strptime({c}, '{fmt}')) FILTER (regexp_matches({c}, '{R.DATE_FORMATS[k]}')) AS f{j}"
        for j, (k, fmt) in enumerate(STRPTIME.items())
    )
    return f"""SELECT '{c}' AS c, {ORDERS_TEXT_COLUMNS.index(c)} AS position, count(*) AS total, CAST(count({c}) AS DOUBLE) AS n,
    count(TRY_CAST({c} AS DOUBLE)) AS num,
    count(*) FILTER (regexp_matches({c}, '[0-9]') AND regexp_matches({c}, '[-/T ]')) AS likely,
    count(TRY_CAST({c} AS TIMESTAMP)) FILTER (regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS iso,
    count(DISTINCT {c}) AS d, {formats} FROM {source}"""


_COUNTS = union_sql([parse_counts_sql(c) for c in ORDERS_TEXT_COLUMNS])
_NUM = "num / n > 0.95"
_LIKE = "likely / n > 0.8"
_KIND = (
    f"CASE WHEN {_NUM} THEN 'numeric' WHEN {_LIKE} AND greatest(f0, f1, f2, f3, f4, f5, iso) / n > 0.9 THEN 'datetime' "
    "WHEN d / n < 0.5 AND d < 1000 THEN 'category' ELSE 'string' END"
)
_FIRST = "CASE " + " ".join(f"WHEN f{j} / n > 0.9 THEN {{f{j}}}" for j in range(6)) + " WHEN iso / n > 0.9 THEN {iso} END"
_FORMAT = _FIRST.format(**{f"f{j}": f"'{k}'" for j, k in enumerate(STRPTIME)}, iso="'inferred'")
_RATE = _FIRST.format(**{f"f{j}": f"f{j} / n" for j in range(6)}, iso="iso / n")
QUERIES["coercion_report"] = (
    lambda s, d: rounded(R.coercion_report(orders_text(s, d)), 6),
    f"""SELECT c AS "column", 'string' AS from_type, {_KIND} AS to_type,
    CASE WHEN NOT {_NUM} AND {_LIKE} THEN {_FORMAT} END AS format,
    round(CASE WHEN {_NUM} THEN num / n WHEN {_LIKE} THEN coalesce({_RATE}, 1) ELSE 1 END, 6) AS success_rate
  FROM ({_COUNTS}) WHERE n > 0""",
)
QUERIES["coerce_types"] = (
    lambda s, d: R.coerce_types(orders_text(s, d)),
    f"""SELECT o_orderkey, TRY_CAST(number_text AS DOUBLE) AS number_text, mixed_text,
    try_strptime(date_text, '%d/%m/%Y') AS date_text, broken_date, try_strptime(iso_text, '%Y-%m-%d') AS iso_text,
    TRY_CAST(iso_t_text AS TIMESTAMP) AS iso_t_text, o_orderpriority, label_text, empty_text FROM {ORDERS_TEXT}""",
)
QUERIES["column_roles"] = (
    lambda s, d: R.role_table(orders_text(s, d)),
    f"""SELECT c AS "column", 'string' AS spark_type,
    CASE WHEN greatest(f0, f1, f2, f3, f4, f5, iso) / CAST(total AS DOUBLE) > 0.8 THEN 'datetime'
      WHEN n > 0 AND d / n < 0.5 AND d <= 100 THEN 'categorical' ELSE 'text_or_high_cardinality' END AS role FROM ({_COUNTS})
  UNION ALL SELECT 'o_orderkey', 'bigint', 'numeric'""",
)
QUERIES["column_roles_events"] = (
    lambda s, d: R.role_table(table(s, d, "events").withColumn("big", F.col("value") > 50)).drop("spark_type"),
    """SELECT * FROM (VALUES ('event_id', 'numeric'), ('ts', 'datetime'), ('user_id', 'numeric'), ('value', 'numeric'), ('big', 'categorical')) t("column", role)
  UNION ALL SELECT 'event_type', CASE WHEN count(DISTINCT event_type) <= 100 AND count(DISTINCT event_type) / CAST(count(event_type) AS DOUBLE) < 0.5 THEN 'categorical' ELSE 'text_or_high_cardinality' END FROM events
  UNION ALL SELECT 'props', CASE WHEN count(DISTINCT props) <= 100 AND count(DISTINCT props) / CAST(count(props) AS DOUBLE) < 0.5 THEN 'categorical' ELSE 'text_or_high_cardinality' END FROM events""",
)
QUERIES["head_preview"] = (
    lambda s, d: K.head(table(s, d, "orders"), 100, ["o_orderkey"]),
    "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
)
QUERIES["sample_rows"] = (
    lambda s, d: K.sample_rows(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
  ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey))
  LIMIT (SELECT CASE WHEN count(*) < 100 THEN count(*) ELSE least(10000, greatest(100, CAST(floor(count(*) * 0.01) AS BIGINT))) END FROM lineitem)""",
)
QUERIES["cap_rows"] = (
    lambda s, d: K.cap_rows(table(s, d, "orders"), ["o_orderkey"], 3000).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat_ws('|', '42', o_orderkey)) LIMIT 3000",
)
QUERIES["evaluation_cap"] = (
    lambda s, d: K.evaluation_cap(table(s, d, "orders"), ["o_orderkey"], 1000).select("o_orderkey"),
    "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', '42', o_orderkey)) LIMIT 1000",
)
QUERIES["split_stratified"] = (
    lambda s, d: K.split_rows(orders_gaps(s, d), ["o_orderkey"], strata="o_orderpriority").select("o_orderkey", "o_orderpriority", "part"),
    f"""SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM
  (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', '42', o_orderkey))) AS rn,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {ORDERS_GAPS})""",
)
QUERIES["split_plain"] = (
    lambda s, d: K.split_rows(table(s, d, "customer"), ["c_custkey"], 0.25).select("c_custkey", "part"),
    """SELECT c_custkey, CASE WHEN rn <= floor(n * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS part FROM
  (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', c_custkey))) AS rn, count(*) OVER () AS n FROM customer)""",
)
_FOLD = " + ".join(f"(rn > floor(n * {j} / 5))::INT" for j in range(1, 5))
QUERIES["folds_stratified"] = (
    lambda s, d: K.assign_folds(table(s, d, "labels"), ["doc_id"], 5, "quality").select("doc_id", "quality", "fold"),
    f"""SELECT doc_id, quality, {_FOLD} AS fold FROM
  (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '42', doc_id))) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)""",
)
QUERIES["folds_shuffled"] = (
    lambda s, d: K.assign_folds(table(s, d, "orders"), ["o_orderkey"]).select("o_orderkey", "fold"),
    f"""SELECT o_orderkey, {_FOLD} AS fold FROM
  (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', o_orderkey))) AS rn, count(*) OVER () AS n FROM orders)""",
)
