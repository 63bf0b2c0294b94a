"""Counts, profiles, distributions and column quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import (
    ORDERS_GAPS, ORDERS_GAPS_COLUMNS, ORDERS_GAPS_NUMERIC, orders_gaps, rounded, table, union_sql,
)
from gridsmith.functions.scalars import missing_to_null
from gridsmith.operators import counting as N
from gridsmith.operators import profile as P

QUERIES = {}
LINEITEM_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
ROUNDING = {"skewness": 4}


def clean_gaps(s, d):
    return missing_to_null(orders_gaps(s, d))


def numeric_profile_sql(source: str, columns: list[str]) -> str:
    return union_sql([
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 4) AS missing_percentage,
    round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
    round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
    round(CASE WHEN stddev_samp({c}) > 0 THEN skewness({c}) END, 4) AS skewness,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75 FROM {source}"""
        for c in columns
    ])


QUERIES["numeric_profile"] = (
    lambda s, d: rounded(P.numeric_profile(table(s, d, "lineitem"))),
    numeric_profile_sql("lineitem", LINEITEM_NUMERIC),
)
QUERIES["numeric_profile_with_gaps"] = (
    lambda s, d: rounded(P.numeric_profile(orders_gaps(s, d))),
    numeric_profile_sql(ORDERS_GAPS, ORDERS_GAPS_NUMERIC),
)
QUERIES["time_profile"] = (
    lambda s, d: rounded(
        P.time_profile(table(s, d, "events").select("ts", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("sometimes")))
    ),
    union_sql([
        f"""SELECT '{n}' AS "column", count(v) AS count, count(*) - count(v) AS missing,
    round((count(*) - count(v)) * CAST(100 AS DOUBLE) / count(*), 4) AS missing_percentage,
    min(v) AS min_date, max(v) AS max_date, count(DISTINCT v) AS "distinct",
    CAST(floor((epoch_us(max(v)) - epoch_us(min(v))) / 86400000000) AS BIGINT) AS range_days
  FROM (SELECT {e} AS v FROM events)"""
        for n, e in [("ts", "ts"), ("sometimes", "CASE WHEN event_id % 3 = 0 THEN ts END")]
    ]),
)
PART_TEXT = ["p_name", "p_brand", "p_type"]
QUERIES["category_profile"] = (
    lambda s, d: rounded(P.category_profile(table(s, d, "part")).drop("top_values")),
    union_sql([
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 4) AS missing_percentage,
    count(DISTINCT {c}) AS "distinct", round(count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE), 4) AS distinct_ratio FROM part"""
        for c in PART_TEXT
    ]),
)
QUERIES["category_top_values"] = (
    lambda s, d: P.category_profile(orders_gaps(s, d).select("o_orderpriority", "o_orderstatus")).select(
        "column", F.explode("top_values").alias("value", "n")
    ),
    union_sql([
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {ORDERS_GAPS} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ["o_orderpriority", "o_orderstatus"]
    ]),
)


def flagship(s, d):
    return rounded(P.table_profile(table(s, d, "lineitem")).drop("top_values"))


def table_profile_sql() -> str:
    names = (
        "count missing missing_percentage mean std min max skewness q25 median q75 "
        "min_date max_date \"distinct\" range_days distinct_ratio kind"
    ).split()
    typed = {
        "min_date": "CAST(NULL AS TIMESTAMP)", "max_date": "CAST(NULL AS TIMESTAMP)", '"distinct"': "CAST(NULL AS BIGINT)",
        "range_days": "CAST(NULL AS BIGINT)",
    }

    def part(kind, source, known):
        cols = [f"{known[n]} AS {n}" if n in known else f"{typed.get(n, 'CAST(NULL AS DOUBLE)')} AS {n}" for n in names if n != "kind"]
        return f"""SELECT "column", {', '.join(cols)}, '{kind}' AS kind FROM ({source})"""

    numeric = part("numeric", numeric_profile_sql("lineitem", LINEITEM_NUMERIC),
                   {n: n for n in "count missing missing_percentage mean std min max skewness q25 median q75".split()})
    common = {n: n for n in ("count", "missing", "missing_percentage")}
    times = part("datetime", """SELECT 'l_shipdate' AS "column", count(l_shipdate) AS count, count(*) - count(l_shipdate) AS missing,
      CAST(0 AS DOUBLE) AS missing_percentage, min(l_shipdate) AS a, max(l_shipdate) AS b, count(DISTINCT l_shipdate) AS c,
      CAST(floor((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 86400000000) AS BIGINT) AS d FROM lineitem""",
                 common | {"min_date": "a", "max_date": "b", '"distinct"': "c", "range_days": "d"})
    texts = part("category", union_sql([
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, CAST(0 AS DOUBLE) AS missing_percentage,
      count(DISTINCT {c}) AS c, round(count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE), 4) AS r FROM lineitem"""
        for c in ("l_returnflag", "l_linestatus")]), common | {'"distinct"': "c", "distinct_ratio": "r"})
    return union_sql([numeric, times, texts])


QUERIES["table_profile"] = (flagship, table_profile_sql())
QUERIES["table_metrics"] = (
    lambda s, d: rounded(N.table_metrics(clean_gaps(s, d).drop("o_orderkey", "o_orderdate", "nan_col", "o_totalprice", "sparse_col"))),
    f"""SELECT sum(n)::BIGINT AS n_rows, 4::BIGINT AS n_cols,
    round(sum(n * ((o_orderpriority IS NULL)::INT + (o_orderstatus IS NULL)::INT + (constant_col IS NULL)::INT + (empty_col IS NULL)::INT))
      * CAST(100 AS DOUBLE) / (sum(n) * 4), 4) AS missing_percentage, sum(n - 1)::BIGINT AS duplicate_rows
  FROM (SELECT o_orderpriority, o_orderstatus, constant_col, empty_col, count(*) AS n FROM {ORDERS_GAPS} GROUP BY ALL)""",
)
TRIPLE = ["l_returnflag", "l_linestatus", "l_linenumber"]
QUERIES["duplicate_rows"] = (
    lambda s, d: N.duplicate_count(table(s, d, "lineitem").select(*TRIPLE)),
    f"SELECT (sum(n - 1))::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(TRIPLE)})",
)
QUERIES["distinct_rows"] = (
    lambda s, d: N.distinct_rows(table(s, d, "lineitem").select(*TRIPLE)),
    f"SELECT DISTINCT {', '.join(TRIPLE)} FROM lineitem",
)
_missing = [
    f"""SELECT '{c}' AS "column", {i} AS position, count(*) AS rows, count(*) - count({c}) AS missing,
    (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS missing_ratio FROM {ORDERS_GAPS}"""
    for i, c in enumerate(ORDERS_GAPS_COLUMNS)
]
QUERIES["missing_overview"] = (
    lambda s, d: N.missing_overview(clean_gaps(s, d)),
    f"""SELECT "column", missing FROM ({union_sql(_missing)}) WHERE missing > 0""",
)
QUERIES["least_missing_columns"] = (
    lambda s, d: rounded(N.least_missing(clean_gaps(s, d), 6)),
    f"""SELECT "column", round(missing_ratio, 4) AS missing_ratio FROM ({union_sql(_missing)}) ORDER BY missing_ratio, position LIMIT 6""",
)
QUERIES["mean_missing_share"] = (
    lambda s, d: rounded(N.mean_missing_share(clean_gaps(s, d))),
    f"""SELECT round(avg(missing_ratio) * 100, 4) AS missing_percentage FROM ({union_sql(_missing)})""",
)
QUERIES["cardinality_overview"] = (
    lambda s, d: N.cardinality_overview(table(s, d, "documents")),
    """SELECT * FROM (SELECT 'text' AS "column", count(DISTINCT text) AS "distinct" FROM documents
  UNION ALL SELECT 'lang', count(DISTINCT lang) FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents)
  WHERE "distinct" <= 100""",
)
_TYPES = {
    "o_orderkey": "bigint", "o_totalprice": "double", "o_orderpriority": "string", "o_orderstatus": "string",
    "o_orderdate": "timestamp_ntz", "nan_col": "double", "constant_col": "int", "sparse_col": "double", "empty_col": "double",
}
QUERIES["schema_table"] = (
    lambda s, d: rounded(N.schema_table(clean_gaps(s, d))),
    union_sql([
        f"""SELECT '{c}' AS "column", '{_TYPES[c]}' AS type, count({c}) AS non_null,
    round((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 4) AS null_percentage FROM {ORDERS_GAPS}"""
        for c in ORDERS_GAPS_COLUMNS
    ]),
)
QUERIES["constant_and_id_like"] = (
    lambda s, d: P.constant_and_id_like(orders_gaps(s, d)),
    union_sql([
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) <= 1 AS constant,
    count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) = count(*) AND count(*) > 10 AS id_like FROM {ORDERS_GAPS}"""
        for c in ORDERS_GAPS_COLUMNS
    ]),
)


def _useless_sql(c):
    low = f" WHEN stddev_samp({c}) = 0 OR abs(stddev_samp({c}) / nullif(avg({c}), 0)) < 0.0001 THEN 'low_variance'" if c in ORDERS_GAPS_NUMERIC else ""
    return f"""SELECT '{c}' AS "column", CASE WHEN (count(*) - count({c})) / CAST(count(*) AS DOUBLE) > 0.6 THEN 'missing'
    WHEN count(DISTINCT {c}) <= 1 THEN 'constant'{low} END AS reason
  FROM (SELECT *, 1000000000 + o_orderkey AS shifted FROM {ORDERS_GAPS})"""


QUERIES["useless_columns"] = (
    lambda s, d: P.useless_columns(orders_gaps(s, d).withColumn("shifted", F.lit(1000000000) + F.col("o_orderkey"))),
    f"SELECT * FROM ({union_sql([_useless_sql(c) for c in ORDERS_GAPS_COLUMNS])} UNION ALL "
    + """SELECT 'shifted', CASE WHEN abs(stddev_samp(1000000000 + o_orderkey) / avg(1000000000 + o_orderkey)) < 0.0001 THEN 'low_variance' END FROM orders)
  WHERE reason IS NOT NULL""",
)
QUERIES["univariate_summary"] = (
    lambda s, d: rounded(P.univariate_summary(table(s, d, "part"))),
    union_sql([
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median,
    round(stddev_samp({c}), 4) AS std, count(DISTINCT {c}) AS "distinct" FROM part"""
        for c in ["p_partkey", "p_size", "p_retailprice"]
    ]),
)
QUERIES["describe_columns"] = (
    lambda s, d: rounded(P.describe(table(s, d, "customer"), ["c_acctbal", "c_nationkey"])),
    union_sql([
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
    CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75,
    CAST(max({c}) AS DOUBLE) AS max FROM customer"""
        for c in ["c_acctbal", "c_nationkey"]
    ]),
)
QUERIES["histogram"] = (
    lambda s, d: rounded(P.histogram(table(s, d, "lineitem"), "l_extendedprice"), 3),
    """WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
  h AS (SELECT least(CAST(floor((l_extendedprice - a) / ((b - a) / 50)) AS BIGINT) + 1, 50) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
  SELECT bin, round(a + (bin - 1) * ((b - a) / 50), 3) AS low, round(a + bin * ((b - a) / 50), 3) AS high, n FROM h, e""",
)
BOX_COLUMNS = ["l_quantity", "l_extendedprice", "skewed"]


def _skewed(s, d):
    return table(s, d, "lineitem").select(
        "l_returnflag", "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_tax")).alias("skewed")
    )


def _box_sql(value: str, key: str, group: str | None) -> str:
    src = f"(SELECT {group or key} AS g, CAST({value} AS DOUBLE) AS x FROM (SELECT *, l_extendedprice * l_extendedprice * l_tax AS skewed FROM lineitem))"
    return f"""SELECT g, count(*) AS count, any_value(q1) AS q25, any_value(q2) AS median, any_value(q3) AS q75,
    min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower_whisker,
    max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper_whisker,
    count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
  FROM {src} JOIN (SELECT g AS k, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM {src} GROUP BY g) ON g = k GROUP BY g"""


_BOX_OUT = ", ".join(f"round({c}, 4) AS {c}" for c in ("q25", "median", "q75", "lower_whisker", "upper_whisker"))
QUERIES["box_statistics"] = (
    lambda s, d: rounded(P.box_statistics(_skewed(s, d), BOX_COLUMNS), 4),
    f"""SELECT g AS "column", count, {_BOX_OUT}, outliers FROM ({union_sql([_box_sql(c, f"'{c}'", None) for c in BOX_COLUMNS])})""",
)
QUERIES["box_by_category"] = (
    lambda s, d: rounded(P.box_by_category(_skewed(s, d), "skewed", "l_returnflag"), 4),
    f"""SELECT g AS "group", count, {_BOX_OUT}, outliers FROM ({_box_sql('skewed', '', 'l_returnflag')})""",
)
QUERIES["box_by_top_categories"] = (
    lambda s, d: rounded(P.box_by_category(table(s, d, "part"), "p_retailprice", "p_name", 20), 4),
    f"""WITH t AS (SELECT p_name AS g, p_retailprice AS x FROM part WHERE p_name IN
      (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 20)),
    q AS (SELECT g AS k, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM t GROUP BY g)
  SELECT g AS "group", count(*) AS count, round(any_value(q1), 4) AS q25, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q75,
    round(min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS lower_whisker,
    round(max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS upper_whisker,
    count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
  FROM t JOIN q ON g = k GROUP BY g""",
)
QUERIES["contingency_table"] = (
    lambda s, d: N.contingency(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"),
    "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
QUERIES["contingency_wide"] = (
    lambda s, d: N.contingency_wide(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]),
    """SELECT o_orderpriority AS a, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
    count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
QUERIES["outlier_counts"] = (
    lambda s, d: P.outlier_counts(_skewed(s, d), BOX_COLUMNS),
    f"""SELECT g AS "column", outliers, outliers > (SELECT count(*) FROM lineitem) * 0.05 AS flagged
  FROM ({union_sql([_box_sql(c, f"'{c}'", None) for c in BOX_COLUMNS])})""",
)
QUERIES["class_distribution"] = (
    lambda s, d: N.class_distribution(orders_gaps(s, d), "o_orderpriority"),
    f"SELECT o_orderpriority AS value, count(*) AS n FROM {ORDERS_GAPS} WHERE o_orderpriority IS NOT NULL GROUP BY 1",
)
QUERIES["top_values"] = (
    lambda s, d: N.top_values(table(s, d, "part"), "p_brand", 20),
    "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
)
