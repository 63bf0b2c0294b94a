"""Task type, balance and fitness rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.association import LI
from catalogue.inputs import ORDERS_GAPS, ORDERS_GAPS_COLUMNS, ORDERS_GAPS_NUMERIC, PREDICTIONS, orders_gaps, predictions, rounded, table, union_sql
from gridsmith.operators import checks as V

QUERIES = {}


def task_sql(source: str, column: str, numeric: bool) -> str:
    rule = f"CASE WHEN count({column}) = 0 THEN 'unknown' " + (
        f"WHEN count(DISTINCT {column}) <= 20 OR count(DISTINCT {column}) / CAST(count({column}) AS DOUBLE) < 0.05 THEN 'classification' ELSE 'regression' END"
        if numeric else "ELSE 'classification' END")
    return f"SELECT '{column}' AS target, {rule} AS task, count({column}) AS n_values, count(DISTINCT {column}) AS n_distinct FROM {source}"


def _tasks(s, d):
    gaps, parts = orders_gaps(s, d), None
    for c in ("o_totalprice", "o_orderpriority", "constant_col", "empty_col", "nan_col"):
        part = V.task_type(gaps, c)
        parts = part if parts is None else parts.unionByName(part)
    return parts.unionByName(V.task_type(gaps, None))


QUERIES["task_type"] = (
    _tasks,
    union_sql([task_sql(ORDERS_GAPS, c, c != "o_orderpriority") for c in ("o_totalprice", "o_orderpriority", "constant_col", "empty_col", "nan_col")])
    + " UNION ALL SELECT NULL, 'clustering', NULL, NULL",
)


def _guarded(s, d):
    o = table(s, d, "orders").withColumn("constant", F.lit("x")).withColumn("day", F.col("o_orderdate").cast("string"))
    parts = None
    for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "constant", "day"):
        part = V.guarded_task_type(o, c)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _guarded_sql(c: str, numeric: bool) -> str:
    cls = "n_distinct <= 20 OR n_distinct / CAST(n AS DOUBLE) < 0.05" if numeric else "true"
    return f"""SELECT '{c}' AS target, CASE WHEN n_distinct = n OR (({cls}) AND n_distinct > 100) THEN 'unknown' WHEN {cls} THEN 'classification' ELSE 'regression' END AS task,
    CASE WHEN n_distinct <> n AND ({cls}) THEN n_distinct ELSE 0 END AS n_classes,
    CASE WHEN n_distinct = n THEN 'identifier' WHEN ({cls}) AND n_distinct > 100 THEN 'too_many_classes' END AS error,
    CASE WHEN n_distinct <> n AND ({cls}) AND n_distinct < 2 THEN 'single_class' END AS warning
  FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS n_distinct FROM (SELECT *, 'x' AS constant, CAST(o_orderdate AS VARCHAR) AS day FROM orders))"""


QUERIES["guarded_task_type"] = (
    _guarded,
    union_sql([_guarded_sql(c, c in ("o_orderkey", "o_totalprice")) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "constant", "day")]),
)


def imbalance_sql(source: str, column: str) -> str:
    return f"""WITH c AS (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1),
  t AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS k, max(n) AS big, min(n) AS small FROM c)
  SELECT k > 1 AND big / CAST(total AS DOUBLE) > 0.8 AS is_imbalanced, CASE WHEN k > 1 THEN round(big / CAST(total AS DOUBLE), 6) ELSE 1 END AS imbalance_ratio,
    CASE WHEN k > 1 THEN round(small / CAST(big AS DOUBLE), 6) END AS balance_ratio, total AS total_samples, k AS total_classes,
    CASE WHEN k > 1 THEN (SELECT min(v) FROM c WHERE n = big) END AS majority_class, CASE WHEN k > 1 THEN big END AS majority_count,
    CASE WHEN k > 1 THEN round(big * CAST(100 AS DOUBLE) / total, 6) END AS majority_percentage,
    CASE WHEN k > 1 THEN (SELECT min(v) FROM c WHERE n = small) END AS minority_class, CASE WHEN k > 1 THEN small END AS minority_count,
    CASE WHEN k > 1 THEN round(small * CAST(100 AS DOUBLE) / total, 6) END AS minority_percentage FROM t"""


QUERIES["class_imbalance_labels"] = (
    lambda s, d: rounded(V.class_imbalance(table(s, d, "labels"), "quality"), 6), imbalance_sql("labels", "quality"),
)
QUERIES["class_imbalance_orders"] = (
    lambda s, d: rounded(V.class_imbalance(orders_gaps(s, d), "o_orderpriority"), 6), imbalance_sql(ORDERS_GAPS, "o_orderpriority"),
)
QUERIES["class_imbalance_single_class"] = (
    lambda s, d: rounded(V.class_imbalance(orders_gaps(s, d), "constant_col"), 6), imbalance_sql(ORDERS_GAPS, "constant_col"),
)
QUERIES["eligible_targets"] = (
    lambda s, d: V.eligible_targets(orders_gaps(s, d)),
    union_sql([f"""SELECT '{c}' AS "column", {'count(DISTINCT ' + c + ') <= 100' if c in ORDERS_GAPS_NUMERIC else 'true'} AS classification,
    {'count(DISTINCT ' + c + ') > 10' if c in ORDERS_GAPS_NUMERIC else 'false'} AS regression FROM {ORDERS_GAPS if c in ORDERS_GAPS_NUMERIC else 'region WHERE r_regionkey = 0'}""" for c in ORDERS_GAPS_COLUMNS]),
)
QUERIES["recommended_features"] = (
    lambda s, d: V.recommended_features(table(s, d, "part"), "p_size"),
    """SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, feature, role FROM (
    SELECT 1 AS o, 'p_partkey' AS feature, 'numeric' AS role UNION ALL SELECT 2, 'p_retailprice', 'numeric'
    UNION ALL SELECT 3, 'p_name', 'categorical' FROM part HAVING count(DISTINCT p_name) <= 20
    UNION ALL SELECT 4, 'p_brand', 'categorical' FROM part HAVING count(DISTINCT p_brand) <= 20
    UNION ALL SELECT 5, 'p_type', 'categorical' FROM part HAVING count(DISTINCT p_type) <= 20)""",
)


def rule(name, level, value, bound, ok):
    return f"SELECT '{name}' AS rule, '{level}' AS level, round(CAST({value} AS DOUBLE), 6) AS value, CAST({bound} AS DOUBLE) AS bound, {ok} AS ok FROM m"


_SHARES = ", ".join(f"1 - count({c}) / CAST(count(*) AS DOUBLE)" for c in ORDERS_GAPS_COLUMNS)
_CONST = " + ".join(f"(count(DISTINCT {c}) <= 1)::INT" for c in ORDERS_GAPS_NUMERIC)
QUERIES["ml_readiness"] = (
    lambda s, d: rounded(V.ml_readiness(orders_gaps(s, d)), 6),
    f"WITH m AS (SELECT count(*) AS n, greatest({_SHARES}) AS worst, {_CONST} AS k FROM {ORDERS_GAPS}) "
    + union_sql([
        rule("min_rows", "error", "n", 50, "n >= 50"), rule("min_columns", "error", 9, 2, "true"),
        rule("max_missing", "error", "worst", 0.5, "worst <= 0.5"), rule("high_missing", "warning", "worst", 0.35, "worst <= 0.35 OR worst > 0.5"),
        rule("constant_numerics", "warning", "k", 6, "k < 6"),
    ]),
)
QUERIES["ml_readiness_clean"] = (
    lambda s, d: rounded(V.ml_readiness(table(s, d, "region")), 6),
    "WITH m AS (SELECT count(*) AS n FROM region) " + union_sql([
        rule("min_rows", "error", "n", 50, "n >= 50"), rule("min_columns", "error", 2, 2, "true"), rule("max_missing", "error", 0, 0.5, "true"),
        rule("high_missing", "warning", 0, 0.35, "true"), rule("constant_numerics", "warning", 0, 1, "true")]),
)
QUERIES["training_data_check"] = (
    lambda s, d: rounded(V.training_data_check(orders_gaps(s, d), ["o_totalprice", "sparse_col", "nan_col"], "o_orderpriority", "classification"), 6),
    f"""WITH m AS (SELECT count(*) AS n, (3 * count(*) - count(o_totalprice) - count(sparse_col) - count(nan_col)) / CAST(3 * count(*) AS DOUBLE) AS share,
    count(o_orderpriority) AS valid, least(count(DISTINCT o_orderpriority), 2) AS classes FROM {ORDERS_GAPS}) """
    + union_sql([
        rule("min_rows", "error", "n", 50, "n >= 50"), rule("has_features", "error", 3, 1, "true"), rule("max_missing", "warning", "share", 0.5, "share <= 0.5"),
        rule("valid_targets", "error", "valid", 50, "valid >= 50"), rule("two_classes", "error", "classes", 2, "classes >= 2")]),
)


def _cluster_input(s, d):
    li = table(s, d, "lineitem")
    return li.select(*LI, F.lit(3.0).alias("flat"), F.when(F.col("l_orderkey") % 10 < 3, F.col("l_tax")).alias("sparse"),
                     (F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_tax")).alias("skewed"), "l_returnflag")


def _outliers_sql(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS feature, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n FROM
    (SELECT {c} AS x FROM {source}), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"""


_CL = "(SELECT *, CAST(3 AS DOUBLE) AS flat, CASE WHEN l_orderkey % 10 < 3 THEN l_tax END AS sparse, l_extendedprice * l_extendedprice * l_tax AS skewed FROM lineitem)"
_CLV = ["l_quantity", "l_discount", "skewed"]
_CL_NUM = [*LI, "sparse", "skewed"]
QUERIES["clustering_features"] = (
    lambda s, d: rounded(V.clustering_features(_cluster_input(s, d), [*_CLV, "flat", "sparse", "l_returnflag", "absent"]), 6),
    f"""WITH r AS ({union_sql([f"SELECT '{a}' AS feature, corr({a}, {b}) AS r FROM {_CL}" for a in [*_CLV, 'sparse'] for b in _CL_NUM if a != b])}),
  s AS (SELECT feature, avg(abs(r)) < 0.3 AS suggested FROM r GROUP BY feature),
  o AS ({union_sql([_outliers_sql(c, _CL) for c in _CLV])})
  SELECT f.feature, f.reason IS NULL AS valid, f.reason, round(f.missing_ratio, 6) AS missing_ratio, o.outliers,
    coalesce(o.outliers > o.n * 0.05, false) AS many_outliers, coalesce(s.suggested, false) AS suggested
  FROM ({union_sql([f"SELECT '{c}' AS feature, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS DOUBLE) AS missing_ratio" for c in _CLV])}
    UNION ALL SELECT 'flat', 'constant', 0 UNION ALL SELECT 'sparse', 'missing', 1 - count(sparse) / CAST(count(*) AS DOUBLE) FROM {_CL}
    UNION ALL SELECT 'l_returnflag', 'not_numeric', NULL UNION ALL SELECT 'absent', 'absent', NULL) f
  LEFT JOIN o USING (feature) LEFT JOIN s USING (feature)""",
)
QUERIES["clustering_feature_summary"] = (
    lambda s, d: rounded(V.clustering_summary(V.clustering_features(_cluster_input(s, d), [*_CLV, "flat", "sparse"])), 6),
    """SELECT CAST(5 AS BIGINT) AS n_features, 3 + (count(DISTINCT sparse) > 1 AND count(sparse) >= count(*) * 0.5)::INT AS n_valid,
    round((3 + (count(DISTINCT sparse) > 1 AND count(sparse) >= count(*) * 0.5)::INT) / CAST(5 AS DOUBLE), 6) AS quality, true AS is_valid FROM """ + _CL,
)
QUERIES["prediction_check_classes"] = (
    lambda s, d: rounded(V.prediction_check(predictions(s, d), "flag", "flag_guess", "classification"), 6),
    f"WITH m AS (SELECT count(*) AS n, count(DISTINCT flag) AS a, count(DISTINCT flag_guess) AS b FROM {PREDICTIONS}) " + union_sql([
        rule("not_empty", "error", "n", 1, "n > 0"), rule("min_rows", "warning", "n", 50, "n >= 50"), rule("true_classes", "error", "a", 2, "a >= 2"),
        rule("predicted_classes", "warning", "b", 2, "b >= 2"), rule("max_classes", "warning", "a", 100, "a <= 100")]),
)
QUERIES["prediction_check_values"] = (
    lambda s, d: rounded(V.prediction_check(orders_gaps(s, d).withColumn("p", F.when(F.col("o_orderkey") % 13 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0))), "nan_col", "p", "regression"), 6),
    f"WITH m AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 13 = 0) AS i, (count(*) - count(nan_col)) AS g FROM {ORDERS_GAPS}) " + union_sql([
        rule("not_empty", "error", "n", 1, "n > 0"), rule("min_rows", "warning", "n", 50, "n >= 50"), rule("finite", "warning", "i", 0, "i = 0"),
        rule("max_missing", "warning", "g / CAST(n AS DOUBLE)", 0.5, "g <= n * 0.5")]),
)
QUERIES["prediction_check_clusters"] = (
    lambda s, d: rounded(V.prediction_check(table(s, d, "embeddings").withColumn("c", F.col("label") - 1), "label", "c", "clustering"), 6),
    "WITH m AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings) " + union_sql([
        rule("not_empty", "error", "n", 1, "n > 0"), rule("min_rows", "warning", "n", 50, "n >= 50"), rule("clusters", "warning", "k", 2, "true")]),
)
