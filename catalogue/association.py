"""Correlations, association and feature relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import ORDERS_GAPS, orders_gaps, rounded, table, union_sql
from gridsmith.operators import association as B

QUERIES = {}
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
GAP_COLS = ["o_totalprice", "nan_col", "sparse_col"]


def matrix_sql(columns: list[str], source: str, value: str = "round(corr({a}, {b}), 6)") -> str:
    return union_sql([
        f"SELECT '{a}' AS a, '{b}' AS b, {value.format(a=a, b=b)} AS r FROM {source}" for a in columns for b in columns
    ])


QUERIES["pearson_matrix"] = (
    lambda s, d: rounded(B.pearson_matrix(orders_gaps(s, d).select(*GAP_COLS)), 6),
    matrix_sql(GAP_COLS, ORDERS_GAPS),
)


def _matrix_input(s, d):
    li = table(s, d, "lineitem")
    return li.select("l_orderkey", *LI, F.when(F.col("l_orderkey") % 3 > 0, F.col("l_discount")).alias("partial"),
                     F.col("l_linenumber").alias("sku_number"), "l_returnflag")


_COMPLETE = "(SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag_code FROM lineitem WHERE l_orderkey % 3 > 0)"


def _heat_sql() -> str:
    names = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "l_linenumber": "l_linenumber",
             "partial": "l_discount", "l_returnflag": "flag_code"}
    return union_sql([
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({x}, {y}), 6) AS r FROM {_COMPLETE}"
        for a, x in names.items() for b, y in names.items()
    ])


QUERIES["correlation_matrix_with_target"] = (
    lambda s, d: rounded(B.correlation_matrix(_matrix_input(s, d), "l_returnflag", limit=B.VIEW_COLUMNS, max_distinct=B.VIEW_DISTINCT), 6), _heat_sql(),
)


def cramer_sql(a: str, b: str, source: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(sqrt(greatest(sum(c.n * c.n / (r.n * k.n)) - 1, 0) / (least(count(DISTINCT c.a), count(DISTINCT c.b)) - 1)), 6) AS score
  FROM (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1, 2) c
  JOIN (SELECT {a} AS a, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1) r ON c.a = r.a
  JOIN (SELECT {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1) k ON c.b = k.b"""


WIDE = [f"m{i}" for i in range(2, 42)]


def _wide(s, d):
    """Forty columns derived from one table, the even ones with gaps."""
    return table(s, d, "part").select(*[
        F.when((F.lit(i % 2) == 1) | (F.col("p_partkey") % i > 0), (F.col("p_partkey") * i + F.col("p_size")) % 101).alias(c) for i, c in enumerate(WIDE, 2)
    ])


def _wide_sql(complete: bool) -> str:
    columns = ", ".join(f"CASE WHEN {i % 2} = 1 OR p_partkey % {i} > 0 THEN CAST((p_partkey * {i} + p_size) % 101 AS DOUBLE) END AS {c}" for i, c in enumerate(WIDE, 2))
    where = " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in WIDE) if complete else ""
    pairs = ", ".join(f"{{a: '{a}', b: '{b}', r: round(corr({a}, {b}), 6)}}" for a in WIDE for b in WIDE)
    return f"SELECT x.a AS a, x.b AS b, x.r AS r FROM (SELECT unnest([{pairs}]) AS x FROM (SELECT {columns} FROM part) w{where})"


QUERIES["pearson_matrix_wide"] = (lambda s, d: rounded(B.pearson_matrix(_wide(s, d)), 6), _wide_sql(False))
QUERIES["correlation_matrix_wide"] = (lambda s, d: rounded(B.correlation_matrix(_wide(s, d)), 6), _wide_sql(True))
QUERIES["cramers_v_many_values"] = (
    lambda s, d: rounded(B.cramers_v(table(s, d, "orders").withColumn("customer", F.col("o_custkey").cast("string")), "customer", "o_orderpriority"), 6),
    cramer_sql("customer", "o_orderpriority", "(SELECT *, CAST(o_custkey AS VARCHAR) AS customer FROM orders)"),
)
QUERIES["anova_many_values"] = (
    lambda s, d: rounded(B.anova_scores(table(s, d, "orders").withColumn("customer", F.col("o_custkey").cast("string")), ["o_totalprice"], "customer"), 6),
    """WITH g AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1 HAVING count(*) >= 2),
  t AS (SELECT sum(n * m) / sum(n) AS mean FROM g),
  f AS (SELECT (sum(n * (m - mean) * (m - mean)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g, t)
  SELECT 'o_totalprice' AS a, 'customer' AS b, round(f / (f + 1), 6) AS score FROM f""",
)
QUERIES["cramers_v"] = (
    lambda s, d: rounded(B.cramers_v(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"), 6),
    cramer_sql("l_returnflag", "l_linestatus", "lineitem"),
)
QUERIES["cramers_v_after_join"] = (
    lambda s, d: rounded(B.cramers_v(
        table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "c_mktsegment", "n_name"), 6),
    cramer_sql("c_mktsegment", "n_name", "(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)"),
)


def f_sql(value: str, cat: str, source: str, smallest: int) -> str:
    src = f"(SELECT {cat} AS g, CAST({value} AS DOUBLE) AS x FROM {source} WHERE {cat} IS NOT NULL AND {value} IS NOT NULL)"
    return f"""(SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n,
    (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM
    (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS gm FROM (SELECT g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM {src} GROUP BY g HAVING count(*) >= {smallest})))"""


def anova_score_sql(value: str, cat: str, source: str, name: str = "score") -> str:
    return f"SELECT '{value}' AS a, '{cat}' AS b, round(f / (f + 1), 6) AS {name} FROM {f_sql(value, cat, source, 2)}"


QUERIES["anova_scores"] = (
    lambda s, d: rounded(B.anova_scores(orders_gaps(s, d), ["o_totalprice", "nan_col"], "o_orderpriority"), 6),
    union_sql([anova_score_sql(v, "o_orderpriority", ORDERS_GAPS) for v in ("o_totalprice", "nan_col")]),
)


def _mixed_sql() -> str:
    num, cat = ["l_quantity", "l_extendedprice", "l_tax"], ["l_returnflag", "l_linestatus"]
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(num) for b in num[i + 1:]]
    parts += [anova_score_sql(a, b, "lineitem", "r") for a in num for b in cat]
    parts.append(cramer_sql(cat[0], cat[1], "lineitem"))
    ones = union_sql([f"SELECT '{c}' AS a, '{c}' AS b, CAST(1 AS DOUBLE) AS r" for c in num + cat])
    return f"WITH h AS ({union_sql(parts)}) SELECT a, b, r FROM h UNION ALL SELECT b AS a, a AS b, r FROM h UNION ALL {ones}"


QUERIES["mixed_association"] = (
    lambda s, d: rounded(B.mixed_association(
        table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], ["l_returnflag", "l_linestatus"]), 6),
    _mixed_sql(),
)
_MANY = [f"k{i}" for i in range(1, 11)]


def _many(s, d):
    """Ten categories derived from one table, the even ones with gaps, and two numbers."""
    key = F.col("p_partkey")
    levels = [F.when((F.lit(i % 2) == 1) | (key % (i + 2) > 0), F.concat(F.lit("v"), ((key * i + F.col("p_size")) % (i + 1)).cast("string"))).alias(c) for i, c in enumerate(_MANY, 1)]
    return table(s, d, "part").select("p_retailprice", F.col("p_size").cast("double").alias("size"), *levels)


def _many_sql() -> str:
    levels = ", ".join(f"CASE WHEN {i % 2} = 1 OR p_partkey % {i + 2} > 0 THEN 'v' || ((p_partkey * {i} + p_size) % {i + 1}) END AS {c}" for i, c in enumerate(_MANY, 1))
    source = f"(SELECT p_retailprice, CAST(p_size AS DOUBLE) AS size, {levels} FROM part)"
    parts = [f"SELECT 'p_retailprice' AS a, 'size' AS b, round(corr(p_retailprice, size), 6) AS r FROM {source}"]
    parts += [anova_score_sql(a, b, source, "r") for a in ("p_retailprice", "size") for b in _MANY]
    parts += [cramer_sql(a, b, f"(SELECT * FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)") for i, a in enumerate(_MANY) for b in _MANY[i + 1:]]
    ones = union_sql([f"SELECT '{c}' AS a, '{c}' AS b, CAST(1 AS DOUBLE) AS r" for c in ["p_retailprice", "size", *_MANY]])
    return f"WITH h AS ({union_sql(parts)}) SELECT a, b, r FROM h UNION ALL SELECT b AS a, a AS b, r FROM h UNION ALL {ones}"


QUERIES["mixed_association_many"] = (lambda s, d: rounded(B.mixed_association(_many(s, d), ["p_retailprice", "size"], _MANY), 6), _many_sql())
QUERIES["trend_line"] = (
    lambda s, d: rounded(B.trend_line(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), 4),
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
    round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""",
)
QUERIES["bivariate_numeric"] = (
    lambda s, d: rounded(B.bivariate(table(s, d, "part"), "p_size", "p_retailprice", "numeric", "numeric"), 4),
    """SELECT round(regr_slope(p_retailprice, p_size), 4) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept,
    round(regr_r2(p_retailprice, p_size), 4) AS r2, CAST(regr_count(p_retailprice, p_size) AS BIGINT) AS n FROM part""",
)
QUERIES["bivariate_categories"] = (
    lambda s, d: B.bivariate(table(s, d, "part"), "p_brand", "p_type", "categorical", "categorical"),
    "SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2",
)
QUERIES["bivariate_mixed"] = (
    lambda s, d: rounded(B.bivariate(table(s, d, "events"), "event_type", "value", "categorical", "numeric").select("group", "count", "q25", "median", "q75"), 4),
    """SELECT event_type AS "group", count(*) AS count, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS median,
    round(quantile_cont(value, 0.75), 4) AS q75 FROM events GROUP BY 1""",
)
QUERIES["correlation_with_codes"] = (
    lambda s, d: rounded(B.correlation_with_codes(table(s, d, "lineitem"), "l_returnflag", LI).drop("p"), 6),
    union_sql([f"""SELECT '{c}' AS feature, round(corr(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, {c}), 6) AS r,
    count({c}) AS n FROM lineitem""" for c in LI]),
)
QUERIES["anova_test"] = (
    lambda s, d: rounded(B.anova_test(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"]).drop("p"), 5),
    union_sql([f"SELECT '{c}' AS feature, groups, n, round(f, 5) AS f FROM {f_sql('l_extendedprice', c, 'lineitem', 1)}"
               for c in ("l_returnflag", "l_linestatus")]),
)
_BLEND = "(SELECT *, l_quantity * 3 + l_discount AS blend FROM lineitem)"


def _blend(s, d):
    li = table(s, d, "lineitem")
    return li.select("l_returnflag", *LI, (F.col("l_quantity") * 3 + F.col("l_discount")).alias("blend"))


QUERIES["relevant_features_numeric_target"] = (
    lambda s, d: rounded(B.relevant_features(_blend(s, d), "blend").withColumn("keep", F.when(F.col("role") == "numeric", F.col("keep"))).drop("p"), 5),
    union_sql([f"""SELECT '{c}' AS feature, 'numeric' AS role, round(corr(blend, {c}), 5) AS score,
    abs(corr(blend, {c})) > 0.1 AS keep FROM {_BLEND}""" for c in LI]
    + [f"SELECT 'l_returnflag', 'categorical', round(f, 5), CAST(NULL AS BOOLEAN) FROM {f_sql('blend', 'l_returnflag', _BLEND, 1)}"]),
)
QUERIES["relevant_features_class_target"] = (
    lambda s, d: rounded(B.relevant_features(table(s, d, "lineitem").select("l_returnflag", "l_linestatus", *LI), "l_returnflag").drop("p"), 6),
    union_sql([f"""SELECT '{c}' AS feature, 'numeric' AS role, round(corr(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, {c}), 6) AS score,
    abs(corr(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, {c})) > 0.1 AS keep FROM lineitem""" for c in LI]
    + ["SELECT 'l_linestatus', 'categorical', CAST(count(DISTINCT l_linestatus) AS DOUBLE), true FROM lineitem"]),
)
_MEAN_R = "(" + matrix_sql(["blend", *LI], _BLEND, "corr({a}, {b})") + ")"
QUERIES["mean_correlation"] = (
    lambda s, d: rounded(B.mean_correlation(_blend(s, d)), 6),
    f"""SELECT a AS feature, round(avg(abs(r)), 6) AS mean_abs_r, avg(abs(r)) < 0.3 AS suggested FROM {_MEAN_R} WHERE a <> b GROUP BY a""",
)
QUERIES["overall_correlation"] = (
    lambda s, d: rounded(B.overall_correlation(_blend(s, d)), 6),
    f"SELECT round(avg(abs(r)), 6) AS avg_correlation FROM {_MEAN_R}",
)
