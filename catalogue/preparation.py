"""Cleaning, imputation, encoding, scaling, oversampling, projections."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from catalogue.inputs import ORDERS_GAPS, ORDERS_GAPS_COLUMNS, ORDERS_GAPS_NUMERIC, orders_gaps, rounded, table, union_sql
from gridsmith.functions.scalars import missing_to_null
from gridsmith.operators import checks as V
from gridsmith.operators import codes as C
from gridsmith.operators import neighbors as NN
from gridsmith.operators import preparation as P
from gridsmith.operators import stages as S
from gridsmith.session import scratch_folder

QUERIES = {}


def _drops(s, d):
    gaps = orders_gaps(s, d).withColumn("few", (F.col("o_orderkey") % 3).cast("double"))
    rows = P.columns_to_drop(gaps, missing_threshold=0.5)
    return s.createDataFrame(rows, "column string, reason string")


def _drop_sql(c: str) -> str:
    few = f" WHEN count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) < 0.01 THEN 'few_values'" if c in ORDERS_GAPS_NUMERIC or c == "few" else ""
    return f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' WHEN count(DISTINCT {c}) = count(*) THEN 'identifier'
    WHEN 1 - count({c}) / CAST(count(*) AS DOUBLE) > 0.5 THEN 'missing'{few} END AS reason FROM (SELECT *, CAST(o_orderkey % 3 AS DOUBLE) AS few FROM {ORDERS_GAPS})"""


QUERIES["columns_to_drop"] = (
    _drops, f"SELECT * FROM ({union_sql([_drop_sql(c) for c in [*ORDERS_GAPS_COLUMNS, 'few']])}) WHERE reason IS NOT NULL",
)
QUERIES["column_cleaner"] = (
    lambda s, d: S.ColumnCleaner().fit(orders_gaps(s, d)).transform(missing_to_null(orders_gaps(s, d))),
    f"SELECT o_totalprice, o_orderpriority, o_orderstatus, o_orderdate, nan_col, sparse_col FROM {ORDERS_GAPS}",
)
QUERIES["zero_variance_columns"] = (
    lambda s, d: s.createDataFrame([(c,) for c in P.zero_variance_columns(orders_gaps(s, d))], "column string"),
    f"""SELECT * FROM ({union_sql([f'SELECT CASE WHEN count(DISTINCT {c}) <= 1 THEN {chr(39)}{c}{chr(39)} END AS "column" FROM {ORDERS_GAPS}' for c in ORDERS_GAPS_NUMERIC])}) WHERE "column" IS NOT NULL""",
)
_MODE = f"(SELECT o_orderpriority FROM {ORDERS_GAPS} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _fill_sql(fn: str) -> str:
    def num(c):
        return f"round(coalesce({c}, (SELECT {fn.format(c=c)} FROM {ORDERS_GAPS})), 4) AS {c}"

    return f"SELECT o_orderkey, {num('o_totalprice')}, {num('nan_col')}, {num('sparse_col')}, coalesce(o_orderpriority, {_MODE}) AS o_orderpriority FROM {ORDERS_GAPS}"


_FILL = ["o_orderkey", "o_totalprice", "nan_col", "sparse_col", "o_orderpriority"]


def _key_kept(df):
    return rounded(df.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint")), 4)


QUERIES["impute_mean_and_mode"] = (
    lambda s, d: _key_kept(P.impute(orders_gaps(s, d).select(*_FILL))), _fill_sql("avg({c})"),
)
QUERIES["impute_median"] = (
    lambda s, d: _key_kept(S.Imputation(numericStrategy="median").fit(orders_gaps(s, d).select(*_FILL)).transform(orders_gaps(s, d).select(*_FILL))),
    _fill_sql("quantile_cont({c}, 0.5)"),
)


def _constants(s, d):
    df = orders_gaps(s, d).select(*_FILL)
    fills = P.imputation_values(df, ["o_totalprice", "nan_col", "sparse_col"], ["o_orderpriority"], "constant", "constant", -1.0)
    return rounded(P.fill_missing(df, fills), 4)


QUERIES["impute_constant"] = (
    _constants,
    f"SELECT o_orderkey, coalesce(o_totalprice, -1) AS o_totalprice, coalesce(nan_col, -1) AS nan_col, coalesce(sparse_col, -1) AS sparse_col, coalesce(o_orderpriority, 'missing') AS o_orderpriority FROM {ORDERS_GAPS}",
)


def part_gaps(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size").cast("double")).alias("size"),
                    F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")).alias("price"), (F.length("p_name") * 1.0).alias("name_length"))


PART_GAPS = """(SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
  CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS price, length(p_name) * CAST(1 AS DOUBLE) AS name_length FROM part)"""
_KNN_PAIR = """(SELECT q.p_partkey AS k, d.p_partkey AS t, {f} AS v, row_number() OVER (PARTITION BY q.p_partkey ORDER BY
    sqrt((coalesce((q.size - d.size) * (q.size - d.size), 0) + coalesce((q.price - d.price) * (q.price - d.price), 0) + (q.name_length - d.name_length) * (q.name_length - d.name_length))
      * 3 / (1 + ((q.size IS NOT NULL AND d.size IS NOT NULL)::INT) + ((q.price IS NOT NULL AND d.price IS NOT NULL)::INT))), md5(CAST(d.p_partkey AS VARCHAR))) AS rn
  FROM g q JOIN g d ON d.{c} IS NOT NULL WHERE q.{c} IS NULL)"""


def _knn_sql() -> str:
    fills = {c: f"(SELECT k, avg(v) AS v FROM {_KNN_PAIR.format(f='d.' + c, c=c)} WHERE rn <= 5 GROUP BY k)" for c in ("size", "price")}
    return f"""WITH g AS {PART_GAPS} SELECT p_partkey, round(coalesce(size, a.v), 4) AS size, round(coalesce(price, b.v), 4) AS price, name_length
  FROM g LEFT JOIN {fills['size']} a ON a.k = p_partkey LEFT JOIN {fills['price']} b ON b.k = p_partkey"""


QUERIES["knn_imputation"] = (
    lambda s, d: rounded(NN.knn_impute(part_gaps(s, d), ["p_partkey"], ["size", "price", "name_length"], 5), 4), _knn_sql(),
)
QUERIES["label_codes"] = (
    lambda s, d: C.code_table(orders_gaps(s, d), "o_orderpriority"),
    f"SELECT o_orderpriority AS value, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM {ORDERS_GAPS} WHERE o_orderpriority IS NOT NULL)",
)
QUERIES["encode_labels"] = (
    lambda s, d: C.encode_labels(orders_gaps(s, d), "o_orderpriority").select("o_orderkey", "o_orderpriority", "label"),
    f"SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) END AS label FROM {ORDERS_GAPS}",
)


def _ordinal(s, d):
    docs = table(s, d, "documents")
    fitted = C.code_table(docs.filter("lang <> 'en'"), "source")
    return P.ordinal_encode(docs.select("doc_id", "lang", "source"), "source", "code", table=fitted)


QUERIES["ordinal_encode"] = (
    _ordinal,
    """SELECT doc_id, lang, source, coalesce(c, -1) AS code FROM documents LEFT JOIN
  (SELECT source AS v, CAST(row_number() OVER (ORDER BY source) - 1 AS DOUBLE) AS c FROM (SELECT DISTINCT source FROM documents WHERE lang <> 'en')) ON v = source""",
)


def _onehot(s, d):
    o = table(s, d, "orders")
    levels = C.few_levels(o.filter("o_orderstatus <> 'P'"), ["o_orderstatus"])["o_orderstatus"]
    hot = P.onehot_columns("o_orderstatus", levels) | P.onehot_columns("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], False, "p")
    return o.select("o_orderkey", *[c.alias(n) for n, c in hot.items()])


QUERIES["onehot_encode"] = (
    _onehot,
    """SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INT)::DOUBLE AS "o_orderstatus_O", CAST(o_orderpriority = '1-URGENT' AS INT)::DOUBLE AS "p_1-URGENT",
    CAST(o_orderpriority = '2-HIGH' AS INT)::DOUBLE AS "p_2-HIGH", CAST(o_orderpriority = '3-MEDIUM' AS INT)::DOUBLE AS "p_3-MEDIUM" FROM orders""",
)


def _scaled(method):
    def run(s, d):
        df = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"), "c_acctbal")
        return rounded(P.scale(df, P.scaling_values(df, ["nation", "c_acctbal"], method)), 5)

    return run


def _scale_sql(centre: str, width: str) -> str:
    def one(c, name):
        return f"round(({c} - (SELECT {centre.format(c=c)} FROM customer)) / (SELECT {width.format(c=c)} FROM customer), 5) AS {name}"

    return f"SELECT c_custkey, {one('CAST(c_nationkey AS DOUBLE)', 'nation')}, {one('c_acctbal', 'c_acctbal')} FROM customer"


QUERIES["standard_scaling"] = (_scaled("standard"), _scale_sql("avg({c})", "stddev_pop({c})"))
QUERIES["minmax_scaling"] = (_scaled("minmax"), _scale_sql("min({c})", "max({c}) - min({c})"))
QUERIES["robust_scaling"] = (_scaled("robust"), _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
QUERIES["date_part_features"] = (
    lambda s, d: rounded(P.scale(
        P.add_date_parts(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"]).drop("o_orderdate"),
        {"o_orderdate_month": (6.0, 2.0)}), 4),
    """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, round((month(o_orderdate) - 6) / CAST(2 AS DOUBLE), 4) AS o_orderdate_month,
    day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_dayofweek FROM orders""",
)
ORDER_ROLES = {
    "numeric": ["o_totalprice", "nan_col", "empty_col"], "categorical": ["o_orderpriority", "o_orderstatus"], "datetime": ["o_orderdate"], "text_or_high_cardinality": ["clerk"],
}


def order_features(s, d):
    return orders_gaps(s, d).withColumn("clerk", F.concat(F.lit("clerk "), (F.col("o_orderkey") % 1500).cast("string")))


def _prepared(s, d):
    df = order_features(s, d)
    model = S.Preprocessor(roles=ORDER_ROLES).fit(df)
    return V.vector_check(model.transform(df))


_CHECK_SQL = """SELECT CAST(2 + (count(DISTINCT o_orderpriority) - 1) + (count(DISTINCT o_orderstatus) - 1) + 4 + 1 AS BIGINT) AS n_features, CAST(0 AS BIGINT) AS nan_count,
  CAST(0 AS BIGINT) AS inf_count, CAST(0 AS BIGINT) AS zero_variance_features, true AS is_valid FROM orders"""
QUERIES["preprocessor_vector_check"] = (_prepared, _CHECK_SQL)


def _saved(s, d):
    df, path = order_features(s, d), scratch_folder(s)
    config = {"encoding_method": "ordinal", "scaling_method": "robust", "numeric_imputation": "median"}
    S.Preprocessor(roles=ORDER_ROLES, config=config).fit(df).write().overwrite().save(path)
    return V.vector_check(PipelineModel.load(path).transform(df))


QUERIES["preprocessor_saved_and_loaded"] = (_saved, _CHECK_SQL.replace("(count(DISTINCT o_orderpriority) - 1) + (count(DISTINCT o_orderstatus) - 1)", "2").replace(" FROM orders", ""))


def _vectors(s, d):
    e = table(s, d, "embeddings")
    return e.withColumn("features", F.col("embedding").cast("array<double>"))


def _check_arrays(s, d):
    from pyspark.ml.functions import array_to_vector

    return V.vector_check(_vectors(s, d).withColumn("features", array_to_vector("features")))


QUERIES["vector_check"] = (
    _check_arrays,
    """SELECT count(*) AS n_features, CAST(0 AS BIGINT) AS nan_count, CAST(0 AS BIGINT) AS inf_count, count(*) FILTER (v = 0) AS zero_variance_features, true AS is_valid
  FROM (SELECT i, var_pop(x) AS v FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY i)""",
)


def _smoted(s, d):
    labels = table(s, d, "labels").join(table(s, d, "documents"), "doc_id")
    df = labels.select("doc_id", F.col("n_chars").cast("double").alias("n"), F.length(F.regexp_replace("text", "[^ ]", "")).cast("double").alias("spaces"), "quality")
    out = NN.smote(df, "doc_id", ["n", "spaces"], "quality", 5)
    return out.groupBy("quality", "synthetic").agg(F.count(F.lit(1)).alias("n"))


QUERIES["smote_class_counts"] = (
    _smoted,
    """WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT quality, false AS synthetic, n FROM c
  UNION ALL SELECT quality, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""",
)


def _smote_span(s, d):
    """Every synthetic row lies within the range of its class."""
    p = table(s, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"), F.when(F.col("c_nationkey") < 4, "few").otherwise("many").alias("y"))
    out = NN.smote(p, "c_custkey", ["c_acctbal", "n"], "y", 3, "minority")
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("x")[0]).alias("low"), F.max(F.col("x")[0]).alias("high"))


QUERIES["smote_within_class_range"] = (
    _smote_span,
    """WITH c AS (SELECT CASE WHEN c_nationkey < 4 THEN 'few' ELSE 'many' END AS y, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1)
  SELECT y, (SELECT max(n) FROM c) AS n, low, high FROM c""",
)


def _plane(s, d):
    df = table(s, d, "lineitem").select(F.col("l_quantity"), (F.col("l_extendedprice") / 1000.0).alias("price"))
    return VectorAssembler(inputCols=["l_quantity", "price"], outputCol="features").transform(df)


def _pca_shares(s, d):
    _, shares = S.pca(_plane(s, d), "features", "pcs", 2)
    return rounded(s.createDataFrame([(i, float(v)) for i, v in enumerate(shares)], "component int, share double"), 6)


QUERIES["pca_shares"] = (
    _pca_shares,
    """WITH m AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice / 1000) AS b, var_samp(l_extendedprice / 1000) AS c FROM lineitem),
  e AS (SELECT (a + c) / 2 AS mid, sqrt((a - c) * (a - c) / 4 + b * b) AS off FROM m)
  SELECT CAST(0 AS INTEGER) AS component, round((mid + off) / (2 * mid), 6) AS share FROM e UNION ALL SELECT 1, round((mid - off) / (2 * mid), 6) FROM e""",
)


def _pca_width(s, d):
    from pyspark.ml.functions import array_to_vector

    df = _vectors(s, d).withColumn("features", array_to_vector("features"))
    out, shares = S.pca(df, "features", "pcs", 0.95)
    return out.select("vec_id", F.lit(len(shares)).alias("components"), F.lit(sum(shares) >= 0.95).alias("enough"))


QUERIES["pca_by_variance_share"] = (_pca_width, None)


def _svd(s, d):
    _, singular = S.truncated_svd(_plane(s, d).withColumn("k", F.lit(1)), "k", "features", 2)
    return rounded(s.createDataFrame([(i, v) for i, v in enumerate(singular)], "component int, value double"), 3)


QUERIES["svd_singular_values"] = (
    _svd,
    """WITH m AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_extendedprice / 1000) AS b, sum(l_extendedprice * l_extendedprice / 1000000) AS c FROM lineitem),
  e AS (SELECT (a + c) / 2 AS mid, sqrt((a - c) * (a - c) / 4 + b * b) AS off FROM m)
  SELECT CAST(0 AS INTEGER) AS component, round(sqrt(mid + off), 3) AS value FROM e UNION ALL SELECT 1, round(sqrt(mid - off), 3) FROM e""",
)
QUERIES["svd_projection"] = (
    lambda s, d: S.truncated_svd(_vectors(s, d), "vec_id", "features", 3)[0].select("vec_id", F.size("svd").alias("width")),
    "SELECT vec_id, CAST(3 AS INTEGER) AS width FROM embeddings",
)
_EDGE = 600


def _wide_rows(s, d):
    """Rows with a single value each, in one of 600 columns: products of columns vanish, so column sums tell the singular values."""
    place = (F.col("p_partkey") % _EDGE).cast("int")
    value = F.col("p_size") / (1 + place)
    return table(s, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(_EDGE - 1)), lambda i: F.when(i == place, value).otherwise(0.0)).alias("features"))


def _wide_svd(s, d):
    out, _ = S.truncated_svd(_wide_rows(s, d), "p_partkey", "features", 3)
    # Each row lies along one of the leading directions, or along none.
    return out.select("p_partkey", F.posexplode("svd").alias("component", "v")).select("p_partkey", "component", F.round(F.abs("v"), 4).alias("value"))


QUERIES["svd_wide_projection"] = (
    _wide_svd,
    f"""WITH r AS (SELECT p_partkey, p_partkey % {_EDGE} AS place, p_size / CAST(1 + p_partkey % {_EDGE} AS DOUBLE) AS v FROM part),
  c AS (SELECT place, row_number() OVER (ORDER BY sum(v * v) DESC) - 1 AS component FROM r GROUP BY place QUALIFY component < 3)
  SELECT p_partkey, CAST(c.component AS INT) AS component, round(CASE WHEN r.place = c.place THEN v ELSE 0 END, 4) AS value FROM r, c""",
)
_TURN = "(SELECT atan2(2 * b, a - c) / 2 AS t FROM m)"
QUERIES["svd_projection_values"] = (
    lambda s, d: S.truncated_svd(_keyed_plane(s, d), "k", "features", 2)[0].select("k", F.transform("svd", lambda v: F.round(v, 4)).alias("svd"))
    .select("k", F.col("svd")[0].alias("first"), F.abs(F.col("svd")[1]).alias("second")),
    f"""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
  m AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM p), t AS {_TURN}
  SELECT k, round(x * cos(t) + y * sin(t), 4) AS first, abs(round(y * cos(t) - x * sin(t), 4)) AS second FROM p, t""",
)
QUERIES["cluster_projection_values"] = (
    lambda s, d: S.cluster_projection(_keyed_plane(s, d).withColumn("side", F.col("k") % 3), "features", "side", "k")[0]
    .select("k", "side", F.round(F.abs("pc1"), 4).alias("pc1"), F.round(F.abs("pc2"), 4).alias("pc2")),
    f"""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
  p AS (SELECT k, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM q), m AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM p), t AS {_TURN}
  SELECT k, k % 3 AS side, round(abs(x * cos(t) + y * sin(t)), 4) AS pc1, round(abs(y * cos(t) - x * sin(t)), 4) AS pc2 FROM p, t""",
)


def _keyed_plane(s, d):
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")
    from pyspark.ml.feature import VectorAssembler

    plane = table(s, d, "lineitem").select(key, F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"))
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(plane)


def _projection(s, d):
    from pyspark.ml.functions import array_to_vector

    df = _vectors(s, d).withColumn("features", array_to_vector("features"))
    out, _ = S.cluster_projection(df, "features", "label", "vec_id")
    return out


QUERIES["cluster_projection"] = (_projection, None)
