"""Models, search and training batches."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from catalogue.inputs import rounded, table, union_sql
from gridsmith.operators import density as DB
from gridsmith.operators import metrics as M
from gridsmith.operators import neighbors as NN
from gridsmith.operators import sampling as K
from gridsmith.plans import training as T
from gridsmith.plans.catalog import build
from gridsmith.session import scratch_folder
from gridsmith.sources import runs as R

QUERIES = {}


def _lines(s, d):
    li = table(s, d, "lineitem")
    return VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(
        li.select("l_quantity", "l_tax", F.col("l_extendedprice").alias("label"))
    )


def _coefficients(name, params=None):
    def run(s, d):
        df = _lines(s, d)
        n, spread = df.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        model = build("regression", name, params, n, spread=spread).fit(df)
        row = [("l_quantity", float(model.coefficients[0])), ("l_tax", float(model.coefficients[1])), ("intercept", float(model.intercept))]
        return rounded(s.createDataFrame(row, "term string, value double"), 3)

    return run


def _least_squares(alpha: str) -> str:
    return f"""WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_tax) AS mz, avg(l_extendedprice) AS my, count(*) * var_pop(l_quantity) + {alpha} AS a, count(*) * covar_pop(l_quantity, l_tax) AS b,
    count(*) * var_pop(l_tax) + {alpha} AS c, count(*) * covar_pop(l_quantity, l_extendedprice) AS p, count(*) * covar_pop(l_tax, l_extendedprice) AS q FROM lineitem),
  w AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS u, (a * q - b * p) / (a * c - b * b) AS v FROM m)
  SELECT 'l_quantity' AS term, round(u, 3) AS value FROM w UNION ALL SELECT 'l_tax', round(v, 3) FROM w UNION ALL SELECT 'intercept', round(my - u * mx - v * mz, 3) FROM w"""


QUERIES["linear_regression"] = (_coefficients("linear_regression"), _least_squares("0"))
QUERIES["ridge_regression"] = (_coefficients("ridge", {"alpha": 10.0}), _least_squares("10"))


def _lasso(s, d):
    df = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        table(s, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000.0).alias("label")))
    model = build("regression", "lasso", {"alpha": 10.0}).setTol(1e-12).fit(df)
    return rounded(s.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"), 3)


QUERIES["lasso_regression"] = (
    _lasso,
    """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_extendedprice / 1000) AS p FROM lineitem),
  w AS (SELECT *, sign(p) * greatest(abs(p) - 10, 0) / a AS u FROM m) SELECT round(u, 3) AS slope, round(my - u * mx, 3) AS intercept FROM w""",
)
CUSTOMER = {"numeric": ["c_acctbal", "c_nationkey", "spend"], "categorical": ["c_mktsegment"]}


def customers(s, d):
    """Customers with what they spent, and a class and a value to learn."""
    spend = table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n_orders"))
    c = table(s, d, "customer").join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["spend", "n_orders"])
    rich = F.when(F.col("c_acctbal") + F.col("n_orders") * 300 > 6500, "rich").when(F.col("c_acctbal") > 2000, "middle").otherwise("poor")
    return c.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", "spend", rich.alias("standing"),
                    F.when(rich == "rich", 1.0).otherwise(0.0).alias("is_rich"), (F.col("c_acctbal") * 0.5 + F.col("n_orders") * 100).alias("worth"))


def _labelled(s, d, target, task):
    from gridsmith.operators.codes import encode_labels

    return K.train_test_split(encode_labels(customers(s, d), target), ["c_custkey"], 0.2, "label" if task == "classification" else None)


def _scores(names, target, task, params=None):
    """Fit each model on the training side and score it on the test side: ``model, metric, value``."""

    def run(s, d):
        train, test = _labelled(s, d, target, task)
        out = None
        for name in names:
            model = T.fit_model(train, "c_custkey", CUSTOMER, task, name, (params or {}).get(name))
            part = M.evaluate(model.transform(test), task).withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    return run


QUERIES["random_forest_regression"] = (_scores(["random_forest"], "worth", "regression", {"random_forest": {"n_estimators": 20, "max_depth": 8}}), None)
QUERIES["gradient_boosting_regression"] = (
    _scores(["gradient_boosting", "xgboost", "lightgbm"], "worth", "regression",
            {"gradient_boosting": {"n_estimators": 10}, "xgboost": {"n_estimators": 8}, "lightgbm": {"n_estimators": 8, "num_leaves": 31}}), None)
QUERIES["tree_regression"] = (_scores(["decision_tree"], "worth", "regression", {"decision_tree": {"max_depth": 8}}), None)
QUERIES["adaboost_regression"] = (_scores(["adaboost"], "worth", "regression", {"adaboost": {"n_estimators": 5}}), None)
QUERIES["logistic_regression"] = (_scores(["logistic_regression"], "standing", "classification"), None)
QUERIES["random_forest_classification"] = (
    _scores(["random_forest"], "standing", "classification", {"random_forest": {"n_estimators": 20, "max_depth": 8, "class_weight": "balanced"}}), None)
QUERIES["tree_classification"] = (_scores(["decision_tree"], "standing", "classification", {"decision_tree": {"max_depth": 8, "class_weight": "balanced"}}), None)
QUERIES["gradient_boosting_classification"] = (_scores(["gradient_boosting"], "is_rich", "classification", {"gradient_boosting": {"n_estimators": 10}}), None)
QUERIES["gradient_boosting_many_classes"] = (_scores(["gradient_boosting"], "standing", "classification", {"gradient_boosting": {"n_estimators": 5}}), None)
QUERIES["adaboost_classification"] = (_scores(["adaboost"], "standing", "classification", {"adaboost": {"n_estimators": 8}}), None)
QUERIES["linear_svm"] = (_scores(["svm"], "is_rich", "classification", {"svm": {"max_iter": 30}}), None)
QUERIES["linear_svm_many_classes"] = (_scores(["svm"], "standing", "classification", {"svm": {"max_iter": 20}}), None)
QUERIES["neural_network"] = (_scores(["neural_network"], "standing", "classification", {"neural_network": {"hidden_layer_sizes": [16], "max_iter": 60}}), None)


def _flags(s, d):
    li = table(s, d, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") / 1000.0).alias("price"),
        F.when(F.col("l_quantity") + F.col("l_linenumber") * 4 > 40, 1.0).when(F.col("l_tax") > 0.05, 2.0).otherwise(0.0).alias("label"))
    return VectorAssembler(inputCols=["l_quantity", "price"], outputCol="features").transform(li)


FLAGS = """(SELECT l_quantity AS x, l_extendedprice / 1000 AS z, CASE WHEN l_quantity + l_linenumber * 4 > 40 THEN 1 WHEN l_tax > 0.05 THEN 2 ELSE 0 END AS y FROM lineitem)"""


def _confusion(name):
    def run(s, d):
        df = _flags(s, d)
        fitted = build("classification", name).fit(df).transform(df)
        return M.confusion_counts(fitted.select(F.col("label").cast("int"), F.col("prediction").cast("int")))

    return run


QUERIES["linear_discriminant"] = (
    _confusion("discriminant"),
    f"""WITH p AS {FLAGS}, c AS (SELECT y, count(*) AS n, avg(x) AS mx, avg(z) AS mz, count(*) * var_pop(x) AS a, count(*) * covar_pop(x, z) AS b, count(*) * var_pop(z) AS c FROM p GROUP BY y),
  s AS (SELECT sum(a) / (sum(n) - 3) AS a, sum(b) / (sum(n) - 3) AS b, sum(c) / (sum(n) - 3) AS c, sum(n) AS n FROM c),
  w AS (SELECT y, (s.c * mx - s.b * mz) / (s.a * s.c - s.b * s.b) AS u, (s.a * mz - s.b * mx) / (s.a * s.c - s.b * s.b) AS v, mx, mz, ln(c.n / CAST(s.n AS DOUBLE)) AS prior FROM c, s)
  SELECT label, prediction, count(*) AS n FROM (SELECT p.y AS label, arg_max(w.y, u * p.x + v * p.z - (u * mx + v * mz) / 2 + prior) AS prediction
    FROM (SELECT *, row_number() OVER () AS id FROM p) p, w GROUP BY p.id, p.y) GROUP BY 1, 2""",
)
QUERIES["gaussian_naive_bayes"] = (
    _confusion("naive_bayes"),
    f"""WITH p AS {FLAGS}, c AS (SELECT y, count(*) AS n, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS vx, var_pop(z) AS vz FROM p GROUP BY y)
  SELECT label, prediction, count(*) AS n FROM (SELECT p.y AS label, arg_max(c.y, ln(c.n) - ln(vx) / 2 - ln(vz) / 2 - (p.x - mx) * (p.x - mx) / (2 * vx) - (p.z - mz) * (p.z - mz) / (2 * vz)) AS prediction
    FROM (SELECT *, row_number() OVER () AS id FROM p) p, c GROUP BY p.id, p.y) GROUP BY 1, 2""",
)


def _knn_parts(s, d):
    c = K.split_rows(table(s, d, "customer").withColumn("y", F.when(F.col("c_mktsegment") < "C", 1.0).otherwise(0.0)), ["c_custkey"])
    return c.filter("part = 'train'"), c.filter("part = 'test'")


def _knn(weights, task, label):
    def run(s, d):
        train, test = _knn_parts(s, d)
        out = NN.knn_predict(train, test, "c_custkey", ["c_acctbal", "c_nationkey"], label, 5, weights, task)
        return rounded(out, 4)

    return run


_KNN = """WITH s AS (SELECT *, CASE WHEN c_mktsegment < 'C' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY md5(concat_ws('|', '42', c_custkey))) <= floor(count(*) OVER () * 0.2 + 0.5) AS test FROM customer),
  n AS (SELECT q.c_custkey, t.y, t.c_acctbal AS v, sqrt((q.c_acctbal - t.c_acctbal) * (q.c_acctbal - t.c_acctbal) + (q.c_nationkey - t.c_nationkey) * (q.c_nationkey - t.c_nationkey)) AS gap,
    row_number() OVER (PARTITION BY q.c_custkey ORDER BY sqrt((q.c_acctbal - t.c_acctbal) * (q.c_acctbal - t.c_acctbal) + (q.c_nationkey - t.c_nationkey) * (q.c_nationkey - t.c_nationkey)), t.c_custkey) AS rn
  FROM s q JOIN s t ON q.test AND NOT t.test)"""
QUERIES["knn_classification"] = (
    _knn("uniform", "classification", "y"),
    f"{_KNN} SELECT c_custkey, CAST(CASE WHEN sum(y) > 2 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM n WHERE rn <= 5 GROUP BY 1",
)
QUERIES["knn_regression_weighted"] = (
    _knn("distance", "regression", "c_acctbal"),
    f"""{_KNN} SELECT c_custkey, round(CASE WHEN min(gap) = 0 THEN avg(v) FILTER (gap = 0) ELSE sum(v / nullif(gap, 0)) / sum(1 / nullif(gap, 0)) END, 4) AS prediction
  FROM n WHERE rn <= 5 GROUP BY 1""",
)


def _points(s, d):
    return table(s, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 200.0).alias("z"))


def _vectors(s, d):
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(_points(s, d))


def _sizes(name, params):
    def run(s, d):
        out = T.fit_clusters(_vectors(s, d), "p_partkey", "features", name, params)
        return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))

    return run


QUERIES["kmeans"] = (_sizes("kmeans", {"n_clusters": 4}), None)
QUERIES["bisecting_kmeans"] = (_sizes("hierarchical", {"n_clusters": 4}), None)
QUERIES["dbscan"] = (
    lambda s, d: DB.dbscan(_points(s, d), "p_partkey", ["x", "z"], 0.05, 3), None,
)
QUERIES["dbscan_noise"] = (
    # Whether a point is noise needs no chain of neighbours, so SQL can say it.
    lambda s, d: DB.dbscan(_points(s, d), "p_partkey", ["x", "z"], 0.02, 3).select("p_partkey", (F.col("cluster") == -1).alias("noise")),
    """WITH p AS (SELECT p_partkey AS k, p_size / CAST(10 AS DOUBLE) AS x, p_retailprice / 200 AS z FROM part),
  e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) <= 0.02),
  c AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 3)
  SELECT k AS p_partkey, NOT EXISTS (SELECT 1 FROM e JOIN c ON e.b = c.a WHERE e.a = k) AS noise FROM p""",
)
QUERIES["dbscan_manhattan"] = (lambda s, d: DB.dbscan(_points(s, d), "p_partkey", ["x", "z"], 0.05, 3, "manhattan"), None)


def _sixteen(s, d):
    """The first sixteen coordinates of the embeddings."""
    return table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 16).cast("array<double>").alias("x"))


def _wide_noise(eps, least, metric):
    return lambda s, d: DB.dbscan(_sixteen(s, d), "vec_id", "x", eps, least, metric).select("vec_id", (F.col("cluster") == -1).alias("noise"))


def _wide_noise_sql(gap: str, reach: str, least: int) -> str:
    # Equal points are copies of one another, so each pair of rows counts.
    return f"""WITH p AS (SELECT vec_id AS k, CAST(embedding[1:16] AS DOUBLE[]) AS x FROM embeddings),
  e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON {gap} <= {reach}), c AS (SELECT a FROM e GROUP BY a HAVING count(*) >= {least})
  SELECT k AS vec_id, NOT EXISTS (SELECT 1 FROM e JOIN c ON e.b = c.a WHERE e.a = k) AS noise FROM p"""


QUERIES["dbscan_wide_noise"] = (_wide_noise(0.42, 5, "euclidean"), _wide_noise_sql("list_distance(a.x, b.x)", "0.42", 5))
QUERIES["dbscan_cosine_noise"] = (_wide_noise(0.42, 5, "cosine"), _wide_noise_sql("1 - list_cosine_similarity(a.x, b.x)", "0.42", 5))


def _cluster_search(s, d):
    _, scores = T.cluster_search(_vectors(s, d), "p_partkey", "features", "kmeans", [{"n_clusters": k} for k in (2, 3, 4)])
    return scores


QUERIES["cluster_search"] = (_cluster_search, None)


def _fit(name, params=None):
    return T.Recipe("c_custkey", CUSTOMER, "classification", name, params)


def _whole(s, d, target):
    from gridsmith.operators.codes import encode_labels

    return encode_labels(customers(s, d), target)


QUERIES["cross_validation"] = (
    lambda s, d: T.cv_summary(T.cross_validate(_whole(s, d, "is_rich"), "c_custkey", _fit("decision_tree", {"max_depth": 5}), "classification", 3)), None,
)
QUERIES["grid_search"] = (
    lambda s, d: T.grid_search(_whole(s, d, "is_rich"), "c_custkey", CUSTOMER, "classification", "decision_tree",
                               [{"max_depth": 3}, {"max_depth": 6}], 3)[2], None,
)
QUERIES["learning_curve"] = (
    lambda s, d: T.learning_curve(_whole(s, d, "is_rich"), "c_custkey", _fit("decision_tree", {"max_depth": 4}), "classification", [0.3, 1.0], 2), None,
)


def _batch(s, d):
    runs, _ = T.train_models(customers(s, d), "c_custkey", CUSTOMER, "standing", "classification", ["logistic_regression", "decision_tree", "naive_bayes"],
                             {"decision_tree": {"max_depth": 6}})
    return R.valid_runs(runs).select("model_name", "status", "success", F.explode("metrics").alias("metric", "value"))


QUERIES["train_models"] = (_batch, None)
QUERIES["train_clusterings"] = (
    lambda s, d: T.train_models(table(s, d, "part"), "p_partkey", {"numeric": ["p_size", "p_retailprice"]}, None, "clustering", ["kmeans", "hierarchical"],
                                {"kmeans": {"n_clusters": 3}})[0].select("model_name", "status", F.explode("metrics").alias("metric", "value")), None,
)


def _leak_free(s, d):
    """SMOTE grows the training side only; the test side keeps its rows."""
    from gridsmith.operators.codes import encode_labels

    train, test = K.train_test_split(encode_labels(customers(s, d), "standing"), ["c_custkey"], 0.2, "label")
    model = T.fit_model(train, "c_custkey", CUSTOMER, "classification", "decision_tree", {"max_depth": 5}, None, {"k": 3})
    path = scratch_folder(s)
    model.write().overwrite().save(path)
    out = PipelineModel.load(path).transform(test)
    return out.groupBy("standing").agg(F.count("prediction").alias("n"))


QUERIES["leak_free_model_saved"] = (
    _leak_free,
    """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT CASE WHEN c_acctbal + coalesce(n, 0) * 300 > 6500 THEN 'rich' WHEN c_acctbal > 2000 THEN 'middle' ELSE 'poor' END AS standing
    FROM customer LEFT JOIN o ON c_custkey = o_custkey) SELECT standing, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n FROM c GROUP BY 1""",
)


def _importance(s, d):
    train = _whole(s, d, "is_rich")
    model = T.fit_model(train, "c_custkey", CUSTOMER, "classification", "decision_tree", {"max_depth": 5})
    return T.feature_importance(model, model.stages[0].transform(train))


QUERIES["feature_importance"] = (_importance, None)
COEFS = {"l_quantity": 900.0, "l_discount": -20000.0, "l_tax": 15000.0}
QUERIES["linear_contributions"] = (
    lambda s, d: rounded(T.linear_contributions(table(s, d, "lineitem"), COEFS), 3),
    union_sql([f"SELECT '{c}' AS feature, round(avg(abs({v} * ({c} - m))), 3) AS contribution FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)" for c, v in COEFS.items()]),
)
