"""Evaluation metrics, cluster quality, drift and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import PREDICTIONS, predictions, rounded, table, union_sql
from gridsmith.operators import cluster_metrics as K
from gridsmith.operators import drift as D
from gridsmith.operators import metrics as M
from gridsmith.operators import ranking as R

QUERIES = {}
_PER_CLASS = """SELECT v AS class, CASE WHEN g > 0 THEN h / CAST(g AS DOUBLE) ELSE 0 END AS precision, CASE WHEN t > 0 THEN h / CAST(t AS DOUBLE) ELSE 0 END AS recall,
    CASE WHEN g + t > 0 THEN 2 * h / CAST(g + t AS DOUBLE) ELSE 0 END AS f1_score, t AS support FROM
  (SELECT v, (SELECT count(*) FROM p WHERE flag = v) AS t, (SELECT count(*) FROM p WHERE flag_guess = v) AS g,
    (SELECT count(*) FROM p WHERE flag = v AND flag_guess = v) AS h FROM (SELECT flag AS v FROM p UNION SELECT flag_guess FROM p))"""
_P = f"WITH p AS {PREDICTIONS}"
QUERIES["classification_metrics"] = (
    lambda s, d: rounded(M.classification_metrics(predictions(s, d), "flag", "flag_guess"), 6),
    f"""{_P}, c AS ({_PER_CLASS}) SELECT (SELECT round(avg((flag = flag_guess)::INT), 6) FROM p) AS accuracy,
    round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(f1_score * support) / sum(support), 6) AS f1_score, CAST(sum(support) AS BIGINT) AS n_samples FROM c""",
)
QUERIES["class_report"] = (
    lambda s, d: rounded(M.class_report(predictions(s, d), "flag", "flag_guess"), 6),
    f"""{_P}, c AS ({_PER_CLASS}) SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM c
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), CAST(sum(support) AS BIGINT) FROM c
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1_score * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c""",
)
QUERIES["class_report_with_accuracy"] = (
    lambda s, d: rounded(M.class_report(predictions(s, d), "flag", "flag_guess", with_accuracy=True), 6),
    f"""{QUERIES["class_report"][1]}
  UNION ALL SELECT 'accuracy', NULL, NULL, round(count(*) FILTER (flag = flag_guess) / CAST(count(*) AS DOUBLE), 6), count(*) FROM p WHERE flag IS NOT NULL AND flag_guess IS NOT NULL""",
)
QUERIES["confusion_matrix"] = (
    lambda s, d: M.confusion_matrix(predictions(s, d), "flag", "flag_guess"),
    f"""{_P}, v AS (SELECT flag AS x FROM p UNION SELECT flag_guess FROM p)
  SELECT a.x AS label, b.x AS prediction, (SELECT count(*) FROM p WHERE flag = a.x AND flag_guess = b.x) AS n FROM v a, v b""",
)


def auc_sql(hit: str, score: str) -> str:
    return f"""(SELECT (sum(r) FILTER (h = 1) - sum(h) * (sum(h) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(h) AS DOUBLE) * sum(1 - h)) AS auc, CAST(sum(h) AS BIGINT) AS support FROM
    (SELECT h, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / CAST(2 AS DOUBLE) AS r FROM
      (SELECT ({hit})::INT AS h, {score} AS x FROM {PREDICTIONS})))"""


QUERIES["roc_auc_binary"] = (
    lambda s, d: rounded(M.roc_auc(M.score_counts(predictions(s, d), "label", "score", 1)), 6),
    f"SELECT round(auc, 6) AS roc_auc FROM {auc_sql('label = 1', 'score')}",
)


def class_scores() -> dict:
    return {"A": F.col("score"), "N": F.round(1 - F.col("score"), 3), "R": F.round(F.col("score") * 0.5 + 0.2, 4)}


CLASS_SCORES_SQL = {"A": "score", "N": "round(1 - score, 3)", "R": "round(score * 0.5 + 0.2, 4)"}
QUERIES["roc_auc_one_vs_rest"] = (
    lambda s, d: rounded(M.roc_auc(M.score_counts_by_class(predictions(s, d), "flag", class_scores())), 6),
    "SELECT round(sum(auc * support) / sum(support), 6) AS roc_auc FROM ("
    + union_sql([f"SELECT * FROM {auc_sql('flag = ' + chr(39) + k + chr(39), x)}" for k, x in CLASS_SCORES_SQL.items()]) + ")",
)
QUERIES["roc_auc_by_class"] = (
    lambda s, d: rounded(M.roc_auc_by_class(M.score_counts_by_class(predictions(s, d), "flag", class_scores())), 6),
    union_sql([f"SELECT '{k}' AS class, round(auc, 6) AS auc, support FROM {auc_sql('flag = ' + chr(39) + k + chr(39), x)}" for k, x in CLASS_SCORES_SQL.items()]),
)
QUERIES["roc_curve"] = (
    lambda s, d: rounded(M.roc_curve(M.score_counts(predictions(s, d), "label", "score", 1)), 6),
    f"""SELECT '1' AS class, threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM
  (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM
    (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM {PREDICTIONS} GROUP BY score)
    WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  UNION ALL SELECT '1', CAST('inf' AS DOUBLE), 0, 0""",
)
QUERIES["regression_metrics"] = (
    lambda s, d: rounded(M.regression_metrics(predictions(s, d), "y", "p"), 4),
    f"""SELECT round(avg((y - p) * (y - p)), 4) AS mse, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
    round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2, round(1 - var_pop(y - p) / var_pop(y), 4) AS explained_variance,
    round(CASE WHEN bool_and(y > 0 AND p > 0) THEN avg((ln(1 + y) - ln(1 + p)) * (ln(1 + y) - ln(1 + p))) END, 4) AS msle, count(*) AS n_samples FROM {PREDICTIONS}""",
)
QUERIES["regression_metrics_negative_values"] = (
    lambda s, d: rounded(M.regression_metrics(table(s, d, "customer").withColumn("p", F.col("c_nationkey") * 300.0), "c_acctbal", "p"), 4),
    """SELECT round(avg((c_acctbal - p) * (c_acctbal - p)), 4) AS mse, round(avg(abs(c_acctbal - p)), 4) AS mae, round(sqrt(avg((c_acctbal - p) * (c_acctbal - p))), 4) AS rmse,
    round(1 - avg((c_acctbal - p) * (c_acctbal - p)) / var_pop(c_acctbal), 4) AS r2, round(1 - var_pop(c_acctbal - p) / var_pop(c_acctbal), 4) AS explained_variance,
    CASE WHEN bool_and(c_acctbal > 0 AND p > 0) THEN avg((ln(1 + c_acctbal) - ln(1 + p)) * (ln(1 + c_acctbal) - ln(1 + p))) END AS msle, count(*) AS n_samples
  FROM (SELECT *, c_nationkey * CAST(300 AS DOUBLE) AS p FROM customer)""",
)
QUERIES["error_statistics"] = (
    lambda s, d: rounded(M.error_statistics(predictions(s, d), "y", "p"), 4),
    f"""SELECT round(avg(e), 4) AS mean_error, round(stddev_pop(e), 4) AS std_error, round(max(e), 4) AS max_error, round(quantile_cont(e, 0.5), 4) AS median_error,
    round(quantile_cont(e, 0.95), 4) AS q95_error FROM (SELECT abs(y - p) AS e FROM {PREDICTIONS})""",
)
QUERIES["residual_table"] = (
    lambda s, d: rounded(M.residual_table(predictions(s, d).select("l_orderkey", "l_linenumber", "y", "p"), "y", "p"), 5),
    f"SELECT l_orderkey, l_linenumber, y, p, round(y - p, 5) AS residual FROM {PREDICTIONS}",
)
QUERIES["prediction_range"] = (
    lambda s, d: M.prediction_range(predictions(s, d), "y", "p"),
    f"SELECT least(min(y), min(p)) AS low, greatest(max(y), max(p)) AS high FROM {PREDICTIONS}",
)
QUERIES["evaluate_predictions"] = (
    lambda s, d: rounded(M.evaluate(predictions(s, d), "classification", "label", "prediction", {"1": F.col("score")}), 6),
    f"""WITH p AS {PREDICTIONS}, c AS (SELECT k, (SELECT count(*) FROM p WHERE label = k) AS t, (SELECT count(*) FROM p WHERE prediction = k) AS g,
    (SELECT count(*) FROM p WHERE label = k AND prediction = k) AS h FROM (SELECT 0 AS k UNION ALL SELECT 1))
  SELECT 'accuracy' AS metric, round(sum(h) / CAST(sum(t) AS DOUBLE), 6) AS value FROM c
  UNION ALL SELECT 'precision', round(sum(h / CAST(g AS DOUBLE) * t) / sum(t), 6) FROM c UNION ALL SELECT 'recall', round(sum(h / CAST(t AS DOUBLE) * t) / sum(t), 6) FROM c
  UNION ALL SELECT 'f1_score', round(sum(2 * h / CAST(g + t AS DOUBLE) * t) / sum(t), 6) FROM c UNION ALL SELECT 'n_samples', CAST(sum(t) AS DOUBLE) FROM c
  UNION ALL SELECT 'roc_auc', round(auc, 6) FROM {auc_sql('label = 1', 'score')}""",
)


# Cluster quality: embeddings with label 0 taken as noise.
def clustered(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") - 1).alias("cluster"))


_PTS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label - 1 AS c FROM embeddings WHERE label >= 1)"
_CELLS = f"(SELECT vec_id, c, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM {_PTS})"
QUERIES["cluster_sizes"] = (
    lambda s, d: K.cluster_sizes(clustered(s, d)),
    "SELECT label - 1 AS cluster, count(*) AS size FROM embeddings WHERE label >= 1 GROUP BY 1",
)
QUERIES["cluster_size_statistics"] = (
    lambda s, d: rounded(K.cluster_size_statistics(clustered(s, d)), 6),
    """SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size
  FROM (SELECT count(*) AS n FROM embeddings WHERE label >= 1 GROUP BY label)""",
)
QUERIES["calinski_harabasz"] = (
    lambda s, d: rounded(K.calinski_harabasz(clustered(s, d), "x"), 5),
    f"""WITH m AS (SELECT c, i, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM {_CELLS} GROUP BY c, i), g AS (SELECT i, avg(v) AS gm FROM {_CELLS} GROUP BY i)
  SELECT round((sum(n * (m - gm) * (m - gm)) / (count(DISTINCT c) - 1)) / (sum(n * s) / ((SELECT count(*) FROM {_PTS}) - count(DISTINCT c))), 5) AS calinski_harabasz_score
  FROM m JOIN g USING (i)""",
)
QUERIES["davies_bouldin"] = (
    lambda s, d: rounded(K.davies_bouldin(clustered(s, d), "x"), 5),
    f"""WITH e AS {_CELLS}, m AS (SELECT c, i, avg(v) AS m FROM e GROUP BY c, i),
  s AS (SELECT c, avg(gap) AS s FROM (SELECT e.c, e.vec_id, sqrt(sum((v - m) * (v - m))) AS gap FROM e JOIN m ON e.c = m.c AND e.i = m.i GROUP BY 1, 2) GROUP BY c),
  q AS (SELECT a.c AS a, b.c AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM m a JOIN m b ON a.i = b.i AND a.c <> b.c GROUP BY 1, 2)
  SELECT round(avg(r), 5) AS davies_bouldin_score FROM (SELECT q.a, max((x.s + y.s) / gap) AS r FROM q JOIN s x ON x.c = q.a JOIN s y ON y.c = q.b GROUP BY q.a)""",
)
_SIL = f"""WITH p AS {_PTS}, t AS (SELECT a.vec_id AS k, a.c AS c, b.c AS o, sum(list_distance(a.x, b.x)) AS t FROM p a, p b GROUP BY 1, 2, 3),
  n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
  s AS (SELECT k, t.c AS cluster, max(CASE WHEN t.c = o THEN t / (n - 1) END) AS a, min(CASE WHEN t.c <> o THEN t / n END) AS b FROM t JOIN n ON n.c = o GROUP BY 1, 2)"""
QUERIES["silhouette_points"] = (
    lambda s, d: rounded(K.silhouette_points(clustered(s, d), "vec_id", "x"), 6),
    f"{_SIL} SELECT k AS vec_id, CAST(cluster AS BIGINT) AS cluster, round((b - a) / greatest(a, b), 6) AS silhouette FROM s",
)
QUERIES["silhouette_score"] = (
    lambda s, d: rounded(K.silhouette(clustered(s, d), "vec_id", "x"), 6),
    f"{_SIL} SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_score FROM s",
)
QUERIES["silhouette_sq_euclidean"] = (
    lambda s, d: rounded(K.silhouette_sq_euclidean(clustered(s, d), "x"), 6),
    _SIL.replace("sum(list_distance(a.x, b.x))", "sum(list_distance(a.x, b.x) * list_distance(a.x, b.x))")
    + " SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_sq_euclidean FROM s",
)
QUERIES["cluster_health"] = (
    lambda s, d: K.cluster_health(clustered(s, d), "x"),
    f"""SELECT (SELECT count(*) FROM embeddings) AS n_samples, (SELECT count(*) FROM embeddings WHERE label = 0) AS n_noise, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_valid,
    count(*) FILTER (n < 5) AS small_clusters, (SELECT count(*) FROM (SELECT i FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY i HAVING var_pop(v) = 0)) AS zero_variance_features,
    CAST(0 AS BIGINT) AS invalid_cells, CASE WHEN count(*) < 2 OR count(*) FILTER (n < 5) > 0 THEN 'poor' ELSE 'good' END AS grade
  FROM (SELECT c, count(*) AS n FROM {_PTS} GROUP BY c)""",
)

# Drift.
QUERIES["drift_distances"] = (
    lambda s, d: rounded(D.ks_distances(
        table(s, d, "events").filter("ts < timestamp'2024-01-15'"), table(s, d, "events").filter("ts >= timestamp'2024-01-15'"), ["value", "user_id"]), 6),
    union_sql([f"""SELECT '{c}' AS "column", round(max(abs(a / CAST(na AS DOUBLE) - b / CAST(nb AS DOUBLE))), 6) AS statistic, any_value(na) AS n_base, any_value(nb) AS n_current FROM
    (SELECT CAST(sum(a) OVER w AS BIGINT) AS a, CAST(sum(b) OVER w AS BIGINT) AS b, CAST(sum(a) OVER () AS BIGINT) AS na, CAST(sum(b) OVER () AS BIGINT) AS nb FROM
      (SELECT {c} AS v, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY 1)
      WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""" for c in ("value", "user_id")]),
)
QUERIES["drifted_columns"] = (
    lambda s, d: D.drifted_columns(
        table(s, d, "lineitem").select("l_quantity", "l_tax"),
        table(s, d, "lineitem").select((F.col("l_quantity") + 5).alias("l_quantity"), "l_tax")).select("column", "drift_detected"),
    """SELECT 'l_quantity' AS "column", true AS drift_detected""",
)


# Runs derived from lineitem: one run per line number.
def runs(s, d):
    n = F.col("l_linenumber")
    task = F.when(n <= 3, "classification").when(n <= 5, "regression").otherwise("clustering")
    g = table(s, d, "lineitem").select(
        "l_linenumber", "l_tax", "l_discount", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("p"),
        (F.when(F.col("l_quantity") > 25, 1).otherwise(0) == F.when(F.round(F.col("l_extendedprice") / 105000.0, 3) > 0.45, 1).otherwise(0)).cast("int").alias("hit"),
    ).groupBy("l_linenumber").agg(
        F.avg("hit").alias("acc"), (F.avg("l_discount") * 10).alias("f1"), F.regr_r2("y", "p").alias("r2"), (F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / 1e8).alias("mse"),
        (F.avg("l_tax") * 18).alias("sil"), F.count_distinct("l_tax").cast("double").alias("k"),
    )
    metrics = F.when(n <= 3, F.create_map(F.lit("accuracy"), F.col("acc"), F.lit("f1_score"), F.col("f1"))).when(
        n <= 5, F.create_map(F.lit("r2"), F.col("r2"), F.lit("mse"), F.col("mse"))
    ).otherwise(F.create_map(F.lit("silhouette_score"), F.col("sil"), F.lit("n_clusters"), F.col("k")))
    return g.select(
        F.concat(F.lit("run-"), n.cast("string")).alias("run_id"), F.concat(F.lit("Model "), n.cast("string")).alias("model_name"), task.alias("task"),
        F.when(n == 3, "FAILED").otherwise("FINISHED").alias("status"), (n != 3).alias("success"), (n * 1.5).alias("training_time"), metrics.alias("metrics"),
    )


RUNS = """(SELECT *, CASE WHEN n <= 3 THEN 'classification' WHEN n <= 5 THEN 'regression' ELSE 'clustering' END AS task, 'run-' || n AS run_id, 'Model ' || n AS model_name,
    CASE WHEN n = 3 THEN 'FAILED' ELSE 'FINISHED' END AS status, n <> 3 AS success, n * CAST(1.5 AS DOUBLE) AS training_time FROM
  (SELECT l_linenumber AS n, avg(((l_quantity > 25)::INT = (round(l_extendedprice / CAST(105000 AS DOUBLE), 3) > 0.45)::INT)::INT) AS acc, avg(l_discount) * 10 AS f1,
    regr_r2(l_extendedprice, l_quantity * CAST(2000 AS DOUBLE)) AS r2, avg((l_extendedprice - l_quantity * 2000) * (l_extendedprice - l_quantity * 2000)) / 1e8 AS mse,
    avg(l_tax) * 18 AS sil, CAST(count(DISTINCT l_tax) AS DOUBLE) AS k FROM lineitem GROUP BY 1))"""
_LONG = f"""(SELECT n, 'accuracy' AS metric, acc AS value FROM {RUNS} WHERE n <= 3 UNION ALL SELECT n, 'f1_score', f1 FROM {RUNS} WHERE n <= 3
  UNION ALL SELECT n, 'r2', r2 FROM {RUNS} WHERE n IN (4, 5) UNION ALL SELECT n, 'mse', mse FROM {RUNS} WHERE n IN (4, 5)
  UNION ALL SELECT n, 'silhouette_score', sil FROM {RUNS} WHERE n > 5 UNION ALL SELECT n, 'n_clusters', k FROM {RUNS} WHERE n > 5)"""
QUERIES["metric_summary"] = (
    lambda s, d: rounded(R.metric_summary(runs(s, d)), 6),
    f"""SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS count FROM {_LONG} GROUP BY 1""",
)
QUERIES["rank_models"] = (
    lambda s, d: rounded(R.rank_models(runs(s, d)), 6),
    f"""SELECT CAST(row_number() OVER (ORDER BY acc DESC, model_name) AS INTEGER) AS rank, model_name, 'accuracy' AS metric, round(acc, 6) AS score FROM {RUNS} WHERE n <= 3""",
)
QUERIES["rank_models_by_error"] = (
    lambda s, d: rounded(R.rank_models(runs(s, d).filter("task = 'regression'").withColumn("metrics", F.map_filter("metrics", lambda k, v: k == "mse"))), 6),
    f"""SELECT CAST(row_number() OVER (ORDER BY mse, model_name) AS INTEGER) AS rank, model_name, 'mse' AS metric, round(mse, 6) AS score FROM {RUNS} WHERE n IN (4, 5)""",
)
QUERIES["best_by_task"] = (
    lambda s, d: rounded(R.best_by_task(runs(s, d), "classification").unionByName(R.best_by_task(runs(s, d), "clustering")), 6),
    f"""(SELECT model_name, round(acc, 6) AS score FROM {RUNS} WHERE n <= 3 ORDER BY acc DESC, f1 DESC, model_name LIMIT 1)
  UNION ALL (SELECT model_name, round(sil, 6) FROM {RUNS} WHERE n > 5 ORDER BY sil DESC, model_name LIMIT 1)""",
)


def _grade(value: str, high: float, good: float) -> str:
    return f"CASE WHEN {value} > {high} THEN 'EXCELLENT' WHEN {value} > {good} THEN 'GOOD' ELSE 'NEEDS_IMPROVEMENT' END"


QUERIES["grade_models"] = (
    lambda s, d: rounded(R.grade_models(runs(s, d)), 6),
    f"""SELECT run_id, model_name, task, CASE WHEN n <= 3 THEN 'accuracy' WHEN n <= 5 THEN 'r2' ELSE 'silhouette_score' END AS primary_metric,
    round(CASE WHEN n <= 3 THEN acc WHEN n <= 5 THEN r2 ELSE sil END, 6) AS primary_score,
    CASE WHEN n = 3 THEN 'FAILED' WHEN n <= 3 THEN {_grade('acc', .9, .7)} WHEN n <= 5 THEN {_grade('r2', .8, .5)} ELSE {_grade('sil', .7, .5)} END AS status FROM {RUNS}""",
)
QUERIES["report_status"] = (
    lambda s, d: rounded(R.report_status(runs(s, d)), 6),
    f"""SELECT run_id, CASE WHEN n <= 3 THEN 'accuracy' WHEN n <= 5 THEN 'r2' ELSE 'silhouette_score' END AS primary_metric, round(v, 6) AS primary_score,
    CASE WHEN v > 0.8 THEN 'excellent' WHEN v > 0.6 THEN 'bon' ELSE 'à améliorer' END AS status
  FROM (SELECT *, CASE WHEN n <= 3 THEN acc WHEN n <= 5 THEN r2 ELSE sil END AS v FROM {RUNS})""",
)


def _nameless(s, d):
    n = F.substring("run_id", 5, 5).cast("int")
    name = F.when(n == 2, "My Logistic model").when(n == 4, "lasso 4").when(n == 6, "DBSCAN x").otherwise(F.col("model_name"))
    r = runs(s, d).withColumn("model_name", name).withColumn("distinct_labels", F.when(n == 1, 3).when(n == 5, 99)).withColumn("clustered", n == 7)
    return r.withColumn("metrics", F.when(n == 3, F.col("metrics")).otherwise(F.map_filter("metrics", lambda k, v: F.lit(False))))


QUERIES["infer_task"] = (
    lambda s, d: R.infer_task(_nameless(s, d), "distinct_labels", "clustered").select("run_id", "inferred_task"),
    f"""SELECT run_id, CASE n WHEN 1 THEN 'classification' WHEN 2 THEN 'classification' WHEN 3 THEN 'classification' WHEN 4 THEN 'regression' WHEN 5 THEN 'regression'
    ELSE 'clustering' END AS inferred_task FROM {RUNS}""",
)
QUERIES["vote_task"] = (
    lambda s, d: R.vote_task(runs(s, d)),
    f"SELECT task AS inferred_task, count(*) AS n FROM {RUNS} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1",
)
QUERIES["runs_wide"] = (
    lambda s, d: rounded(R.runs_wide(runs(s, d), ["accuracy", "r2", "silhouette_score"], ["FINISHED"], ["Model 1", "Model 3", "Model 4", "Model 7"]), 6),
    f"""SELECT run_id, model_name, status, round(CASE WHEN n <= 3 THEN acc END, 6) AS accuracy, round(CASE WHEN n IN (4, 5) THEN r2 END, 6) AS r2,
    round(CASE WHEN n > 5 THEN sil END, 6) AS silhouette_score FROM {RUNS} WHERE status = 'FINISHED' AND n IN (1, 3, 4, 7) ORDER BY run_id LIMIT 10""",
)
QUERIES["comparison_table"] = (
    lambda s, d: rounded(R.comparison_table(runs(s, d), "classification"), 6),
    f"""SELECT model_name, success, training_time, round(CASE WHEN success THEN acc END, 6) AS accuracy, round(CASE WHEN success THEN f1 END, 6) AS f1_score,
    CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS roc_auc FROM {RUNS} WHERE n <= 3""",
)
QUERIES["success_rate"] = (
    lambda s, d: rounded(R.success_rate(runs(s, d)), 6),
    f"SELECT count(*) AS total, count(*) FILTER (NOT success) AS failed, round(avg(success::INT) * 100, 6) AS success_rate FROM {RUNS}",
)
QUERIES["results_advice"] = (
    lambda s, d: rounded(R.results_advice(runs(s, d).filter("task = 'classification'"), "classification"), 6),
    f"""SELECT count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, max_by(model_name, acc) FILTER (success) AS best_model,
    round(stddev_pop(acc) FILTER (success), 6) AS primary_std, stddev_pop(acc) FILTER (success) > 0.1 AS wide_spread,
    count(*) FILTER (success) < count(*) / CAST(2 AS DOUBLE) AS advise_tuning FROM {RUNS} WHERE n <= 3""",
)
