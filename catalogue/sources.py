"""Reading, writing, load reports, run tables and the feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import ORDERS_TEXT, orders_text, rounded, table, union_sql
from catalogue.metrics import RUNS, runs
from catalogue.profiles import TRIPLE
from gridsmith.operators import ranking as RK
from gridsmith.operators import sampling as K
from gridsmith.session import scratch_folder
from gridsmith.sources import runs as R
from gridsmith.sources import tables as S
from gridsmith.sources.features import FeatureStore

QUERIES = {}


def _csv(s, d):
    path = scratch_folder(s) + ".csv"
    R.export_csv(table(s, d, "part"), path)
    return S.load_table(s, path).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


QUERIES["csv_round_trip"] = (_csv, "SELECT * FROM part")
QUERIES["parquet_scan"] = (lambda s, d: S.load_table(s, f"{d}/customer.parquet"), "SELECT * FROM customer")


def _json(s, d):
    path = scratch_folder(s) + ".json"
    R.export_json(table(s, d, "nation"), path)
    return S.load_table(s, path).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


QUERIES["json_round_trip"] = (_json, "SELECT * FROM nation")


def _forced(s, d):
    path = scratch_folder(s) + ".csv"
    R.export_csv(orders_text(s, d).select("o_orderkey", "number_text", "o_orderpriority"), path)
    return S.load_table(s, path, types={"number_text": "double", "o_orderkey": "string"})


QUERIES["forced_column_types"] = (
    _forced, f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST(number_text AS DOUBLE) AS number_text, o_orderpriority FROM {ORDERS_TEXT}",
)


def _lines(s, d):
    path = scratch_folder(s) + "-lines"
    docs = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "[\r\n]+")).alias("line"))
    bad = F.concat("line", F.unhex(F.lit("FF")).cast("string"))
    docs.select(F.when(F.col("doc_id") % 10 == 0, bad).otherwise(F.col("line")).alias("value")).write.text(path)
    return S.text_quality(s, path)


QUERIES["text_quality"] = (
    _lines,
    """SELECT count(*) AS lines, count(*) FILTER (doc_id % 10 <> 0 AND trim(line) = '') AS blank_lines, count(*) FILTER (doc_id % 10 = 0) AS bad_utf8_lines, true AS is_valid
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS line FROM documents)""",
)


def _ragged(s, d):
    path = scratch_folder(s) + "-ragged"
    k = F.col("p_partkey")
    line = F.when(k % 10 == 0, F.concat_ws(",", k.cast("string"), "p_brand")).when(
        k % 10 == 1, F.concat_ws(",", k.cast("string"), "p_brand", F.col("p_size").cast("string"), F.lit("x"))
    ).otherwise(F.concat_ws(",", k.cast("string"), "p_brand", F.col("p_size").cast("string")))
    table(s, d, "part").select(line.alias("value")).write.text(path)
    return S.ragged_rows(s, path, "k bigint, brand string, size int", header=False)


QUERIES["ragged_csv_rows"] = (_ragged, "SELECT count(*) AS rows, count(*) FILTER (p_partkey % 10 IN (0, 1)) AS corrupt_rows FROM part")
QUERIES["load_report"] = (
    lambda s, d: S.prepare_loaded(table(s, d, "lineitem").select(*TRIPLE)).report,
    f"""SELECT (SELECT count(*) FROM lineitem) AS rows_read, count(*) AS rows, CAST(3 AS INTEGER) AS columns, (SELECT count(*) FROM lineitem) - count(*) AS duplicates_removed,
    true AS sanitized, CAST(2 AS INTEGER) AS conversions FROM (SELECT DISTINCT {', '.join(TRIPLE)} FROM lineitem)""",
)
QUERIES["load_conversions"] = (
    lambda s, d: S.prepare_loaded(table(s, d, "documents").select("doc_id", "lang", "source", "text")).conversions.select("column", "to_type"),
    """SELECT c AS "column", CASE WHEN d / CAST(n AS DOUBLE) < 0.5 AND d < 1000 THEN 'category' ELSE 'string' END AS to_type FROM (
    SELECT 'lang' AS c, count(DISTINCT lang) AS d, count(*) AS n FROM documents UNION ALL SELECT 'source', count(DISTINCT source), count(*) FROM documents
    UNION ALL SELECT 'text', count(DISTINCT text), count(*) FROM documents)""",
)


def _export(s, d):
    path = scratch_folder(s) + ".csv"
    R.export_csv(K.head(table(s, d, "orders"), 100, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return S.load_table(s, path, schema="o_orderkey bigint, o_orderstatus string, o_totalprice double")


QUERIES["csv_export_of_sample"] = (_export, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")


def _run_rows(s, d):
    r = runs(s, d)
    return r.select("*", F.create_map().cast("map<string,string>").alias("params"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("bigint").alias("start_time"))


def _appended(s, d):
    path = scratch_folder(s)
    rows = _run_rows(s, d)
    R.append_runs(rows, path)
    R.append_runs(rows.filter("task = 'regression'").withColumn("run_id", F.concat("run_id", F.lit("-again"))), path)
    R.append_runs(rows.withColumn("run_id", F.lit("")), path)
    return R.read_runs(s, path).select("run_id", "model_name", "status", "success", "training_time")


QUERIES["runs_table"] = (
    _appended,
    f"""SELECT run_id, model_name, status, success, training_time FROM {RUNS} UNION ALL SELECT run_id || '-again', model_name, status, success, training_time FROM {RUNS} WHERE task = 'regression'""",
)


def _exported(s, d):
    path = scratch_folder(s) + ".json"
    R.export_json(RK.long_metrics(_run_rows(s, d)), path)
    return rounded(S.load_table(s, path).select("run_id", "metric", "value"), 6)


QUERIES["evaluation_export"] = (
    _exported,
    union_sql([f"SELECT run_id, '{m}' AS metric, round({v}, 6) AS value FROM {RUNS} WHERE {w}" for m, v, w in [
        ("accuracy", "acc", "n <= 3"), ("f1_score", "f1", "n <= 3"), ("r2", "r2", "n IN (4, 5)"), ("mse", "mse", "n IN (4, 5)"),
        ("silhouette_score", "sil", "n > 5"), ("n_clusters", "k", "n > 5")]]),
)


def _store(s, d):
    store = FeatureStore(s, scratch_folder(s))
    prices = table(s, d, "orders").select("o_totalprice")
    store.register("price", prices, "order price", ["numeric"])
    version = store.register("price", prices)
    shifted = prices.select((F.col("o_totalprice") + 200000).alias("o_totalprice"))
    same, moved = store.drift("price", prices), store.drift("price", shifted)
    valid = store.check("price", prices, version).select("is_valid")
    return (
        same.select(F.lit("same").alias("case"), "drift_detected")
        .unionByName(moved.select(F.lit("shifted").alias("case"), "drift_detected"))
        .unionByName(valid.select(F.lit("consistent").alias("case"), F.col("is_valid").alias("drift_detected")))
        .unionByName(store.versions().select(F.lit("two versions").alias("case"), (F.size("versions") == 2).alias("drift_detected")))
    )


QUERIES["feature_store"] = (
    _store, """SELECT * FROM (VALUES ('same', false), ('shifted', true), ('consistent', true), ('two versions', true)) t("case", drift_detected)""",
)


def _store_drift(s, d):
    """Distance of a stored feature's columns to another table, and a check against other values."""
    store = FeatureStore(s, scratch_folder(s))
    early, late = (table(s, d, "events").filter(f"ts {side} timestamp'2024-01-15'").select("value", "user_id") for side in ("<", ">="))
    store.register("activity", early)
    told = store.drift("activity", late).select("feature_name", F.round("drift_score", 6).alias("drift_score"), "drift_detected")
    changed = store.check("activity", early.withColumn("value", F.col("value") + 1)).select("differing_columns", "is_valid")
    return told.crossJoin(changed)  # one row each


QUERIES["feature_drift_score"] = (
    _store_drift,
    """WITH k AS (""" + " UNION ALL ".join(f"""SELECT max(abs(a / CAST(na AS DOUBLE) - b / CAST(nb AS DOUBLE))) AS gap FROM
    (SELECT sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM
      (SELECT {c} AS v, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY 1)
      WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""" for c in ("value", "user_id")) + """)
  SELECT 'activity' AS feature_name, round(max(gap), 6) AS drift_score, max(gap) > 0.1 AS drift_detected, CAST(1 AS BIGINT) AS differing_columns, false AS is_valid FROM k""",
)
