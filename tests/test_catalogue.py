"""Every registered query runs; those with a SQL twin give the same rows."""

import pytest
from conftest import SF_DIR

from __spark_entry__ import entry, oracle_sql, queries
from compare import normal

SQL = oracle_sql()
# Fits take seconds each; two of each kind keep the suite short. compare.py runs them all.
SLOW = {
    "gradient_boosting_regression", "gradient_boosting_many_classes", "linear_svm_many_classes", "neural_network",
    "adaboost_regression", "random_forest_regression", "grid_search", "learning_curve", "cross_validation", "train_models",
    "adaboost_classification", "linear_svm", "leak_free_model_saved",
}


@pytest.mark.parametrize("name", [n for n in queries() if n not in SLOW])
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert normal(rows, df.columns) == normal(result.fetchall(), columns)
    else:
        assert rows


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 11


def test_twins_have_queries():
    assert set(SQL) <= set(queries())
