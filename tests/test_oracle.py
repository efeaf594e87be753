"""Spark vs DuckDB on a representative slice of the registered queries (sf0.001)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
NAMES = ["profile_describe", "profile_histogram", "profile_correlation", "profile_non_numeric", "issues_health_score",
         "issues_all", "prep_impute_median", "prep_cap_outliers", "split_stratified", "cv_folds", "encode_onehot",
         "prep_full", "model_gnb_proba", "model_knn", "eval_all_models", "eval_confusion_insights",
         "report_best_model", "report_issue_lines"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    sdf = E.queries()[name](spark, SF001)
    cols = sdf.columns
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in sdf.collect())
    b = sorted(repr(tuple(_norm(r[i]) for i in dorder)) for r in cur.fetchall())
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "health_score" in df.columns
