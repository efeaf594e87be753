import os
import tempfile

from pyspark.sql import functions as F

from sparkclf.models.search import param_distributions, sample_candidates, grid_candidates, param_grids
from sparkclf.plans.preprocess import PrepConfig
from sparkclf.sources import read_csv, write_csv, write_report
from sparkclf.operators import report as R


def test_csv_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="sparkclf-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d\n1,x,1.5,true\n2,NA,,false\n3,n/a,2e3,true\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double", "d": "boolean"}
    rows = df.orderBy("a").collect()
    assert rows[1]["b"] is None and rows[1]["c"] is None and rows[2]["c"] == 2000.0


def test_csv_sink_keeps_spaces(spark):
    d = tempfile.mkdtemp(prefix="sparkclf-csv-")
    df = spark.createDataFrame([(1, " a ")], "i int, s string")
    write_csv(df, os.path.join(d, "o"))
    back = spark.read.option("header", True).csv(os.path.join(d, "o"))
    assert back.first()["s"] == " a "


def test_report_sink_json(spark):
    d = tempfile.mkdtemp(prefix="sparkclf-rep-")
    res = spark.createDataFrame([("m", 0.5, 0.5, 0.5, 0.5)],
                                "model string, accuracy double, precision_weighted double, "
                                "recall_weighted double, f1_weighted double")
    long = R.report_sections({"comparison": R.comparison_table(res)})
    write_report(long, os.path.join(d, "r"))
    assert spark.read.json(os.path.join(d, "r")).count() == 4


def test_prep_config_guard_and_lines():
    assert PrepConfig(encoding="none").is_noop
    assert PrepConfig().has_selected_actions            # one-hot is the function default
    assert PrepConfig(encoding="none", outliers=True).has_selected_actions
    cfg = PrepConfig(impute=True, impute_method="mean", scaling="minmax")
    assert not cfg.is_noop
    assert cfg.summary_lines() == ["Missing Values: Handled using mean method", "Encoding: Onehot encoding applied",
                                   "Scaling: Minmax scaling applied"]


def test_grid_sizes_and_random_draws():
    sizes = {k: len(grid_candidates(v)) for k, v in param_grids().items() if v}
    assert sizes == {"Logistic Regression": 4, "K-Nearest Neighbors": 16, "Decision Tree": 36, "Naive Bayes": 3,
                     "Random Forest": 32, "SVM": 12}
    d = sample_candidates(param_distributions()["Random Forest"], 20, 42)
    assert len(d) == 20 and all(50 <= c["n_estimators"] < 300 and 1 <= c["min_samples_leaf"] < 10 for c in d)
    assert d == sample_candidates(param_distributions()["Random Forest"], 20, 42)
    c = sample_candidates(param_distributions()["Logistic Regression"], 50, 1)
    assert all(0.001 <= x["C"] < 100.001 for x in c)


def test_best_model_tie_goes_to_first_name(spark):
    res = spark.createDataFrame([("b", 0.9, 0.8, 0.7, 0.6), ("a", 0.9, 0.8, 0.7, 0.6)],
                                "model string, accuracy double, precision_weighted double, recall_weighted double, "
                                "f1_weighted double")
    r = R.best_model(res).first()
    assert r["model_name"] == "a" and r["best_accuracy"] == "a"


def test_raw_and_processed_side_by_side(spark):
    from sparkclf.sources import raw_and_processed
    d = tempfile.mkdtemp(prefix="sparkclf-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("id,amount,label\n1,\" 1,5 \",a\n2,2,b\n3,n/a,a\n4,x,b\n")
    raw, processed = raw_and_processed(spark, p)
    assert dict(raw.dtypes)["amount"] == "string"
    assert dict(processed.dtypes)["amount"] == "double"
    assert {r["id"]: r["amount"] for r in processed.collect()} == {1: 1.5, 2: 2.0, 3: None, 4: None}
    raw.unpersist()
