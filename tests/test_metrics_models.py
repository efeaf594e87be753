import numpy as np
from pyspark.sql import functions as F

from sparkclf.models import knn as K
from sparkclf.operators import metrics as M
from sparkclf.plans import fixtures as fx
from conftest import SF01


def _auc(spark, rows):
    df = spark.createDataFrame([("m", i, y, 0, [1 - s, s]) for i, (y, s) in enumerate(rows)],
                               "model string, id long, y_true int, y_pred int, scores array<double>")
    return M.roc_auc(df).first()["roc_auc"]


def test_auc_ties_and_symmetry(spark):
    rows = [(0, 0.1), (1, 0.1), (0, 0.4), (1, 0.8), (1, 0.4), (0, 0.9)]
    a = _auc(spark, rows)
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a - brute) < 1e-12
    assert abs(_auc(spark, [(y, 1 - s) for y, s in rows]) - (1 - a)) < 1e-12


def test_golden_binary_auc(spark):
    p = fx.preds_bin(spark, SF01)
    df = p.select(F.lit("m").alias("model"), F.col("doc_id").alias("id"), "y_true", "y_pred",
                  F.array(1 - F.col("score"), F.col("score")).alias("scores"))
    assert abs(M.roc_auc(df).first()["roc_auc"] - 0.496814643) < 1e-9


def test_one_class_auc_is_null(spark):
    assert _auc(spark, [(1, 0.2), (1, 0.3)]) is None


def test_confusion_sums_to_n(spark):
    p = fx.preds_multi(spark, SF01).select(F.lit("r").alias("model"), "id", "y_true", "y_pred")
    cm = M.confusion_matrix(p)
    assert cm.agg(F.sum("n")).first()[0] == p.count()
    assert cm.count() == 25


def test_knn_blocked_equals_brute_force(spark, monkeypatch):
    rng = np.random.RandomState(0)
    X = rng.normal(size=(120, 5))
    y = (X[:, 0] > 0).astype(int)
    rows = [(i, X[i].tolist(), int(y[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, f array<double>, y int")
    train, test = df.where("id < 90"), df.where("id >= 90")
    monkeypatch.setattr(K, "TRAIN_BLOCK_ROWS", 16)
    monkeypatch.setattr(K, "QUERY_BLOCK_ROWS", 8)
    nb = K.neighbours(train, test, "f", "id", "y", 5, ("euclidean", "manhattan")).collect()
    got = {(r["metric"], r["qid"]): [] for r in nb}
    for r in sorted(nb, key=lambda r: r["rank"]):
        got[(r["metric"], r["qid"])].append(r["tid"])
    for q in range(90, 120):
        for metric in ("euclidean", "manhattan"):
            d = np.sqrt(((X[:90] - X[q]) ** 2).sum(1)) if metric == "euclidean" else np.abs(X[:90] - X[q]).sum(1)
            want = sorted(range(90), key=lambda t: (d[t], t))[:5]
            assert got[(metric, q)] == want


def test_separable_models_beat_baseline(spark):
    from sparkclf.models.search import train_and_optimize, predict_all
    from sparkclf.functions import uniform
    base = spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("int").alias("c"))
    df = base.select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("c") + 1).alias("y"),
                     F.array((4.0 * F.col("c") + uniform("id")), (4.0 * (F.col("c") % 2) + uniform("id", 7)))
                     .alias("features"))
    from sparkclf.operators.split import train_test_split
    s = train_test_split(df, "y", "id", 0.8).persist()
    names = ("Logistic Regression", "Naive Bayes", "K-Nearest Neighbors", "Decision Tree",
             "Rule-based (Stratified Baseline)")
    res, cv = train_and_optimize(s.where("split = 'train'"), "features", "id", "y", names=names, k=3)
    ev = {r["model"]: r["accuracy"] for r in M.evaluate_all(
        predict_all(res, s.where("split = 'test'"), "features", "id", "y")).collect()}
    for n in names[:-1]:
        assert ev[n] > ev["Rule-based (Stratified Baseline)"] and ev[n] > 0.9, (n, ev)


def test_auc_across_partitions_and_batches(spark, monkeypatch):
    rng = np.random.RandomState(3)
    n = 3000
    y = rng.randint(0, 3, size=n)
    s = np.round(rng.uniform(size=(n, 3)), 3)       # many ties within each class column
    rows = [("m", i, int(y[i]), int(y[i]), [float(v) for v in s[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "model string, id long, y_true int, y_pred int, scores array<double>")
    monkeypatch.setattr(M, "AUC_ROWS_PER_PARTITION", 97)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = M.roc_auc(df).first()["roc_auc"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    tot, w = 0.0, 0
    for c in range(3):
        pos, neg = s[y == c, c], s[y != c, c]
        a = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        tot += a * len(pos)
        w += len(pos)
    assert abs(got - tot / w) < 1e-12


def test_explainability_flags_and_importances(spark):
    from sparkclf.models.spark_ml import fit_spark_model
    from sparkclf.models.gnb import fit_gnb
    from sparkclf.operators import explain as X
    rng = np.random.RandomState(1)
    X0 = rng.normal(size=(200, 3))
    y = (X0[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, X0[i].tolist(), int(y[i])) for i in range(200)],
                               "id long, f array<double>, y int")
    fitted = {
        "Logistic Regression": fit_spark_model("Logistic Regression", df, "f", "y", [0, 1], {"C": 1.0}),
        "Decision Tree": fit_spark_model("Decision Tree", df, "f", "y", [0, 1], {"max_depth": 3}),
        "SVM": fit_spark_model("SVM", df, "f", "y", [0, 1], {"C": 1.0, "kernel": "rbf", "gamma": "scale"}),
        "Naive Bayes": fit_gnb(df, "f", "y"),
    }
    imp, flags = X.explainability(spark, fitted, ["a", "b", "c"])
    assert {r["model"]: r["supports_importance"] for r in flags.collect()} == {
        "Logistic Regression": True, "Decision Tree": True, "SVM": False, "Naive Bayes": False}
    top = {r["model"]: r["feature"] for r in X.top_features(imp, 1).collect()}
    assert top == {"Logistic Regression": "b", "Decision Tree": "b"}
    p = fitted["SVM"].predict(df, "id", "y")
    assert p.where("y_true = y_pred").count() > 150
    assert all(abs(sum(r["scores"]) - 1) < 1e-9 for r in p.select("scores").collect())
