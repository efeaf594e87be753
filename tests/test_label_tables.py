"""Evaluation with very many labels, and the two-level prefix scan against pair counting."""
import numpy as np
from pyspark.sql import functions as F

from sparkclf.operators import metrics as M


def test_twenty_thousand_labels(spark):
    n = 20_000
    rows = spark.range(3 * n).select(F.lit("m").alias("model"), F.format_string("c%05d", F.col("id") % n).alias("y_true"),
                                     F.format_string("c%05d", (F.col("id") + (F.col("id") >= 2 * n).cast("int")) % n).alias("y_pred"))
    t = M.label_table(rows, "y_true")
    assert t.count() == n and t.where("label <> format_string('c%05d', pos)").isEmpty()
    m = M.classification_metrics(rows).first()
    assert abs(m["accuracy"] - 2 / 3) < 1e-12 and abs(m["f1_weighted"] - 2 / 3) < 1e-12
    cells = M.confusion_matrix(rows).where("i < 3")
    got = {(r["i"], r["j"]): r["n"] for r in cells.where("n > 0").collect()}
    assert cells.count() == 3 * n and got == {(i, j): (2 if i == j else 1) for i in range(3) for j in (i, i + 1)}


def test_auc_by_pairs(spark, monkeypatch):
    rng = np.random.RandomState(8)
    labels = np.array(["a", "b", "c", "d"])[rng.randint(0, 4, 400)]
    scores = np.round(rng.random(size=(400, 4)), 2)                   # many ties
    rows = [("multi", str(y), s.tolist()) for y, s in zip(labels, scores)]
    rows += [("two", str(y), s[:2].tolist()) for y, s in zip(labels, scores) if y in "ab"]
    rows += [("one", "a", [1.0]), ("unfit", "a", [0.1, 0.2]), ("unfit", "b", [0.1]), ("unfit", "c", [0.3, 0.1, 0.2]), ("multi", None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "model string, y_true string, scores array<double>").repartition(5)

    def auc(pos, neg):
        return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])

    want = {"multi": sum(auc(scores[labels == c, i], scores[labels != c, i]) * (labels == c).sum() for i, c in enumerate("abcd")) / 400,
            "two": auc(scores[labels == "b", 1], scores[labels == "a", 1]), "one": None}
    for per in (1_000_000, 3):
        monkeypatch.setattr(M, "AUC_ROWS_PER_PARTITION", per)
        got = {r["model"]: r["roc_auc"] for r in M.roc_auc(df).collect()}
        assert got["one"] is None and all(abs(got[k] - v) < 1e-12 for k, v in want.items() if v is not None)
