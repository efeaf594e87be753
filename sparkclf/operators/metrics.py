"""Evaluation on prediction tables.

A prediction table has ``model``, ``y_true``, ``y_pred`` and optionally
``scores`` (array<double>, one entry per model class in sorted class order).
All metrics for all models come out of a few aggregates:

* the confusion counts (model, y_true, y_pred, n) — bounded by models x classes²;
* exact, tie-aware ROC-AUC per (model, class), computed from a score histogram
  with prefix sums that never put more than one range partition in a task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt_fixed, fmt_pct, safe_div
from ..session import cut_lineage

METRICS = ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")


def confusion_counts(preds: DataFrame) -> DataFrame:
    """(model, y_true, y_pred, n) for labelled rows."""
    return (preds.where(F.col("y_true").isNotNull())
            .groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")))


def classification_metrics(preds: DataFrame) -> DataFrame:
    """(model, accuracy, precision_weighted, recall_weighted, f1_weighted);
    zero division counts as 0, classes are weighted by their support."""
    cm = confusion_counts(preds)
    sup = cm.groupBy("model", F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy("model", F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    tp = cm.where(F.col("y_true") == F.col("y_pred")).select("model", F.col("y_true").alias("label"),
                                                             F.col("n").alias("tp"))
    per = (sup.join(prd, ["model", "label"], "full").join(tp, ["model", "label"], "left")
           .na.fill(0, ["support", "predicted", "tp"]))
    p = F.coalesce(safe_div("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(safe_div("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(safe_div(F.col("tp") * 2, F.col("support") + F.col("predicted")), F.lit(0.0))
    tot = F.sum("support")
    return per.groupBy("model").agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("support") * p) / tot).alias("precision_weighted"),
        (F.sum(F.col("support") * r) / tot).alias("recall_weighted"),
        (F.sum(F.col("support") * f1) / tot).alias("f1_weighted"))


AUC_ROWS_PER_PARTITION = 1_000_000


def label_table(rows: DataFrame, *cols: str) -> DataFrame:
    """(model, label, pos): the sorted distinct labels of each model in ``cols``, as rows numbered from 0."""
    one = None
    for c in cols:
        r = rows.select("model", F.col(c).alias("label"))
        one = r if one is None else one.unionByName(r)
    one = one.where(F.col("label").isNotNull()).distinct()
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("model").orderBy("label")) - 1)


def _prefix_auc(groups: DataFrame) -> DataFrame:
    """groups: (g, s, pos, neg) with one row per (group, distinct score).
    Returns (g, auc_sum, P, N) where auc_sum = Σ pos·(neg below + neg/2).

    A prefix scan on two levels.  Rows are range-partitioned on (g, s) (about a million
    distinct scores per partition) and sorted; each partition streams its Arrow batches and
    yields, per group, only its totals: positives, negatives and Σ pos·(neg before, within
    the partition, + neg/2).  The negatives of earlier partitions are then added from these
    totals - a row per (group, partition) - as their number times the positives.  Every row
    is used once, so nothing depends on two runs sampling the same range bounds.
    """
    sch = "g string, first_s double, inside double, pos long, neg long"

    def local(batches):
        now, total = None, None

        def row():
            return pd.DataFrame([(now, *total)], columns=["g", "first_s", "inside", "pos", "neg"])

        for pdf in batches:
            if pdf.empty:
                continue
            g, sv = pdf["g"].to_numpy(), pdf["s"].to_numpy(dtype=float)
            pos, neg = pdf["pos"].to_numpy(dtype=np.int64), pdf["neg"].to_numpy(dtype=np.int64)
            # rows arrive sorted by (g, s): split the batch into runs of equal g
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
                if g[a] != now:
                    if now is not None:
                        yield row()
                    now, total = g[a], (float(sv[a]), 0.0, 0, 0)
                first, inside, p, n = total
                below = n + np.cumsum(neg[a:b]) - neg[a:b]
                inside += float((pos[a:b] * (below + neg[a:b] / 2.0)).sum())
                total = (first, inside, p + int(pos[a:b].sum()), n + int(neg[a:b].sum()))
        if now is not None:
            yield row()

    spark = groups.sparkSession
    groups = cut_lineage(groups)                       # counted, sampled and sorted from here
    nparts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), -(-groups.count() // AUC_ROWS_PER_PARTITION))
    totals = groups.repartitionByRange(nparts, "g", "s").sortWithinPartitions("g", "s").mapInPandas(local, sch)
    w = Window.partitionBy("g").orderBy("first_s").rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("off", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return t.groupBy("g").agg(F.sum(F.col("inside") + F.col("off") * F.col("pos")).alias("auc_sum"), F.sum("pos").alias("P"),
                              F.sum("neg").alias("N"))


def roc_auc(preds: DataFrame, score_col: str = "scores") -> DataFrame:
    """(model, roc_auc).  Binary: positive = larger label, score = scores[1];
    multiclass: one-vs-rest per class weighted by support; NULL when the
    labels do not fit the scores (e.g. a single class)."""
    lab = preds.where(F.col("y_true").isNotNull())
    labels = label_table(lab, "y_true")
    sizes = labels.groupBy("model").agg(F.count(F.lit(1)).alias("nc"))
    j = (lab.join(labels.withColumnRenamed("label", "y_true"), ["model", "y_true"]).join(sizes, "model")
            .select("model", "nc", "pos", F.col(score_col).alias("__s")).withColumn("ns", F.size("__s")))
    ok = ((F.col("nc") == 2) & (F.col("ns") == 2)) | ((F.col("nc") > 2) & (F.col("nc") == F.col("ns")))
    j = j.where(ok)
    bin_rows = j.where(F.col("nc") == 2).select(
        "model", F.lit(1).alias("ci"), (F.col("pos") == 1).alias("is_pos"), F.col("__s")[1].cast("double").alias("s"))
    multi = j.where(F.col("nc") > 2).select("model", "pos", F.posexplode("__s").alias("ci", "s"))
    multi_rows = multi.select("model", "ci", (F.col("pos") == F.col("ci")).alias("is_pos"), F.col("s").cast("double").alias("s"))
    rows = bin_rows.unionByName(multi_rows)
    g = F.concat_ws("\u0001", F.col("model"), F.col("ci").cast("string"))
    hist = rows.groupBy(g.alias("g"), "s").agg(F.count_if("is_pos").alias("pos"),
                                              F.count_if(~F.col("is_pos")).alias("neg"))
    per = _prefix_auc(hist)
    per = per.select(F.split("g", "\u0001")[0].alias("model"),
                     F.split("g", "\u0001")[1].cast("int").alias("ci"),
                     safe_div("auc_sum", F.col("P") * F.col("N")).alias("auc"), "P", "N")
    out = per.groupBy("model").agg(
        F.when(F.count(F.lit(1)) == 1, F.first("auc"))
        .otherwise(F.sum(F.col("auc") * F.col("P")) / F.sum("P")).alias("roc_auc"),
        F.count_if(F.col("auc").isNull()).alias("bad"))
    out = out.select("model", F.when(F.col("bad") == 0, F.col("roc_auc")).alias("roc_auc"))
    models = preds.select("model").distinct()
    return models.join(out, "model", "left")


def evaluate_all(preds: DataFrame, with_auc: bool = True) -> DataFrame:
    """One row per model: accuracy, weighted precision/recall/F1 and ROC-AUC."""
    m = classification_metrics(preds)
    if with_auc and "scores" in preds.columns:
        m = m.join(roc_auc(preds), "model", "left")
    else:
        m = m.withColumn("roc_auc", F.lit(None).cast("double"))
    return m.select("model", *METRICS, "roc_auc")


# Groups that the rows of a model's confusion matrix are dealt to.
MATRIX_GROUPS = 64


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """Long confusion matrix with zero cells over the sorted union of labels:
    (model, i, j, y_true, y_pred, n).  The cells of a model come from many tasks:
    its rows are dealt to groups, each of which meets the model's labels."""
    cm = confusion_counts(preds)
    labels = label_table(cm, "y_true", "y_pred")
    down = labels.select("model", F.col("pos").alias("i"), F.col("label").alias("y_true"),
                         F.pmod("pos", F.lit(MATRIX_GROUPS)).cast("int").alias("grp"))
    across = labels.select("model", F.col("pos").alias("j"), F.col("label").alias("y_pred"),
                           F.explode(F.sequence(F.lit(0), F.lit(MATRIX_GROUPS - 1))).alias("grp"))
    return (down.join(across, ["model", "grp"]).join(cm, ["model", "y_true", "y_pred"], "left")
            .select("model", "i", "j", "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_insights(cm_long: DataFrame) -> DataFrame:
    """(model, metric, value): overall accuracy, best and worst recall class,
    most common error, with classes named 'Class <i>' by sorted position.
    Ties: best -> first class, worst -> last class, error -> first cell in
    row-major order."""
    rows = cm_long.groupBy("model", "i").agg(
        F.sum("n").alias("actual"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("tp"))
    rec = rows.select("model", "i", F.coalesce(safe_div("tp", "actual"), F.lit(0.0)).alias("recall"))
    tot = cm_long.groupBy("model").agg(F.sum("n").alias("total"),
                                       F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("correct"))
    best = rec.groupBy("model").agg(F.max_by(F.struct("i", "recall"), F.struct("recall", -F.col("i"))).alias("b"))
    worst = rec.groupBy("model").agg(F.min_by(F.struct("i", "recall"), F.struct("recall", -F.col("i"))).alias("w"))
    off = cm_long.where(F.col("i") != F.col("j"))
    err = off.groupBy("model").agg(F.max_by(F.struct("i", "j", "n"),
                                            F.struct("n", -F.col("i"), -F.col("j"))).alias("e"))
    name = lambda c: F.concat(F.lit("Class "), c.cast("string"))
    j = tot.join(best, "model").join(worst, "model").join(err, "model", "left")
    acc = F.coalesce(safe_div("correct", "total"), F.lit(0.0))
    return j.select("model", F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("Overall Accuracy").alias("metric"), fmt_pct(acc).alias("value")),
        F.struct(F.lit(2).alias("pos"), F.lit("Best Class (recall)").alias("metric"),
                 F.concat(name(F.col("b.i")), F.lit(" ("), fmt_pct(F.col("b.recall")), F.lit(")")).alias("value")),
        F.struct(F.lit(3).alias("pos"), F.lit("Worst Class (recall)").alias("metric"),
                 F.concat(name(F.col("w.i")), F.lit(" ("), fmt_pct(F.col("w.recall")), F.lit(")")).alias("value")),
        F.struct(F.lit(4).alias("pos"), F.lit("Common Error").alias("metric"),
                 F.when(F.col("e.n") > 0, F.concat(name(F.col("e.i")), F.lit(" → "), name(F.col("e.j"))))
                 .otherwise(F.lit("N/A")).alias("value")),
    )).alias("r")).select("model", F.col("r.pos").alias("position"), F.col("r.metric").alias("metric"),
                          F.col("r.value").alias("value"))


def rank_models(results: DataFrame, metric: str = "f1_weighted") -> DataFrame:
    """Add ``rank`` (1 = best) by ``metric`` descending; NaN/NULL last; ties by model name.
    An unknown metric falls back to the second column."""
    if metric not in results.columns:
        metric = results.columns[1] if len(results.columns) > 1 else results.columns[0]
    m = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    w = Window.orderBy(m.desc_nulls_last(), F.col("model"))
    return results.select(F.row_number().over(w).alias("rank"), *results.columns)


def leaderboard(results: DataFrame, metric: str = "f1_weighted", k: int = 10) -> DataFrame:
    """Top-k (rank, model, value text '%.4f' or 'N/A')."""
    r = rank_models(results, metric)
    return r.where(F.col("rank") <= k).select(
        "rank", "model", F.coalesce(fmt_fixed(F.nanvl(F.col(metric), F.lit(None)), 4), F.lit("N/A")).alias(metric))


def metric_melt(results: DataFrame) -> DataFrame:
    """(model, metric, value) for the four headline metrics; NULL -> 0."""
    present = [m for m in METRICS if m in results.columns]
    return (results.select("model", *[F.col(m).cast("double").alias(m) for m in present])
            .unpivot(["model"], present, "metric", "value").na.fill(0.0, ["value"]))


def training_time_order(results: DataFrame) -> DataFrame:
    """Models by training time ascending with their position."""
    w = Window.orderBy(F.col("training_time").asc_nulls_last(), F.col("model"))
    return results.select(F.row_number().over(w).alias("position"), "model", "training_time")
