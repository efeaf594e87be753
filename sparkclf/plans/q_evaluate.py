"""Registered evaluation / ranking queries and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import fixtures as fx
from . import zoo as Z
from .catalog import register
from .q_models import ZOO_CTES
from .q_profile import W

METRIC_CTES = [
    "cm AS (SELECT model, y_true, y_pred, count(*) AS n FROM preds WHERE y_true IS NOT NULL GROUP BY ALL)",
    "sup AS (SELECT model, y_true AS label, sum(n) AS support FROM cm GROUP BY ALL)",
    "prd AS (SELECT model, y_pred AS label, sum(n) AS predicted FROM cm GROUP BY ALL)",
    "tpt AS (SELECT model, y_true AS label, n AS tp FROM cm WHERE y_true = y_pred)",
    "per AS (SELECT coalesce(s.model, p.model) AS model, coalesce(s.label, p.label) AS label, "
    "coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted FROM sup s "
    "FULL OUTER JOIN prd p ON s.model = p.model AND s.label = p.label)",
    "per2 AS (SELECT per.*, coalesce(t.tp, 0) AS tp FROM per LEFT JOIN tpt t ON t.model = per.model "
    "AND t.label = per.label)",
    "mets AS (SELECT model, sum(tp) / sum(support) AS accuracy, "
    "sum(support * coalesce(tp / nullif(predicted, 0), 0)) / sum(support) AS precision_weighted, "
    "sum(support * coalesce(tp / nullif(support, 0), 0)) / sum(support) AS recall_weighted, "
    "sum(support * coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) / sum(support) AS f1_weighted "
    "FROM per2 GROUP BY model)",
]
AUC_CTES = [
    "ycls AS (SELECT model, count(DISTINCT y_true) AS nc FROM preds WHERE y_true IS NOT NULL GROUP BY model)",
    "nsc AS (SELECT model, count(DISTINCT class) AS ns FROM proba GROUP BY model)",
    "arows AS (SELECT p.model, pr.class, p.y_true = pr.class AS is_pos, pr.proba AS s FROM preds p "
    "JOIN proba pr ON p.model = pr.model AND p.id = pr.id JOIN ycls ON ycls.model = p.model "
    "JOIN nsc ON nsc.model = p.model WHERE ycls.nc > 2 AND ycls.nc = nsc.ns AND p.y_true IS NOT NULL)",
    "ah AS (SELECT model, class, s, count_if(is_pos) AS pos, count_if(NOT is_pos) AS neg FROM arows GROUP BY ALL)",
    "ac AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, class ORDER BY s "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ah)",
    "aa AS (SELECT model, class, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc, "
    "sum(pos) AS P FROM ac GROUP BY ALL)",
    "aucs AS (SELECT model, CASE WHEN count_if(auc IS NULL) = 0 THEN sum(auc * P) / sum(P) END AS roc_auc "
    "FROM aa GROUP BY model)",
    "results AS (SELECT m.model, m.accuracy, m.precision_weighted, m.recall_weighted, m.f1_weighted, a.roc_auc "
    "FROM mets m LEFT JOIN aucs a ON a.model = m.model)",
]
RESULTS_SQL = W(*ZOO_CTES, *METRIC_CTES, *AUC_CTES)
RCOLS = ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc")


def zoo_results(spark, d):
    return M.evaluate_all(Z.zoo_predictions(spark, d))


register("eval_all_models", RESULTS_SQL + "SELECT * FROM results", rnd=RCOLS)(zoo_results)

register("eval_multiclass_auc", RESULTS_SQL + "SELECT model, roc_auc FROM results", rnd=("roc_auc",))(
    lambda spark, d: M.roc_auc(Z.zoo_predictions(spark, d)))

# -- binary predictions over labels -----------------------------------------------------------------
BIN_PREDS = ("preds AS (SELECT 'score' AS model, doc_id AS id, y_true, y_pred, score FROM preds_bin)")


def _bin_preds(spark, d):
    p = fx.preds_bin(spark, d)
    return p.select(F.lit("score").alias("model"), F.col("doc_id").alias("id"), "y_true", "y_pred",
                    F.array(1.0 - F.col("score"), F.col("score")).alias("scores"))


register("eval_binary",
         W(fx.PREDS_BIN_SQL, BIN_PREDS, *METRIC_CTES,
           "bh AS (SELECT score AS s, count_if(y_true = (SELECT max(y_true) FROM preds)) AS pos, "
           "count_if(y_true <> (SELECT max(y_true) FROM preds)) AS neg FROM preds GROUP BY score)",
           "bc AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
           "AS below FROM bh)",
           "bauc AS (SELECT sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM bc)") +
         "SELECT m.*, (SELECT roc_auc FROM bauc) AS roc_auc FROM mets m", rnd=RCOLS)(
    lambda spark, d: M.evaluate_all(_bin_preds(spark, d)))

# -- confusion matrices -------------------------------------------------------------------------------
CONF_CTES = [
    "labs AS (SELECT model, l, (row_number() OVER (PARTITION BY model ORDER BY l) - 1)::INTEGER AS idx FROM "
    "(SELECT DISTINCT model, y_true AS l FROM preds WHERE y_true IS NOT NULL UNION "
    "SELECT DISTINCT model, y_pred FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL))",
    "cml AS (SELECT a.model, a.idx AS i, b.idx AS j, a.l AS y_true, b.l AS y_pred, coalesce(cm.n, 0)::BIGINT AS n "
    "FROM labs a JOIN labs b ON a.model = b.model LEFT JOIN cm ON cm.model = a.model AND cm.y_true = a.l "
    "AND cm.y_pred = b.l)",
]
MULTI_PREDS = "preds AS (SELECT 'rule' AS model, id, y_true, y_pred FROM preds_multi)"


def _multi(spark, d):
    return fx.preds_multi(spark, d).select(F.lit("rule").alias("model"), "id", "y_true", "y_pred")


register("eval_confusion", W(fx.PREDS_MULTI_SQL, MULTI_PREDS, METRIC_CTES[0], *CONF_CTES) + "SELECT * FROM cml")(
    lambda spark, d: M.confusion_matrix(_multi(spark, d)))
register("eval_metrics_multi", W(fx.PREDS_MULTI_SQL, MULTI_PREDS, *METRIC_CTES) + "SELECT * FROM mets",
         rnd=RCOLS[:4])(lambda spark, d: M.classification_metrics(_multi(spark, d)))
register("eval_confusion_zoo", RESULTS_SQL.rstrip() + ", " + ", ".join(CONF_CTES) + " SELECT * FROM cml")(
    lambda spark, d: M.confusion_matrix(Z.zoo_predictions(spark, d)))


def _insights_sql():
    pct = "printf('%.1f%%', round({x} * 100, 1))"
    return (
        ", ".join([
            "rec AS (SELECT model, i, coalesce(sum(CASE WHEN i = j THEN n ELSE 0 END) / nullif(sum(n), 0), 0.0) AS recall "
            "FROM cml GROUP BY model, i)",
            "itot AS (SELECT model, sum(n) AS total, sum(CASE WHEN i = j THEN n ELSE 0 END) AS correct FROM cml GROUP BY model)",
            "bw AS (SELECT model, arg_max(i, struct_pack(r := recall, k := -i)) AS bi, max(recall) AS br, "
            "arg_min(i, struct_pack(r := recall, k := -i)) AS wi, min(recall) AS wr FROM rec GROUP BY model)",
            "er AS (SELECT model, arg_max(struct_pack(i := i, j := j, n := n), struct_pack(n := n, a := -i, b := -j)) AS e "
            "FROM cml WHERE i <> j GROUP BY model)",
        ]) +
        " SELECT t.model, 1 AS position, 'Overall Accuracy' AS metric, " +
        pct.format(x="coalesce(correct / nullif(total, 0), 0.0)") + " AS value FROM itot t "
        "UNION ALL SELECT model, 2, 'Best Class (recall)', 'Class ' || bi || ' (' || " + pct.format(x="br") + " || ')' FROM bw "
        "UNION ALL SELECT model, 3, 'Worst Class (recall)', 'Class ' || wi || ' (' || " + pct.format(x="wr") + " || ')' FROM bw "
        "UNION ALL SELECT t.model, 4, 'Common Error', CASE WHEN er.e.n > 0 THEN 'Class ' || er.e.i || ' → Class ' || er.e.j "
        "ELSE 'N/A' END FROM itot t LEFT JOIN er ON er.model = t.model")


register("eval_confusion_insights",
         RESULTS_SQL.rstrip() + ", " + ", ".join(CONF_CTES) + ", " + _insights_sql())(
    lambda spark, d: M.confusion_insights(M.confusion_matrix(Z.zoo_predictions(spark, d))))
register("eval_confusion_insights_rule",
         W(fx.PREDS_MULTI_SQL, MULTI_PREDS, METRIC_CTES[0], *CONF_CTES).rstrip() + ", " + _insights_sql())(
    lambda spark, d: M.confusion_insights(M.confusion_matrix(_multi(spark, d))))

# -- ranking, leaderboard, melt ---------------------------------------------------------------------
register("rank_models",
         RESULTS_SQL + "SELECT (row_number() OVER (ORDER BY f1_weighted DESC NULLS LAST, model))::INTEGER AS rank, * FROM results",
         rnd=RCOLS)(lambda spark, d: M.rank_models(zoo_results(spark, d), "f1_weighted"))
register("rank_models_by_auc",
         RESULTS_SQL + "SELECT (row_number() OVER (ORDER BY roc_auc DESC NULLS LAST, model))::INTEGER AS rank, * FROM results",
         rnd=RCOLS)(lambda spark, d: M.rank_models(zoo_results(spark, d), "roc_auc"))


def _board_sql(k, metric="f1_weighted"):
    return (RESULTS_SQL + f"SELECT rank, model, coalesce(printf('%.4f', round({metric}, 4)), 'N/A') AS {metric} "
            f"FROM (SELECT (row_number() OVER (ORDER BY {metric} DESC NULLS LAST, model))::INTEGER AS rank, * FROM results) "
            f"WHERE rank <= {k}")


register("leaderboard_top10", _board_sql(10))(lambda spark, d: M.leaderboard(zoo_results(spark, d), k=10))
register("leaderboard_top3", _board_sql(3))(lambda spark, d: M.leaderboard(zoo_results(spark, d), k=3))
register("metric_melt",
         RESULTS_SQL + "SELECT model, metric, coalesce(value, 0.0) AS value FROM "
         "(UNPIVOT (SELECT model, accuracy, f1_weighted, precision_weighted, recall_weighted FROM results) "
         "ON accuracy, f1_weighted, precision_weighted, recall_weighted INTO NAME metric VALUE value)",
         rnd=("value",))(lambda spark, d: M.metric_melt(zoo_results(spark, d)))
