"""Registered training queries.

Naive Bayes, KNN and the baseline have DuckDB twins that rebuild folds, fits, votes and
scores; the other fits are iterative (rows-only checks, and tests of their solvers).

One query per model and search type trains only that model, with all its candidates
and all five folds; the queries over all models train each of them once per Spark
application and data folder.  Input: the prepared documents table (documents x labels ->
dedupe, median imputation, IQR capping, stratified split, one-hot, standard scaling).
"""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..models import search as SM
from ..operators import explain as X
from ..operators import metrics as M
from ..operators import report as R
from ..session import cut_lineage
from .catalog import register
from .q_prepare import _FULL_FEATS, _FULL_SQL, _full, folds_sql
from .training import assemble, run_training

_RUNS: dict = {}
MODELS = {"lr": SM.LR, "knn": SM.KNN, "dt": SM.DT, "nb": SM.NB, "rf": SM.RF, "svm": SM.SVM, "baseline": SM.BASE}


def _once(spark, d, what, make):
    """Within one Spark application, the same input is prepared or trained once."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _RUNS:
        _RUNS[key] = make()
    return _RUNS[key]


def training_run(spark, d, search="grid"):
    def make():
        p = _full(spark, d)
        return (p, *run_training(p.data, p.features, "doc_id", "quality", search=search))
    return _once(spark, d, search, make)


def candidate_rows(spark, results) -> "DataFrame":  # noqa: F821
    """(model, candidate, params, mean_score, best): every candidate's mean fold score."""
    rows = []
    for r in results:
        for i, (c, s) in enumerate(zip(r.candidates, r.scores)):
            rows.append((r.model, i, json.dumps(c, sort_keys=True), float(s), c is r.best_params))
        if not r.candidates:      # the baseline has nothing to tune
            rows.append((r.model, 0, "{}", None, True))
    return spark.createDataFrame(rows, "model string, candidate int, params string, mean_score double, best boolean").withColumn(
        "mean_score", F.round("mean_score", 6))


def _one(name, search, primary="f1_weighted"):
    def fn(spark, d):
        def make():
            p = _full(spark, d)
            return cut_lineage(assemble(p.data, p.features, "doc_id", "quality")).where("split = 'train'")
        train = _once(spark, d, "train", make)
        return candidate_rows(spark, [SM.search_model(name, train, "features", "doc_id", "quality", search, primary)])
    return fn


# -- twins: folds, fits and scores in SQL ---------------------------------------------------------------
def _candidates(name, search):
    space = (SM.param_grids() if search == "grid" else SM.param_distributions())[name]
    return SM.grid_candidates(space) if search == "grid" else SM.sample_candidates(space, 20, 42)


def _cand_sql(cands, *keys):
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)
    rows = ", ".join(f"({i}, '{json.dumps(c, sort_keys=True)}', {', '.join(lit(c[k]) for k in keys)})" for i, c in enumerate(cands))
    return f"cand AS (SELECT * FROM (VALUES {rows}) AS t(candidate, params, {', '.join(keys)}))"


_TRAIN_CTES = [
    f"prepared AS ({_FULL_SQL})",
    "splitted2 AS (SELECT doc_id, quality, split FROM prepared)",
    f"folded AS ({folds_sql().replace('FROM splitted ', 'FROM splitted2 ')})",
    "x AS (SELECT f.doc_id, f.quality, f.fold, u.j, u.v FROM folded f JOIN (UNPIVOT (SELECT doc_id, "
    + ", ".join(f"{c}::DOUBLE AS {c}" for c in _FULL_FEATS) + " FROM prepared) ON " + ", ".join(_FULL_FEATS)
    + " INTO NAME j VALUE v) u ON u.doc_id = f.doc_id)",
    "fo AS (SELECT DISTINCT fold AS f FROM folded)",
]
# preds(candidate, f, y, p) -> one row per candidate; the score is the mean over folds.
_SCORE_CTES = {
    "f1_weighted": [
        "cl AS (SELECT candidate, f, l, sum(t)::BIGINT AS sup, sum(q)::BIGINT AS prd, sum(h)::BIGINT AS tp FROM ("
        "SELECT candidate, f, y AS l, 1 AS t, 0 AS q, (y = p)::INT AS h FROM preds UNION ALL "
        "SELECT candidate, f, p, 0, 1, 0 FROM preds) GROUP BY ALL)",
        "per AS (SELECT candidate, f, sum(sup * (2.0::DOUBLE * tp / (sup + prd))) / sum(sup) AS s FROM cl GROUP BY ALL)"],
    "accuracy": ["per AS (SELECT candidate, f, avg((y = p)::INT) AS s FROM preds GROUP BY ALL)"],
}


def _score_sql(model, ctes, primary):
    from .q_profile import W
    mean = ["mean AS (SELECT candidate, avg(s) AS m FROM per GROUP BY candidate)",
            "top AS (SELECT min(candidate) AS b FROM mean WHERE round(m, 12) = (SELECT max(round(m, 12)) FROM mean))"]
    return (W(*_TRAIN_CTES, *ctes, *_SCORE_CTES[primary], *mean) +
            f"SELECT '{model}' AS model, candidate, params, round(m, 6) AS mean_score, candidate = b AS best "
            "FROM mean JOIN cand USING (candidate), top")


def _nb_sql(search, primary="f1_weighted"):
    return _score_sql(SM.NB, [
        _cand_sql(_candidates(SM.NB, search), "var_smoothing"),
        "st AS (SELECT f, quality, j, avg(v) AS mu, var_pop(v) AS va, count(*) AS n FROM fo JOIN x ON x.fold <> f GROUP BY ALL)",
        "mx AS (SELECT f, max(va) AS va FROM (SELECT f, j, var_pop(v) AS va FROM fo JOIN x ON x.fold <> f GROUP BY ALL) GROUP BY f)",
        "ll AS (SELECT candidate, st.f, x.doc_id, x.quality AS y, st.quality AS c, ln(any_value(st.n)) "
        "- 0.5 * sum(ln(2 * pi() * (st.va + var_smoothing * mx.va)) + (v - mu) * (v - mu) / (st.va + var_smoothing * mx.va)) AS s "
        "FROM x JOIN st ON st.f = x.fold AND st.j = x.j JOIN mx ON mx.f = st.f, cand GROUP BY ALL)",
        "preds AS (SELECT candidate, f, y, arg_max(c, struct_pack(a := s, b := -c)) AS p FROM ll GROUP BY candidate, f, doc_id, y)"],
        primary)


def _knn_sql(search, primary="f1_weighted"):
    return _score_sql(SM.KNN, [
        _cand_sql(_candidates(SM.KNN, search), "n_neighbors", "weights", "metric"),
        "d AS (SELECT q.fold AS f, q.doc_id AS qid, q.quality AS y, t.doc_id AS tid, t.quality AS c, sqrt(sum((q.v - t.v) * (q.v - t.v))) AS e, "
        "sum(abs(q.v - t.v)) AS m FROM x q JOIN x t ON q.j = t.j AND q.fold <> t.fold GROUP BY ALL)",
        "dm AS (SELECT f, qid, y, tid, c, 'euclidean' AS metric, e AS dist FROM d UNION ALL SELECT f, qid, y, tid, c, 'manhattan', m FROM d)",
        "nn AS (SELECT *, row_number() OVER (PARTITION BY metric, qid ORDER BY round(dist, 10), tid) AS r FROM dm)",
        "w AS (SELECT candidate, f, qid, y, c, CASE WHEN weights = 'uniform' THEN 1.0 WHEN min(dist) OVER o = 0 "
        "THEN (dist = 0)::INT ELSE 1 / dist END AS w FROM nn JOIN cand USING (metric) WHERE r <= n_neighbors "
        "WINDOW o AS (PARTITION BY candidate, qid))",
        "preds AS (SELECT candidate, f, y, arg_max(c, struct_pack(a := round(s, 10), b := -c)) AS p "
        "FROM (SELECT candidate, f, qid, y, c, sum(w) AS s FROM w GROUP BY ALL) GROUP BY candidate, f, qid, y)"], primary)


_TWINS = {("nb", "grid"): _nb_sql("grid"), ("nb", "random"): _nb_sql("random"), ("knn", "grid"): _knn_sql("grid"),
          ("knn", "random"): _knn_sql("random"),
          ("baseline", "grid"): f"SELECT '{SM.BASE}' AS model, 0 AS candidate, '{{}}' AS params, NULL::DOUBLE AS mean_score, true AS best"}

for _key, _name in MODELS.items():
    register(f"train_grid_{_key}", _TWINS.get((_key, "grid")))(_one(_name, "grid"))
    if _name != SM.BASE:
        register(f"train_random_{_key}", _TWINS.get((_key, "random")))(_one(_name, "random"))

register("train_accuracy_nb", _nb_sql("grid", "accuracy"))(_one(SM.NB, "grid", "accuracy"))
register("train_accuracy_knn", _knn_sql("grid", "accuracy"))(_one(SM.KNN, "grid", "accuracy"))

register("train_cv_results")(lambda spark, d: training_run(spark, d)[2])
register("train_cv_table")(lambda spark, d: SM.cv_table(training_run(spark, d)[2]))
register("train_evaluation")(lambda spark, d: training_run(spark, d)[3])
register("train_predictions")(lambda spark, d: training_run(spark, d)[4].select(
    "model", "id", "y_true", "y_pred", "scores"))
register("train_rank")(lambda spark, d: M.rank_models(training_run(spark, d)[3], "f1_weighted"))
register("train_time_order")(lambda spark, d: M.training_time_order(training_run(spark, d)[3]))
register("train_comparison")(lambda spark, d: R.comparison_table(training_run(spark, d)[3]))
register("train_model_configurations")(lambda spark, d: R.model_configurations(
    {n: r.best_params for n, r in training_run(spark, d)[1].items()}, spark))
register("train_best_model")(lambda spark, d: R.best_model(training_run(spark, d)[3]))


def _explain(spark, d):
    p, res, _, _, _ = training_run(spark, d)
    imp, _ = X.explainability(spark, {n: r.fitted for n, r in res.items()}, p.features)
    return X.top_features(imp, 20)


def _flags(spark, d):
    p, res, _, _, _ = training_run(spark, d)
    return X.explainability(spark, {n: r.fitted for n, r in res.items()}, p.features)[1]


register("train_feature_importance")(_explain)
register("train_explainability_flags")(_flags)
register("train_cv_results_random")(lambda spark, d: training_run(spark, d, "random")[2])
register("train_candidate_scores")(lambda spark, d: candidate_rows(
    spark, [r for r in training_run(spark, d)[1].values() if r.candidates]).drop("best"))

# -- result tables of the orders: one "model" per priority, so that their rows can be checked by value ---------
_ORDER_RESULTS = ("res AS (SELECT o_orderpriority AS model, avg((o_orderstatus = 'F')::INT) AS best_score, '{}' AS best_params, "
                  "CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE avg(o_totalprice) / 1000 END AS training_time, 'grid' AS search_type "
                  "FROM orders GROUP BY 1)")


def _order_results(spark, d):
    from ..sources import read_table
    g = read_table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"))
    r = g.agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("best_score"), F.avg("o_totalprice").alias("p"))
    return r.select("model", "best_score", F.lit("{}").alias("best_params"),
                    F.when(~F.col("model").startswith("5"), F.col("p") / 1000).alias("training_time"), F.lit("grid").alias("search_type"))


register("time_order_orders", f"WITH {_ORDER_RESULTS} SELECT row_number() OVER (ORDER BY training_time NULLS LAST, model)::INTEGER "
         "AS position, model, training_time FROM res", rnd=("training_time",))(
    lambda spark, d: M.training_time_order(_order_results(spark, d)))
register("cv_table_orders", f"WITH {_ORDER_RESULTS} SELECT model, round(best_score, 4) AS best_score, best_params, "
         "round(training_time, 3) AS training_time, search_type FROM res")(lambda spark, d: SM.cv_table(_order_results(spark, d)))
