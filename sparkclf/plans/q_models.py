"""Registered model queries (prior baseline, Gaussian NB, exact KNN) and twins."""
from __future__ import annotations

from . import zoo as Z
from .catalog import register
from .q_prepare import split_sql
from .q_profile import W

EMB_SPLIT = split_sql("embeddings", "vec_id", "label", ["vec_id", "embedding", "label"])
EX = ("ex AS (SELECT vec_id, label, split, unnest(embedding)::DOUBLE AS x, "
      "unnest(generate_series(0, len(embedding) - 1)) AS j FROM splitted)")
TRAIN_CC = "cc AS (SELECT label, count(*) AS n FROM splitted WHERE split = 'train' GROUP BY label)"

PRIOR_PRED = (
    "prior_pred AS (SELECT '" + Z.BASELINE + "' AS model, t.vec_id AS id, t.label AS y_true, "
    "(SELECT label FROM cb WHERE t.h::HUGEINT * cb.tot < cb.cum::HUGEINT * 4294967296 ORDER BY label LIMIT 1) "
    "AS y_pred FROM (SELECT vec_id, label, ('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT "
    "AS h FROM splitted WHERE split = 'test') t)")
PRIOR_CTES = [TRAIN_CC, "cb AS (SELECT label, sum(n) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) AS cum, "
              "sum(n) OVER () AS tot FROM cc)", PRIOR_PRED]

GNB_CTES = [
    EX,
    "st AS (SELECT label, j, avg(x) AS mu, var_pop(x) AS v FROM ex WHERE split = 'train' GROUP BY ALL)",
    "eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT j, var_pop(x) AS v FROM ex WHERE split = 'train' GROUP BY j))",
    TRAIN_CC,
    "pri AS (SELECT label, n / sum(n) OVER () AS p FROM cc)",
    "jll AS (SELECT t.vec_id, st.label, ln(any_value(pri.p)) - 0.5 * sum(ln(2 * pi() * (st.v + eps.e))) "
    "- 0.5 * sum((t.x - st.mu) * (t.x - st.mu) / (st.v + eps.e)) AS jll FROM ex t JOIN st ON t.j = st.j "
    "JOIN pri ON pri.label = st.label CROSS JOIN eps WHERE t.split = 'test' GROUP BY t.vec_id, st.label)",
    "jexp AS (SELECT vec_id, label, exp(jll - max(jll) OVER (PARTITION BY vec_id)) AS e FROM jll)",
    "gnb_proba AS (SELECT '" + Z.NB + "' AS model, vec_id AS id, label AS class, "
    "e / sum(e) OVER (PARTITION BY vec_id) AS proba FROM jexp)",
    "gnb_pred AS (SELECT '" + Z.NB + "' AS model, j.vec_id AS id, s.label AS y_true, arg_max(j.label, "
    "struct_pack(a := j.jll, b := -j.label)) AS y_pred FROM jll j JOIN splitted s ON s.vec_id = j.vec_id "
    "GROUP BY j.vec_id, s.label)",
]


def knn_ctes(name, k, metric, weights, prefix):
    dist = ("sqrt(sum((q.x - t.x) * (q.x - t.x)))" if metric == "euclidean" else "sum(abs(q.x - t.x))")
    w = ("1.0" if weights == "uniform" else
         "CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) = 1 "
         "THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / dist END")
    return [
        f"{prefix}_d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, any_value(t.label) AS label, {dist} AS dist "
        "FROM ex q JOIN ex t ON q.j = t.j WHERE q.split = 'test' AND t.split = 'train' GROUP BY q.vec_id, t.vec_id)",
        f"{prefix}_nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS r "
        f"FROM {prefix}_d) WHERE r <= {k})",
        f"{prefix}_v AS (SELECT qid, label, sum(w) AS w FROM (SELECT qid, label, {w} AS w FROM {prefix}_nn) "
        "GROUP BY qid, label)",
        f"{prefix}_proba AS (SELECT '{name}' AS model, q.qid AS id, c.label AS class, "
        f"coalesce(v.w, 0.0) / sum(coalesce(v.w, 0.0)) OVER (PARTITION BY q.qid) AS proba "
        f"FROM (SELECT DISTINCT qid FROM {prefix}_nn) q CROSS JOIN cc c "
        f"LEFT JOIN {prefix}_v v ON v.qid = q.qid AND v.label = c.label)",
        f"{prefix}_pred AS (SELECT '{name}' AS model, p.id, s.label AS y_true, "
        "arg_max(p.class, struct_pack(a := p.proba, b := -p.class)) AS y_pred "
        f"FROM {prefix}_proba p JOIN splitted s ON s.vec_id = p.id GROUP BY p.id, s.label)",
    ]


KNN_CTES = knn_ctes(Z.KNN, 5, "euclidean", "uniform", "knn")
KNN_DM_CTES = knn_ctes(Z.KNN_DM, 7, "manhattan", "distance", "knd")


def _preds(models):
    def fn(spark, d):
        return Z.zoo_predictions(spark, d, models).select("model", "id", "y_true", "y_pred")
    return fn


def _proba(models):
    def fn(spark, d):
        p = Z.zoo_predictions(spark, d, models)
        return Z.proba_long(p, Z.fx.emb_clf(spark, d))
    return fn


register("model_prior_baseline", W(EMB_SPLIT, *PRIOR_CTES) + "SELECT * FROM prior_pred")(_preds((Z.BASELINE,)))
register("model_gnb", W(EMB_SPLIT, *GNB_CTES) + "SELECT * FROM gnb_pred")(_preds((Z.NB,)))
register("model_gnb_proba", W(EMB_SPLIT, *GNB_CTES) + "SELECT * FROM gnb_proba", rnd=("proba",))(_proba((Z.NB,)))
register("model_knn", W(EMB_SPLIT, EX, TRAIN_CC, *KNN_CTES) + "SELECT * FROM knn_pred")(_preds((Z.KNN,)))
register("model_knn_proba", W(EMB_SPLIT, EX, TRAIN_CC, *KNN_CTES) + "SELECT * FROM knn_proba",
         rnd=("proba",))(_proba((Z.KNN,)))
register("model_knn_distance_manhattan", W(EMB_SPLIT, EX, TRAIN_CC, *KNN_DM_CTES) + "SELECT * FROM knd_pred")(
    _preds((Z.KNN_DM,)))

ZOO_CTES = [EMB_SPLIT, *GNB_CTES, *PRIOR_CTES[1:], *KNN_CTES, *KNN_DM_CTES,
            "preds AS (SELECT * FROM prior_pred UNION ALL SELECT * FROM gnb_pred UNION ALL SELECT * FROM knn_pred "
            "UNION ALL SELECT * FROM knd_pred)",
            "proba AS (SELECT p.model, p.id, c.label AS class, CASE WHEN p.y_pred = c.label THEN 1.0 ELSE 0.0 END "
            "AS proba FROM prior_pred p CROSS JOIN cc c UNION ALL SELECT * FROM gnb_proba UNION ALL "
            "SELECT * FROM knn_proba UNION ALL SELECT * FROM knd_proba)"]
