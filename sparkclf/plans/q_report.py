"""Registered report and explainability queries (and their DuckDB twins)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import quality as Q
from ..operators import report as R
from . import fixtures as fx
from . import zoo as Z
from .catalog import register
from .q_evaluate import RESULTS_SQL, zoo_results
from .q_models import EMB_SPLIT
from .q_profile import W
from .q_quality import DOC, _parts_sql

DOC_NUM = ["doc_id", "n_chars", "quality"]
DOC_CAT = ["text", "lang", "source"]

# -- H1-H3 -------------------------------------------------------------------------------
register("report_overview",
         W(fx.DOC_CLF_SQL, "grp AS (SELECT count(*) AS c FROM doc_clf GROUP BY doc_id, n_chars, text, lang, source, "
           "quality)") +
         "SELECT count(*)::BIGINT AS total_rows, 6::BIGINT AS total_columns, 'quality' AS target_column, "
         "(" + " + ".join(f"count_if({c} IS NULL)" for c in
                          ["doc_id", "n_chars", "text", "lang", "source", "quality"]) + ")::BIGINT AS missing_values, "
         "(SELECT coalesce(sum(c - 1), 0) FROM grp)::BIGINT AS duplicate_rows, "
         "['doc_id', 'n_chars', 'text', 'lang', 'source', 'quality'] AS features FROM doc_clf")(
    lambda spark, d: R.dataset_overview(fx.doc_clf(spark, d), "quality"))

register("report_numeric_stats",
         W(fx.DOC_CLF_SQL) + " UNION ALL ".join(
             f"(SELECT {i} AS position, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, "
             f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, quantile_cont({c}, 0.5) AS median, "
             f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM doc_clf)"
             for i, c in enumerate(DOC_NUM)),
         rnd=("mean", "std", "min", "max", "median", "q25", "q75"))(
    lambda spark, d: R.numeric_stats(fx.doc_clf(spark, d)))

register("report_categorical_stats",
         W(fx.DOC_CLF_SQL) + " UNION ALL ".join(
             f"(SELECT {i} AS position, '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM doc_clf)::BIGINT "
             f"AS unique_values, coalesce(t.v, 'N/A') AS most_common, coalesce(t.f, 0)::BIGINT AS most_common_count "
             f"FROM (SELECT 1) d LEFT JOIN (SELECT {c} AS v, count(*) AS f FROM doc_clf WHERE {c} IS NOT NULL "
             f"GROUP BY {c} ORDER BY f DESC, v LIMIT 1) t ON true)"
             for i, c in enumerate(DOC_CAT)))(
    lambda spark, d: R.categorical_stats(fx.doc_clf(spark, d)))


# -- H4 issue lines ----------------------------------------------------------------------
def _issue_lines_sql(s):
    return (W(*_parts_sql(s)) +
            "SELECT * FROM (SELECT 1 AS position, 'Missing Values: ' || (SELECT count(*) FROM miss) || "
            "' columns affected' AS line WHERE (SELECT count(*) FROM miss) > 0 "
            "UNION ALL SELECT 2, 'Outliers: Detected in ' || (SELECT count(*) FROM outl) || ' columns' "
            "WHERE (SELECT count(*) FROM outl) > 0 "
            "UNION ALL SELECT 3, 'Class Imbalance: Ratio ' || printf('%.2f', (SELECT ratio FROM imb)) "
            "WHERE (SELECT ratio FROM imb) < 0.3 "
            "UNION ALL SELECT 4, 'High Cardinality: ' || (SELECT count(*) FROM card) || ' categorical features' "
            "WHERE (SELECT count(*) FROM card) > 0 "
            "UNION ALL SELECT 5, 'Constant Features: ' || (SELECT count(*) FROM cons) || ' columns' "
            "WHERE (SELECT count(*) FROM cons) > 0 "
            "UNION ALL SELECT 6, 'Duplicate Rows: ' || (SELECT dup_count FROM dup) || ' (' || "
            "printf('%.1f', (SELECT percentage FROM dup)) || '%)' WHERE (SELECT percentage FROM dup) > 1.0 "
            "UNION ALL SELECT 0, 'Health Score: ' || greatest(0, 100 - d_missing - d_outliers - d_imbalance - "
            "d_card - d_const - d_dup) || '/100' FROM ded)")


def _positioned(lines):
    # positions follow the issue kind so both sides agree on which line is which
    kinds = {"Missing": 1, "Outliers": 2, "Class": 3, "High": 4, "Constant": 5, "Duplicate": 6, "Health": 0}
    m = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    return lines.select(F.element_at(m, F.regexp_extract("line", "^([A-Za-z]+)", 1)).alias("position"), "line")


def _issue_lines(spark, d):
    return _positioned(R.issue_lines(Q.detect_all(fx.doc_clf(spark, d), "quality"), spark))


register("report_issue_lines", _issue_lines_sql(DOC))(_issue_lines)
register("report_issue_lines_dirty",
         _issue_lines_sql(dict(cte=fx.ORDERS_DIRTY_SQL, table="orders_dirty",
                               all=["id", "status", "price", "price_text", "priority", "k"], num=["id", "price"],
                               cat=["status", "price_text", "priority", "k"], target="priority")))(
    lambda spark, d: _lines_dirty(spark, d))


def _lines_dirty(spark, d):
    return _positioned(R.issue_lines(Q.detect_all(fx.orders_dirty(spark, d), "priority"), spark))


# -- H7-H10 on the model zoo --------------------------------------------------------------------
register("report_comparison",
         RESULTS_SQL + "SELECT model, round(accuracy, 4) AS accuracy, round(precision_weighted, 4) AS "
         "precision_weighted, round(recall_weighted, 4) AS recall_weighted, round(f1_weighted, 4) AS f1_weighted "
         "FROM results", rnd=("accuracy", "precision_weighted", "recall_weighted", "f1_weighted"))(
    lambda spark, d: R.comparison_table(zoo_results(spark, d)))

BEST_SQL = ("best AS (SELECT arg_max(model, struct_pack(v := f1_weighted, t := -r)) AS model_name, "
            "arg_max(accuracy, struct_pack(v := f1_weighted, t := -r)) AS accuracy, "
            "max(f1_weighted) AS f1_score, "
            "arg_max(precision_weighted, struct_pack(v := f1_weighted, t := -r)) AS precision, "
            "arg_max(recall_weighted, struct_pack(v := f1_weighted, t := -r)) AS recall, "
            "arg_max(model, struct_pack(v := accuracy, t := -r)) AS best_accuracy, "
            "arg_max(model, struct_pack(v := precision_weighted, t := -r)) AS best_precision, "
            "arg_max(model, struct_pack(v := recall_weighted, t := -r)) AS best_recall "
            "FROM (SELECT *, dense_rank() OVER (ORDER BY model) AS r FROM results))")
register("report_best_model", RESULTS_SQL.rstrip() + ", " + BEST_SQL + " SELECT * FROM best",
         rnd=("accuracy", "f1_score", "precision", "recall"))(
    lambda spark, d: R.best_model(zoo_results(spark, d)))

register("report_alternatives",
         RESULTS_SQL.rstrip() + ", " + BEST_SQL +
         " SELECT 1 AS pos, 'Best Accuracy' AS category, left(b.best_accuracy, 30) AS model, "
         "printf('%.4f', round(r.accuracy, 4)) AS score FROM best b JOIN results r ON r.model = b.best_accuracy "
         "UNION ALL SELECT 2, 'Best Precision', left(b.best_precision, 30), printf('%.4f', round(r.precision_weighted, 4)) "
         "FROM best b JOIN results r ON r.model = b.best_precision "
         "UNION ALL SELECT 3, 'Best Recall', left(b.best_recall, 30), printf('%.4f', round(r.recall_weighted, 4)) "
         "FROM best b JOIN results r ON r.model = b.best_recall")(
    lambda spark, d: R.alternatives(zoo_results(spark, d)))

EMB_SPEC = dict(cte="emb AS (SELECT vec_id, embedding, label FROM embeddings)", table="emb",
                all=["vec_id", "embedding", "label"], num=["vec_id", "label"], cat=[], target="label")


def _emb_parts():
    parts = _parts_sql(EMB_SPEC)
    # no categorical columns: the high-cardinality CTE is empty
    return [p if not p.startswith("card AS") else
            "card AS (SELECT NULL::VARCHAR AS col, 0 AS u WHERE false)" for p in parts]


def _executive(spark, d):
    emb = fx.emb_clf(spark, d)
    rep = Q.detect_all(emb, "label")
    return R.executive_summary(zoo_results(spark, d), R.dataset_overview(emb, "label"), rep.score)


register("report_executive",
         RESULTS_SQL.rstrip() + ", " + ", ".join(_emb_parts()) +
         " SELECT (SELECT count(*) FROM results)::BIGINT AS n_models, (SELECT count(*) FROM emb)::BIGINT AS "
         "total_rows, 3::BIGINT AS total_columns, 'label' AS target_column, (SELECT max(accuracy) FROM results) "
         "AS best_accuracy, (SELECT avg(accuracy) FROM results) AS mean_accuracy, greatest(0, 100 - d_missing - "
         "d_outliers - d_imbalance - d_card - d_const - d_dup)::INTEGER AS health_score FROM ded",
         rnd=("best_accuracy", "mean_accuracy"))(_executive)


def _sections(spark, d):
    res = zoo_results(spark, d)
    comp = R.comparison_table(res)
    num = R.numeric_stats(fx.doc_clf(spark, d)).drop("position")
    fmt = lambda df: df.select(*[F.format_string("%.6f", F.round(F.col(c), 6)).alias(c)
                                 if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])
    return R.report_sections({"comparison": fmt(comp), "numeric_features": fmt(num)})


def _sections_sql():
    comp = ("SELECT 'comparison' AS section, model AS item, metric, printf('%.6f', round(value, 6)) AS value FROM "
            "(UNPIVOT (SELECT model, round(accuracy, 4) AS accuracy, round(precision_weighted, 4) AS precision_weighted, "
            "round(recall_weighted, 4) AS recall_weighted, round(f1_weighted, 4) AS f1_weighted FROM results) "
            "ON accuracy, precision_weighted, recall_weighted, f1_weighted INTO NAME metric VALUE value)")
    nums = " UNION ALL ".join(
        f"SELECT 'numeric_features', '{c}', m, printf('%.6f', round(v, 6)) FROM (SELECT unnest(['mean', 'std', 'min', "
        f"'max', 'median', 'q25', 'q75']) AS m, unnest([avg({c}), stddev_samp({c}), min({c})::DOUBLE, "
        f"max({c})::DOUBLE, quantile_cont({c}, 0.5), quantile_cont({c}, 0.25), quantile_cont({c}, 0.75)]) AS v "
        f"FROM doc_clf)" for c in DOC_NUM)
    return RESULTS_SQL.rstrip() + ", " + fx.DOC_CLF_SQL + f" {comp} UNION ALL {nums}"


register("report_sections", _sections_sql())(_sections)


# -- G: explainability ------------------------------------------------------------------------
def _coef_long(spark, d):
    s = Z.emb_split(spark, d).where("split = 'train'")
    ex = s.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))
    return ex.groupBy(F.col("label").alias("class"), F.concat(F.lit("x"), F.col("j")).alias("feature")).agg(
        F.avg("x").alias("coef"))


COEF_SQL = (W(EMB_SPLIT, "ex AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, "
              "len(embedding) - 1)) AS j FROM splitted WHERE split = 'train')",
              "coef AS (SELECT label AS class, 'x' || j AS feature, avg(x) AS coef FROM ex GROUP BY ALL)",
              "imp AS (SELECT feature, avg(abs(coef)) AS importance FROM coef GROUP BY feature)"))
register("explain_coefficients", COEF_SQL + "SELECT * FROM imp", rnd=("importance",))(
    lambda spark, d: X.linear_importance_long(_coef_long(spark, d)))
register("explain_top_features",
         COEF_SQL + "SELECT 'class means' AS model, feature, importance, rank FROM (SELECT *, row_number() OVER "
         "(ORDER BY importance DESC, feature)::INTEGER AS rank FROM imp) WHERE rank <= 20", rnd=("importance",))(
    lambda spark, d: X.top_features(X.linear_importance_long(_coef_long(spark, d))
                                    .withColumn("model", F.lit("class means")), 20)
    .select("model", "feature", "importance", "rank"))
