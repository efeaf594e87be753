"""Registered issue-detection queries and their DuckDB twins."""
from __future__ import annotations

from ..operators import quality as Q
from . import fixtures as fx
from .catalog import register
from .q_profile import DIRTY_ALL, DOC_ALL, W, _iqr_sql, union

DOC = dict(cte=fx.DOC_CLF_SQL, table="doc_clf", all=DOC_ALL, num=["doc_id", "n_chars", "quality"],
           cat=["text", "lang", "source"], target="quality")
DIRTY = dict(cte=fx.ORDERS_DIRTY_SQL, table="orders_dirty", all=DIRTY_ALL, num=["id", "price"],
             cat=["status", "price_text", "priority", "k"], target="priority")


def _parts_sql(s):
    """CTEs computing the six detector summaries for spec ``s``."""
    t = s["table"]
    miss = union(f"SELECT '{c}' AS col, 100.0 * count_if({c} IS NULL) / count(*) AS pct FROM {t}"
                 for c in s["all"])
    const = union(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS u FROM {t}" for c in s["all"])
    card = union(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS u FROM {t}" for c in s["cat"])
    return [
        s["cte"],
        f"miss AS (SELECT * FROM ({miss}) WHERE pct > 0)",
        f"outl AS (SELECT * FROM ({_iqr_sql(t, s['num'])}) WHERE percentage > 5.0)",
        f"cls AS (SELECT CAST({s['target']} AS VARCHAR) AS class, count(*) AS n FROM {t} GROUP BY 1)",
        "imb AS (SELECT count(*) AS n_classes, min(n) AS min_count, max(n) AS max_count, "
        "coalesce(min(n) / nullif(max(n), 0), 1.0) AS ratio FROM cls)",
        f"card AS (SELECT * FROM ({card}) WHERE u > 50)",
        f"cons AS (SELECT * FROM ({const}) WHERE u <= 1)",
        f"grp AS (SELECT count(*) AS c FROM {t} GROUP BY ALL_COLS)".replace("ALL_COLS", ", ".join(s["all"])),
        "dup AS (SELECT coalesce(sum(c - 1), 0) AS dup_count, coalesce(100.0 * sum(c - 1) / "
        "nullif(sum(c), 0), 0.0) AS percentage FROM grp)",
        "ded AS (SELECT "
        "CASE WHEN (SELECT count(*) FROM miss) > 0 THEN least((SELECT count(*) FROM miss) * 5, 25) ELSE 0 END AS d_missing, "
        "CASE WHEN (SELECT count(*) FROM outl) > 0 THEN least((SELECT count(*) FROM outl) * 3, 15) ELSE 0 END AS d_outliers, "
        "CASE WHEN (SELECT ratio FROM imb) < 0.3 THEN CASE WHEN (SELECT ratio FROM imb) < 0.1 THEN 20 "
        "WHEN (SELECT ratio FROM imb) < 0.2 THEN 15 ELSE 10 END ELSE 0 END AS d_imbalance, "
        "CASE WHEN (SELECT count(*) FROM card) > 0 THEN least((SELECT count(*) FROM card) * 5, 15) ELSE 0 END AS d_card, "
        "CASE WHEN (SELECT count(*) FROM cons) > 0 THEN least((SELECT count(*) FROM cons) * 3, 10) ELSE 0 END AS d_const, "
        "CASE WHEN (SELECT percentage FROM dup) > 1.0 THEN CASE WHEN (SELECT percentage FROM dup) > 10 THEN 15 "
        "WHEN (SELECT percentage FROM dup) > 5 THEN 10 ELSE 5 END ELSE 0 END AS d_dup)",
    ]


def _score_sql(s):
    return (W(*_parts_sql(s)) +
            "SELECT greatest(0, 100 - d_missing - d_outliers - d_imbalance - d_card - d_const - d_dup)::INTEGER "
            "AS health_score, (-d_missing)::INTEGER AS missing_values, (-d_outliers)::INTEGER AS outliers, "
            "(-d_imbalance)::INTEGER AS class_imbalance, (-d_card)::INTEGER AS high_cardinality, "
            "(-d_const)::INTEGER AS constant_features, (-d_dup)::INTEGER AS duplicates FROM ded")


register("issues_health_score", _score_sql(DOC))(
    lambda spark, d: Q.health_score(fx.doc_clf(spark, d), "quality"))
register("issues_health_score_dirty", _score_sql(DIRTY))(
    lambda spark, d: Q.health_score(fx.orders_dirty(spark, d), "priority"))

register("issues_missing",
         W(*_parts_sql(DIRTY)) + "SELECT col AS \"column\", pct AS missing_percentage FROM miss",
         rnd=("missing_percentage",))(
    lambda spark, d: Q.detect_missing(fx.orders_dirty(spark, d)))

register("issues_outliers",
         W(*_parts_sql(DOC)) + "SELECT \"column\", outlier_count, percentage FROM outl",
         rnd=("percentage",))(
    lambda spark, d: Q.detect_outliers(fx.doc_clf(spark, d)))

register("issues_imbalance",
         W(*_parts_sql(DOC)) + "SELECT n_classes::BIGINT AS n_classes, min_count::BIGINT AS min_count, "
         "max_count::BIGINT AS max_count, ratio::DOUBLE AS ratio, ratio < 0.3 AS has_issue FROM imb",
         rnd=("ratio",))(
    lambda spark, d: Q.detect_class_imbalance(fx.doc_clf(spark, d), "quality"))

register("issues_high_cardinality",
         W(*_parts_sql(DIRTY)) + "SELECT col AS \"column\", u::BIGINT AS n_unique FROM card")(
    lambda spark, d: Q.detect_high_cardinality(fx.orders_dirty(spark, d)))

register("issues_high_cardinality_docs",
         W(*_parts_sql(DOC)) + "SELECT col AS \"column\", u::BIGINT AS n_unique FROM card")(
    lambda spark, d: Q.detect_high_cardinality(fx.doc_clf(spark, d)))

register("issues_constant",
         W(*_parts_sql(DIRTY)) + "SELECT col AS \"column\" FROM cons")(
    lambda spark, d: Q.detect_constant(fx.orders_dirty(spark, d)))

LDUP = dict(cte=fx.LINEITEM_DUPS_SQL, table="lineitem_dups",
            all=["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"],
            num=["l_quantity", "l_discount", "l_tax"], cat=["l_returnflag", "l_linestatus"], target="l_returnflag")

register("issues_duplicates",
         W(*_parts_sql(LDUP)) + "SELECT dup_count::BIGINT AS dup_count, percentage::DOUBLE AS percentage, "
         "percentage > 1.0 AS has_issue FROM dup", rnd=("percentage",))(
    lambda spark, d: Q.detect_duplicates(fx.lineitem_dups(spark, d)))

register("issues_health_score_dups", _score_sql(LDUP))(
    lambda spark, d: Q.health_score(fx.lineitem_dups(spark, d), "l_returnflag"))


def _all_sql(s):
    return (W(*_parts_sql(s)) +
            "SELECT 'missing_values' AS issue, col AS \"column\", pct::DOUBLE AS value FROM miss UNION ALL "
            "SELECT 'outliers', \"column\", outlier_count::DOUBLE FROM outl UNION ALL "
            "SELECT 'class_distribution', coalesce(class, 'nan'), n::DOUBLE FROM cls UNION ALL "
            "SELECT 'class_imbalance_ratio', NULL, ratio::DOUBLE FROM imb UNION ALL "
            "SELECT 'high_cardinality', col, u::DOUBLE FROM card UNION ALL "
            "SELECT 'constant_features', col, 1.0 FROM cons UNION ALL "
            "SELECT 'duplicate_rows', NULL, dup_count::DOUBLE FROM dup UNION ALL "
            "SELECT 'duplicate_percentage', NULL, percentage::DOUBLE FROM dup UNION ALL "
            "SELECT 'health_score', NULL, greatest(0, 100 - d_missing - d_outliers - d_imbalance - d_card "
            "- d_const - d_dup)::DOUBLE FROM ded")


register("issues_all", _all_sql(DIRTY), rnd=("value",))(
    lambda spark, d: Q.issue_table(Q.detect_all(fx.orders_dirty(spark, d), "priority"), spark))

_BREAKDOWN = (W(*_parts_sql(DOC)) +
              "SELECT n.position, n.issue, v.deduction FROM (VALUES (1, 'Missing Values'), (2, 'Outliers'), "
              "(3, 'Class Imbalance'), (4, 'High Cardinality'), (5, 'Constant Features'), (6, 'Duplicates')) "
              "AS n(position, issue) JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS p, unnest([-d_missing, -d_outliers, "
              "-d_imbalance, -d_card, -d_const, -d_dup]) AS deduction FROM ded) v ON n.position = v.p")
register("issues_breakdown",
         "SELECT position::INTEGER AS position, issue, deduction::INTEGER AS deduction, "
         "CASE WHEN deduction = 0 THEN 'OK' ELSE 'Affected' END AS status FROM (" + _BREAKDOWN + ") AS b")(
    lambda spark, d: Q.score_breakdown(Q.detect_all(fx.doc_clf(spark, d), "quality"), spark))

register("issues_tables",
         W(*_parts_sql(DIRTY)) +
         "SELECT 'Missing Values' AS \"table\", col AS key, printf('%.2f', round(pct, 2)) || '%' AS value FROM miss "
         "UNION ALL SELECT 'Outliers', \"column\", CAST(outlier_count AS VARCHAR) FROM outl "
         "UNION ALL SELECT 'Class Distribution', coalesce(class, 'nan'), CAST(n AS VARCHAR) FROM cls "
         "UNION ALL SELECT 'High Cardinality', col, CAST(u AS VARCHAR) FROM card "
         "UNION ALL SELECT 'Constant Features', col, NULL FROM cons "
         "UNION ALL SELECT 'Duplicates', 'rows', CAST(dup_count AS VARCHAR) FROM dup")(
    lambda spark, d: Q.formatted_issue_tables(Q.detect_all(fx.orders_dirty(spark, d), "priority"), spark))
