"""Registered profile (EDA) queries and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import read_table
from . import fixtures as fx
from .catalog import register

DOC_NUM = ["doc_id", "n_chars", "quality"]
DOC_CAT = ["text", "lang", "source"]
DOC_ALL = ["doc_id", "n_chars", "text", "lang", "source", "quality"]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
DIRTY_ALL = ["id", "status", "price", "price_text", "priority", "k"]


def W(*ctes) -> str:
    return "WITH " + ", ".join(ctes) + " "


def union(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# -- B1 preview ---------------------------------------------------------------
register("profile_preview",
         "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer "
         "ORDER BY c_custkey LIMIT 5")(
    lambda spark, d: P.preview(read_table(spark, d, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey"))

# -- B2 shape -----------------------------------------------------------------
register("profile_shape",
         "SELECT 'Rows' AS metric, count(*)::BIGINT AS count FROM lineitem UNION ALL "
         "SELECT 'Columns', (SELECT count(*) FROM information_schema.columns "
         "WHERE table_name = 'lineitem')::BIGINT")(
    lambda spark, d: P.shape(read_table(spark, d, "lineitem")))

# -- B3 schema ----------------------------------------------------------------
register("profile_schema",
         "SELECT ordinal_position::INTEGER AS position, column_name AS \"column\", "
         "CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' "
         "WHEN 'SMALLINT' THEN 'int16' WHEN 'TINYINT' THEN 'int8' WHEN 'DOUBLE' THEN 'float64' "
         "WHEN 'FLOAT' THEN 'float32' WHEN 'BOOLEAN' THEN 'bool' "
         "WHEN 'TIMESTAMP' THEN 'datetime64[ns]' ELSE 'object' END AS data_type "
         "FROM information_schema.columns WHERE table_name = 'lineitem'")(
    lambda spark, d: P.schema_table(read_table(spark, d, "lineitem")))


# -- B4 describe --------------------------------------------------------------
def _describe_sql(table, numeric, categorical, order):
    parts = []
    for c in order:
        i = order.index(c)
        if c in numeric:
            parts.append(
                f"SELECT {i} AS position, '{c}' AS \"column\", count({c})::BIGINT AS count, "
                f"NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq, "
                f"avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, "
                f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
                f"quantile_cont({c}, 0.75) AS q75, max({c})::DOUBLE AS max FROM {table}")
        else:
            parts.append(
                f"SELECT {i}, '{c}', (SELECT count({c}) FROM {table})::BIGINT, "
                f"(SELECT count(DISTINCT {c}) FROM {table})::BIGINT, t.v, t.f::BIGINT, "
                f"NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, "
                f"NULL::DOUBLE FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS f FROM {table} "
                f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY f DESC, v LIMIT 1) t")
    return union(parts)


register("profile_describe",
         W(fx.DOC_CLF_SQL) + "SELECT * FROM (" + _describe_sql("doc_clf", DOC_NUM, DOC_CAT, DOC_ALL) + ")",
         rnd=("mean", "std", "min", "q25", "q50", "q75", "max"))(
    lambda spark, d: P.describe_all(fx.doc_clf(spark, d)))


# -- B5 missing ---------------------------------------------------------------
def _missing_sql(table, cols):
    return union(
        f"SELECT {i} AS position, '{c}' AS \"column\", count_if({c} IS NULL)::BIGINT AS missing_count, "
        f"coalesce(100.0 * count_if({c} IS NULL) / nullif(count(*), 0), 0.0)::DOUBLE AS missing_percentage "
        f"FROM {table}" for i, c in enumerate(cols))


register("profile_missing", W(fx.ORDERS_DIRTY_SQL) + _missing_sql("orders_dirty", DIRTY_ALL),
         rnd=("missing_percentage",))(
    lambda spark, d: P.missing_summary(fx.orders_dirty(spark, d)))

register("profile_missing_overall",
         W(fx.ORDERS_DIRTY_SQL) +
         "SELECT (" + " + ".join(f"count_if({c} IS NULL)" for c in DIRTY_ALL) + ")::BIGINT AS total_missing, "
         f"(count(*) * {len(DIRTY_ALL)})::BIGINT AS total_cells, "
         "coalesce(100.0 * (" + " + ".join(f"count_if({c} IS NULL)" for c in DIRTY_ALL) + ") / "
         f"nullif(count(*) * {len(DIRTY_ALL)}, 0), 0.0)::DOUBLE AS overall_percentage FROM orders_dirty",
         rnd=("overall_percentage",))(
    lambda spark, d: P.missing_overall(fx.orders_dirty(spark, d)))


# -- B6-B8 outliers -----------------------------------------------------------
def _iqr_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN q3 - q1 = 0 OR q1 IS NULL THEN 0 ELSE "
            f"(SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM {table}) "
            f"END::BIGINT AS outlier_count, "
            f"CASE WHEN q3 - q1 = 0 OR q1 IS NULL OR n = 0 THEN 0.0 ELSE 100.0 * "
            f"(SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM {table}) / n "
            f"END::DOUBLE AS percentage FROM (SELECT quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM {table}) s")
    return union(parts)


def _z_sql(table, cols):
    parts = []
    for c in cols:
        cond = f"abs(({c} - m) / s) > 3"
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN s IS NULL OR s = 0 THEN 0 ELSE "
            f"(SELECT count_if({cond}) FROM {table}) END::BIGINT AS outlier_count, "
            f"CASE WHEN s IS NULL OR s = 0 OR n = 0 THEN 0.0 ELSE 100.0 * "
            f"(SELECT count_if({cond}) FROM {table}) / n END::DOUBLE AS percentage "
            f"FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s, count({c}) AS n FROM {table}) st")
    return union(parts)


EV_NUM = ["event_id", "user_id", "value"]
register("profile_outliers_iqr", W(fx.EVENTS_NUM_SQL) + _iqr_sql("events_num", EV_NUM),
         rnd=("percentage",))(
    lambda spark, d: P.outliers_iqr(fx.events_num(spark, d)))
register("profile_outliers_iqr_lineitem", W(fx.LINEITEM_NUM_SQL) + _iqr_sql("lineitem_num", LI_NUM),
         rnd=("percentage",))(
    lambda spark, d: P.outliers_iqr(fx.lineitem_num(spark, d)))
register("profile_outliers_zscore", W(fx.EVENTS_NUM_SQL) + _z_sql("events_num", EV_NUM),
         rnd=("percentage",))(
    lambda spark, d: P.outliers_zscore(fx.events_num(spark, d)))
register("profile_outlier_summary",
         W(fx.DOC_CLF_SQL) + "SELECT a.\"column\", a.outlier_count AS iqr_count, a.percentage AS iqr_percentage, "
         "b.outlier_count AS z_count, b.percentage AS z_percentage FROM (" + _iqr_sql("doc_clf", DOC_NUM) +
         ") a JOIN (" + _z_sql("doc_clf", DOC_NUM) + ") b ON a.\"column\" = b.\"column\"",
         rnd=("iqr_percentage", "z_percentage"))(
    lambda spark, d: P.outlier_summary(fx.doc_clf(spark, d)))


# -- B9 histogram ---------------------------------------------------------------
def _auto_bins_sql(c, table, integers=()):
    """(lo, hi, n, k) of a column under the automatic bin rule."""
    wide = "greatest(w, 1.0)" if c in integers else "w"
    return (f"(SELECT lo, hi, n, CASE WHEN hi = lo THEN 1 ELSE ceil((hi - lo) / {wide})::INTEGER END AS k FROM (SELECT *, "
            f"CASE WHEN iqr > 0 THEN least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1 / 3::DOUBLE)) ELSE (hi - lo) / (log2(n) + 1) END AS w "
            f"FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count({c}) AS n, "
            f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {table})))")


def _hist_sql(table, cols, rule="auto", integers=()):
    parts = []
    for c in cols:
        spec = _auto_bins_sql(c, table, integers) if rule == "auto" else (
            f"(SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, (ceil(log2(count({c}))) + 1)::INTEGER AS k FROM {table})")
        parts.append(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x, s.lo, s.hi, s.k FROM {table}, {spec} s WHERE {c} IS NOT NULL")
    return (f"WITH v AS ({union(parts)}), spec AS (SELECT DISTINCT \"column\", lo, hi, k FROM v), "
            "c AS (SELECT \"column\", CASE WHEN hi = lo THEN 1 ELSE "
            "least(floor((x - lo) / ((hi - lo) / k))::INTEGER + 1, k) END AS bin, count(*) AS n "
            "FROM v GROUP BY ALL), g AS (SELECT \"column\", lo, hi, k, "
            "unnest(generate_series(1, k)) AS bin FROM spec) "
            "SELECT g.\"column\", g.bin::INTEGER AS bin, g.lo + (g.bin - 1) * ((g.hi - g.lo) / g.k) AS bin_lo, "
            "g.lo + g.bin * ((g.hi - g.lo) / g.k) AS bin_hi, coalesce(c.n, 0)::BIGINT AS count "
            "FROM g LEFT JOIN c ON g.\"column\" = c.\"column\" AND g.bin = c.bin")


register("profile_histogram", W(fx.LINEITEM_NUM_SQL).rstrip() + ", " + _hist_sql("lineitem_num", LI_NUM, "sturges")[5:],
         rnd=("bin_lo", "bin_hi"))(
    lambda spark, d: P.histogram(fx.lineitem_num(spark, d), bins="sturges"))
register("profile_histogram_auto", W(fx.LINEITEM_NUM_SQL).rstrip() + ", " + _hist_sql("lineitem_num", LI_NUM, integers=("l_linenumber",))[5:],
         rnd=("bin_lo", "bin_hi"))(
    lambda spark, d: P.histogram(fx.lineitem_num(spark, d)))


# -- B10 kde -----------------------------------------------------------------------
def _kde_sql(table, cols, grid=200, cut=3.0):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL")
    return (f"v AS ({union(parts)}), st AS (SELECT \"column\", count(*) AS n, stddev_samp(x) AS sd, "
            "min(x) AS lo, max(x) AS hi FROM v GROUP BY 1 HAVING count(*) >= 2 AND stddev_samp(x) > 0), "
            "p AS (SELECT \"column\", n, sd * pow(n, -0.2) AS bw, lo, hi FROM st), "
            f"g AS (SELECT \"column\", n, bw, unnest(range({grid})) AS point, "
            f"lo - {cut} * bw AS start, (hi - lo + {2 * cut} * bw) / {grid - 1} AS step FROM p) "
            "SELECT g.\"column\", g.point::INTEGER AS point, g.start + g.point * g.step AS x, "
            "sum(exp(-0.5 * ((g.start + g.point * g.step - v.x) / g.bw) * ((g.start + g.point * g.step - v.x) / g.bw))) "
            "/ (g.n * g.bw * sqrt(2 * pi())) AS density "
            "FROM g JOIN v ON g.\"column\" = v.\"column\" GROUP BY g.\"column\", g.point, g.start, g.step, g.n, g.bw")


register("profile_kde", W(fx.DOC_CLF_SQL, _kde_sql("doc_clf", DOC_NUM)).replace("WITH ", "WITH ", 1),
         rnd=("x", "density"))(
    lambda spark, d: P.kde(fx.doc_clf(spark, d), DOC_NUM, cut=3.0))
register("profile_kde_curve",
         W(fx.DOC_CLF_SQL, "k AS (SELECT c.\"column\", c.point, c.x, c.density * b.n * (b.hi - b.lo) / b.k AS density FROM (WITH " +
           _kde_sql("doc_clf", DOC_NUM, cut=0.0) + ") c JOIN (" + union(
               f"SELECT '{c}' AS \"column\", * FROM {_auto_bins_sql(c, 'doc_clf', DOC_NUM)}" for c in DOC_NUM) +
           ") b ON b.\"column\" = c.\"column\")") + "SELECT * FROM k", rnd=("x", "density"))(
    lambda spark, d: P.kde(fx.doc_clf(spark, d), DOC_NUM, counts=True))


# -- B11-B14 ------------------------------------------------------------------
register("profile_frequencies",
         "WITH f AS (" + union(
             f"SELECT '{c}' AS \"column\", {c} AS value, count(*)::BIGINT AS count FROM orders GROUP BY {c}"
             for c in ["o_orderstatus", "o_orderpriority"]) + ") "
         "SELECT \"column\", value, count, count * 100.0 / sum(count) OVER (PARTITION BY \"column\") "
         "AS percentage FROM f", rnd=("percentage",))(
    lambda spark, d: P.frequencies(read_table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


def _corr_sql(table, cols):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            xa = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            yb = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            spread = f"nullif(stddev_pop({xa}) * stddev_pop({yb}), 0)"
            # DuckDB's least and greatest skip NULL, so a constant column is told apart first
            expr = f"CASE WHEN {spread} IS NOT NULL THEN greatest(-1.0, least(1.0, covar_pop({xa}, {yb}) / {spread})) END"
            if a == b:
                expr = f"CASE WHEN nullif(stddev_pop({a}), 0) IS NULL THEN NULL ELSE 1.0 END"
            parts.append(f"SELECT '{a}' AS col_x, '{b}' AS col_y, ({expr})::DOUBLE AS corr FROM {table}")
    return union(parts)


register("profile_correlation", W(fx.LINEITEM_NUM_SQL) + _corr_sql("lineitem_num", LI_NUM),
         rnd=("corr",))(
    lambda spark, d: P.correlation(fx.lineitem_num(spark, d)))

register("profile_class_distribution",
         "SELECT CAST(o_orderpriority AS VARCHAR) AS class, count(*)::BIGINT AS count, "
         "count(*) * 100.0 / sum(count(*)) OVER () AS percentage FROM orders GROUP BY 1",
         rnd=("percentage",))(
    lambda spark, d: P.class_distribution(read_table(spark, d, "orders"), "o_orderpriority"))

register("profile_split_sizes",
         W(fx.DOC_CLF_SQL) + "SELECT floor(count(*) * 0.8::DOUBLE)::BIGINT AS train_rows, "
         "(count(*) - floor(count(*) * 0.8::DOUBLE))::BIGINT AS test_rows FROM doc_clf")(
    lambda spark, d: P.split_sizes(fx.doc_clf(spark, d), 0.8))

# -- B15-B18 ------------------------------------------------------------------
NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _num_sql(expr):
    return f"CASE WHEN regexp_full_match({expr}, '{NUM_RE}') THEN TRY_CAST({expr} AS DOUBLE) END"


def _trim_sql(expr):
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def _spark_str(c, dtype):
    # Spark's text form of a double differs from DuckDB's; the dirty table's only
    # double column is ``price`` which parses either way, so it is never sampled.
    return f"CAST({c} AS VARCHAR)"


register("profile_non_numeric",
         W(fx.ORDERS_DIRTY_SQL) + "SELECT * FROM (" + union(
             f"SELECT '{c}' AS \"column\", count_if({c} IS NOT NULL AND "
             f"({_num_sql(_trim_sql(_spark_str(c, None)))}) IS NULL)::BIGINT AS non_numeric_count, "
             f"(SELECT list(v ORDER BY v)[1:10] FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
             f"FROM orders_dirty WHERE {c} IS NOT NULL)) AS sample_values FROM orders_dirty"
             for c in DIRTY_ALL) + ") WHERE non_numeric_count > 0")(
    lambda spark, d: P.non_numeric_report(fx.orders_dirty(spark, d)))


def _clean_sql(c):
    s = f"CAST({c} AS VARCHAR)"
    s = _trim_sql(s)
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    s = f"replace({s}, ',', '.')"
    return f"nullif({s}, 'nan')"


register("profile_coercible",
         W(fx.ORDERS_DIRTY_SQL) + union(
             f"SELECT '{c}' AS \"column\", avg(CASE WHEN ({_num_sql(_clean_sql(c))}) IS NOT NULL "
             f"THEN 1.0 ELSE 0.0 END) AS parse_fraction FROM orders_dirty"
             for c in ["status", "price_text", "priority", "k"]),
         rnd=("parse_fraction",))(
    lambda spark, d: _coercible(fx.orders_dirty(spark, d)))


def _coercible(df):
    cleaned = P.clean_strings(df)
    from ..functions import num, string_columns
    cols = string_columns(cleaned)
    st = cleaned.agg(*[F.avg(num(c).isNotNull().cast("double")).alias(c) for c in cols])
    return st.unpivot([], cols, "column", "parse_fraction")


register("profile_clean_coerce",
         W(fx.ORDERS_DIRTY_SQL) + f"SELECT id, {_clean_sql('status')} AS status, price, "
         f"{_num_sql(_clean_sql('price_text'))} AS price_text, {_clean_sql('priority')} AS priority, "
         f"{_clean_sql('k')} AS k FROM orders_dirty", rnd=("price", "price_text"))(
    lambda spark, d: P.clean_and_coerce(fx.orders_dirty(spark, d), 0.5))

register("profile_column_types",
         "SELECT CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT') "
         "OR data_type LIKE 'DECIMAL%' THEN 'numeric' ELSE 'categorical' END AS kind, column_name AS \"column\" "
         "FROM information_schema.columns WHERE (table_name = 'documents' AND column_name IN "
         "('doc_id', 'n_chars', 'text', 'lang', 'source')) OR (table_name = 'labels' AND column_name = 'quality')")(
    lambda spark, d: _types(fx.doc_clf(spark, d)))


def _types(df):
    from ..functions import categorical_columns, numeric_columns
    rows = [("numeric", c) for c in numeric_columns(df)] + [("categorical", c) for c in categorical_columns(df)]
    return df.sparkSession.createDataFrame(rows, "kind string, column string")


# -- B10 kde, binned mode (values pre-aggregated into 4096 bins per column) -----------------
def _kde_binned_sql(table, cols, grid=200, bins=4096):
    parts = [f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL" for c in cols]
    return (f"v AS ({union(parts)}), st AS (SELECT \"column\", count(*) AS n, stddev_samp(x) AS sd, "
            "min(x) AS lo, max(x) AS hi FROM v GROUP BY 1 HAVING count(*) >= 2 AND stddev_samp(x) > 0), "
            f"vb AS (SELECT v.\"column\", least(floor((v.x - st.lo) / (st.hi - st.lo) * {bins})::INTEGER, "
            f"{bins - 1}) AS b, st.lo, st.hi, count(*)::DOUBLE AS w FROM v JOIN st ON v.\"column\" = st.\"column\" "
            "GROUP BY ALL), "
            f"wx AS (SELECT \"column\", lo + (b + 0.5) * (hi - lo) / {bins} AS x, w FROM vb), "
            "p AS (SELECT \"column\", n, sd * pow(n, -0.2) AS bw, lo, hi FROM st), "
            f"g AS (SELECT \"column\", n, bw, unnest(range({grid})) AS point, "
            f"lo - 3.0 * bw AS start, (hi - lo + 6.0 * bw) / {grid - 1} AS step FROM p) "
            "SELECT g.\"column\", g.point::INTEGER AS point, g.start + g.point * g.step AS x, "
            "sum(wx.w * exp(-0.5 * ((g.start + g.point * g.step - wx.x) / g.bw) * "
            "((g.start + g.point * g.step - wx.x) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())) AS density "
            "FROM g JOIN wx ON g.\"column\" = wx.\"column\" GROUP BY g.\"column\", g.point, g.start, g.step, g.n, g.bw")


register("profile_kde_binned",
         W(fx.LINEITEM_NUM_SQL, _kde_binned_sql("lineitem_num", ["l_extendedprice", "l_quantity"])),
         rnd=("x", "density"))(
    lambda spark, d: P.kde(fx.lineitem_num(spark, d), ["l_extendedprice", "l_quantity"], cut=3.0, exact=False))
