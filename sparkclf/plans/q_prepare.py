"""Registered preprocessing / split / encoding queries and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import prepare as P
from ..operators import split as S
from ..operators.quality import detect_constant
from ..sources import read_table
from . import fixtures as fx
from .catalog import register
from .preprocess import PrepConfig, apply_preprocessing
from .q_profile import W

DIRTY_ALL = ["id", "status", "price", "price_text", "priority", "k"]


def H_SQL(k, seed=42):
    return f"('0x' || substr(md5('{seed}:' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT"


def _mode_sql(table, c):
    return (f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


# -- D1-D3 ---------------------------------------------------------------------
register("prep_dedupe", W(fx.LINEITEM_DUPS_SQL) + "SELECT DISTINCT * FROM lineitem_dups")(
    lambda spark, d: P.drop_duplicates(fx.lineitem_dups(spark, d)))


def _drop_const(spark, d):
    df = fx.orders_dirty(spark, d)
    cols = [r["column"] for r in detect_constant(df).collect()]
    return P.drop_constant(df, cols, protect=("priority",))


register("prep_drop_constant",
         W(fx.ORDERS_DIRTY_SQL) + "SELECT id, status, price, price_text, priority FROM orders_dirty")(_drop_const)

register("prep_drop_null_rows",
         W(fx.ORDERS_DIRTY_SQL) + "SELECT * FROM orders_dirty WHERE " +
         " AND ".join(f"{c} IS NOT NULL" for c in DIRTY_ALL))(
    lambda spark, d: P.impute(fx.orders_dirty(spark, d), "drop_rows"))

register("prep_drop_null_columns",
         W(fx.ORDERS_DIRTY_SQL) + "SELECT id, price_text, priority, k FROM orders_dirty")(
    lambda spark, d: P.impute(fx.orders_dirty(spark, d), "drop_columns"))


def _impute_sql(num_fill, cat_fill):
    return (W(fx.ORDERS_DIRTY_SQL) +
            f"SELECT id, coalesce(status, {cat_fill}) AS status, coalesce(price, {num_fill})::DOUBLE AS price, "
            "price_text, priority, k FROM orders_dirty")


register("prep_impute_mean", _impute_sql("(SELECT avg(price) FROM orders_dirty)",
                                         _mode_sql("orders_dirty", "status")), rnd=("price",))(
    lambda spark, d: P.impute(fx.orders_dirty(spark, d), "mean"))
register("prep_impute_median", _impute_sql("(SELECT quantile_cont(price, 0.5) FROM orders_dirty)",
                                           _mode_sql("orders_dirty", "status")), rnd=("price",))(
    lambda spark, d: P.impute(fx.orders_dirty(spark, d), "median"))
register("prep_impute_mode", _impute_sql(_mode_sql("orders_dirty", "price"),
                                         _mode_sql("orders_dirty", "status")), rnd=("price",))(
    lambda spark, d: P.impute(fx.orders_dirty(spark, d), "mode"))
register("prep_impute_constant", _impute_sql("0.0", "'missing'"), rnd=("price",))(
    lambda spark, d: P.impute(fx.orders_dirty(spark, d), "constant", None))
register("prep_impute_constant_value", _impute_sql("7.5", "'7.5'"), rnd=("price",))(
    lambda spark, d: P.impute(fx.orders_dirty(spark, d), "constant", "7.5"))

# -- D4 -------------------------------------------------------------------------
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
register("prep_iqr_bounds",
         W(fx.LINEITEM_NUM_SQL) + " UNION ALL ".join(
             f"(SELECT '{c}' AS \"column\", q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high "
             f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem_num))"
             for c in LI_NUM), rnd=("q1", "q3", "low", "high"))(
    lambda spark, d: P.iqr_bounds_table(fx.lineitem_num(spark, d)))

_EV_B = ("b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
         "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_num))")
register("prep_cap_outliers",
         W(fx.EVENTS_NUM_SQL, _EV_B) + "SELECT event_id, ts, user_id, event_type, CASE WHEN value IS NULL THEN NULL "
         "ELSE least(greatest(value, lo), hi) END::DOUBLE AS value, props FROM events, b", rnd=("value",))(
    lambda spark, d: P.cap_outliers(read_table(spark, d, "events"), ["value"]))
register("prep_remove_outliers",
         W(fx.EVENTS_NUM_SQL, _EV_B) + "SELECT event_id, ts, user_id, event_type, value, props FROM events, b "
         "WHERE NOT coalesce(value < lo OR value > hi, false)")(
    lambda spark, d: P.remove_outliers(read_table(spark, d, "events"), ["value"]))

_DOC_B = ("b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
          "(SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM doc_clf))")
register("prep_remove_outliers_docs",
         W(fx.DOC_CLF_SQL, _DOC_B) + "SELECT doc_id, n_chars, text, lang, source, quality FROM doc_clf, b "
         "WHERE NOT coalesce(n_chars < lo OR n_chars > hi, false)")(
    lambda spark, d: P.remove_outliers(fx.doc_clf(spark, d), ["n_chars"]))

# -- D5 X / y projection ------------------------------------------------------------
register("prep_features_label",
         W(fx.DOC_CLF_SQL) + "SELECT doc_id, n_chars, text, lang, source, quality AS label FROM doc_clf")(
    lambda spark, d: fx.doc_clf(spark, d).select(
        *[c for c in fx.doc_clf(spark, d).columns if c != "quality"], F.col("quality").alias("label")))


# -- D5 split / E11 folds ---------------------------------------------------------------
def split_sql(table, id_col, label, cols, ts=0.8, stratify=True, seed=42):
    key = f"coalesce(CAST({label} AS VARCHAR), chr(0) || '<null>')" if stratify else "'all'"
    return (
        f"base AS (SELECT *, {H_SQL(id_col, seed)} AS __h, {key} AS __k FROM {table}), "
        "cnt AS (SELECT __k, count(*) AS n FROM base GROUP BY __k), "
        f"tot AS (SELECT sum(n) AS n, floor(sum(n) * {ts}::DOUBLE) AS ntr FROM cnt), "
        "cont AS (SELECT __k, tot.ntr * cnt.n / tot.n AS c, floor(tot.ntr * cnt.n / tot.n) AS f FROM cnt, tot), "
        "nd AS (SELECT (SELECT ntr FROM tot) - sum(f) AS need FROM cont), "
        "alloc AS (SELECT __k, f + CASE WHEN row_number() OVER (ORDER BY c - f DESC, __k) <= "
        "(SELECT need FROM nd) THEN 1 ELSE 0 END AS a FROM cont), "
        f"splitted AS (SELECT {', '.join(cols)}, CASE WHEN row_number() OVER (PARTITION BY base.__k "
        f"ORDER BY __h, {id_col}) <= a THEN 'train' ELSE 'test' END AS split FROM base JOIN alloc "
        "ON base.__k = alloc.__k)")


register("split_stratified",
         W(fx.DOC_CLF_SQL, split_sql("doc_clf", "doc_id", "quality", ["doc_id", "quality"])) +
         "SELECT * FROM splitted")(
    lambda spark, d: S.train_test_split(fx.doc_clf(spark, d).select("doc_id", "quality"), "quality", "doc_id"))

register("split_stratified_orders",
         W(split_sql("orders", "o_orderkey", "o_orderpriority", ["o_orderkey", "o_orderpriority"], ts=0.75)) +
         "SELECT * FROM splitted")(
    lambda spark, d: S.train_test_split(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
                                        "o_orderpriority", "o_orderkey", 0.75))

register("split_plain",
         W(fx.DOC_CLF_SQL, split_sql("doc_clf", "doc_id", "quality", ["doc_id", "quality"], stratify=False)) +
         "SELECT * FROM splitted")(
    lambda spark, d: S.train_test_split(fx.doc_clf(spark, d).select("doc_id", "quality"), "quality", "doc_id",
                                        stratify=False))

register("split_class_sizes",
         W(fx.DOC_CLF_SQL, split_sql("doc_clf", "doc_id", "quality", ["doc_id", "quality"])) +
         "SELECT quality, split, count(*)::BIGINT AS n FROM splitted GROUP BY ALL")(
    lambda spark, d: S.train_test_split(fx.doc_clf(spark, d).select("doc_id", "quality"), "quality", "doc_id")
    .groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n")))


def folds_sql(k=5, seed=42):
    return (f"SELECT doc_id, quality, ((row_number() OVER (PARTITION BY coalesce(CAST(quality AS VARCHAR), "
            f"chr(0) || '<null>') ORDER BY {H_SQL('doc_id', seed + 1)}, doc_id) - 1) % {k})::INTEGER AS fold "
            "FROM splitted WHERE split = 'train'")


register("cv_folds",
         W(fx.DOC_CLF_SQL, split_sql("doc_clf", "doc_id", "quality", ["doc_id", "quality"])) + folds_sql())(
    lambda spark, d: S.kfold(S.train_test_split(fx.doc_clf(spark, d).select("doc_id", "quality"),
                                                "quality", "doc_id").where("split = 'train'").drop("split"),
                             "quality", "doc_id", 5))

# -- D6-D7 encoders / scalers -----------------------------------------------------------------
DOC_ENC = ["doc_id", "n_chars", "lang", "source", "quality"]
# The categories present in the train split at sf0.01 (output schema of the one-hot twin).
LANGS = ["de", "en", "es", "fr"]
SOURCES = ["src0", "src1", "src10", "src11", "src12", "src13", "src14", "src15", "src16", "src17",
           "src18", "src19", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9"]


def _doc_split(spark, d):
    return S.train_test_split(fx.doc_clf(spark, d).select(*DOC_ENC), "quality", "doc_id")


def _onehot_cols():
    return ([f"CAST(CASE WHEN lang = '{v}' THEN 1 ELSE 0 END AS TINYINT) AS lang_{v}" for v in LANGS] +
            [f"CAST(CASE WHEN source = '{v}' THEN 1 ELSE 0 END AS TINYINT) AS source_{v}" for v in SOURCES])


register("encode_onehot",
         W(fx.DOC_CLF_SQL, split_sql("doc_clf", "doc_id", "quality", DOC_ENC)) +
         "SELECT doc_id, n_chars, quality, split, " + ", ".join(_onehot_cols()) + " FROM splitted")(
    lambda spark, d: (lambda s: E.onehot_fit(s, exclude=("quality", "doc_id", "split")).transform(s))(
        _doc_split(spark, d)))


def _ordinal_sql():
    parts = []
    for c in ["text", "lang", "source"]:
        parts.append(f"m_{c} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code FROM "
                     f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM splitted WHERE split = 'train' "
                     f"AND {c} IS NOT NULL))")
    return parts


register("encode_ordinal",
         W(fx.DOC_CLF_SQL, split_sql("doc_clf", "doc_id", "quality", [*DOC_ENC, "text"]), *_ordinal_sql()) +
         "SELECT doc_id, n_chars, coalesce(m_text.code, -1)::INTEGER AS text, coalesce(m_lang.code, -1)::INTEGER AS lang, "
         "coalesce(m_source.code, -1)::INTEGER AS source, quality, split FROM splitted "
         "LEFT JOIN m_text ON splitted.text = m_text.v "
         "LEFT JOIN m_lang ON splitted.lang = m_lang.v LEFT JOIN m_source ON splitted.source = m_source.v")(
    lambda spark, d: (lambda s: E.ordinal_fit(s, exclude=("quality", "doc_id", "split")).transform(s))(
        S.train_test_split(fx.doc_clf(spark, d), "quality", "doc_id")))

ORD_SPLIT = split_sql("orders", "o_orderkey", "o_orderpriority",
                      ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


def _orders_split(spark, d):
    return S.train_test_split(read_table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


def _scaled(method):
    def fn(spark, d):
        s = _orders_split(spark, d)
        return E.scaler_fit(s, method, exclude=("o_orderkey", "o_orderpriority", "split")).transform(s)
    return fn


register("scale_standard",
         W(ORD_SPLIT, "st AS (SELECT avg(o_custkey) AS m1, coalesce(nullif(stddev_pop(o_custkey), 0), 1) AS s1, "
           "avg(o_totalprice) AS m2, coalesce(nullif(stddev_pop(o_totalprice), 0), 1) AS s2 FROM splitted "
           "WHERE split = 'train')") +
         "SELECT o_orderkey, (o_custkey - m1) / s1 AS o_custkey, o_orderstatus, (o_totalprice - m2) / s2 AS o_totalprice, "
         "o_orderdate, o_orderpriority, split FROM splitted, st", rnd=("o_custkey", "o_totalprice"))(_scaled("standard"))

register("scale_minmax",
         W(ORD_SPLIT, "st AS (SELECT min(o_custkey) AS a1, coalesce(nullif(max(o_custkey) - min(o_custkey), 0), 1) "
           "AS r1, min(o_totalprice) AS a2, coalesce(nullif(max(o_totalprice) - min(o_totalprice), 0), 1) AS r2 "
           "FROM splitted WHERE split = 'train')") +
         "SELECT o_orderkey, (o_custkey - a1) / r1 AS o_custkey, o_orderstatus, (o_totalprice - a2) / r2 AS o_totalprice, "
         "o_orderdate, o_orderpriority, split FROM splitted, st", rnd=("o_custkey", "o_totalprice"))(_scaled("minmax"))

# -- D8 / D10 full preprocessing and split shapes ---------------------------------------------------
FULL_CFG = PrepConfig(duplicates=True, impute=True, impute_method="median", outliers=True,
                      outlier_columns=("n_chars",), outlier_method="cap", encoding="onehot", scaling="standard",
                      onehot_layout="columns")


def _full(spark, d):
    return apply_preprocessing(fx.doc_clf(spark, d).select(*DOC_ENC), "quality", FULL_CFG, "doc_id")


def _full_sql():
    cap = ("capped AS (SELECT doc_id, CASE WHEN n_chars IS NULL THEN NULL ELSE least(greatest(n_chars::DOUBLE, lo), hi) "
           "END AS n_chars, lang, source, quality FROM (SELECT DISTINCT * FROM doc_clf), b)")
    sp = split_sql("capped", "doc_id", "quality", ["doc_id", "n_chars", "lang", "source", "quality"])
    enc = ("enc AS (SELECT doc_id, n_chars, quality, split, " + ", ".join(_onehot_cols()) + " FROM splitted)")
    feats = ["n_chars"] + [f"lang_{v}" for v in LANGS] + [f"source_{v}" for v in SOURCES]
    st = "st AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in feats) + \
        " FROM enc WHERE split = 'train')"
    sel = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in feats)
    return W(fx.DOC_CLF_SQL, _DOC_B, cap, sp, enc, st) + f"SELECT doc_id, quality, split, {sel} FROM enc, st", feats


_FULL_SQL, _FULL_FEATS = _full_sql()
register("prep_full", _FULL_SQL, rnd=tuple(_FULL_FEATS))(lambda spark, d: _full(spark, d).data)


def _shapes(spark, d):
    p = _full(spark, d)
    k = len(p.features)
    g = p.data.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    x = g.select(F.concat(F.lit("X_"), F.col("split")).alias("split"), F.col("rows").cast("bigint"),
                 F.lit(k).cast("bigint").alias("cols"))
    y = g.select(F.concat(F.lit("y_"), F.col("split")).alias("split"), F.col("rows").cast("bigint"),
                 F.lit(1).cast("bigint").alias("cols"))
    return x.unionByName(y)


register("split_shape",
         W(fx.DOC_CLF_SQL, split_sql("(SELECT DISTINCT * FROM doc_clf)", "doc_id", "quality", ["doc_id"])) +
         f"SELECT 'X_' || split AS split, count(*)::BIGINT AS rows, {len(_FULL_FEATS)}::BIGINT AS cols "
         "FROM splitted GROUP BY 1 UNION ALL SELECT 'y_' || split, count(*)::BIGINT, 1::BIGINT FROM splitted "
         "GROUP BY 1")(_shapes)

# -- the same over the whole table, text included: sparse one-hot ------------------------------------------
def _index_sql(table, cols):
    return [f"m_{c} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS i, (count(*) OVER ())::INTEGER AS n FROM "
            f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {table} WHERE split = 'train' AND {c} IS NOT NULL))" for c in cols]


_WIDE = ["text", "lang", "source"]
_WIDE_SEL = ", ".join(f"m_{c}.i AS {c}_index, (SELECT max(n) FROM m_{c}) AS {c}_size" for c in _WIDE)
_WIDE_JOIN = " ".join(f"LEFT JOIN m_{c} ON splitted.{c} = m_{c}.v" for c in _WIDE)


def _flat(df):
    """Sparse one-hot columns as two plain columns each."""
    hot = [c for c in df.columns if c.endswith("_onehot")]
    return df.select(*[c for c in df.columns if c not in hot],
                     *[F.col(f"{c}.{x}").alias(f"{c[:-7]}_{x}") for c in hot for x in ("index", "size")])


register("encode_onehot_sparse",
         W(fx.DOC_CLF_SQL, split_sql("doc_clf", "doc_id", "quality", [*DOC_ENC, "text"]), *_index_sql("splitted", _WIDE)) +
         f"SELECT doc_id, n_chars, quality, split, {_WIDE_SEL} FROM splitted {_WIDE_JOIN}")(
    lambda spark, d: (lambda s: _flat(E.onehot_fit(s, exclude=("quality", "doc_id", "split"), layout="sparse").transform(s)))(
        S.train_test_split(fx.doc_clf(spark, d), "quality", "doc_id")))

SPARSE_CFG = PrepConfig(duplicates=True, impute=True, impute_method="median", outliers=True, outlier_columns=("n_chars",),
                        outlier_method="cap", encoding="onehot", scaling="standard")
_CAPPED = ("capped AS (SELECT doc_id, CASE WHEN n_chars IS NULL THEN NULL ELSE least(greatest(n_chars::DOUBLE, lo), hi) "
           "END AS n_chars, text, lang, source, quality FROM (SELECT DISTINCT * FROM doc_clf), b)")
_WHOLE = (fx.DOC_CLF_SQL, _DOC_B, _CAPPED, split_sql("capped", "doc_id", "quality", [*DOC_ENC, "text"]), *_index_sql("splitted", _WIDE))


def _whole(spark, d):
    return apply_preprocessing(fx.doc_clf(spark, d), "quality", SPARSE_CFG, "doc_id")


register("prep_full_text",
         W(*_WHOLE, "st AS (SELECT avg(n_chars) AS m, coalesce(nullif(stddev_pop(n_chars), 0), 1) AS s FROM splitted WHERE split = 'train')") +
         f"SELECT doc_id, (n_chars - m) / s AS n_chars, quality, split, {_WIDE_SEL} FROM splitted {_WIDE_JOIN}, st",
         rnd=("n_chars",))(lambda spark, d: _flat(_whole(spark, d).data))


def _whole_shapes(spark, d):
    p = _whole(spark, d)
    g = p.data.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return g.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{x}_"), "split").alias("split"), F.col("rows"),
                                                 F.lit(n).cast("bigint").alias("cols")) for x, n in (("X", p.n_features), ("y", 1))])).alias("r")).select("r.*")


register("split_shape_text",
         W(*_WHOLE, "w AS (SELECT 1 + " + " + ".join(f"(SELECT max(n) FROM m_{c})" for c in _WIDE) + " AS cols)") +
         "SELECT 'X_' || split AS split, count(*)::BIGINT AS rows, max(cols)::BIGINT AS cols FROM splitted, w GROUP BY 1 "
         "UNION ALL SELECT 'y_' || split, count(*)::BIGINT, 1::BIGINT FROM splitted GROUP BY 1")(_whole_shapes)
