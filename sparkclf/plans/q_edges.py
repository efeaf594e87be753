"""Registered queries on the hard cases: NaN beside NULL, timestamps and booleans,
many classes, missing ids, a class with one row.  The twins map NaN to NULL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import prepare as P
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import report as R
from ..operators import split as S
from ..sources import read_table
from . import fixtures as fx
from .catalog import register
from .q_prepare import _mode_sql, split_sql
from .q_profile import W, _corr_sql, _describe_sql, _hist_sql, _iqr_sql, _kde_binned_sql, _missing_sql, _z_sql
from .q_quality import _all_sql, _parts_sql, _score_sql

NAN_ALL, NAN_NUM = ["id", "price", "load", "flat", "priority"], ["id", "price", "load", "flat"]
NAN = dict(cte=fx.ORDERS_NAN_SQL, table="orders_nan", all=NAN_ALL, num=NAN_NUM, cat=["priority"], target="priority")
_N = W(fx.ORDERS_NAN_SQL)


def _nan(fn):
    return lambda spark, d: fn(fx.orders_nan(spark, d))


register("nan_describe", _N + "SELECT * FROM (" + _describe_sql("orders_nan", NAN_NUM, ["priority"], NAN_ALL) + ")",
         rnd=("mean", "std", "min", "q25", "q50", "q75", "max"))(_nan(PR.describe_all))
register("nan_missing", _N + _missing_sql("orders_nan", NAN_ALL), rnd=("missing_percentage",))(_nan(PR.missing_summary))
register("nan_outliers_iqr", _N + _iqr_sql("orders_nan", NAN_NUM), rnd=("percentage",))(_nan(PR.outliers_iqr))
register("nan_outliers_zscore", _N + _z_sql("orders_nan", NAN_NUM), rnd=("percentage",))(_nan(PR.outliers_zscore))
register("nan_histogram", _N.rstrip() + ", " + _hist_sql("orders_nan", ["price", "load"])[5:], rnd=("bin_lo", "bin_hi"))(
    _nan(lambda df: PR.histogram(df, ["price", "load"])))
register("nan_kde_binned", W(fx.ORDERS_NAN_SQL, _kde_binned_sql("orders_nan", ["load"])), rnd=("x", "density"))(
    _nan(lambda df: PR.kde(df, ["load"], cut=3.0, exact=False)))
register("nan_correlation", _N + _corr_sql("orders_nan", NAN_NUM), rnd=("corr",))(_nan(PR.correlation))
register("nan_health_score", _score_sql(NAN))(_nan(lambda df: Q.health_score(df, "priority")))
register("nan_issues_all", _all_sql(NAN), rnd=("value",))(
    lambda spark, d: Q.issue_table(Q.detect_all(fx.orders_nan(spark, d), "priority"), spark))
register("nan_issues_constant", W(*_parts_sql(NAN)) + "SELECT col AS \"column\" FROM cons")(_nan(Q.detect_constant))
register("nan_drop_rows", _N + "SELECT * FROM orders_nan WHERE price IS NOT NULL AND load IS NOT NULL AND flat IS NOT NULL")(
    _nan(lambda df: P.impute(df, "drop_rows")))
register("nan_drop_columns", _N + "SELECT id, priority FROM orders_nan")(_nan(lambda df: P.impute(df, "drop_columns")))
for _method, _fill in (("mean", "(SELECT avg({c}) FROM orders_nan)"), ("median", "(SELECT quantile_cont({c}, 0.5) FROM orders_nan)"),
                       ("mode", None), ("constant", "0.0")):
    _cols = ", ".join(f"coalesce({c}, {_fill.format(c=c) if _fill else _mode_sql('orders_nan', c)})::DOUBLE AS {c}"
                      for c in ("price", "load", "flat"))
    register(f"nan_impute_{_method}", _N + f"SELECT id, {_cols}, priority FROM orders_nan", rnd=("price", "load", "flat"))(
        _nan(lambda df, m=_method: P.impute(df, m)))
_B = ("b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
      "(SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM orders_nan))")
register("nan_cap_outliers", W(fx.ORDERS_NAN_SQL, _B) + "SELECT id, CASE WHEN price IS NULL THEN NULL ELSE "
         "least(greatest(price, lo), hi) END::DOUBLE AS price, load, flat, priority FROM orders_nan, b", rnd=("price",))(
    _nan(lambda df: P.cap_outliers(df, ["price"])))
register("nan_remove_outliers", W(fx.ORDERS_NAN_SQL, _B) + "SELECT id, price, load, flat, priority FROM orders_nan, b "
         "WHERE NOT coalesce(price < lo OR price > hi, false)", rnd=("price",))(_nan(lambda df: P.remove_outliers(df, ["price"])))
register("nan_report_overview",
         _N + "SELECT count(*)::BIGINT AS total_rows, 5::BIGINT AS total_columns, 'priority' AS target_column, "
         "sum((price IS NULL)::INT + (load IS NULL)::INT + (flat IS NULL)::INT)::BIGINT AS missing_values, 0::BIGINT AS duplicate_rows, "
         "['id', 'price', 'load', 'flat', 'priority'] AS features FROM orders_nan")(
    _nan(lambda df: R.dataset_overview(df, "priority")))

# -- timestamps and booleans -----------------------------------------------------------
SHIP_ALL = ["id", "line", "shipdate", "bulky", "flag"]
register("typed_describe", W(fx.SHIP_SQL) + "SELECT * FROM (" + _describe_sql("ship", ["id", "line"], ["shipdate", "bulky", "flag"], SHIP_ALL) + ")",
         rnd=("mean", "std", "min", "q25", "q50", "q75", "max"))(lambda spark, d: PR.describe_all(fx.ship(spark, d)))
register("typed_impute_mode", W(fx.SHIP_SQL) + f"SELECT id, line, coalesce(shipdate, {_mode_sql('ship', 'shipdate')}) AS shipdate, "
         f"coalesce(bulky, {_mode_sql('ship', 'bulky')}) AS bulky, flag FROM ship")(lambda spark, d: P.impute(fx.ship(spark, d), "mode"))
register("typed_ordinal", W(fx.SHIP_SQL, *[
    f"m_{c} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code FROM "
    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM ship WHERE {c} IS NOT NULL))" for c in ("shipdate", "bulky", "flag")]) +
    "SELECT id, line, " + ", ".join(f"coalesce(m_{c}.code, -1)::INTEGER AS {c}" for c in ("shipdate", "bulky", "flag")) + " FROM ship " +
    " ".join(f"LEFT JOIN m_{c} ON CAST(ship.{c} AS VARCHAR) = m_{c}.v" for c in ("shipdate", "bulky", "flag")))(
    lambda spark, d: E.ordinal_fit(fx.ship(spark, d), split_col=None).transform(fx.ship(spark, d)))

# -- classes and ids ---------------------------------------------------------------------
register("issues_distribution_many", "SELECT CAST(l_orderkey AS VARCHAR) AS class, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")(
    lambda spark, d: Q.class_counts(read_table(spark, d, "lineitem"), "l_orderkey"))


def _sizes(df, label):
    return df.groupBy(label, "split").agg(F.count(F.lit(1)).alias("n"))


register("split_no_id", W(fx.LINEITEM_DUPS_SQL, split_sql(
    "(SELECT *, row_number() OVER () AS rid FROM lineitem_dups)", "rid", "l_returnflag", ["l_returnflag"])) +
    "SELECT l_returnflag, split, count(*)::BIGINT AS n FROM splitted GROUP BY ALL")(
    lambda spark, d: _sizes(S.train_test_split(fx.lineitem_dups(spark, d), "l_returnflag", None), "l_returnflag"))
_GUARD = "guard AS (SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'one' ELSE o_orderpriority END AS label FROM orders)"
register("split_guard", W(_GUARD, split_sql("guard", "o_orderkey", "label", ["o_orderkey", "label"], stratify=False)) + "SELECT * FROM splitted")(
    lambda spark, d: _guarded(read_table(spark, d, "orders")))


def _guarded(o):
    first = o.agg(F.min("o_orderkey")).first()[0]
    label = F.when(F.col("o_orderkey") == first, "one").otherwise(F.col("o_orderpriority"))
    return S.train_test_split(o.select("o_orderkey", label.alias("label")), "label", "o_orderkey")


register("split_null_ids", W("x AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS id, o_orderpriority AS label, "
                             "o_orderkey AS k FROM orders)", split_sql("x", "k", "label", ["label"])) +
         "SELECT label, split, count(*)::BIGINT AS n FROM splitted GROUP BY ALL")(
    lambda spark, d: _sizes(S.train_test_split(read_table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("label")), "label", "id"), "label"))
