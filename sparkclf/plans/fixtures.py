"""Analysis tables derived from the base tables, each with its DuckDB twin.

Every table here is a Spark plan over the given parquet tables, so its work
grows with them.  The ``*_SQL`` strings define the same table for the DuckDB
oracle (used as a CTE in ``oracle_sql``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from ..functions import normalize_missing


def doc_clf(spark: SparkSession, d: str) -> DataFrame:
    """documents joined with labels; target ``quality``."""
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars", "text", "lang", "source")
    labels = read_table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id")


DOC_CLF_SQL = ("doc_clf AS (SELECT d.doc_id, d.n_chars, d.text, d.lang, d.source, l.quality "
               "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


def orders_dirty(spark: SparkSession, d: str) -> DataFrame:
    """orders with injected missing values, number-like text and a constant column."""
    o = read_table(spark, d, "orders")
    k = F.col("o_orderkey")
    price_txt = F.concat(F.lit(" "), F.replace(F.format_string("%.2f", F.col("o_totalprice")),
                                               F.lit("."), F.lit(",")), F.lit(" "))
    return o.select(
        k.alias("id"),
        F.when(k % 17 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 13 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 7 == 0, F.lit("n/a")).otherwise(price_txt).alias("price_text"),
        F.col("o_orderpriority").alias("priority"),
        F.lit("k").alias("k"))


ORDERS_DIRTY_SQL = (
    "orders_dirty AS (SELECT o_orderkey AS id, "
    "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS status, "
    "CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS price, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' "
    "ELSE ' ' || replace(printf('%.2f', o_totalprice), '.', ',') || ' ' END AS price_text, "
    "o_orderpriority AS priority, 'k' AS k FROM orders)")


def lineitem_dups(spark: SparkSession, d: str) -> DataFrame:
    """Five-column projection of lineitem: many duplicate rows."""
    return read_table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")


LINEITEM_DUPS_SQL = ("lineitem_dups AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax "
                     "FROM lineitem)")


def lineitem_num(spark: SparkSession, d: str) -> DataFrame:
    """Numeric measures of lineitem (correlation, scaling, outliers)."""
    return read_table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


LINEITEM_NUM_SQL = ("lineitem_num AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber "
                    "FROM lineitem)")


def emb_clf(spark: SparkSession, d: str) -> DataFrame:
    """embeddings; features ``embedding`` (array<float>), target ``label``."""
    return read_table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def events_num(spark: SparkSession, d: str) -> DataFrame:
    return normalize_missing(read_table(spark, d, "events").select("event_id", "user_id", "value"))


EVENTS_NUM_SQL = "events_num AS (SELECT event_id, user_id, value FROM events)"


def preds_bin(spark: SparkSession, d: str) -> DataFrame:
    """Binary predictions over labels: score = uniform(doc_id), y_pred = score >= 0.5."""
    from ..functions import uniform
    lab = read_table(spark, d, "labels")
    s = uniform("doc_id")
    return lab.select("doc_id", F.col("quality").alias("y_true"), s.alias("score"),
                      (s >= 0.5).cast("int").alias("y_pred"))


U_SQL = "(('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"

PREDS_BIN_SQL = ("preds_bin AS (SELECT doc_id, quality AS y_true, " + U_SQL.format(k="doc_id") +
                 " AS score, CAST(" + U_SQL.format(k="doc_id") + " >= 0.5 AS INTEGER) AS y_pred FROM labels)")


def preds_multi(spark: SparkSession, d: str) -> DataFrame:
    """Multiclass predictions over orders: every third order is predicted '1-URGENT'."""
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("y_true"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.lit("1-URGENT"))
                    .otherwise(F.col("o_orderpriority")).alias("y_pred"))


PREDS_MULTI_SQL = ("preds_multi AS (SELECT o_orderkey AS id, o_orderpriority AS y_true, "
                   "CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS y_pred "
                   "FROM orders)")


def orders_nan(spark: SparkSession, d: str) -> DataFrame:
    """orders with NaN and NULL side by side: outliers in ``price``, a constant with NaN in ``flat``."""
    o = read_table(spark, d, "orders")
    k, nan = F.col("o_orderkey"), F.lit(float("nan"))
    price = F.when(k % 101 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice"))
    return o.select(
        k.alias("id"),
        F.when(k % 13 == 0, nan).when(k % 17 == 0, F.lit(None).cast("double")).otherwise(price).alias("price"),
        F.when(k % 7 == 0, nan).otherwise(F.col("o_custkey").cast("double")).alias("load"),
        F.when(k % 5 == 0, nan).otherwise(F.lit(1.0)).alias("flat"),
        F.col("o_orderpriority").alias("priority"))


ORDERS_NAN_SQL = (
    "orders_nan AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL "
    "WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price, "
    "CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey::DOUBLE END AS load, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN 1.0::DOUBLE END AS flat, o_orderpriority AS priority FROM orders)")


def ship(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a timestamp and a boolean column, both with gaps."""
    k = F.col("l_orderkey")
    return read_table(spark, d, "lineitem").select(
        k.alias("id"), F.col("l_linenumber").alias("line"), F.when(k % 11 != 0, F.col("l_shipdate")).alias("shipdate"),
        F.when(k % 13 != 0, F.col("l_quantity") > 25).alias("bulky"), F.col("l_returnflag").alias("flag"))


SHIP_SQL = ("ship AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_orderkey % 11 <> 0 THEN l_shipdate END AS shipdate, "
            "CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity > 25 END AS bulky, l_returnflag AS flag FROM lineitem)")
