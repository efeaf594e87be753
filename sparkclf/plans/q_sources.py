"""Registered source/sink queries: CSV written by Spark from a given table and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import capitalize, date_text, fmt_thousands, shorten, split_once, title_case
from ..operators.metrics import rank_models
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import read_csv, read_table, write_csv, write_report
from . import fixtures as fx
from .catalog import register
from .q_evaluate import RESULTS_SQL, zoo_results
from .q_profile import W
from .q_report import _sections, _sections_sql


def _scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drop(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _through(spark, path, df):
    """The table as read from ``path``, kept in the checkpoint folder; the files themselves are removed."""
    out = cut_lineage(df)
    _drop(spark, path)
    return out


def _csv_roundtrip(spark, d):
    """orders_dirty -> CSV (partitioned output in the shared checkpoint folder) -> typed read."""
    path = _scratch(spark, "csv")
    write_csv(fx.orders_dirty(spark, d), path)
    return _through(spark, path, read_csv(spark, path))


def _leaderboard_csv(spark, d):
    """Ranked results -> one CSV file -> typed read."""
    path = _scratch(spark, "leaderboard")
    write_csv(rank_models(zoo_results(spark, d), "f1_weighted").select("rank", "model", "f1_weighted"), path, single_file=True)
    return _through(spark, path, read_csv(spark, path))


def _report_sink(spark, d):
    """The long report table through its JSON sink."""
    path = _scratch(spark, "report")
    df = _sections(spark, d)
    write_report(df, path, "json")
    return _through(spark, path, spark.read.schema(df.schema).json(path).select(*df.columns))


register("sink_leaderboard_csv", RESULTS_SQL + "SELECT row_number() OVER (ORDER BY f1_weighted DESC NULLS LAST, model)::INTEGER AS rank, "
         "model, f1_weighted FROM results", rnd=("f1_weighted",))(_leaderboard_csv)
register("sink_report", _sections_sql())(_report_sink)
register("scalar_text",
         "SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS capital, "
         "CASE WHEN length(c_name) > 12 THEN left(c_name, 12) || '...' ELSE c_name END AS short_name, "
         "string_split(c_name, '#')[2] AS number, format('{:,}', round(abs(c_acctbal) * 1000)::BIGINT) AS thousands FROM customer")(
    lambda spark, d: read_table(spark, d, "customer").select(
        "c_custkey", capitalize("c_mktsegment").alias("capital"), shorten("c_name", 12).alias("short_name"),
        F.get(split_once("c_name", "#"), F.lit(1)).alias("number"),
        fmt_thousands(F.round(F.abs(F.col("c_acctbal")) * 1000)).alias("thousands")))
register("scalar_title",
         "SELECT c_custkey, array_to_string(list_transform(string_split(replace(lower(c_mktsegment) || '_market_of_' || c_nationkey, '_', ' '), ' '), "
         "lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM customer")(
    lambda spark, d: read_table(spark, d, "customer").select(
        "c_custkey", title_case(F.concat(F.lower("c_mktsegment"), F.lit("_market_of_"), F.col("c_nationkey").cast("string"))).alias("title")))
register("scalar_dates", "SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS day FROM orders")(
    lambda spark, d: read_table(spark, d, "orders").select("o_orderkey", date_text("o_orderdate").alias("day")))


# The reader trims nothing and turns the missing-value tokens ('n/a', '', ...) into NULL;
# numbers are inferred per column (int, bigint, double), text stays text.
register("source_csv_roundtrip",
         W(fx.ORDERS_DIRTY_SQL) + "SELECT id::INTEGER AS id, status, price, "
         "CASE WHEN price_text = 'n/a' THEN NULL ELSE price_text END AS price_text, priority, k FROM orders_dirty",
         rnd=("price",))(_csv_roundtrip)
