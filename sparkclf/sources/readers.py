"""Readers: CSV with header and inferred types (fail fast on malformed rows), parquet."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text tokens a pandas CSV read treats as missing.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with a header row.

    Missing-value tokens are turned into NULL before type inference: the file
    is read as text, tokens are nulled, and each column is cast to the
    narrowest of int/bigint/double that every remaining value parses as (one
    aggregate), else kept as text.  A malformed row aborts the read.
    """
    raw = (spark.read.option("header", True).option("mode", "FAILFAST")
           .option("inferSchema", False).csv(path))
    cols = raw.columns
    nulled = raw.select(*[F.when(F.col(c).isin(list(NULL_TOKENS)), None).otherwise(F.col(c)).alias(c)
                          for c in cols])
    if not infer:
        return nulled
    checks = []
    for i, c in enumerate(cols):
        x = F.col(c)
        checks += [F.count(x).alias(f"n{i}"),
                   F.count(x.try_cast("int")).alias(f"i{i}"),
                   F.count(x.try_cast("bigint")).alias(f"l{i}"),
                   F.count(F.when(x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), 1)).alias(f"d{i}"),
                   F.count(F.when(F.lower(x).isin("true", "false"), 1)).alias(f"b{i}")]
    r = nulled.agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        if n == 0:
            out.append(F.col(c).cast("double").alias(c))
        elif r[f"i{i}"] == n:
            out.append(F.col(c).cast("int").alias(c))
        elif r[f"l{i}"] == n:
            out.append(F.col(c).cast("bigint").alias(c))
        elif r[f"d{i}"] == n:
            out.append(F.col(c).cast("double").alias(c))
        elif r[f"b{i}"] == n:
            out.append((F.lower(F.col(c)) == "true").alias(c))
        else:
            out.append(F.col(c))
    return nulled.select(*out)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on extension: .csv -> ``read_csv``, otherwise parquet."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def raw_and_processed(spark: SparkSession, path: str, threshold: float = 0.5, persist: bool = True):
    """The raw table and its cleaned / numerically coerced twin, side by side.

    Profiling reads the processed table; issue detection and preprocessing read
    the raw one.  The raw table is persisted because both derive from it and it
    is scanned by several passes."""
    from ..operators.profile import clean_and_coerce
    from ..functions import normalize_missing
    raw = normalize_missing(read_path(spark, path))
    if persist:
        raw = raw.persist()
    return raw, clean_and_coerce(raw, threshold)
