"""Sinks: CSV and parquet writers (partitioned output, no single-file funnel)."""
from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> str:
    """Header CSV, no index column.  ``single_file`` is only for tiny tables
    (e.g. a leaderboard); large tables keep one file per partition."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Report sink: the long (section, item, metric, value) table as JSON or parquet."""
    w = report.write.mode(mode)
    (w.json if fmt == "json" else w.parquet)(path)
    return path
