"""Cleaning steps: duplicates, constant columns, missing values, outliers.

Fitted steps (imputation values, IQR bounds) run one aggregate over the table
and apply the result as literals in a single projection.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import missing_as_null, non_numeric_columns, numeric_columns
from .profile import iqr_bounds
from .stats import exact_quantiles, modes

IMPUTE_METHODS = ("drop_rows", "drop_columns", "mean", "median", "mode", "constant")


@missing_as_null
def drop_duplicates(df: DataFrame, apply: bool = True) -> DataFrame:
    """Full-row de-duplication (which copy survives is immaterial)."""
    return df.dropDuplicates() if apply else df


def drop_constant(df: DataFrame, columns: list[str] | None, protect=()) -> DataFrame:
    """Drop the listed columns that exist; never the protected ones (target)."""
    cols = [c for c in (columns or []) if c in df.columns and c not in protect]
    return df.drop(*cols) if cols else df


def _null_counts(df: DataFrame, cols) -> dict:
    if not cols:
        return {}
    r = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c: int(r[f"n{i}"]) for i, c in enumerate(cols)}


@missing_as_null
def impute(df: DataFrame, method: str = "median", constant_value=None, exclude=()) -> DataFrame:
    """Fill or drop missing values.

    drop_rows / drop_columns; mean or median for numeric columns plus the mode
    for the rest; mode everywhere; or one constant (float for numeric columns,
    0.0 when it does not parse; text otherwise, 'missing' when absent).
    Numeric columns that get filled become double.
    """
    if method not in IMPUTE_METHODS:
        raise ValueError(f"unknown imputation method {method!r}")
    cols = [c for c in df.columns if c not in exclude]
    if method == "drop_rows":
        return df.dropna(how="any", subset=cols or None)
    nulls = _null_counts(df, cols)
    if method == "drop_columns":
        return df.drop(*[c for c in cols if nulls[c] > 0])
    gaps = [c for c in cols if nulls[c] > 0]
    if not gaps:
        return df
    nums = [c for c in numeric_columns(df) if c in gaps]
    others = [c for c in gaps if c not in nums and c in non_numeric_columns(df)]
    fill: dict = {}
    if method == "mean":
        r = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in nums]).first() if nums else {}
        fill.update({c: r[c] for c in nums})
    elif method == "median":
        q = exact_quantiles(df, nums, [0.5])
        fill.update({c: q[(c, 0.5)] for c in nums})
    elif method == "mode":
        for r in modes(df, nums, numeric=True).collect():
            fill[r["column"]] = r["value"]
    if method in ("mean", "median", "mode"):
        for r in modes(df, others).collect():
            fill[r["column"]] = r["value"]
    if method == "constant":
        try:
            v = float(constant_value) if constant_value is not None else 0.0
        except (TypeError, ValueError):
            v = 0.0
        fill.update({c: v for c in nums})
        fill.update({c: str(constant_value) if constant_value is not None else "missing" for c in others})
    out = []
    for c in df.columns:
        if c in fill and fill[c] is not None:
            if c in nums:
                out.append(F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))).alias(c))
            else:
                dt = df.schema[c].dataType
                val = F.lit(fill[c]).cast(dt) if not isinstance(dt, T.StringType) else F.lit(str(fill[c]))
                out.append(F.coalesce(F.col(c), val).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@missing_as_null
def cap_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clip the chosen numeric columns to their IQR bounds; NULL stays NULL."""
    cols = [c for c in columns or [] if c in numeric_columns(df)]
    if not cols:
        return df
    b = iqr_bounds(df, cols)
    out = []
    for c in df.columns:
        if c in cols and b[c][0] is not None:
            lo, hi = F.lit(b[c][2]), F.lit(b[c][3])
            x = F.col(c).cast("double")
            out.append(F.when(x.isNull(), F.lit(None).cast("double"))
                       .otherwise(F.least(F.greatest(x, lo), hi)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@missing_as_null
def remove_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows outside the IQR bounds of any chosen column (bounds from the
    table before removal; NULL comparisons keep the row)."""
    cols = [c for c in columns or [] if c in numeric_columns(df)]
    if not cols:
        return df
    b = iqr_bounds(df, cols)
    cond = F.lit(False)
    for c in cols:
        if b[c][0] is None:
            continue
        x = F.col(c).cast("double")
        cond = cond | F.coalesce((x < F.lit(b[c][2])) | (x > F.lit(b[c][3])), F.lit(False))
    return df.where(~cond)


def handle_outliers(df: DataFrame, columns: list[str] | None, method: str = "none") -> DataFrame:
    if not columns or method == "none":
        return df
    if method == "cap":
        return cap_outliers(df, columns)
    if method == "remove":
        return remove_outliers(df, columns)
    return df


@missing_as_null
def iqr_bounds_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, q1, q3, low, high) per numeric column."""
    b = iqr_bounds(df, cols)
    rows = [(c, v[0], v[1], v[2], v[3]) for c, v in b.items()]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double, low double, high double")
