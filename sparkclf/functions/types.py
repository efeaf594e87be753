"""Column classes by type and the NaN -> NULL normalisation.

The type classes mirror how a pandas user partitions a frame:
numeric (ints, floats, decimals; not boolean, not time), categorical (strings
and booleans), report-categorical (strings only) and non-numeric (everything
that is not numeric).
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    """Strings and booleans (profile and issue detection)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def report_categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    """Strings only (report statistics)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return report_categorical_columns(df, exclude)


def non_numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Everything that is not numeric: strings, booleans, dates, timestamps."""
    return [f.name for f in df.schema.fields
            if not is_numeric_type(f.dataType)
            and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
            and f.name not in exclude]


def normalize_missing(df: DataFrame) -> DataFrame:
    """Map NaN to NULL on float/double columns so NaN and NULL are one notion.

    The result is marked, so operators that call each other project once.
    """
    if getattr(df, "_missing_is_null", False):
        return df
    floats = [f for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if floats:
        names = {f.name for f in floats}
        df = df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name) if f.name in names
                         else F.col(f"`{f.name}`") for f in df.schema.fields])
    df._missing_is_null = True
    return df


def missing_as_null(op):
    """Operator decorator: its first argument reaches it with NaN as NULL."""
    @functools.wraps(op)
    def run(df, *args, **kwargs):
        return op(normalize_missing(df), *args, **kwargs)
    return run
