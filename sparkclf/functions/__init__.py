"""Column-level helpers (all built from ``pyspark.sql.functions``; no Python UDFs)."""
from .scalar import (  # noqa: F401
    NUMBER_PATTERN,
    capitalize,
    clean_text,
    compact_key,
    date_text,
    fmt_fixed,
    fmt_pct,
    fmt_thousands,
    hash32,
    num,
    safe_div,
    shorten,
    split_once,
    title_case,
    uniform,
)
from .types import (  # noqa: F401
    categorical_columns,
    is_numeric_type,
    missing_as_null,
    non_numeric_columns,
    normalize_missing,
    numeric_columns,
    report_categorical_columns,
    string_columns,
)
