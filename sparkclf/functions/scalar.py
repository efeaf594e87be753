"""Scalar column expressions shared by every operator."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text form of a plain decimal number accepted by ``num``.
# Spark alone would also accept '1d' or '1.5f', DuckDB would accept '1_0'; the
# guard keeps both engines (and pandas' to_numeric) in agreement.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

_TWO32 = 4294967296.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """Parse text as a double; anything that is not a plain number becomes NULL."""
    s = _c(c).cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def clean_text(c) -> Column:
    """Trim all whitespace, collapse inner runs to one space, ',' -> '.', 'nan' -> NULL."""
    s = _c(c).cast("string")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.replace(s, F.lit(","), F.lit("."))
    return F.nullif(s, F.lit("nan"))


def hash32(key, seed: int = 42) -> Column:
    """First 32 bits of md5('<seed>:<key>') as a non-negative bigint (deterministic draw)."""
    txt = F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint")


def uniform(key, seed: int = 42) -> Column:
    """Deterministic uniform draw in [0, 1) from ``hash32``."""
    return hash32(key, seed).cast("double") / F.lit(_TWO32)


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (never raises under ANSI mode)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def fmt_fixed(c, digits: int) -> Column:
    """Round half-up first, then print with a fixed number of decimals.

    Rounding before printing keeps Spark's and DuckDB's text identical even when
    the binary value sits exactly on a half.
    """
    return F.format_string(f"%.{digits}f", F.round(_c(c).cast("double"), digits))


def fmt_pct(c, digits: int = 1, scale: float = 100.0) -> Column:
    """Percentage text such as '87.5%'."""
    v = F.round(_c(c).cast("double") * F.lit(scale), digits)
    return F.format_string(f"%.{digits}f%%", v)


def compact_key(c) -> Column:
    """Grouping key for a text value that is never longer than 17 bytes:
    values of up to 16 bytes are kept as they are (tag 0x00), longer ones are
    replaced by their 128-bit md5 (tag 0x01).  NULL stays NULL."""
    s = _c(c).cast("string")
    raw = F.encode(s, "UTF-8")
    return F.when(s.isNull(), F.lit(None).cast("binary")).when(
        F.octet_length(s) <= 16, F.concat(F.unhex(F.lit("00")), raw)).otherwise(
        F.concat(F.unhex(F.lit("01")), F.unhex(F.md5(s))))


def title_case(c) -> Column:
    """'f1_weighted' -> 'F1 Weighted'."""
    return F.initcap(F.replace(_c(c), F.lit("_"), F.lit(" ")))


def capitalize(c) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.left(_c(c), F.lit(1))), F.lower(F.substring(_c(c), 2, 2147483647)))


def shorten(c, n: int = 12) -> Column:
    """The first ``n`` characters and an ellipsis where the text is longer."""
    return F.when(F.length(_c(c)) > n, F.concat(F.left(_c(c), F.lit(n)), F.lit("..."))).otherwise(_c(c))


def split_once(c, sep: str) -> Column:
    """array(text before the first ``sep``, text behind it), or array(text)."""
    return F.split(_c(c), f"\\Q{sep}\\E", 2)


def fmt_thousands(c) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(_c(c), 0)


def date_text(c=None) -> Column:
    """A date as 'January 05, 2026'; today's by default."""
    return F.date_format(F.current_timestamp() if c is None else _c(c), "MMMM dd, yyyy")
