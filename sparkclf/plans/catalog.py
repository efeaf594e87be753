"""Catalog of registered queries over the given tables.

Each entry is ``name -> Entry(fn, sql, rnd)``: ``fn(spark, sf_dir)`` builds the
Spark result; ``sql`` is the DuckDB twin used as the correctness oracle (None
when the result is not expressible in SQL, e.g. an iterative model fit); ``rnd``
lists double columns rounded to 6 decimals on both sides.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


@dataclass
class Entry:
    fn: Callable
    sql: str | None
    rnd: tuple


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, rnd=()):
    def deco(fn):
        CATALOG[name] = Entry(fn, sql, tuple(rnd))
        return fn
    return deco


def rounded(df: DataFrame, cols) -> DataFrame:
    if not cols:
        return df
    return df.select(*[F.round(F.col(c), DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])


def spark_queries() -> dict:
    def bind(e):
        return lambda spark, d: rounded(e.fn(spark, d), e.rnd)
    return {n: bind(e) for n, e in CATALOG.items()}


def oracle_queries() -> dict:
    out = {}
    for n, e in CATALOG.items():
        if e.sql is None:
            continue
        if e.rnd:
            rep = ", ".join(f'round("{c}", {DIGITS}) AS "{c}"' for c in e.rnd)
            out[n] = f"SELECT * REPLACE ({rep}) FROM ({e.sql}) AS q"
        else:
            out[n] = e.sql
    return out


def load_all():
    """Import every module that registers queries."""
    import importlib
    for m in ("q_profile", "q_quality", "q_prepare", "q_edges", "q_models", "q_evaluate", "q_report", "q_sources", "q_train"):
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
    return CATALOG


def clear_caches():
    """Forget per-session memoised results (model zoo, training runs)."""
    from . import zoo
    zoo._CACHE.clear()
    try:
        from . import q_train
        q_train._RUNS.clear()
    except ImportError:
        pass
