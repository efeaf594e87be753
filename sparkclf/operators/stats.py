"""Shared statistics passes: fused per-column aggregates, exact quantiles, modes.

Everything here is written so that no single task ever has to hold a whole
column:

* ``column_stats`` is one aggregate with map-side partial aggregation.
* ``exact_quantiles`` uses Spark's exact ``percentile`` only when the column has
  few enough distinct values for its value->count map to fit one task; otherwise mergeable
  rank-error sketches of all columns bracket the target ranks in one scan and one more scan
  counts and picks (each sketch leaves about one row in 1,600, so columns of more than some
  300 million rows take another).
* ``modes`` uses a frequency table and two aggregates (max count, then smallest
  value at that count) instead of ``mode()``, whose buffer is a whole-column map.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The built-in exact percentile keeps a value -> count map of the column in its
# final task, so its memory grows with the number of distinct values.  Columns
# with at most this many (approximate, HLL) distinct values use it in one pass;
# the others use sketch-guided brackets.
SMALL_COLUMN_NDV = 500_000
SKETCH_LEVELS = 2048        # a sketch's rank error is 1 / (4 * levels) of the rows it reads
SKETCHES_PER_SCAN = 128
FINAL_BRACKET_ROWS = 200_000
MODE_BROADCAST_KEYS = 1_000_000


@dataclass
class ColumnStats:
    n: int            # non-null count
    nulls: int
    mean: float | None
    std: float | None        # sample
    std_pop: float | None
    min: object
    max: object
    ndv: int | None = None   # approximate distinct count (numeric columns)


def column_stats(df: DataFrame, cols: list[str], numeric: list[str] | None = None) -> tuple[int, dict]:
    """One aggregate: row count plus non-null/null counts for ``cols`` and
    mean/std/min/max for ``numeric`` columns.  Returns (rows, {col: ColumnStats})."""
    numeric = list(numeric or [])
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        exprs.append(F.count(F.col(c)).alias(f"n{i}"))
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        exprs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                  F.stddev_pop(x).alias(f"p{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                  F.approx_count_distinct(x).alias(f"d{i}")]
    r = df.agg(*exprs).first()
    rows = int(r["__rows"])
    out = {}
    for i, c in enumerate(cols):
        n = int(r[f"n{i}"])
        out[c] = ColumnStats(n, rows - n, None, None, None, None, None)
    for i, c in enumerate(numeric):
        s = out.get(c) or ColumnStats(0, 0, None, None, None, None, None)
        s.mean, s.std, s.std_pop = r[f"m{i}"], r[f"s{i}"], r[f"p{i}"]
        s.min, s.max = r[f"lo{i}"], r[f"hi{i}"]
        s.ndv = int(r[f"d{i}"])
        out[c] = s
    return rows, out


def _long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """(c, x) pairs of non-null values, x as double."""
    stacked = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "c", "x")
    return stacked.where(F.col("x").isNotNull() & ~F.isnan("x"))


def count_and_ndv(df: DataFrame, cols: list[str], bounds: dict | None = None) -> tuple[dict, dict]:
    """One pass: non-null count and approximate distinct count per column
    (and, when a ``bounds`` dict is given, each column's (min, max) into it)."""
    if not cols:
        return {}, {}
    x = [F.col(c).cast("double") for c in cols]
    r = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
               *[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)],
               *[F.min(v).alias(f"lo{i}") for i, v in enumerate(x)],
               *[F.max(v).alias(f"hi{i}") for i, v in enumerate(x)]).first()
    if bounds is not None:
        bounds.update({c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)})
    return ({c: int(r[f"n{i}"]) for i, c in enumerate(cols)}, {c: int(r[f"d{i}"]) for i, c in enumerate(cols)})


def _chunks(cols: list[str], ndv: dict, limit: int) -> list[list[str]]:
    """Columns in order, cut so that the distinct counts of a chunk add up to ``limit`` or are one column's."""
    out, total = [], 0
    for c in cols:
        n = ndv.get(c, 0)
        if not out or total + n > limit:
            out.append([])
            total = 0
        out[-1].append(c)
        total += n
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    counts: dict | None = None, ndv: dict | None = None, small_ndv: int = SMALL_COLUMN_NDV,
                    buckets: int = SKETCH_LEVELS, bounds: dict | None = None) -> dict:
    """Exact linear-interpolation quantiles (pandas ``quantile`` / DuckDB
    ``quantile_cont``) on the non-null values of each column.

    ``counts`` / ``ndv`` (non-null and approximate distinct counts) may come
    from an earlier fused pass; ``buckets`` are the levels of a sketch.  Returns {(col, p): value or None}.
    """
    if not cols:
        return {}
    if counts is None or ndv is None:
        bounds = {} if bounds is None else bounds
        c2, d2 = count_and_ndv(df, cols, bounds)
        counts = counts if counts is not None else c2
        ndv = ndv if ndv is not None else d2
    out = {}
    small = [c for c in cols if ndv.get(c, 0) <= small_ndv]
    large = [c for c in cols if c not in small and counts[c]]
    out.update({(c, p): None for c in cols if c not in small and not counts[c] for p in probs})
    if small:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        # the value maps of one pass meet in one task: their sizes add up to at most small_ndv
        for chunk in _chunks(small, ndv, small_ndv):
            r = df.agg(*[F.percentile(F.col(c).cast("double"), arr).alias(f"q{i}")
                         for i, c in enumerate(chunk)]).first()
            for i, c in enumerate(chunk):
                vals = r[f"q{i}"]
                for j, p in enumerate(probs):
                    out[(c, p)] = None if vals is None or counts[c] == 0 else float(vals[j])
    if large:
        ranks = {}
        for c in large:
            n = counts[c]
            for p in probs:
                h = (n - 1) * p
                k0 = int(math.floor(h))
                ranks[(c, k0)] = None
                ranks[(c, min(k0 + 1, n - 1))] = None
        vals = _select_ranks(df, sorted(ranks), buckets, counts, bounds)
        for c in large:
            n = counts[c]
            for p in probs:
                h = (n - 1) * p
                k0 = int(math.floor(h))
                k1 = min(k0 + 1, n - 1)
                a, b = vals[(c, k0)], vals[(c, k1)]
                out[(c, p)] = a + (h - k0) * (b - a)
    return out


def _select_ranks(df: DataFrame, targets: list[tuple], levels: int, counts: dict, known: dict | None = None) -> dict:
    """k-th smallest value (0-based) for each (col, k) target.

    One scan takes a rank-error sketch of every open window of values (``percentile_approx``, error
    1 / (4 * levels) of the window's rows), which narrows each target to the values between two
    levels.  A window expected to hold at most ``FINAL_BRACKET_ROWS`` rows is finished by one more scan,
    shared by all targets, that counts the rows below it and the values inside.  A heavy value is one
    counted value there, and a bracket that turns out not to hold its rank is taken again, wider.
    ``known`` may carry each column's (min, max) from an earlier pass.
    """
    eps = 1.0 / (4 * levels)
    cols = sorted({c for c, _ in targets})
    whole = {c: tuple((known or {}).get(c) or (None, None)) for c in cols}
    whole = {c: tuple(-math.inf if i == 0 and v is None or v != v else math.inf if v is None else float(v)
                      for i, v in enumerate(b)) for c, b in whole.items()}
    window = {t: whole[t[0]] for t in targets}
    size = {t: counts[t[0]] for t in targets}
    margin = {t: 1.5 * eps for t in targets}
    result = {}
    while len(result) < len(targets):
        left = [t for t in targets if t not in result]
        wide = [t for t in left if size[t] > FINAL_BRACKET_ROWS and window[t][0] < window[t][1] and margin[t] < 0.5]
        if wide:
            for t, found in _narrow(df, wide, window, margin, levels, eps, counts, whole).items():
                window[t], size[t] = found
            continue
        got = _finish(df, left, window)
        result |= got
        for t in left:      # not in its bracket: the sketch was further off than its bound
            if t not in got:
                if window[t] == whole[t[0]]:
                    raise RuntimeError(f"the rows of {t[0]} changed between two scans")
                window[t], size[t], margin[t] = whole[t[0]], counts[t[0]], 4 * margin[t]
    return result


def _narrow(df: DataFrame, targets: list[tuple], window: dict, margin: dict, levels: int, eps: float,
            counts: dict, whole: dict) -> dict:
    """One scan of sketches: {target: ((lo, hi), expected rows)}."""
    asked: dict[tuple, set] = {}
    for t in targets:
        w = (t[0], *window[t])
        if window[t] == whole[t[0]]:       # ranks within the whole column are known before the scan
            p = t[1] / counts[t[0]]
            asked.setdefault(w, set()).update((max(0.0, p - margin[t]), min(1.0, p + margin[t])))
        else:
            asked[w] = {i / levels for i in range(levels + 1)}
    order = sorted(asked)
    out, sketches = {}, {}
    for at in range(0, len(order), SKETCHES_PER_SCAN):
        part, exprs = order[at:at + SKETCHES_PER_SCAN], []
        for i, (c, lo, hi) in enumerate(part):
            x = F.col(c).cast("double")
            there = ~F.isnan(x) & (x >= lo) & (x <= hi)
            exprs += [F.count_if(~F.isnan(x) & (x < lo)).alias(f"b{i}"), F.count_if(there).alias(f"n{i}"),
                      F.percentile_approx(F.when(there, x), F.array(*[F.lit(p) for p in sorted(asked[part[i]])]),
                                          F.lit(4 * levels)).alias(f"q{i}")]
        r = df.agg(*exprs).first()
        for i, w in enumerate(part):
            sketches[w] = (r[f"b{i}"], r[f"n{i}"], list(zip(sorted(asked[w]), r[f"q{i}"] or [])))
    for t in targets:
        lo, hi = window[t]
        below, inside, found = sketches[(t[0], lo, hi)]
        p = (t[1] - below) / max(1, inside)
        under = [q for q in found if q[0] <= p - margin[t] + 1e-12 and q[0] > 0]
        over = [q for q in found if q[0] >= p + margin[t] - 1e-12 and q[0] < 1]
        a, b = (under[-1] if under else (0.0, lo)), (over[0] if over else (1.0, hi))
        expected = int(inside * (b[0] - a[0] + 2 * eps)) + 1
        # a step that does not narrow leaves the window to the finishing scan
        out[t] = ((a[1], b[1]), expected if (a[1], b[1]) != (lo, hi) else 0)
    return out


def _finish(df: DataFrame, targets: list[tuple], window: dict) -> dict:
    """One scan: the values of all windows with their counts and the rows below; ranks are read off on executors."""
    spark = df.sparkSession
    spans: dict[str, list] = {}
    for c, lo, hi in sorted({(t[0], *window[t]) for t in targets}):      # windows that overlap are one
        if spans.get(c) and lo <= spans[c][-1][1]:
            spans[c][-1][1] = max(hi, spans[c][-1][1])
        else:
            spans.setdefault(c, []).append([lo, hi])
    flat = [(i, c, float(lo), float(hi)) for i, (c, lo, hi) in enumerate((c, lo, hi) for c, v in spans.items() for lo, hi in v)]
    own = {t: next(i for i, c, lo, hi in flat if c == t[0] and lo <= window[t][0] <= hi) for t in targets}
    wdf = spark.createDataFrame(flat, "w int, c string, wlo double, whi double")
    ranks = spark.createDataFrame([(own[t], int(t[1]), n) for n, t in enumerate(targets)], "w int, k bigint, target int")
    counted = (_long_numeric(df, sorted(spans)).join(F.broadcast(wdf), "c").where(F.col("x") <= F.col("whi"))
               .groupBy("w", F.when(F.col("x") >= F.col("wlo"), F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("w").orderBy(F.col("v").asc_nulls_first()))
    below = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("n"))).over(Window.partitionBy("w")), F.lit(0))
    got = (counted.select("w", "v", upto.alias("upto"), below.alias("below")).join(F.broadcast(ranks), "w")
           .where(F.col("v").isNotNull() & (F.col("upto") > F.col("k")) & (F.col("below") <= F.col("k")))
           .groupBy("target").agg(F.min("v").alias("x")).collect())       # one number per target
    return {targets[r["target"]]: r["x"] for r in got}


def frequency_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, count) including a NULL group per column; values as text."""
    if not cols:
        schema = "column string, value string, count bigint"
        return df.sparkSession.createDataFrame([], schema)
    stacked = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value")
    return stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def modes(df: DataFrame, cols: list[str], numeric: bool = False) -> DataFrame:
    """Most frequent non-null value per column, smallest value on ties.

    Returns (column, value, count) with value as double (numeric=True) or text.
    Counting groups by ``compact_key`` so long values never travel through
    the shuffle; the value itself is recovered by a second, semi-joined pass
    that takes the smallest value among the keys tied at the top count.
    """
    vt = "double" if numeric else "string"
    if not cols:
        return df.sparkSession.createDataFrame([], f"column string, value {vt}, count bigint")
    if numeric:
        stacked = df.select(*[F.col(c).cast(vt).alias(c) for c in cols]).unpivot(
            [], cols, "column", "value").where(F.col("value").isNotNull())
        freq = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
        top = freq.groupBy("column").agg(F.max("count").alias("count"))
        return (freq.join(top, ["column", "count"])
                .groupBy("column").agg(F.min("value").alias("value"), F.first("count").alias("count"))
                .select("column", "value", "count"))
    from ..functions import compact_key
    from ..session import cut_lineage
    stacked = df.select(*[F.col(c).cast(vt).alias(c) for c in cols]).unpivot(
        [], cols, "column", "value").where(F.col("value").isNotNull())
    keyed = stacked.withColumn("key", compact_key("value"))
    freq = keyed.groupBy("column", "key").agg(F.count(F.lit(1)).alias("count"))
    top = freq.groupBy("column").agg(F.max("count").alias("count"))
    tops = {r["column"]: r["count"] for r in top.collect()}          # one row per column
    once = [c for c in cols if tops.get(c) == 1]
    if once:      # every value is tied: the smallest one is a map-side minimum, nothing else travels
        low = df.agg(*[F.min(F.col(c).cast(vt)).alias(c) for c in once]).unpivot([], once, "column", "value")
        low = low.withColumn("count", F.lit(1).cast("bigint"))
        rest = [c for c in cols if c in tops and c not in once]
        return low.unionByName(modes(df, rest)) if rest else low
    tied = cut_lineage(freq.join(F.broadcast(top), ["column", "count"]).select("column", "key"))
    # A bounded tied set is broadcast (map-side semi-join: a hot value never
    # lands in one task).  A large tied set means every tied key has a small
    # count (ties x top count <= rows), so the shuffled semi-join has no hot key.
    n_tied = tied.count()
    tied_side = F.broadcast(tied) if n_tied <= MODE_BROADCAST_KEYS else tied
    return (keyed.join(tied_side, ["column", "key"], "left_semi").join(F.broadcast(top), "column")
            .groupBy("column").agg(F.min("value").alias("value"), F.first("count").alias("count"))
            .select("column", "value", "count"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact non-null distinct count per column: (column, n_unique).

    Values are reduced to ``compact_key`` (short values kept, long ones as a
    128-bit digest) so long texts do not travel through the shuffle; the
    distinct itself is a two-stage aggregate (map-side de-duplication, then a
    count per column).
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint")
    from ..functions import compact_key
    stacked = df.select(*[compact_key(c).alias(c) for c in cols]).unpivot(
        [], cols, "column", "digest").where(F.col("digest").isNotNull())
    cnt = stacked.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(cnt, "column", "left").select(
        "column", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"))


RANK_ROWS_PER_PARTITION = 1_000_000


def global_positions(df: DataFrame, order_col: str, out_col: str = "pos", rows: int | None = None,
                     per_partition: int | None = None) -> DataFrame:
    """0-based position of every row in ``order_col`` order (values distinct),
    without a single-task global window: rows are range-partitioned, numbered
    inside each partition, and shifted by the row counts of earlier partitions
    (a table with one row per partition)."""
    if rows is None:
        rows = df.count()
    nparts = max(1, -(-rows // (per_partition or RANK_ROWS_PER_PARTITION)))
    from ..session import cut_lineage
    # numbered and counted from one checkpoint, so the sampled bounds cannot differ between the two
    r = cut_lineage(df.repartitionByRange(nparts, order_col).withColumn("__pid", F.spark_partition_id()))
    sizes = r.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offs = sizes.select("__pid", F.coalesce(F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    w = Window.partitionBy("__pid").orderBy(order_col)
    return (r.join(F.broadcast(offs), "__pid")
            .withColumn(out_col, (F.col("__off") + F.row_number().over(w) - 1).cast("int"))
            .drop("__pid", "__off"))
