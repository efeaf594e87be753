"""Profile (EDA) operators.

Each operator takes any DataFrame and returns a small result DataFrame.  Work
that needs statistics first (quantiles, means) runs those as one fused
aggregate and then builds the final projection with the statistics as
literals, so every column is profiled in a fixed number of passes instead of
one pass per column.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (categorical_columns, clean_text, missing_as_null, num, numeric_columns,
                         safe_div, string_columns)
from .stats import column_stats, count_and_ndv, distinct_counts, exact_quantiles, frequency_table, modes

# ---------------------------------------------------------------------------
# B1-B3: preview, shape, schema


@missing_as_null
def preview(df: DataFrame, key: str | list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by ``key`` (Spark has no row order, so the key is required)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """Two rows: ('Rows', n) and ('Columns', k)."""
    k = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(F.array(
            F.struct(F.lit("Rows").alias("metric"), F.col("rows").cast("bigint").alias("count")),
            F.struct(F.lit("Columns").alias("metric"), F.lit(k).cast("bigint").alias("count")),
        )).alias("s")).select("s.metric", "s.count")


def _dtype_name(dt: T.DataType) -> str:
    """pandas-style dtype name of a Spark type."""
    if isinstance(dt, T.LongType):
        return "int64"
    if isinstance(dt, T.IntegerType):
        return "int32"
    if isinstance(dt, T.ShortType):
        return "int16"
    if isinstance(dt, T.ByteType):
        return "int8"
    if isinstance(dt, (T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.FloatType):
        return "float32"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "datetime64[ns]"
    return "object"


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, data_type) with pandas-style dtype names."""
    rows = [(i + 1, f.name, _dtype_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, data_type string")


# ---------------------------------------------------------------------------
# B4: describe(include='all'), transposed


@missing_as_null
def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: count, unique, top, freq, mean, std, min, q25, q50, q75, max.

    Numeric columns fill the numeric fields; all other columns fill
    unique/top/freq.  Ties for ``top`` go to the smallest value.
    """
    spark = df.sparkSession
    cols = df.columns
    nums = numeric_columns(df)
    others = [c for c in cols if c not in nums and not isinstance(
        df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    _, st = column_stats(df, cols, nums)
    qs = exact_quantiles(df, nums, [0.25, 0.5, 0.75], counts={c: st[c].n for c in nums},
                         ndv={c: st[c].ndv for c in nums}, bounds={c: (st[c].min, st[c].max) for c in nums})
    num_rows = [(c, st[c].n, st[c].mean, st[c].std, _f(st[c].min), qs[(c, 0.25)], qs[(c, 0.5)],
                 qs[(c, 0.75)], _f(st[c].max)) for c in nums]
    ndf = spark.createDataFrame(
        num_rows, "column string, count bigint, mean double, std double, min double, "
                  "q25 double, q50 double, q75 double, max double")
    cat = (distinct_counts(df, others).join(modes(df, others), "column", "left")
           .select("column", "n_unique", F.col("value").alias("top"), F.col("count").alias("freq")))
    counts = spark.createDataFrame([(c, st[c].n) for c in cols], "column string, count bigint")
    order = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, column string")
    return (order.join(counts, "column")
            .join(cat, "column", "left").join(ndf.drop("count"), "column", "left")
            .select("position", "column", "count", F.col("n_unique").alias("unique"), "top",
                    "freq", "mean", "std", "min", "q25", "q50", "q75", "max"))


def _f(v):
    return None if v is None else float(v)


# ---------------------------------------------------------------------------
# B5: missing values


@missing_as_null
def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_percentage) in one aggregate."""
    cols = df.columns
    n = F.count(F.lit(1))
    agg = df.agg(n.alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}")
                                    for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.col(f"m{i}").cast("bigint").alias("missing_count"))
               for i, c in enumerate(cols)]
    return (agg.select("__n", F.explode(F.array(*entries)).alias("e"))
            .select("e.position", "e.column", "e.missing_count",
                    F.coalesce(safe_div(F.col("e.missing_count") * 100.0, F.col("__n")),
                               F.lit(0.0)).alias("missing_percentage")))


@missing_as_null
def missing_overall(df: DataFrame) -> DataFrame:
    """One row: total_missing, total_cells, overall_percentage (Σmissing / (rows·cols))."""
    cols = df.columns
    total = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    return df.agg(total.cast("bigint").alias("total_missing"),
                  (F.count(F.lit(1)) * F.lit(len(cols))).cast("bigint").alias("total_cells")).select(
        "total_missing", "total_cells",
        F.coalesce(safe_div(F.col("total_missing") * 100.0, F.col("total_cells")),
                   F.lit(0.0)).alias("overall_percentage"))


# ---------------------------------------------------------------------------
# B6-B8: outliers


@missing_as_null
def iqr_bounds(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, counts: dict | None = None,
               ndv: dict | None = None) -> dict:
    """{col: (q1, q3, low, high, non_null_count)} on non-null values.

    ``counts`` (non-null count per column) can come from an earlier fused pass."""
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return {}
    bounds: dict = {}
    if counts is None or ndv is None:
        counts, ndv = count_and_ndv(df, cols, bounds)
    qs = exact_quantiles(df, cols, [0.25, 0.75], counts=counts, ndv=ndv, bounds=bounds)
    out = {}
    for c in cols:
        q1, q3 = qs[(c, 0.25)], qs[(c, 0.75)]
        if q1 is None:
            out[c] = (None, None, None, None, counts[c])
        else:
            iqr = q3 - q1
            out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr, counts[c])
    return out


@missing_as_null
def outliers_iqr(df: DataFrame, cols: list[str] | None = None, counts: dict | None = None,
                 ndv: dict | None = None) -> DataFrame:
    """(column, outlier_count, percentage): strict < low or > high; IQR 0 -> 0."""
    cols = numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, outlier_count bigint, percentage double")
    b = iqr_bounds(df, cols, counts=counts, ndv=ndv)
    exprs = []
    for i, c in enumerate(cols):
        q1, q3, lo, hi, n = b[c]
        if q1 is None or q3 - q1 == 0:
            exprs.append(F.lit(0).cast("bigint").alias(f"o{i}"))
        else:
            x = F.col(c).cast("double")
            exprs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).cast("bigint").alias(f"o{i}"))
    r = df.agg(*exprs).first()
    rows = [(i, c, int(r[f"o{i}"]), (100.0 * r[f"o{i}"] / b[c][4]) if b[c][4] else 0.0)
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "position int, column string, outlier_count bigint, "
                                       "percentage double").drop("position")


@missing_as_null
def outliers_zscore(df: DataFrame, cols: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """(column, outlier_count, percentage): |x-mean|/std_sample > z; std 0 or NULL -> 0."""
    cols = numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, outlier_count bigint, percentage double")
    _, st = column_stats(df, cols, cols)
    exprs = []
    for i, c in enumerate(cols):
        s = st[c]
        if not s.std:
            exprs.append(F.lit(0).cast("bigint").alias(f"o{i}"))
        else:
            x = F.col(c).cast("double")
            exprs.append(F.count_if(F.abs((x - F.lit(s.mean)) / F.lit(s.std)) > F.lit(z))
                         .cast("bigint").alias(f"o{i}"))
    r = df.agg(*exprs).first()
    rows = [(c, int(r[f"o{i}"]), (100.0 * r[f"o{i}"] / st[c].n) if st[c].n else 0.0)
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "column string, outlier_count bigint, percentage double")


@missing_as_null
def outlier_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Both methods side by side: (column, iqr_count, iqr_percentage, z_count, z_percentage)."""
    a = outliers_iqr(df, cols).select("column", F.col("outlier_count").alias("iqr_count"),
                                      F.col("percentage").alias("iqr_percentage"))
    b = outliers_zscore(df, cols).select("column", F.col("outlier_count").alias("z_count"),
                                         F.col("percentage").alias("z_percentage"))
    return a.join(F.broadcast(b), "column")


# ---------------------------------------------------------------------------
# B9-B10: histogram and kernel density


MAX_AUTO_BINS = 100_000     # a bin table stays this small whatever the Freedman-Diaconis width


def auto_bins(df: DataFrame, st: dict, cols: list[str]) -> dict:
    """{col: bin count}: the smaller width of Sturges, range / (log2 n + 1), and
    Freedman-Diaconis, 2 IQR / n^(1/3) (left out where the IQR is 0); at least 1 wide on integers."""
    b = iqr_bounds(df, cols, counts={c: st[c].n for c in cols}, ndv={c: st[c].ndv for c in cols})
    out = {}
    for c in cols:
        n, span = st[c].n, (float(st[c].max) - float(st[c].min)) if st[c].n else 0.0
        if not n or span == 0:
            out[c] = 1
            continue
        width, iqr = span / (math.log2(n) + 1), b[c][1] - b[c][0]
        if iqr > 0:
            width = min(width, 2 * iqr / n ** (1 / 3))
        if isinstance(df.schema[c].dataType, T.IntegralType):
            width = max(width, 1.0)
        out[c] = min(MAX_AUTO_BINS, max(1, math.ceil(span / width)))
    return out


@missing_as_null
def histogram(df: DataFrame, cols: list[str] | None = None, bins: int | str = "auto") -> DataFrame:
    """(column, bin, bin_lo, bin_hi, count) on non-null values, empty bins included.

    ``bins`` is a number, 'auto' (see ``auto_bins``) or 'sturges' (ceil(log2 n) + 1).
    The top edge belongs to the last bin.
    """
    cols = numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    _, st = column_stats(df, cols, cols)
    auto = auto_bins(df, st, cols) if bins == "auto" else {}
    spec = []
    for c in cols:
        s = st[c]
        if s.n == 0:
            continue
        k = auto.get(c) or (int(math.ceil(math.log2(s.n))) + 1 if bins == "sturges" else int(bins))
        spec.append((c, float(s.min), float(s.max), k))
    if not spec:
        return spark.createDataFrame([], "column string, bin int, bin_lo double, bin_hi double, count bigint")
    sdf = spark.createDataFrame(spec, "column string, lo double, hi double, k int")
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column", "x").where(F.col("x").isNotNull())
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width).cast("int") + 1, F.col("k")))
    counts = (long.join(F.broadcast(sdf), "column").groupBy("column", b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = sdf.select("column", "lo", "hi", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.col("k")
    return (grid.join(counts, ["column", "bin"], "left")
            .select("column", "bin",
                    (F.col("lo") + (F.col("bin") - 1) * w).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * w).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


@missing_as_null
def kde(df: DataFrame, cols: list[str] | None = None, grid: int = 200, cut: float = 0.0,
        exact: bool = True, fine_bins: int = 4096, counts: bool = False, reach: float = 8.6) -> DataFrame:
    """Gaussian kernel density on a ``grid``-point line per column.

    Bandwidth is Scott's rule (sample std · n^(-1/5)); the line spans
    [min - cut·bw, max + cut·bw].  ``counts`` scales the curve to the bars of ``histogram``
    (density · n · bin width).  ``exact`` evaluates the values themselves; otherwise values are
    first pre-aggregated into ``fine_bins`` bins per column and bin centres are evaluated with
    their counts.

    A value meets only the grid points within ``reach`` bandwidths of it, which it finds by their
    index on the line.  What is left out is below exp(-reach² / 2) / (bw·√(2π)) at every point
    (7.6e-17 of the kernel's height at 8.6, less than a double's rounding).  The sums are added up map-side: a
    partition sends one number per grid point, never its values.  Columns with less than an eighth
    as many distinct values as rows are counted by value first.  A column with fewer than two
    values, without spread or with an infinite value has no curve.
    """
    cols = numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    _, st = column_stats(df, cols, cols)
    params = {}
    for c in cols:
        s = st[c]
        if s.n < 2 or not s.std or not math.isfinite(s.std):
            continue
        bw = s.std * s.n ** (-0.2)
        params[c] = (float(s.min) - cut * bw, (float(s.max) - float(s.min) + 2 * cut * bw) / (grid - 1),
                     bw, s.n, float(s.min), float(s.max))
    schema = "column string, point int, x double, density double"
    if not params:
        return spark.createDataFrame([], schema)
    use = list(params)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in use]).unpivot(
        [], use, "column", "x").where(F.col("x").isNotNull())
    if exact:      # equal values are one value with a weight where that saves work
        few = [c for c in use if st[c].ndv * 8 < st[c].n]
        weighted = long.where(~F.col("column").isin(few)).select("column", "x", F.lit(1.0).alias("w"))
        if few:
            weighted = weighted.unionByName(long.where(F.col("column").isin(few)).groupBy("column", "x")
                                            .agg(F.count(F.lit(1)).cast("double").alias("w")))
    else:
        pdf = spark.createDataFrame([(c, p[4], p[5]) for c, p in params.items()],
                                    "column string, lo double, hi double")
        b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
                            * F.lit(fine_bins)).cast("int"), F.lit(fine_bins - 1))
        weighted = (long.join(F.broadcast(pdf), "column")
                    .groupBy("column", b.alias("b"), "lo", "hi").agg(F.count(F.lit(1)).alias("w"))
                    .select("column", (F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo"))
                                       / F.lit(fine_bins)).alias("x"), F.col("w").cast("double")))
    bars = auto_bins(df, st, use) if counts else {}
    line = spark.createDataFrame(
        [(c, p[0], p[1], p[2], float(p[3]), p[3] * (p[5] - p[4]) / bars[c] if counts else 1.0) for c, p in params.items()],
        "column string, start double, step double, bw double, n double, scale double")
    first = F.greatest(F.lit(0), F.ceil((F.col("x") - reach * F.col("bw") - F.col("start")) / F.col("step"))).cast("int")
    last = F.least(F.lit(grid - 1), F.floor((F.col("x") + reach * F.col("bw") - F.col("start")) / F.col("step"))).cast("int")
    met = (weighted.join(F.broadcast(line.drop("n", "scale")), "column").withColumn("first", first).withColumn("last", last)
           .where(F.col("first") <= F.col("last"))        # between two points of a line coarser than the reach
           .withColumn("point", F.explode(F.sequence("first", "last"))))
    d = (F.col("start") + F.col("point") * F.col("step") - F.col("x")) / F.col("bw")
    sums = met.groupBy("column", "point").agg(F.sum(F.col("w") * F.exp(-0.5 * d * d)).alias("s"))
    points = line.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return (points.join(sums, ["column", "point"], "left")
            .select("column", "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"),
                    (F.col("scale") * F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))))
                    .alias("density")))


# ---------------------------------------------------------------------------
# B11-B14: frequencies, correlation, class distribution, split sizes


@missing_as_null
def frequencies(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, count, percentage) for each categorical column, NULL is a group."""
    cols = categorical_columns(df) if cols is None else cols
    f = frequency_table(df, cols)
    # NULL is a group, so every column's counts add up to the row count (no
    # per-column window, which would put all distinct values of a column in one task)
    n = df.count()
    return f.select("column", "value", "count", (F.col("count") * 100.0 / F.lit(n)).alias("percentage"))


# Column pairs whose sums one task holds (six numbers each); more pairs take another scan.
GRAM_CELLS = 2_000_000
GRAM_ROWS = 64               # matrix rows that are merged together
GRAM_GROUPS = 64             # groups of tasks merged before the rest
_SUMS = ("n", "mx", "my", "cxx", "cyy", "cxy")


def _pair_sums(x, known, shift, rows) -> dict:
    """Sums over the rows where both columns are known, for column pairs (``rows``, all): count, means, central products."""
    import numpy as np
    m = known.astype(float)
    z = np.where(known, x - shift, 0.0)
    zr, mr = z[:, rows], m[:, rows]
    n = mr.T @ m
    with np.errstate(invalid="ignore", divide="ignore"):
        sx, sy = zr.T @ m, mr.T @ z
        sxx, syy = (zr * zr).T @ m, mr.T @ (z * z)
        cxx, cyy = sxx - sx * sx / n, syy - sy * sy / n
        out = {"n": n, "mx": shift[rows, None] + sx / n, "my": shift[None, :] + sy / n,
               "cxx": np.where(cxx > 1e-13 * sxx, cxx, 0.0), "cyy": np.where(cyy > 1e-13 * syy, cyy, 0.0),
               "cxy": zr.T @ z - sx * sy / n}
    return {k: np.where(n > 0, v, 0.0) for k, v in out.items()}


def _merge_sums(a: dict, b: dict) -> dict:
    """Sums of the union of two disjoint sets of rows."""
    import numpy as np
    n = a["n"] + b["n"]
    with np.errstate(invalid="ignore", divide="ignore"):
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        share, w = np.where(n > 0, b["n"] / n, 0.0), np.where(n > 0, a["n"] * b["n"] / n, 0.0)
    return {"n": n, "mx": a["mx"] + dx * share, "my": a["my"] + dy * share, "cxx": a["cxx"] + b["cxx"] + dx * dx * w,
            "cyy": a["cyy"] + b["cyy"] + dy * dy * w, "cxy": a["cxy"] + b["cxy"] + dx * dy * w}


def _gram(df: DataFrame, cols: list[str], chunks: list[int]) -> DataFrame:
    """(chunk, n, mx, my, cxx, cyy, cxy): pairwise-complete sums of the matrix rows of each chunk, from one scan."""
    import numpy as np
    import pyarrow as pa
    k, width = len(cols), GRAM_ROWS
    fields = ", ".join(f"{s} array<double>" for s in _SUMS)

    def row(c: int, sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *(pa.array([sums[s].ravel()], pa.list_(pa.float64())) for s in _SUMS)],
                                          ["chunk", *_SUMS])

    def fold(batches):
        held, shift = {}, None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)], axis=1)   # null is NaN
            known = ~np.isnan(x)
            if shift is None:        # close to the values, and equal to them in a column that does not vary
                some = known.any(axis=0)
                count = np.maximum(known.sum(axis=0), 1)
                low = np.where(some, np.where(known, x, np.inf).min(axis=0), 0.0)
                high = np.where(some, np.where(known, x, -np.inf).max(axis=0), 0.0)
                shift = np.where(low == high, low, low + np.where(known, x - low, 0.0).sum(axis=0) / count)
            for c in chunks:
                new = _pair_sums(x, known, shift, slice(c * width, (c + 1) * width))
                held[c] = _merge_sums(held[c], new) if c in held else new
        for c, sums in held.items():
            yield row(c, sums)

    def run(batches):
        now, held = None, None
        for b in batches:
            for i, c in enumerate(b.column("chunk").to_pylist()):
                new = {s: b.column(s)[i].values.to_numpy() for s in _SUMS}
                if now is not None and c != now:
                    yield row(now, held)
                held = _merge_sums(held, new) if c == now else new
                now = c
        if now is not None:
            yield row(now, held)

    schema = f"chunk int, {fields}"
    cells = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    parts = cells.mapInArrow(fold, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GRAM_GROUPS)))
    some = parts.repartition("chunk", "part").sortWithinPartitions("chunk", "part").drop("part").mapInArrow(run, schema)
    return some.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


@missing_as_null
def correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation, pairwise-complete, long form (col_x, col_y, corr).

    A constant column gives NULL (never a divide-by-zero), as does a pair that no row
    knows both of; the diagonal is 1 where the column varies.  One scan adds up masked
    products: with x centred near its mean and 0 where unknown, and m the 0/1 mask, the
    matrices m'm, x'm, (x^2)'m and x'x hold the counts, means and central products of every
    pair over the rows that know both columns.  Tasks' sums are merged in parallel, a few
    matrix rows at a time.  Up to 1,400 columns are one scan; wider tables take as many as
    their pairs need, each task holding at most ``GRAM_CELLS`` pairs.
    """
    cols = numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    schema = "col_x string, col_y string, corr double"
    if not cols or df.isEmpty():      # without rows there are no sums; the pairs are listed all the same
        return spark.createDataFrame([(a, b, None) for a in cols for b in cols], schema)
    k, width = len(cols), GRAM_ROWS
    n_chunks = -(-k // width)
    per = max(1, GRAM_CELLS // (width * k))
    sums = None
    for lo in range(0, n_chunks, per):
        g = _gram(df, cols, list(range(lo, min(n_chunks, lo + per))))
        sums = g if sums is None else sums.unionByName(g)

    def pairs(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for i, c in enumerate(b.column("chunk").to_pylist()):
                s = {x: b.column(x)[i].values.to_numpy().reshape(-1, k) for x in _SUMS}
                with np.errstate(invalid="ignore", divide="ignore"):
                    # rounding in the means leaves a constant column a variance of this size
                    still = (s["cxx"] <= s["n"] * (1e-12 * s["mx"]) ** 2) | (s["cyy"] <= s["n"] * (1e-12 * s["my"]) ** 2)
                    r = np.clip(s["cxy"] / np.sqrt(s["cxx"] * s["cyy"]), -1.0, 1.0)
                here = np.arange(len(r))
                r[here, here + c * width] = 1.0
                r = np.where(still | (s["n"] == 0), np.nan, r).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(cols, object)[c * width:(c + 1) * width], k), pa.string()),
                     pa.array(np.tile(np.array(cols, object), len(here)), pa.string()), pa.array(r, mask=np.isnan(r))], ["col_x", "col_y", "corr"])

    return sums.mapInArrow(pairs, schema)


@missing_as_null
def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, count, percentage) of the target, NULL class included."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to count classes of")
    g = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    n = df.count()
    return g.select("class", "count", (F.col("count") * 100.0 / F.lit(n)).alias("percentage"))


def split_sizes(df: DataFrame, train_size: float = 0.8) -> DataFrame:
    """One row: train_rows = floor(n·train_size), test_rows = n - train_rows."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n")).select(
        F.floor(F.col("n") * F.lit(float(train_size))).cast("bigint").alias("train_rows"),
        (F.col("n") - F.floor(F.col("n") * F.lit(float(train_size)))).cast("bigint").alias("test_rows"))


# ---------------------------------------------------------------------------
# B15-B18: non-numeric report, cleaning, coercion, type selection


def smallest_values(df: DataFrame, c: str, k: int) -> list[str]:
    """The ``k`` smallest distinct non-null values of a column, as text.

    Every task keeps its few smallest rows (a top-k, no shuffle of the column); where repeated
    values fill them, the search goes on behind the largest value found, so each scan finds at
    least one more.
    """
    found: list[str] = []
    text = df.select(F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull())
    while len(found) < k:
        rest = text.where(F.col("v") > F.lit(found[-1])) if found else text
        got = [r["v"] for r in rest.orderBy("v").limit(4 * k).collect()]
        found += list(dict.fromkeys(got))
        if len(got) < 4 * k:
            break
    return found[:k]


@missing_as_null
def non_numeric_report(df: DataFrame, sample_limit: int = 10) -> DataFrame:
    """(column, non_numeric_count, sample_values) for columns with unparseable entries.

    A value counts when it is not NULL and does not parse as a number after
    trimming.  Samples are the ``sample_limit`` smallest distinct non-null values.
    """
    cols = [c for c in df.columns if not isinstance(
        df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    spark = df.sparkSession
    schema = "column string, non_numeric_count bigint, sample_values array<string>"
    if not cols:
        return spark.createDataFrame([], schema)
    exprs = []
    for i, c in enumerate(cols):
        s = F.col(c).cast("string")
        bad = s.isNotNull() & num(F.regexp_replace(s, r"^\s+|\s+$", "")).isNull()
        exprs.append(F.count_if(bad).cast("bigint").alias(f"b{i}"))
    r = df.agg(*exprs).first()
    rows = [(c, int(r[f"b{i}"]), smallest_values(df, c, sample_limit)) for i, c in enumerate(cols) if r[f"b{i}"] > 0]
    return spark.createDataFrame(rows, schema)


def clean_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Apply ``clean_text`` to every string column (one projection)."""
    cols = string_columns(df) if cols is None else cols
    return df.select(*[clean_text(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def coercible_columns(df: DataFrame, threshold: float = 0.5) -> dict:
    """{column: parse fraction} for string columns whose parse fraction over all
    rows (NULLs count against) is >= threshold."""
    cols = string_columns(df)
    if not cols:
        return {}
    r = df.agg(*[F.avg(num(c).isNotNull().cast("double")).alias(f"f{i}")
                 for i, c in enumerate(cols)]).first()
    return {c: r[f"f{i}"] for i, c in enumerate(cols)
            if r[f"f{i}"] is not None and r[f"f{i}"] >= threshold}


@missing_as_null
def clean_and_coerce(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """String cleaning, then numeric coercion of columns that mostly parse.

    Costs one aggregate (the parse fractions) before the plan is final because
    the output schema depends on the data.
    """
    cleaned = clean_strings(df)
    conv = coercible_columns(cleaned, threshold)
    return cleaned.select(*[num(c).alias(c) if c in conv else F.col(c) for c in cleaned.columns])


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Column pruning by type class: numeric | categorical | report_categorical |
    non_numeric | string."""
    from .. import functions as fn
    pick = {"numeric": fn.numeric_columns, "categorical": fn.categorical_columns,
            "report_categorical": fn.report_categorical_columns,
            "non_numeric": fn.non_numeric_columns, "string": fn.string_columns}[kind]
    return df.select(*pick(df))
