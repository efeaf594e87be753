"""Data-quality issue detectors and the 0-100 health score.

Every detector returns a small DataFrame; ``detect_all`` writes the source once,
long texts as digests, and runs them on that table with shared passes (one fused aggregate for missing values and constant columns, the IQR
quantile pass, one grouping each for the class counts, the distinct counts and
the duplicate count) and assembles the long issue table and the score.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import categorical_columns, compact_key, missing_as_null, numeric_columns, safe_div
from ..session import cut_lineage, delete_path, shared_path
from .profile import outliers_iqr
from .stats import distinct_counts

# Thresholds and penalties of the health score.
MISSING_PER_COLUMN, MISSING_CAP = 5, 25
OUTLIER_PER_COLUMN, OUTLIER_CAP = 3, 15
IMBALANCE_PENALTY = ((0.1, 20), (0.2, 15), (None, 10))      # ratio < 0.1 -> 20, < 0.2 -> 15, else 10
CARDINALITY_PER_COLUMN, CARDINALITY_CAP = 5, 15
CONSTANT_PER_COLUMN, CONSTANT_CAP = 3, 10
DUPLICATE_PENALTY = ((10.0, 15), (5.0, 10), (None, 5))     # pct > 10 -> 15, > 5 -> 10, else 5
OUTLIER_THRESHOLD_PCT = 5.0
IMBALANCE_RATIO = 0.3
UNIQUE_THRESHOLD = 50
DUPLICATE_THRESHOLD_PCT = 1.0
ISSUE_NAMES = ("Missing Values", "Outliers", "Class Imbalance", "High Cardinality",
               "Constant Features", "Duplicates")


def _comparable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType,))]


@missing_as_null
def missing_and_constant(df: DataFrame) -> tuple[int, DataFrame]:
    """Fused pass: per column null count, missing percentage and constant flag
    (<= 1 distinct non-null value, via min <=> max)."""
    cols = df.columns
    nums = set(numeric_columns(df))
    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        exprs.append(F.count_if(F.col(c).isNull()).alias(f"m{i}"))
        if c in _comparable(df):
            exprs.append(F.min(c).eqNullSafe(F.max(c)).alias(f"k{i}"))
        else:
            exprs.append(F.lit(False).alias(f"k{i}"))
        # approximate distinct count of numeric columns picks the quantile strategy later
        exprs.append(F.approx_count_distinct(c).alias(f"d{i}") if c in nums else F.lit(None).alias(f"d{i}"))
    r = df.agg(*exprs).first()
    n = int(r["__n"])
    rows = [(i, c, int(r[f"m{i}"]), (100.0 * r[f"m{i}"] / n) if n else 0.0, bool(r[f"k{i}"]), r[f"d{i}"])
            for i, c in enumerate(cols)]
    out = df.sparkSession.createDataFrame(
        rows, "position int, column string, missing_count bigint, missing_percentage double, "
              "is_constant boolean, ndv bigint")
    return n, out


@missing_as_null
def detect_missing(df: DataFrame) -> DataFrame:
    """(column, missing_percentage) for columns with any missing value."""
    _, mc = missing_and_constant(df)
    return mc.where("missing_count > 0").select("column", "missing_percentage")


@missing_as_null
def detect_outliers(df: DataFrame, threshold_pct: float = OUTLIER_THRESHOLD_PCT,
                    counts: dict | None = None, ndv: dict | None = None) -> DataFrame:
    """(column, outlier_count, percentage) of numeric columns whose IQR outlier share > threshold."""
    return outliers_iqr(df, counts=counts, ndv=ndv).where(F.col("percentage") > F.lit(threshold_pct))


@missing_as_null
def detect_class_imbalance(df: DataFrame, target: str, ratio_threshold: float = IMBALANCE_RATIO) -> DataFrame:
    """One row: n_classes, min_count, max_count, ratio, has_issue.

    The NULL class counts; a missing column or empty table gives ratio 1.0.
    """
    s = class_counts(df, target).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_classes"),
        F.min("n").cast("bigint").alias("min_count"), F.max("n").cast("bigint").alias("max_count"))
    ratio = F.coalesce(safe_div("min_count", "max_count"), F.lit(1.0))
    return s.select("n_classes", "min_count", "max_count", ratio.alias("ratio"),
                    (ratio < F.lit(ratio_threshold)).alias("has_issue"))


@missing_as_null
def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n) rows of every class of the target, NULL as 'nan'; empty for a missing column.

    A table, however many classes there are: it never becomes one row or a driver map.
    """
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], "class string, n bigint")
    # two levels, so that a text 'nan' and NULL stay two classes
    return (df.groupBy(F.col(target).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.coalesce("c", F.lit("nan")).alias("class"), "n"))


@missing_as_null
def detect_high_cardinality(df: DataFrame, unique_threshold: int = UNIQUE_THRESHOLD) -> DataFrame:
    """(column, n_unique) of string/bool columns with more than ``unique_threshold`` distinct values."""
    return distinct_counts(df, categorical_columns(df)).where(F.col("n_unique") > unique_threshold)


@missing_as_null
def detect_constant(df: DataFrame) -> DataFrame:
    """(column) with <= 1 distinct non-null value (all-NULL counts as constant)."""
    _, mc = missing_and_constant(df)
    return mc.where("is_constant").select("column")


_FIXED_WIDTH = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def row_key(df: DataFrame) -> list:
    """Grouping key equivalent to the whole row: fixed-width columns as they are,
    variable-length ones (text, binary, nested) as a 128-bit digest, so long
    values never travel through the shuffle.  NULL stays NULL (one group)."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _FIXED_WIDTH):
            out.append(c.alias(f"k{i}"))
        elif isinstance(f.dataType, T.StringType):
            out.append(compact_key(c).alias(f"k{i}"))
        elif isinstance(f.dataType, T.BinaryType):
            out.append(F.md5(c).alias(f"k{i}"))
        else:
            out.append(F.md5(F.to_json(F.struct(c))).alias(f"k{i}"))
    return out


@missing_as_null
def detect_duplicates(df: DataFrame, pct_threshold: float = DUPLICATE_THRESHOLD_PCT) -> DataFrame:
    """One row: dup_count (rows beyond the first of each identical group), percentage, has_issue.

    Rows are grouped by ``row_key`` (long values reduced to digests); the
    partial count runs map-side, so a group holding a third of all rows
    collapses before the exchange.
    """
    g = df.groupBy(*row_key(df)).agg(F.count(F.lit(1)).alias("c"))
    s = g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("dup_count"),
              F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("rows"))
    pct = F.coalesce(safe_div(F.col("dup_count") * 100.0, F.col("rows")), F.lit(0.0))
    return s.select("dup_count", pct.alias("percentage"), (pct > F.lit(pct_threshold)).alias("has_issue"))


@dataclass
class IssueReport:
    rows: int
    missing: dict = field(default_factory=dict)          # column -> pct
    outliers: dict = field(default_factory=dict)         # column -> count
    imbalance_ratio: float = 1.0
    imbalance_issue: bool = False
    distribution: DataFrame | None = None               # (class, n) rows
    high_cardinality: dict = field(default_factory=dict)  # column -> n_unique
    constant: list = field(default_factory=list)
    dup_count: int = 0
    dup_pct: float = 0.0
    dup_issue: bool = False
    score: int = 100
    breakdown: dict = field(default_factory=dict)


def penalties(n_missing: int, n_outlier: int, imb_issue: bool, ratio: float, n_card: int,
              n_const: int, dup_issue: bool, dup_pct: float) -> dict:
    """Deduction (positive number) per issue name."""
    d = {}
    d["Missing Values"] = min(n_missing * MISSING_PER_COLUMN, MISSING_CAP) if n_missing else 0
    d["Outliers"] = min(n_outlier * OUTLIER_PER_COLUMN, OUTLIER_CAP) if n_outlier else 0
    if imb_issue:
        d["Class Imbalance"] = next(p for t, p in IMBALANCE_PENALTY if t is None or ratio < t)
    else:
        d["Class Imbalance"] = 0
    d["High Cardinality"] = min(n_card * CARDINALITY_PER_COLUMN, CARDINALITY_CAP) if n_card else 0
    d["Constant Features"] = min(n_const * CONSTANT_PER_COLUMN, CONSTANT_CAP) if n_const else 0
    if dup_issue:
        d["Duplicates"] = next(p for t, p in DUPLICATE_PENALTY if t is None or dup_pct > t)
    else:
        d["Duplicates"] = 0
    return d


def _written(df: DataFrame, target: str, path: str) -> DataFrame:
    """The table as Parquet at ``path``: the source and its joins run once, and each pass reads its own columns only.

    Texts other than the target are kept as ``compact_key``s, which are equal where the
    texts are, so null, distinct, constant and duplicate counts stay the same.
    """
    cols = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and f.name != target:
            c = F.hex(compact_key(c))        # text again, so the column keeps its class
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("binary")             # Parquet has no such type; all missing either way
        cols.append(c.alias(f"c{i}"))
    df.select(*cols).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)


@missing_as_null
def detect_all(df: DataFrame, target: str) -> IssueReport:
    """Run every detector and compute the health score (driver-side summary of
    small results; the heavy work is one write of the source and five Spark aggregates over it)."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "issues")
    try:
        return _detect_all(_written(df, target, path), target)
    finally:
        delete_path(spark, path)


def _detect_all(df: DataFrame, target: str) -> IssueReport:
    n, mc = missing_and_constant(df)
    mrows = mc.collect()
    rep = IssueReport(rows=n)
    rep.missing = {r["column"]: r["missing_percentage"] for r in mrows if r["missing_count"] > 0}
    rep.constant = [r["column"] for r in mrows if r["is_constant"]]
    # non-null counts from the fused pass feed the quantile pass (no extra count scan)
    nn = {r["column"]: n - r["missing_count"] for r in mrows}
    nd = {r["column"]: r["ndv"] for r in mrows if r["ndv"] is not None}
    rep.outliers = {r["column"]: r["outlier_count"] for r in detect_outliers(df, counts=nn, ndv=nd).collect()}
    imb = detect_class_imbalance(df, target).first()
    rep.imbalance_ratio, rep.imbalance_issue = float(imb["ratio"]), bool(imb["has_issue"])
    rep.distribution = cut_lineage(class_counts(df, target))      # outlives the written table
    rep.high_cardinality = {r["column"]: r["n_unique"] for r in detect_high_cardinality(df).collect()}
    dup = detect_duplicates(df).first()
    rep.dup_count, rep.dup_pct, rep.dup_issue = int(dup["dup_count"]), float(dup["percentage"]), bool(dup["has_issue"])
    rep.breakdown = penalties(len(rep.missing), len(rep.outliers), rep.imbalance_issue, rep.imbalance_ratio,
                              len(rep.high_cardinality), len(rep.constant), rep.dup_issue, rep.dup_pct)
    rep.score = max(0, 100 - sum(rep.breakdown.values()))
    return rep


@missing_as_null
def health_score(df: DataFrame, target: str) -> DataFrame:
    """One row: health_score plus the six deductions (as negative numbers)."""
    rep = detect_all(df, target)
    b = rep.breakdown
    row = (rep.score, -b["Missing Values"], -b["Outliers"], -b["Class Imbalance"], -b["High Cardinality"],
           -b["Constant Features"], -b["Duplicates"])
    return df.sparkSession.createDataFrame(
        [row], "health_score int, missing_values int, outliers int, class_imbalance int, "
               "high_cardinality int, constant_features int, duplicates int")


def issue_table(rep: IssueReport, spark) -> DataFrame:
    """Long issue table (issue, column, value): one row per affected column,
    one row per class for the imbalance distribution and summary rows."""
    rows = []
    rows += [("missing_values", c, float(v)) for c, v in rep.missing.items()]
    rows += [("outliers", c, float(v)) for c, v in rep.outliers.items()]
    rows.append(("class_imbalance_ratio", None, float(rep.imbalance_ratio)))
    rows += [("high_cardinality", c, float(v)) for c, v in rep.high_cardinality.items()]
    rows += [("constant_features", c, 1.0) for c in rep.constant]
    rows.append(("duplicate_rows", None, float(rep.dup_count)))
    rows.append(("duplicate_percentage", None, float(rep.dup_pct)))
    rows.append(("health_score", None, float(rep.score)))
    out = spark.createDataFrame(rows, "issue string, column string, value double")
    if rep.distribution is None:
        return out
    return out.unionByName(rep.distribution.select(F.lit("class_distribution").alias("issue"), F.col("class").alias("column"),
                                                   F.col("n").cast("double").alias("value")))


def score_breakdown(rep: IssueReport, spark) -> DataFrame:
    """(issue, deduction, status) with status OK when nothing was deducted."""
    rows = [(i + 1, name, -rep.breakdown[name], "OK" if rep.breakdown[name] == 0 else "Affected")
            for i, name in enumerate(ISSUE_NAMES)]
    return spark.createDataFrame(rows, "position int, issue string, deduction int, status string")


def formatted_issue_tables(rep: IssueReport, spark) -> DataFrame:
    """Display rows (table, key, value) as shown to a user: missing as 'x.xx%',
    outlier counts, class counts, unique counts, constant columns, duplicates."""
    from ..functions import fmt_fixed
    rows = []
    rows += [("Missing Values", c, float(v), None) for c, v in rep.missing.items()]
    rows += [("Outliers", c, None, int(v)) for c, v in rep.outliers.items()]
    rows += [("High Cardinality", c, None, int(v)) for c, v in rep.high_cardinality.items()]
    rows += [("Constant Features", c, None, None) for c in rep.constant]
    rows.append(("Duplicates", "rows", None, rep.dup_count))
    df = spark.createDataFrame(rows, "tbl string, key string, pct double, cnt bigint")
    if rep.distribution is not None:
        df = df.unionByName(rep.distribution.select(F.lit("Class Distribution").alias("tbl"), F.col("class").alias("key"),
                                                    F.lit(None).cast("double").alias("pct"), F.col("n").alias("cnt")))
    txt = F.when(F.col("pct").isNotNull(), F.concat(fmt_fixed("pct", 2), F.lit("%"))).otherwise(
        F.col("cnt").cast("string"))
    return df.select(F.col("tbl").alias("table"), "key", txt.alias("value"))
