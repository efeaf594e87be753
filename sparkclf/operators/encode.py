"""Encoders and scalers fitted on the train split, applied to both splits.

Categories are numbered in a dictionary table (column, value digest, index): the distinct
train values in their sorted order, numbered by a range-partitioned ranking, so neither
the values nor their number have to fit the driver or one task.  Ordinal codes and the
sparse one-hot form are look-ups in it.  Values are looked up by their 128-bit digest; a
column of few categories is joined to its part of the dictionary where the rows are (entries
have a fixed size, so their number bounds the bytes sent), columns of many categories send
(row, column, digest) through the shuffle and one aggregation brings a row's indices back.

Scaler fits are small aggregates over train rows; their transform is one projection.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import missing_as_null, non_numeric_columns, normalize_missing, numeric_columns, report_categorical_columns
from ..session import cut_lineage
from . import stats
from .stats import global_positions

# Dictionary entries (a 16-byte digest and an int) that are sent to every task; 12 MB at most.
BROADCAST_MAPPING_MAX = 200_000
# Bytes of values that one task ranks.
RANK_BYTES = 32 << 20
# The form with a column per category lists the categories in its schema; beyond this the schema itself is the limit.
MAX_DUMMY_COLUMNS = 20_000


def _train(df: DataFrame, split_col: str | None):
    return df.where(F.col(split_col) == "train") if split_col else df


def _digest(c: str) -> Column:
    return F.unhex(F.md5(F.col(c).cast("string").cast("binary")))


@dataclass
class Dictionary:
    """Numbered categories: ``table`` has (col int, key binary, index int), ``col`` counting ``columns``."""
    columns: list
    table: DataFrame | None
    sizes: dict

    def lookup(self, df: DataFrame, prefix: str = "__index") -> DataFrame:
        """``df`` with one int column ``<prefix><i>`` per dictionary column; null for null and unseen values."""
        out, wide = df, []
        for i, c in enumerate(self.columns):
            if not self.sizes[c]:
                out = out.withColumn(f"{prefix}{i}", F.lit(None).cast("int"))
            elif self.sizes[c] <= BROADCAST_MAPPING_MAX:
                part = self.table.where(F.col("col") == i).select(F.col("key").alias("__key"), F.col("index").alias(f"{prefix}{i}"))
                out = out.withColumn("__key", _digest(c)).join(F.broadcast(part), "__key", "left").drop("__key")
            else:
                wide.append(i)
        if not wide:
            return out
        # rows are named once; the same names must be read twice
        rows = cut_lineage(out.withColumn("__row", F.monotonically_increasing_id()))
        cells = rows.select("__row", F.explode(F.array(*[F.struct(F.lit(i).alias("col"), _digest(self.columns[i]).alias("key"))
                                                         for i in wide])).alias("e")).select("__row", "e.col", "e.key")
        hits = cells.where(F.col("key").isNotNull()).join(self.table.where(F.col("col").isin(wide)), ["col", "key"])
        found = hits.groupBy("__row").agg(*[F.max(F.when(F.col("col") == i, F.col("index"))).alias(f"{prefix}{i}") for i in wide])
        return rows.join(found, "__row", "left").drop("__row")


def dictionary_fit(train: DataFrame, cols: list[str]) -> Dictionary:
    """Sorted distinct non-null values (as text) of each column -> 0..k-1."""
    if not cols:
        return Dictionary([], None, {})
    cells = train.select(F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value"))
                                             for i, c in enumerate(cols)])).alias("e")).select("e.col", "e.value")
    cells = cells.where(F.col("value").isNotNull()).withColumn("key", _digest("value"))
    one = cells.groupBy("col", "key").agg(F.min("value").alias("value")).select(F.struct("col", "value").alias("ord"), "key")
    one = cut_lineage(one)
    size = one.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("ord.value")).alias("bytes")).first()
    per = max(1, size["n"] // max(1, -(-(size["bytes"] or 0) // RANK_BYTES)))       # long values: fewer to a partition
    placed = cut_lineage(global_positions(one, "ord", "pos", size["n"], min(stats.RANK_ROWS_PER_PARTITION, per)).select(F.col("ord.col").alias("col"), "key", "pos"))
    firsts = {r["col"]: (r["first"], r["n"]) for r in
              placed.groupBy("col").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).collect()}   # a row per column
    shift = F.element_at(F.create_map(*[x for i, (f, _) in firsts.items() for x in (F.lit(i), F.lit(f))]), F.col("col")) if firsts else F.lit(0)
    table = placed.select("col", "key", (F.col("pos") - shift).cast("int").alias("index"))
    return Dictionary(cols, table, {c: firsts.get(i, (0, 0))[1] for i, c in enumerate(cols)})


@dataclass
class OneHotModel:
    columns: list
    cats: dict = field(default_factory=dict)      # column -> sorted values, in the form with a column per category
    dictionary: Dictionary | None = None          # in the sparse form

    @property
    def width(self) -> int:
        """Number of 0/1 features that the encoded columns stand for."""
        return sum(self.dictionary.sizes.values()) if self.dictionary else sum(map(len, self.cats.values()))

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c not in self.columns]
        if self.dictionary is not None:
            hot = [F.struct(F.lit(self.dictionary.sizes[c]).cast("int").alias("size"), F.col(f"__index{i}").alias("index")).alias(f"{c}_onehot")
                   for i, c in enumerate(self.columns)]
            return self.dictionary.lookup(df).select(*keep, *hot)
        dummies = [F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).cast("tinyint").alias(f"{c}_{v}")
                   for c in self.columns for v in self.cats[c]]
        return df.select(*keep, *dummies)


@missing_as_null
def onehot_fit(df: DataFrame, cols: list[str] | None = None, split_col: str | None = "split",
               exclude=(), layout: str = "columns") -> OneHotModel:
    """Categories from train rows; NULL and unseen values give all zeros.

    ``layout`` alone decides the schema, whatever the data's size.  "columns": a tinyint column
    ``<col>_<value>`` per category, for columns of few categories (their names are the schema).
    "sparse": a column ``<col>_onehot`` struct<size, index> per column, for any number of
    categories: the row's ``index``-th of ``size`` features is 1 (null index: none is).
    """
    cols = report_categorical_columns(df, exclude) if cols is None else cols
    tr = _train(df, split_col)
    if layout == "sparse":
        return OneHotModel(cols, dictionary=dictionary_fit(tr, cols))
    if layout != "columns":
        raise ValueError(f"unknown layout {layout!r}")
    if not cols:
        return OneHotModel([])
    cells = (tr.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
               .where(F.col("value").isNotNull()).distinct())
    names = cells.limit(MAX_DUMMY_COLUMNS + 1).collect()
    if len(names) > MAX_DUMMY_COLUMNS:
        raise ValueError(f"more than {MAX_DUMMY_COLUMNS} categories cannot be columns of a table; use layout='sparse'")
    return OneHotModel(cols, {c: sorted(r["value"] for r in names if r["column"] == c) for c in cols})


@dataclass
class OrdinalModel:
    dictionary: Dictionary

    def transform(self, df: DataFrame) -> DataFrame:
        codes = {c: F.coalesce(F.col(f"__index{i}"), F.lit(-1)).alias(c) for i, c in enumerate(self.dictionary.columns)}
        return self.dictionary.lookup(df).select(*[codes.get(c, F.col(c)) for c in df.columns])


@missing_as_null
def ordinal_fit(df: DataFrame, cols: list[str] | None = None, split_col: str | None = "split",
                exclude=()) -> OrdinalModel:
    """Sorted train categories -> 0..k-1; NULL and unseen -> -1 (int)."""
    cols = non_numeric_columns(df, exclude) if cols is None else cols
    return OrdinalModel(dictionary_fit(_train(df, split_col), cols))


@dataclass
class ScalerModel:
    method: str
    params: dict           # column -> (shift, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.params:
                a, s = self.params[c]
                out.append(((F.col(c).cast("double") - F.lit(a)) / F.lit(s)).alias(c))
            else:
                out.append(F.col(c))
        return normalize_missing(df).select(*out)


@missing_as_null
def scaler_fit(df: DataFrame, method: str, cols: list[str] | None = None, split_col: str | None = "split",
               exclude=()) -> ScalerModel | None:
    """standard: (x - mean) / population std (0 -> 1); minmax: (x - min) / range (0 -> 1)."""
    if method not in ("standard", "minmax"):
        return None
    cols = numeric_columns(df, exclude) if cols is None else cols
    tr = _train(df, split_col)
    if not cols:
        return ScalerModel(method, {})
    if method == "standard":
        r = tr.agg(*[F.avg(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        params = {c: (r[f"a{i}"] or 0.0, r[f"s{i}"] if r[f"s{i}"] else 1.0) for i, c in enumerate(cols)}
    else:
        r = tr.agg(*[F.min(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[F.max(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        params = {}
        for i, c in enumerate(cols):
            lo, hi = r[f"a{i}"], r[f"b{i}"]
            rng = (hi - lo) if lo is not None and hi is not None else 0.0
            params[c] = (lo or 0.0, rng if rng else 1.0)
    return ScalerModel(method, params)
