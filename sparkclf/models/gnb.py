"""Gaussian naive Bayes with variance smoothing.

Fit: every task folds its rows into (n, mean, M2) per class, cut into blocks of features;
blocks of the same class are merged pairwise (the parallel form of the variance), first
within groups of tasks, then across them, each merge streaming over sorted rows.  Nothing
is exploded per cell, and a task holds at most ``HELD_CELLS`` numbers before it passes its
blocks on.  The parameters are a table (y, block, n, mean, m2); the smoothing term is the
largest variance over all train rows, merged from the same blocks across the classes.

Scoring: a model of at most ``LOCAL_CELLS`` class means is sent to the tasks (its size is
known from the table) and scored in one pass per Arrow batch.  A larger one stays a table:
rows are cut into the same feature blocks, each (feature block, class block) meets blocks
of rows, and the log densities of a row's blocks are added up by class.  Several smoothing
values are scored from one fit either way.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import pred_table

BLOCK = 4096                # features of a block
HELD_CELLS = 4_000_000      # (class, feature) cells a task holds
LOCAL_CELLS = 2_000_000     # class means and variances that are sent to the tasks: 32 MB at most
CLASS_CELLS = 1_000_000     # cells of a (feature block, class block) of the table
ROW_BLOCK = 4096
GROUPS = 64                 # groups of tasks merged before the rest


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten()
    if a.null_count or flat.null_count or len(flat) % max(1, len(a)):
        raise ValueError("naive Bayes needs vectors of one length without missing values")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(a), -1)


def merge(a: tuple, b: tuple) -> tuple:
    """(n, mean, M2) of the union of two disjoint sets of rows."""
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + delta * delta * (a[0] * b[0] / n)


def _moments(rows: DataFrame) -> DataFrame:
    """(y, block, n, mean, m2, part): one row per task, class and feature block."""
    schema = f"y {rows.schema['y'].dataType.simpleString()}, block int, n long, mean array<double>, m2 array<double>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for y, (n, mean, m2) in held.items():
                edges = range(0, len(mean), BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([y] * len(edges), kind), pa.array(range(len(edges)), pa.int32()), pa.array([n] * len(edges), pa.int64()),
                     *(pa.array([v[i:i + BLOCK] for i in edges], pa.list_(pa.float64())) for v in (mean, m2))],
                    ["y", "block", "n", "mean", "m2"])
            held.clear()

        for b in batches:
            x, labels = _matrix(b.column("x")), b.column("y")
            kind = labels.type
            code = labels.dictionary_encode()
            at = code.indices.to_numpy(zero_copy_only=False)
            for i, y in enumerate(code.dictionary.to_pylist()):
                some = x[at == i]
                mean = some.mean(axis=0)
                new = (len(some), mean, ((some - mean) ** 2).sum(axis=0))
                held[y] = merge(held[y], new) if y in held else new
            if held and len(held) * x.shape[1] > HELD_CELLS:
                yield from passed_on()
        if held:
            yield from passed_on()

    return rows.mapInArrow(fold, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))


def _merged(moments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the rows of a key are merged one after the other as they stream in."""
    names = [*keys, "n", "mean", "m2"]
    rows = moments.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kinds = None, None, None

        def row() -> pa.RecordBatch:
            n, mean, m2 = held
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(now, kinds)), pa.array([n], pa.int64()),
                                               *(pa.array([v], pa.list_(pa.float64())) for v in (mean, m2))], names)

        for b in batches:
            kinds = [b.column(k).type for k in keys]
            key = list(zip(*(b.column(k).to_pylist() for k in keys)))
            n, mean, m2 = b.column("n").to_pylist(), b.column("mean"), b.column("m2")
            for i, k in enumerate(key):
                new = (n[i], mean[i].values.to_numpy(), m2[i].values.to_numpy())
                if k != now and now is not None:
                    yield row()
                held = merge(held, new) if k == now else new
                now = k
        if now is not None:
            yield row()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, rows.schema)


@dataclass
class GaussianNBModel:
    classes: list           # sorted
    counts: list            # train rows of each class
    params: DataFrame | None   # (y, block, n, mean, m2)
    dims: int
    max_var: float
    var_smoothing: float = 1e-9
    local: tuple | None = None   # (mean, var) matrices of a small model

    def with_smoothing(self, s: float) -> "GaussianNBModel":
        return replace(self, var_smoothing=s)

    def log_prior(self) -> np.ndarray:
        return np.log(np.array(self.counts, float) / sum(self.counts))

    def _local_udf(self, eps: list[float]):
        mean, var0 = self.local
        logp = self.log_prior()

        @F.pandas_udf("array<array<double>>")
        def score(feats: pd.Series) -> pd.Series:
            X = np.vstack(feats.to_numpy()) if len(feats) else np.zeros((0, mean.shape[1]))
            out = np.empty((X.shape[0], len(eps), mean.shape[0]))
            for c in range(mean.shape[0]):
                # evaluated directly (no expansion), so tiny variances do not cancel
                square = (X - mean[c]) ** 2
                for k, e in enumerate(eps):
                    var = var0[c] + e
                    out[:, k, c] = logp[c] - 0.5 * np.log(2.0 * np.pi * var).sum() - 0.5 * (square / var).sum(axis=1)
            return pd.Series([list(r) for r in out])
        return score

    def log_joint(self, df: DataFrame, features: str, smoothings: list, name: str = "__jll") -> DataFrame:
        """``df`` with an array (one entry per smoothing) of arrays: the log joint density of each class."""
        eps = [s * self.max_var for s in smoothings]
        x = F.col(features).cast("array<double>")
        if self.local is not None:
            return df.withColumn(name, self._local_udf(eps)(x))
        rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))      # named once, read twice
        sums = self._table_scores(rows.select("__row", x.alias("x")), eps)
        return rows.join(sums.withColumnRenamed("scores", name), "__row", "left").drop("__row")

    def _table_scores(self, rows: DataFrame, eps: list[float]) -> DataFrame:
        """(__row, scores): the parameter table meets the rows block by block."""
        spark, n_blocks, dims = rows.sparkSession, -(-self.dims // BLOCK), self.dims
        per = max(1, CLASS_CELLS // min(BLOCK, dims))
        n_class_blocks = -(-len(self.classes) // per)
        row_blocks = max(1, math.ceil(rows.count() / ROW_BLOCK))
        kind = self.params.schema["y"].dataType
        index = spark.createDataFrame([(c, i) for i, c in enumerate(self.classes)], f"y {kind.simpleString()}, cls int")
        params = (self.params.join(index, "y").withColumn("cb", (F.col("cls") / per).cast("int"))
                      .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))))
        cells = (rows.withColumn("rb", F.pmod(F.xxhash64("__row"), F.lit(row_blocks)).cast("int"))
                     .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
                     .select("__row", "rb", "block", F.slice("x", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("x"))
                     .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_class_blocks - 1)))))

        def densities(r: pa.Table, p: pa.Table) -> pa.Table:
            names, types = ["__row", "cls", "part"], [pa.int64(), pa.int32(), pa.list_(pa.float64())]
            if not r.num_rows or not p.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
            X, out = _matrix(r.column("x")), []
            mean, m2 = _matrix(p.column("mean")), _matrix(p.column("m2"))
            n = p.column("n").to_numpy()
            for c, cls in enumerate(p.column("cls").to_pylist()):
                square, part = (X - mean[c]) ** 2, np.empty((len(X), len(eps)))
                for k, e in enumerate(eps):
                    var = m2[c] / n[c] + e
                    part[:, k] = -0.5 * np.log(2.0 * np.pi * var).sum() - 0.5 * (square / var).sum(axis=1)
                out.append(pa.table([r.column("__row"), pa.array([cls] * len(X), pa.int32()), pa.array(list(part), types[2])], names=names))
            return pa.concat_tables(out)

        keys = ["block", "cb", "rb"]
        parts = (cells.groupBy(*keys).cogroup(params.groupBy(*keys))
                      .applyInArrow(densities, "__row long, cls int, part array<double>"))
        total = parts.groupBy("__row", "cls").agg(*[F.sum(F.col("part")[k]).alias(f"s{k}") for k in range(len(eps))])
        prior = spark.createDataFrame(list(enumerate(map(float, self.log_prior()))), "cls int, prior double")
        total = total.join(prior, "cls")
        pairs = F.array_sort(F.collect_list(F.struct("cls", F.array(*[F.col(f"s{k}") + F.col("prior") for k in range(len(eps))]).alias("s"))))
        got = total.groupBy("__row").agg(pairs.alias("all"))

        def of(k: int):
            return F.transform("all", lambda v: v["s"][k])

        return got.select("__row", F.array(*map(of, range(len(eps)))).alias("scores"))

    def predict_many(self, df: DataFrame, features: str, smoothings: list) -> DataFrame:
        """Predicted class index for every smoothing value from one pass:
        adds ``__idx`` (array<int>, one entry per smoothing)."""
        out = self.log_joint(df, features, smoothings)
        return out.withColumn("__idx", F.transform("__jll", lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))).drop("__jll")

    def predict(self, df: DataFrame, features: str, id_col: str, label: str, name: str = "Naive Bayes"):
        s = F.col("__jll")[0]
        out = self.log_joint(df, features, [self.var_smoothing]).withColumn("__idx", F.array_position(s, F.array_max(s)).cast("int"))
        top = F.transform(s, lambda v: F.exp(v - F.array_max(s)))
        out = out.withColumn("__e", top).withColumn("__sum", F.aggregate("__e", F.lit(0.0), lambda a, v: a + v))
        lab = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("__idx"))
        return pred_table(out, id_col, label, lab, F.transform("__e", lambda v: v / F.col("__sum")), name)


def fit_gnb(train: DataFrame, features: str, label: str, var_smoothing: float = 1e-9) -> GaussianNBModel:
    """``features`` is an array<double> column; rows without a label take no part."""
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.col(features).cast("array<double>").alias("x"))
    params = cut_lineage(_merged(_merged(_moments(rows), ["y", "block", "part"]), ["y", "block"]))
    sizes = {r["y"]: r["n"] for r in params.where("block = 0").select("y", "n").collect()}      # a row per class
    classes = sorted(sizes)
    if not classes:
        return GaussianNBModel([], [], params, 0, 0.0, var_smoothing)
    over_all = _merged(params, ["block"]).select(
        F.array_max(F.transform("m2", lambda v: v / F.col("n"))).alias("v"), (F.col("block") * BLOCK + F.size("mean")).alias("d"))
    r = over_all.agg(F.max("v").alias("v"), F.max("d").alias("d")).first()
    model = GaussianNBModel(classes, [sizes[c] for c in classes], params, r["d"], float(r["v"]), var_smoothing)
    if len(classes) * model.dims <= LOCAL_CELLS:
        place, mean, var = {c: i for i, c in enumerate(classes)}, np.zeros((len(classes), model.dims)), np.zeros((len(classes), model.dims))
        for p in params.collect():                                    # at most LOCAL_CELLS cells
            at = slice(p["block"] * BLOCK, p["block"] * BLOCK + len(p["mean"]))
            mean[place[p["y"]], at], var[place[p["y"]], at] = p["mean"], np.array(p["m2"]) / p["n"]
        model.local = (mean, var)
    return model
