"""Shared model plumbing: feature arrays, class lists, prediction tables."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_PARTITION = 100_000


ROWS_WORTH_A_TASK = 1_000
PARTITION_BYTES = 64 << 20


def partitions_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_PARTITION))


def spread(data: DataFrame, rows: int, width: int) -> DataFrame:
    """Rows of ``width`` doubles over every core, in partitions of bounded bytes: a small table
    arrives in one or two partitions, however much work its rows are."""
    cores = min(data.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_WORTH_A_TASK))
    return data.repartition(max(partitions_for(rows), cores, -(-rows * width * 8 // PARTITION_BYTES), 1))


def _unrolled(c: str) -> Column:
    """0/1 features of a sparse one-hot column (struct of size and index)."""
    at, size = F.col(f"{c}.index"), F.col(f"{c}.size")
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.when(at.isNull(), zeros).otherwise(F.concat(F.array_repeat(F.lit(0.0), at), F.array(F.lit(1.0)),
                                                         F.array_repeat(F.lit(0.0), size - at - 1)))


def feature_array(df: DataFrame, features) -> Column:
    """array<double> of the feature columns, vectors and sparse one-hot columns unrolled (or of a single array column)."""
    if isinstance(features, str):
        features = [features]
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return F.col(features[0]).cast("array<double>")
    parts, run = [], []
    for c in features:
        kind = df.schema[c].dataType
        if isinstance(kind, (VectorUDT, T.StructType)):
            hot = vector_to_array(F.col(c)) if isinstance(kind, VectorUDT) else _unrolled(c)
            parts += [F.array(*run), hot] if run else [hot]
            run = []
        else:
            run.append(F.col(c).cast("double"))
    if run or not parts:
        parts.append(F.array(*run))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def sorted_classes(train: DataFrame, label: str) -> list:
    """Distinct non-null labels in sorted order (bounded by the class count)."""
    return [r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def class_counts(train: DataFrame, label: str) -> dict:
    rows = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[label]: int(r["n"]) for r in rows}


def pred_table(df: DataFrame, id_col: str, label: str, pred: Column, scores: Column, model: str) -> DataFrame:
    return df.select(F.lit(model).alias("model"), F.col(id_col).alias("id"), F.col(label).alias("y_true"),
                     pred.alias("y_pred"), scores.alias("scores"))
