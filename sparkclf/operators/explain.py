"""Explainability: feature importances from fitted models.

Tree models expose impurity importances, linear models their coefficients
(mean absolute value over classes).  KNN, naive Bayes, RBF-kernel SVM and the
prior baseline have no importance.  Coefficient matrices can also be reduced
in long form (class, feature, coef) with one aggregate.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "model string, feature string, importance double"


def _importances(fitted) -> np.ndarray | None:
    from ..models.spark_ml import SparkClassifier
    if not isinstance(fitted, SparkClassifier):
        return None
    m = fitted.model
    if hasattr(m, "featureImportances"):
        return m.featureImportances.toArray()
    if fitted.kernel is not None:
        return None                     # RBF: coefficients live in the space of the landmark map
    if hasattr(m, "coefficientMatrix"):
        return np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(m, "coefficients"):
        return np.abs(m.coefficients.toArray())
    if hasattr(m, "models"):           # one-vs-rest of linear SVMs
        return np.abs(np.vstack([x.coefficients.toArray() for x in m.models])).mean(axis=0)
    return None


def feature_importance(spark, name: str, fitted, feature_names: list) -> DataFrame | None:
    """(model, feature, importance) sorted by importance desc, or None when unsupported."""
    imp = _importances(fitted)
    if imp is None:
        return None
    rows = [(name, f, float(v)) for f, v in zip(feature_names, imp)]
    return spark.createDataFrame(rows, SCHEMA).orderBy(F.desc("importance"), "feature")


def linear_importance_long(coefs: DataFrame) -> DataFrame:
    """(feature, importance = mean over classes of |coef|) from a long (class, feature, coef) table."""
    return coefs.groupBy("feature").agg(F.avg(F.abs("coef")).alias("importance"))


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """Top-n rows by importance (ties by feature name)."""
    w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def explainability(spark, fitted: dict, feature_names: list) -> tuple[DataFrame, DataFrame]:
    """(importances of every supporting model, (model, supports_importance) flags)."""
    parts, flags = [], []
    for name, m in fitted.items():
        df = feature_importance(spark, name, m, feature_names)
        flags.append((name, df is not None))
        if df is not None:
            parts.append(df)
    imp = parts[0] if parts else spark.createDataFrame([], SCHEMA)
    for p in parts[1:]:
        imp = imp.unionByName(p)
    return imp, spark.createDataFrame(flags, "model string, supports_importance boolean")
