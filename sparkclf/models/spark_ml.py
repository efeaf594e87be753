"""Spark ML classifiers with scikit-learn-style hyper-parameters.

Parameter mapping (documented approximations where Spark has no twin):

* logistic regression: C -> regParam = 1 / (C · n_train), L2, no standardisation,
  maxIter 1000, tol 1e-4 (same objective up to the constant factor C·n);
* decision tree / random forest: max_depth None -> 30 (Spark's limit);
  min_samples_leaf -> minInstancesPerNode, min_samples_split s has no twin and is
  folded in as minInstancesPerNode = max(leaf, ceil(s / 2)); forest uses
  featureSubsetStrategy 'sqrt';
* SVM: hinge loss (one-vs-rest for more than two classes), C -> regParam = 1/(C·n), by the
  solver of the search (``batch_linear``), so the model that is kept is one that was scored;
  the RBF kernel is a landmark map (``nystroem``) whose error on the train rows is
  measured, with gamma 'scale' = 1 / (d · var(X)) or 'auto' = 1 / d; probabilities by
  Platt-style calibration (a multinomial logistic regression on the margins).
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch_linear import LinearTask, _bases, _kernels, _on_base, fit_many
from .common import partitions_for, pred_table, spread
from .nystroem import KernelMap, fit_kernel_map, kernel_error

MAX_DEPTH_UNLIMITED = 30
# Solver tolerances of the reference's estimators (logistic regression 1e-4, SVC 1e-3).
LR_TOL = 1e-4
SVM_TOL = 1e-3


def label_index(label: str, classes: list):
    """0-based position of the label in the sorted class list (double, for Spark ML)."""
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double")


def with_ml_columns(df: DataFrame, features: str, label: str, classes: list) -> DataFrame:
    """Add ``features_vec`` (ml vector) and ``label_idx`` columns."""
    return df.withColumn("features_vec", array_to_vector(F.col(features).cast("array<double>"))).withColumn(
        "label_idx", label_index(label, classes))


def _depth(v):
    return MAX_DEPTH_UNLIMITED if v is None else int(v)


def _min_node(params):
    leaf = int(params.get("min_samples_leaf", 1))
    split = int(params.get("min_samples_split", 2))
    return max(leaf, int(math.ceil(split / 2)))


class MarginModel:
    """Linear margins of the SVM solver, behind its kernel map if it has one, with the columns that Spark ML's models add."""

    def __init__(self, weights: np.ndarray, kernel: KernelMap | None = None):
        self.weights, self.kernel = weights, kernel  # (outputs, features + 1), the intercept last
        self.coefficientMatrix = DenseMatrix(*weights[:, :-1].shape, weights[:, :-1].ravel().tolist(), isTransposed=True)

    def transform(self, df: DataFrame) -> DataFrame:
        kernels, w = _kernels([self.kernel], [0]), _on_base(self.weights, self.kernel)

        def margins(x: pd.Series) -> pd.Series:
            m = _bases(np.vstack(x.to_numpy()), kernels)[0] @ w[:, :-1].T + w[:, -1] if len(x) else np.zeros((0, len(w)))
            return pd.Series(list(np.column_stack([-m, m]) if len(w) == 1 else m), dtype=object)

        raw = F.pandas_udf(margins, "array<double>")(vector_to_array("features_vec"))
        out = df.withColumn("__margins", raw)
        top = F.array_position("__margins", F.array_max("__margins")) - 1
        return out.withColumn("prediction", top.cast("double")).withColumn("rawPrediction", array_to_vector("__margins")).drop("__margins")


@dataclass
class SparkClassifier:
    """A fitted Spark ML model plus the metadata to predict with original labels."""
    name: str
    model: object
    classes: list
    features: str
    params: dict = field(default_factory=dict)
    kernel: KernelMap | None = None
    kernel_error: float | None = None     # bound on |k - z·z| over all pairs of train rows
    calibrator: object = None
    training_time: float = 0.0

    def _prepared(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features_vec", array_to_vector(F.col(self.features).cast("array<double>")))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._prepared(df))
        if self.calibrator is not None:
            out = self.calibrator.transform(out.withColumnRenamed("probability", "__p0")
                                            .withColumn("margins", F.col("rawPrediction")))
        return out

    def predict(self, df: DataFrame, id_col: str, label: str, name: str | None = None) -> DataFrame:
        out = self.transform(df)
        cls = F.array(*[F.lit(c) for c in self.classes])
        pred = F.element_at(cls, F.col("prediction").cast("int") + 1)
        if "probability" in out.columns:
            scores = vector_to_array(F.col("probability"))
        else:
            scores = F.lit(None).cast("array<double>")
        return pred_table(out, id_col, label, pred, scores, name or self.name)


def make_estimator(kind: str, params: dict, n_train: int, seed: int = 42, n_classes: int = 2):
    """Spark ML estimator for one parameter set (features_vec -> label_idx)."""
    common = dict(featuresCol="features_vec", labelCol="label_idx")
    if kind == "Logistic Regression":
        C = float(params.get("C", 1.0))
        return LogisticRegression(maxIter=1000, tol=LR_TOL, regParam=1.0 / (C * n_train), elasticNetParam=0.0,
                                  standardization=False, family="auto", **common)
    if kind == "Decision Tree":
        return DecisionTreeClassifier(impurity="gini", maxDepth=_depth(params.get("max_depth")),
                                      minInstancesPerNode=_min_node(params), seed=seed, cacheNodeIds=True,
                                      **common)
    if kind == "Random Forest":
        return RandomForestClassifier(numTrees=int(params.get("n_estimators", 100)),
                                      maxDepth=_depth(params.get("max_depth")),
                                      minInstancesPerNode=_min_node(params), featureSubsetStrategy="sqrt",
                                      seed=seed, cacheNodeIds=True, maxMemoryInMB=1024, **common)
    if kind == "SVM":
        C = float(params.get("C", 1.0))
        svc = LinearSVC(regParam=1.0 / (C * n_train), maxIter=1000, tol=SVM_TOL, standardization=False, **common)
        return svc if n_classes <= 2 else OneVsRest(classifier=svc, parallelism=4, **common)
    raise ValueError(f"not a Spark ML model kind: {kind}")


def _gamma(train: DataFrame, features: str, dim: int, gamma) -> float:
    if gamma == "auto":
        return 1.0 / dim
    if gamma == "scale":
        v = train.select(F.explode(F.col(features).cast("array<double>")).alias("x")).agg(F.var_pop("x")).first()[0]
        return 1.0 / (dim * v) if v else 1.0
    return float(gamma)


def fit_spark_model(kind: str, train: DataFrame, features: str, label: str, classes: list, params: dict,
                    seed: int = 42) -> SparkClassifier:
    """Fit one model on labelled train rows."""
    import time
    t0 = time.time()
    tr = train.where(F.col(label).isNotNull())
    n = tr.count()
    kernel, error = None, None
    if kind == "SVM" and params.get("kernel", "rbf") == "rbf":
        dim = len(tr.select(features).first()[0])
        kernel = fit_kernel_map(tr, features, _gamma(tr, features, dim, params.get("gamma", "scale")), seed=seed)
        error = float(kernel_error(tr, features, kernel).first()["worst"])
    data = with_ml_columns(tr, features, label, classes)
    if kind == "SVM":
        data = spread(data, n, kernel.dims if kernel else len(tr.select(features).first()[0])).persist()
    else:
        data = data.coalesce(partitions_for(n)).persist()
    cal = None
    if kind != "SVM":
        model = make_estimator(kind, params, n, seed, len(classes)).fit(data)
    else:                                             # by the solver that scored the candidates
        dims = kernel.dims if kernel else data.select(F.size(features)).first()[0]
        rows = data.select(F.col(features).cast("array<double>").alias("x"), F.col("label_idx").cast("int").alias("y"), F.lit(0).alias("fold"))
        task = LinearTask("hinge", 1.0 / (float(params.get("C", 1.0)) * max(1, n)), -1)
        model = MarginModel(fit_many(rows, [task], [kernel], [dims], len(classes), {0: n})[0], kernel)
        cal = LogisticRegression(featuresCol="margins", labelCol="label_idx", predictionCol="__cal_pred",
                                 rawPredictionCol="__cal_raw", probabilityCol="probability", maxIter=100,
                                 regParam=1e-6).fit(model.transform(data).withColumnRenamed("rawPrediction", "margins"))
    data.unpersist()
    out = SparkClassifier(kind, model, classes, features, dict(params), kernel, error, cal)
    out.training_time = time.time() - t0
    return out

