"""RBF kernel by landmarks (Nystroem), with a measured error.

With landmarks L and K = k(L, L) = U S U', the map z(x) = k(x, L) U S^(-1/2) gives
z(x)·z(y) = k(x, L) K^+ k(L, y): the kernel of x and y after both are projected on the span
of the landmarks.  As k(x, x) = 1, what the projection of x loses is r(x) = 1 - |z(x)|^2 >= 0,
and |k(x, y) - z(x)·z(y)| <= sqrt(r(x) r(y)): one pass over the rows that takes the largest
r bounds the error of every pair of rows, without looking at pairs.

Landmarks are chosen by k-means++ (each next one with probability proportional to the
squared distance to the nearest so far) and a few k-means rounds, on the rows with the
smallest id hashes, ``SAMPLE_ROWS`` of them at most.  A sample with no more distinct rows
than landmarks gives the exact kernel on these rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANDMARKS = 256
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 64 << 20
ROUNDS = 5


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.add.outer((x * x).sum(1), (y * y).sum(1))
    d -= x @ (2.0 * y).T
    return np.maximum(d, 0.0, out=d)


def choose_landmarks(x: np.ndarray, count: int, seed: int) -> np.ndarray:
    x = np.unique(x, axis=0)
    if len(x) <= count:
        return x
    rng = np.random.RandomState(seed)
    at = [int(rng.randint(len(x)))]
    near = square_distances(x, x[at])[:, 0]
    while len(at) < count and near.max() > 0:
        at.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, square_distances(x, x[at[-1:]])[:, 0])
    centre = x[at]
    for _ in range(ROUNDS):
        mine = square_distances(x, centre).argmin(1)
        total, n = np.zeros_like(centre), np.bincount(mine, minlength=len(centre))
        np.add.at(total, mine, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return np.unique(centre, axis=0)


def kernel_values(distances: np.ndarray, gamma: float) -> np.ndarray:
    k = -gamma * distances
    return np.exp(k, out=k)


class KernelMap:
    """x -> z(x) = k(x, landmarks) · weights, with z(x)·z(y) close to exp(-gamma |x - y|^2)."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = landmarks, gamma
        value, vector = np.linalg.eigh(kernel_values(square_distances(landmarks, landmarks), gamma))
        kept = value > 1e-10 * value.max()
        self.weights = vector[:, kept] / np.sqrt(value[kept])

    @property
    def dims(self) -> int:
        return self.weights.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return kernel_values(square_distances(x, self.landmarks), self.gamma) @ self.weights

    def transform(self, df: DataFrame, col: str) -> DataFrame:
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(self(np.vstack(x.to_numpy()))) if len(x) else [], dtype=object)

        return df.withColumn(col, F.pandas_udf(mapped, "array<double>")(F.col(col).cast("array<double>")))


def fit_kernel_map(df: DataFrame, features: str, gamma: float, landmarks: int = LANDMARKS, seed: int = 42) -> KernelMap:
    x = F.col(features).cast("array<double>")
    first = df.select(F.size(x).alias("d")).first()
    rows = max(landmarks, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, first["d"]))))
    sample = df.select(x.alias("x"), F.xxhash64(x, F.lit(seed)).alias("h")).orderBy("h", "x").limit(rows).toArrow()
    column = sample.column("x").combine_chunks()
    return KernelMap(choose_landmarks(column.flatten().to_numpy().reshape(len(column), -1), landmarks, seed), gamma)


def kernel_error(df: DataFrame, features: str, kernel: KernelMap) -> DataFrame:
    """One row (rows, worst, mean): the largest and mean r(x); ``worst`` bounds |k - z·z| over all pairs of rows."""
    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("x")
            if len(col):
                z = kernel(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(1.0 - (z * z).sum(1), 0.0, None))], ["r"])

    r = df.select(F.col(features).cast("array<double>").alias("x")).mapInArrow(lost, "r double")
    return r.agg(F.count("r").alias("rows"), F.max("r").alias("worst"), F.avg("r").alias("mean"))
