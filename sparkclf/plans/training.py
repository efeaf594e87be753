"""Train -> evaluate -> rank on a prepared table (split column, numeric features)."""
from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.common import feature_array
from ..models.search import MODEL_NAMES, each_at_once, predict_all, train_and_optimize
from ..operators.metrics import evaluate_all
from ..session import cut_lineage


def assemble(df: DataFrame, features: list, id_col: str, label: str) -> DataFrame:
    """(id, label, split, features array<double>) — one projection."""
    return df.select(id_col, label, "split", feature_array(df, features).alias("features"))


def run_training(prepared: DataFrame, features: list, id_col: str, label: str, search: str = "grid",
                 primary: str = "f1_weighted", k: int = 5, n_iter: int = 20, seed: int = 42, names=MODEL_NAMES,
                 parallelism: int = 4):
    """Search every model on the train rows, predict the test rows, evaluate.

    Returns (search results dict, CV results DataFrame, evaluation DataFrame with
    training and inference times).  The assembled table is checkpointed once
    because every fit and every fold reads it.
    """
    data = cut_lineage(assemble(prepared, features, id_col, label))
    train = data.where("split = 'train'")
    test = data.where("split = 'test'")
    res, cv = train_and_optimize(train, "features", id_col, label, search, primary, k, n_iter, seed, names,
                                 parallelism)

    def predict(name):
        t0 = time.time()
        p = cut_lineage(predict_all({name: res[name]}, test, "features", id_col, label))
        return p, (name, time.time() - t0, float(res[name].training_time))

    made = each_at_once(predict, res)
    u = functools.reduce(DataFrame.unionByName, [p for p, _ in made])
    times = [t for _, t in made]
    ev = evaluate_all(u)
    t = prepared.sparkSession.createDataFrame(times, "model string, inference_time double, training_time double")
    return res, cv, ev.join(F.broadcast(t), "model"), u
