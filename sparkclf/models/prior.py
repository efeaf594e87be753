"""Stratified random baseline: draw each prediction from the train class prior.

The draw is the deterministic ``uniform(id, seed)``; class ``c`` covers the
interval [cum(c-1)/n, cum(c)/n) of the sorted classes.  Prediction is a look-up in
the array of cumulative bounds (no join, no shuffle).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash32
from .common import class_counts, pred_table


@dataclass
class PriorModel:
    classes: list
    counts: list
    seed: int = 42

    @property
    def priors(self):
        n = sum(self.counts)
        return [c / n for c in self.counts]

    def class_index(self, id_col: str):
        """0-based class of the draw: how many of the cumulative bounds it has passed."""
        n, cum, bounds = sum(self.counts), 0, []
        for c in self.counts[:-1]:
            cum += c
            bounds.append(F.lit(cum * 4294967296).cast("decimal(38,0)"))
        if not bounds:
            return F.lit(0)
        h = hash32(F.coalesce(F.col(id_col).cast("string"), F.lit("")), self.seed)
        at = h.cast("decimal(38,0)") * F.lit(n)       # u = h / 2^32; h * n against cum * 2^32 is exact
        return F.size(F.filter(F.array(*bounds), lambda b: at >= b))

    def predict(self, df: DataFrame, id_col: str, label: str, name: str = "Rule-based (Stratified Baseline)"):
        """The class index is computed once per row; prediction and scores are read off it,
        so the expression grows with the classes, not with their square."""
        k = len(self.classes)
        d = df.withColumn("__ci", self.class_index(id_col))
        cls = F.array(*[F.lit(c) for c in self.classes])
        scores = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("__ci")).cast("double"))
        return pred_table(d, id_col, label, F.element_at(cls, F.col("__ci") + 1), scores, name)


def fit_prior(train: DataFrame, label: str, seed: int = 42) -> PriorModel:
    cc = class_counts(train, label)
    classes = sorted(cc)
    return PriorModel(classes, [cc[c] for c in classes], seed)
