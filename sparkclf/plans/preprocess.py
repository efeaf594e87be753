"""End-to-end preprocessing in the fixed order: dedupe -> constant columns ->
missing values -> outliers -> split -> encode -> scale.

Imputation and outlier statistics come from the whole table (target included
when it qualifies); encoder and scaler statistics come from train rows only.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import encode as E
from ..operators import prepare as P
from ..operators.split import train_test_split
from ..session import cut_lineage


@dataclass(frozen=True)
class PrepConfig:
    duplicates: bool = False
    constant_columns: tuple = ()
    drop_constant: bool = False
    impute: bool = False
    impute_method: str = "median"
    constant_value: str | None = None
    outliers: bool = False
    outlier_columns: tuple = ()
    outlier_method: str = "none"
    encoding: str = "onehot"          # onehot | ordinal | none
    scaling: str = "none"             # standard | minmax | none
    onehot_layout: str = "sparse"     # sparse (any number of categories) | columns (one 0/1 column per category)

    @property
    def has_selected_actions(self) -> bool:
        """At least one action is chosen: an apply flag, an encoding or a scaling
        (the split alone is not an action)."""
        return (self.duplicates or self.drop_constant or self.impute or self.outliers
                or self.encoding in ("onehot", "ordinal") or self.scaling in ("standard", "minmax"))

    @property
    def is_noop(self) -> bool:
        return not self.has_selected_actions

    def summary_lines(self) -> list[str]:
        out = []
        if self.impute:
            out.append(f"Missing Values: Handled using {self.impute_method} method")
        if self.outliers:
            out.append(f"Outliers: {self.outlier_method.capitalize()} method applied")
        if self.drop_constant:
            out.append("Constant Features: Removed from dataset")
        if self.duplicates:
            out.append("Duplicates: Removed from dataset")
        if self.encoding != "none":
            out.append(f"Encoding: {self.encoding.capitalize()} encoding applied")
        if self.scaling != "none":
            out.append(f"Scaling: {self.scaling.capitalize()} scaling applied")
        return out


@dataclass
class Prepared:
    clean: DataFrame              # after cleaning, before the split
    data: DataFrame               # encoded + scaled, with ``split``
    features: list = field(default_factory=list)
    target: str = ""
    n_features: int = 0           # width of the feature matrix, sparse one-hot columns unrolled


def apply_preprocessing(df: DataFrame, target: str, cfg: PrepConfig, id_col: str,
                        train_size: float = 0.8, seed: int = 42, materialize: bool = True) -> Prepared:
    """Every fitted step reads its input again; with ``materialize`` the cleaned
    table and the split are checkpointed (shared checkpoint folder) so later
    steps read them instead of recomputing de-duplication, imputation and the
    split, and a lost executor does not replay the whole chain."""
    out = P.drop_duplicates(df, cfg.duplicates)
    if cfg.drop_constant:
        out = P.drop_constant(out, list(cfg.constant_columns), protect=(target, id_col))
    if cfg.impute:
        out = P.impute(out, cfg.impute_method, cfg.constant_value)
    if cfg.outliers:
        out = P.handle_outliers(out, list(cfg.outlier_columns), cfg.outlier_method)
    clean = cut_lineage(out) if materialize else out
    split = train_test_split(clean, target, id_col, train_size, seed)
    if materialize:
        split = cut_lineage(split)
    skip = (target, id_col, "split")
    width = 0
    if cfg.encoding == "onehot":
        hot = E.onehot_fit(split, exclude=skip, layout=cfg.onehot_layout)
        split, width = hot.transform(split), hot.width
    elif cfg.encoding == "ordinal":
        split = E.ordinal_fit(split, exclude=skip).transform(split)
    sc = E.scaler_fit(split, cfg.scaling, exclude=skip)
    if sc is not None:
        split = sc.transform(split)
    feats = [c for c in split.columns if c not in skip]
    width += sum(not (cfg.encoding == "onehot" and c not in clean.columns) for c in feats)
    return Prepared(clean, split, feats, target, width)
