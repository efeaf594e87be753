"""Report tables: dataset overview, feature statistics, issue and preprocessing
lines, model comparison, best model, executive summary, alternatives, and the
long (section, item, metric, value) table that a report sink writes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt_fixed, missing_as_null, numeric_columns, report_categorical_columns
from .quality import IssueReport, issue_table, row_key
from .stats import column_stats, distinct_counts, exact_quantiles, modes

HEALTH_DEFAULT = 85
# Parameters shown in the model configuration table when present.
KEY_PARAMS = ("n_estimators", "max_depth", "learning_rate", "C", "kernel", "n_neighbors", "criterion",
              "random_state", "max_iter", "gamma", "alpha")


@missing_as_null
def dataset_overview(df: DataFrame, target: str) -> DataFrame:
    """One row: total_rows, total_columns, target_column, missing_values, duplicate_rows, features.

    Two aggregates (null counts; duplicate count over row fingerprints) whose
    one-row results are combined on the driver."""
    cols = df.columns
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), nulls.alias("m")).first()
    dups = (df.groupBy(*row_key(df)).agg(F.count(F.lit(1)).alias("c"))
            .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("d")).first()["d"])
    return df.sparkSession.createDataFrame(
        [(int(r["n"]), len(cols), target, int(r["m"]), int(dups), list(cols))],
        "total_rows bigint, total_columns bigint, target_column string, missing_values bigint, "
        "duplicate_rows bigint, features array<string>")


@missing_as_null
def numeric_stats(df: DataFrame, max_cols: int = 8) -> DataFrame:
    """First ``max_cols`` numeric columns: mean, std, min, max, median, q25, q75."""
    cols = numeric_columns(df)[:max_cols]
    _, st = column_stats(df, cols, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], counts={c: st[c].n for c in cols},
                        ndv={c: st[c].ndv for c in cols}, bounds={c: (st[c].min, st[c].max) for c in cols})
    rows = [(i, c, st[c].mean, st[c].std, _f(st[c].min), _f(st[c].max), q[(c, 0.5)], q[(c, 0.25)], q[(c, 0.75)])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, mean double, std double, min double, max double, median double, "
              "q25 double, q75 double")


def _f(v):
    return None if v is None else float(v)


@missing_as_null
def categorical_stats(df: DataFrame, max_cols: int = 5) -> DataFrame:
    """First ``max_cols`` string columns: unique_values, most_common (smallest on
    ties; 'N/A' when empty), most_common_count (0 when empty)."""
    cols = report_categorical_columns(df)[:max_cols]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, unique_values bigint, most_common string, "
                                         "most_common_count bigint")
    order = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, column string")
    return (order.join(distinct_counts(df, cols), "column").join(modes(df, cols), "column", "left")
            .select("position", "column", F.col("n_unique").alias("unique_values"),
                    F.coalesce("value", F.lit("N/A")).alias("most_common"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("most_common_count")))


def issue_lines(rep: IssueReport | None, spark) -> DataFrame:
    """(position, line) issue summary plus the health score (default 85 when not detected),
    as one aggregate over the long issue table."""
    if rep is None:
        return spark.createDataFrame([(0, f"Health Score: {HEALTH_DEFAULT}/100")], "position int, line string")
    t = issue_table(rep, spark)
    n = lambda issue: F.count_if(F.col("issue") == issue)
    v = lambda issue: F.max(F.when(F.col("issue") == issue, F.col("value")))
    a = t.agg(n("missing_values").alias("missing"), n("outliers").alias("outl"), v("class_imbalance_ratio").alias("ratio"),
              n("high_cardinality").alias("card"), n("constant_features").alias("cons"), v("duplicate_rows").alias("dups"),
              v("duplicate_percentage").alias("pct"), v("health_score").alias("score"))
    # The wording of the lines.
    lines = [(F.col("missing") > 0, F.format_string("Missing Values: %d columns affected", "missing")),
             (F.col("outl") > 0, F.format_string("Outliers: Detected in %d columns", "outl")),
             (F.lit(rep.imbalance_issue), F.concat(F.lit("Class Imbalance: Ratio "), fmt_fixed("ratio", 2))),
             (F.col("card") > 0, F.format_string("High Cardinality: %d categorical features", "card")),
             (F.col("cons") > 0, F.format_string("Constant Features: %d columns", "cons")),
             (F.lit(rep.dup_issue), F.concat(F.format_string("Duplicate Rows: %d (", F.col("dups").cast("bigint")), fmt_fixed("pct", 1), F.lit("%)")))]
    every = F.array(F.format_string("Health Score: %d/100", F.col("score").cast("bigint")), *[F.when(c, x) for c, x in lines])
    shown = F.filter(every, lambda x: x.isNotNull())
    return a.select(F.posexplode(shown).alias("position", "line"))


def preprocessing_lines(cfg, spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(cfg.summary_lines())], "position int, line string")


# The estimators' parameters and defaults, in alphabetical order.
ESTIMATOR_PARAMS = {
    "Logistic Regression": {"C": 1.0, "class_weight": None, "fit_intercept": True, "max_iter": 1000, "penalty": "l2", "random_state": None},
    "K-Nearest Neighbors": {"algorithm": "auto", "leaf_size": 30, "metric": "minkowski", "n_neighbors": 5, "p": 2, "weights": "uniform"},
    "Decision Tree": {"criterion": "gini", "max_depth": None, "min_samples_leaf": 1, "min_samples_split": 2, "random_state": 42},
    "Naive Bayes": {"priors": None, "var_smoothing": 1e-09},
    "Random Forest": {"criterion": "gini", "max_depth": None, "min_samples_leaf": 1, "min_samples_split": 2, "n_estimators": 100, "random_state": 42},
    "SVM": {"C": 1.0, "gamma": "scale", "kernel": "rbf", "max_iter": -1, "probability": True, "random_state": 42},
    "Rule-based (Stratified Baseline)": {"constant": None, "random_state": 42, "strategy": "stratified"},
}
FIRST_PARAMS = 5


def model_configurations(best_params: dict, spark) -> DataFrame:
    """(model, param, value) of each trained model, {name: tuned parameters}: its key
    parameters, or the first five of all where it has none of them."""
    rows = [(m, k, str({**ESTIMATOR_PARAMS.get(m, {}), **tuned}[k]), i, k in KEY_PARAMS)
            for m, tuned in best_params.items() for i, k in enumerate(sorted({**ESTIMATOR_PARAMS.get(m, {}), **tuned}))]
    t = spark.createDataFrame(rows, "model string, param string, value string, nth int, is_key boolean")
    none = t.groupBy("model").agg(F.max("is_key").alias("any_key"))
    return (t.join(F.broadcast(none), "model").where(F.col("is_key") | (~F.col("any_key") & (F.col("nth") < FIRST_PARAMS)))
            .select("model", "param", "value"))


def comparison_table(results: DataFrame) -> DataFrame:
    """Model, accuracy, precision, recall, F1 to 4 places, training time to 2."""
    cols = [F.col("model")] + [F.round(c, 4).alias(c) for c in
                               ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")]
    if "training_time" in results.columns:
        cols.append(F.round("training_time", 2).alias("training_time"))
    return results.select(*cols)


def best_model(results: DataFrame) -> DataFrame:
    """One row: best model by F1 (ties by model name) with its metrics, and the
    best models by accuracy, precision and recall."""
    def key(c):
        return F.struct(F.nanvl(F.col(c), F.lit(None).cast("double")).alias("v"), F.col("neg").alias("t"))
    # the results table has one row per model, so this global window is tiny
    r = results.withColumn("neg", F.lit(0) - F.dense_rank().over(Window.orderBy("model")))
    extra = [F.max_by("training_time", key("f1_weighted")).alias("training_time")] \
        if "training_time" in results.columns else []
    return r.agg(
        F.max_by("model", key("f1_weighted")).alias("model_name"),
        F.max_by("accuracy", key("f1_weighted")).alias("accuracy"),
        F.max_by("f1_weighted", key("f1_weighted")).alias("f1_score"),
        F.max_by("precision_weighted", key("f1_weighted")).alias("precision"),
        F.max_by("recall_weighted", key("f1_weighted")).alias("recall"),
        *extra,
        F.max_by("model", key("accuracy")).alias("best_accuracy"),
        F.max_by("model", key("precision_weighted")).alias("best_precision"),
        F.max_by("model", key("recall_weighted")).alias("best_recall"))


def alternatives(results: DataFrame) -> DataFrame:
    """(category, model, score text) for the best accuracy / precision / recall models."""
    b = best_model(results)
    cats = b.select(F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("Best Accuracy").alias("category"), F.col("best_accuracy").alias("model"),
                 F.lit("accuracy").alias("metric")),
        F.struct(F.lit(2).alias("pos"), F.lit("Best Precision").alias("category"),
                 F.col("best_precision").alias("model"), F.lit("precision_weighted").alias("metric")),
        F.struct(F.lit(3).alias("pos"), F.lit("Best Recall").alias("category"), F.col("best_recall").alias("model"),
                 F.lit("recall_weighted").alias("metric")))).alias("c")).select("c.*")
    long = results.select("model", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("v")),
        F.struct(F.lit("precision_weighted").alias("metric"), F.col("precision_weighted").alias("v")),
        F.struct(F.lit("recall_weighted").alias("metric"), F.col("recall_weighted").alias("v")))).alias("m")) \
        .select("model", "m.metric", "m.v")
    return (cats.join(F.broadcast(long), ["model", "metric"])
            .select("pos", "category", F.substring("model", 1, 30).alias("model"), fmt_fixed("v", 4).alias("score")))


def executive_summary(results: DataFrame, overview: DataFrame, health_score: int | None) -> DataFrame:
    """One row: n_models, total_rows, total_columns, target_column, best and mean accuracy, health score."""
    o = overview.first()
    return results.agg(F.count(F.lit(1)).cast("bigint").alias("n_models"), F.max("accuracy").alias("best_accuracy"),
                       F.avg("accuracy").alias("mean_accuracy")).select(
        "n_models", F.lit(o["total_rows"]).cast("bigint").alias("total_rows"),
        F.lit(o["total_columns"]).cast("bigint").alias("total_columns"),
        F.lit(o["target_column"]).alias("target_column"), "best_accuracy", "mean_accuracy",
        F.lit(HEALTH_DEFAULT if health_score is None else health_score).alias("health_score"))


def report_sections(sections: dict) -> DataFrame:
    """Long report table: union of {section: DataFrame} melted to (section, item, metric, value) text."""
    out = None
    for name, df in sections.items():
        key = df.columns[0]
        others = [c for c in df.columns if c != key]
        long = df.select(F.col(key).cast("string").alias("item"),
                         *[F.col(c).cast("string").alias(c) for c in others]).unpivot(
            ["item"], others, "metric", "value").withColumn("section", F.lit(name))
        long = long.select("section", "item", "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out
