"""Evaluation protocol: tune the threshold on validation, freeze it, report each
split once; experiment rows, leaderboard, train-val gap and delta tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import curves
from ..session import cut_lineage, small_side


def protocol_metrics(scores: DataFrame, beta: float = 2.0, model_col: str = "model",
                     split_col: str = "split", tune_split: str = "val") -> DataFrame:
    """``scores`` (model, split, y_true, y_proba) -> one metric record per
    (model, split) at the model's F-beta threshold tuned on ``tune_split``."""
    groups = [model_col, split_col]
    curve = curves.curve_table(scores, groups)
    tuned = curves.tune_threshold(curve.where(F.col(split_col) == tune_split), beta, [model_col]) \
                  .select(model_col, F.col("threshold").alias("_t"))
    # one threshold row per model
    return curves.evaluate(curve.join(small_side(cut_lineage(tuned)), model_col), F.col("_t"), groups)


def experiment_rows(metrics: DataFrame, notes: str = "", model_col: str = "model",
                    split_col: str = "split") -> DataFrame:
    """The experiment-log row shape (fixed 11-column order)."""
    return metrics.select(F.current_timestamp().alias("timestamp"),
                          F.col(model_col).alias("model"), F.col(split_col).alias("split"),
                          *[F.col(c).cast("double").alias(c) for c in S.METRIC_COLUMNS],
                          F.lit(notes).alias("notes"))


LEADERBOARD_COLUMNS = ["model", "average_precision", "roc_auc", "f1", "precision", "recall",
                       "threshold"]


def leaderboard(log: DataFrame, split: str = "test", digits: int = 4) -> DataFrame:
    """Rows of one split, best average precision first, 7 columns rounded."""
    rows = log.where(F.col("split") == split)
    return rows.orderBy(F.desc("average_precision"), F.asc("model")).select(
        "model", *[F.round(F.col(c), digits).alias(c) for c in LEADERBOARD_COLUMNS[1:]])


def train_val_gap(metrics: DataFrame, metric: str = "average_precision") -> DataFrame:
    return metrics.groupBy("model").agg(
        (F.max(F.when(F.col("split") == "train", F.col(metric)))
         - F.max(F.when(F.col("split") == "val", F.col(metric)))).alias(f"{metric}_gap"))


def delta_table(metrics: DataFrame, baseline: str, candidate: str,
                metric_cols=("average_precision", "roc_auc", "precision", "recall", "f1")) -> DataFrame:
    """(metric, split) rows with baseline, candidate and candidate - baseline."""
    cols = list(metric_cols)
    long = metrics.where(F.col("model").isin(baseline, candidate)) \
                  .select("model", "split", *[F.col(c).cast("double") for c in cols]) \
                  .unpivot(["model", "split"], cols, "metric", "value")
    wide = long.groupBy("metric", "split").agg(
        F.max(F.when(F.col("model") == baseline, F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("model") == candidate, F.col("value"))).alias("candidate"))
    return wide.withColumn("delta", F.col("candidate") - F.col("baseline"))
