"""Search over the booster's parameters, refit of the best trial and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import booster, search, trees
from ..sources import io
from . import protocol

TRIAL_SCHEMA = "trial int, num_leaves int, learning_rate double, min_child_samples int, subsample double, " \
               "colsample double, reg_lambda double, reg_alpha double, n_trees int, val_ap double"
NAMES = [name for name, *_ in search.BOOSTER_SPACE]
#: Trials drawn at random, and those that each later batch draws from the trials before it.
STARTUP, BATCH = 10, 15


def _params(values: dict, n_estimators: int) -> booster.BoostParams:
    return booster.BoostParams(n_estimators=n_estimators, **{n: values[n] for n in NAMES})


def booster_search(train: DataFrame, val: DataFrame, n_trials: int = 40, n_estimators: int = 1000,
                   patience: int = 100, seed: int = 42, log_path: str | None = None) -> DataFrame:
    """One row a trial: its parameters, the chosen number of trees and the validation AP.

    Trials are drawn by ``search.tpe_params`` in batches. A batch's boosters grow side by side
    in the same passes over the rows, so the number of jobs follows the rounds, not trials x
    rounds. A finished batch is logged at once: a lost driver keeps it."""
    spark, done, rows = SparkSession.active(), [], []
    while len(rows) < n_trials:
        size = min(BATCH if done else STARTUP, n_trials - len(rows))
        batch = [search.tpe_params(done, len(rows) + k, seed, STARTUP) for k in range(size)]
        fits = booster.fit_boosters(train, [_params(v, n_estimators) for v in batch], val, patience)
        entries = []
        for values, fit in zip(batch, fits):
            trial, ap = len(rows), dict(fit.history).get(fit.best, 0.0)
            done.append((values, ap))
            rows.append((trial, *(values[n] for n in NAMES), fit.best, ap))
            entries.append((f"booster_trial_{trial}", {"average_precision": ap}, f"{values} trees={fit.best}"))
        if log_path:
            io.log_experiments(spark, log_path, entries)
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def refit_best(trials: DataFrame, train: DataFrame, rows: DataFrame, name: str, log_path: str, score_path: str,
               n_estimators: int = 1000, patience: int = 100) -> DataFrame:
    """Refit the best trial on ``train``, score ``rows`` (with a ``split`` column) by its best
    prefix, tune F2 on val and report every split once; log the reports, save the test scores."""
    spark = train.sparkSession
    best = trials.orderBy(F.desc("val_ap"), F.asc("trial")).first().asDict()
    fit = booster.fit_boosters(train, [_params(best, n_estimators)], rows.where(F.col("split") == "val"), patience)[0]
    scored = trees.score_prefix(fit.boosted, rows, fit.best).join(rows.select(S.ID, "split"), S.ID)
    scored = scored.select(F.lit(name).alias("model"), "split", S.ID, "y_true", "y_proba")
    io.save_scores(scored.where(F.col("split") == "test"), score_path, name)
    report = protocol.protocol_metrics(scored)
    for row in report.collect():  # a row a split
        metrics = {k: v for k, v in row.asDict().items() if k in S.METRIC_COLUMNS}
        io.log_experiment(spark, log_path, name, metrics, row["split"], f"trial {best['trial']}, {fit.best} trees")
    return report
