"""Error analysis: confident mistakes, confusion matrix, cohort profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def top_errors(df: DataFrame, threshold: float, kind: str = "false_negatives", top_n: int = 10,
               score: str = "y_proba", label: str = S.TARGET, key: str = S.ID) -> DataFrame:
    """Most confidently wrong rows: missed positives lowest score first, false
    alarms highest score first; ``predicted_proba`` leads. ``orderBy().limit()``
    plans a TakeOrdered (per-task top-n, then a merge), never a full sort."""
    y, s = F.col(label), F.col(score)
    if kind == "false_negatives":
        rows, order = df.where((y == 1) & (s < threshold)), [F.asc(score), F.asc(key)]
    elif kind == "false_positives":
        rows, order = df.where((y != 1) & (s >= threshold)), [F.desc(score), F.asc(key)]
    else:
        raise ValueError(f"kind must be 'false_negatives' or 'false_positives', got {kind!r}")
    picked = rows.orderBy(*order).limit(top_n)
    return picked.select(s.alias("predicted_proba"), *[c for c in df.columns if c != score])


def confusion_matrix(scores: DataFrame, threshold, score: str = "y_proba",
                     label: str = "y_true") -> DataFrame:
    """2x2 counts (empty cells 0) and each cell's share of its true-class row."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = (F.col(score) >= t).cast("int")
    counts = scores.groupBy(F.col(label).cast("int").alias("y_true"), pred.alias("y_pred")) \
                   .agg(F.count(F.lit(1)).alias("n"))
    spark = scores.sparkSession
    grid = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "y_true int, y_pred int")
    full = F.broadcast(grid).join(counts, ["y_true", "y_pred"], "left") \
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long"))
    row = Window.partitionBy("y_true")  # two rows per partition
    total = F.sum("n").over(row)
    return full.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def error_cohorts(df: DataFrame, threshold: float, columns, score: str = "y_proba",
                  label: str = S.TARGET) -> DataFrame:
    """Mean of ``columns`` for missed positives, caught positives and real rows,
    long form (field, cohort, mean)."""
    y, s = F.col(label), F.col(score)
    cohort = (F.when((y == 1) & (s < threshold), F.lit("missed_scams"))
               .when(y == 1, F.lit("caught_scams")).otherwise(F.lit("real_postings")))
    wide = df.groupBy(cohort.alias("cohort")).agg(*[F.avg(F.col(c).cast("double")).alias(c)
                                                    for c in columns])
    return wide.unpivot(["cohort"], list(columns), "field", "mean")


def share_missed(scores: DataFrame, threshold: float, score: str = "y_proba",
                 label: str = "y_true") -> DataFrame:
    y, s = F.col(label), F.col(score)
    return scores.agg(F.count_if((y == 1) & (s < threshold)).alias("missed"),
                      F.count_if(y == 1).alias("positives")) \
        .withColumn("share_missed", F.col("missed") / F.greatest(F.col("positives"), F.lit(1)))
