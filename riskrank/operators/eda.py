"""Exploratory summaries: class balance, flag rates, missingness lift, medians,
category risk, histograms, box statistics, class weights.

Aggregations are grouped by low-cardinality keys (class, flag, category, split),
so Spark's partial (map-side) aggregation makes a hot key cost one row per map
task. Wide tables are aggregated first and unpivoted after, never the reverse.
Quantiles are exact and distributed (``running.exact_quantiles``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as tx
from ..session import cut_lineage, small_side
from .running import exact_quantiles, quantile_columns


def class_balance(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Rows per class, share, and whether the class is the majority (its share is
    then the always-majority accuracy; the positive share is the prevalence)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # over the class rows only (one per class)
    return counts.select(
        target, "n",
        (F.col("n") / F.sum("n").over(everything)).alias("share"),
        (F.col("n") == F.max("n").over(everything)).cast("int").alias("is_majority"))


def split_summary(df: DataFrame, split_col: str = "split", target: str = S.TARGET) -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"),
                                     F.avg(target).alias("positive_rate"))


def flag_rates(df: DataFrame, flags) -> DataFrame:
    return df.agg(*[F.avg(f).alias(f) for f in flags])


def flag_rate_by_class(df: DataFrame, flags, target: str = S.TARGET) -> DataFrame:
    return df.groupBy(target).agg(*[F.avg(f).alias(f) for f in flags])


MISSINGNESS_FLAGS = ["company_profile_is_missing", "salary_range_is_missing",
                     "benefits_is_missing", "requirements_is_missing", "department_is_missing"]
INVERTED_PRESENCE = {"no_company_logo": "has_company_logo",
                     "no_screening_questions": "has_questions"}


def missingness_lift(df: DataFrame, target: str = S.TARGET, flags=None,
                     inverted=None) -> DataFrame:
    """Per flag: missing rate among negatives (``real``) and positives (``fake``)
    and ``lift`` = fake / real (NULL when real is 0), highest lift first; ``lift_rank`` is the place."""
    flags = list(flags or MISSINGNESS_FLAGS)
    inverted = dict(inverted or INVERTED_PRESENCE)
    rates = [F.avg(f).alias(f) for f in flags] + \
            [(1 - F.avg(src)).alias(name) for name, src in inverted.items()]
    wide = df.groupBy(target).agg(*rates)  # one row per class
    names = flags + list(inverted)
    long = wide.unpivot([target], names, "flag", "rate")
    out = long.groupBy("flag").agg(
        F.max(F.when(F.col(target) == 0, F.col("rate"))).alias("real"),
        F.max(F.when(F.col(target) == 1, F.col("rate"))).alias("fake"))
    out = out.withColumn("lift", F.try_divide(F.col("fake"), F.nullif(F.col("real"), F.lit(0.0))))
    by_lift = Window.orderBy(F.desc_nulls_last("lift"), "flag")  # one row per flag
    return out.withColumn("lift_rank", F.row_number().over(by_lift)).orderBy("lift_rank")


def median_by_class(df: DataFrame, columns, target: str = S.TARGET) -> DataFrame:
    """Exact (interpolated) median per (field, class), long form."""
    long = df.select(target, *[F.col(c).cast("double").alias(c) for c in columns]) \
             .unpivot([target], list(columns), "field", "value")
    q = exact_quantiles(long, "value", [0.5], ["field", target])
    return q.select("field", target, F.col("value").alias("median"))


def present_rate(df: DataFrame, column: str, target: str = S.TARGET) -> DataFrame:
    """Share of rows whose (cleaned) text is non-empty, per class."""
    return df.groupBy(target).agg(
        F.avg((F.length(F.coalesce(F.col(column), F.lit(""))) > 0).cast("double")).alias("present_rate"))


def rate_by_category(df: DataFrame, column: str, target: str = S.TARGET, min_count: int = 30,
                     top: int = 12) -> DataFrame:
    """Positive rate per category with at least ``min_count`` rows, top-n by rate
    (ties by category name). NULL categories are left out, as in a pandas groupby."""
    grouped = (df.where(F.col(column).isNotNull())
                 .groupBy(column).agg(F.avg(target).alias("positive_rate"),
                                      F.count(F.lit(1)).alias("n")))
    return (grouped.where(F.col("n") >= min_count)
                   .orderBy(F.desc("positive_rate"), F.asc(column)).limit(top))


def length_histogram(df: DataFrame, column: str, target: str = S.TARGET, lo: float = 0.0,
                     hi: float = 1200.0, bins: int = 60) -> DataFrame:
    """Density histogram per class on [lo, hi]: values outside are dropped, ``hi``
    falls in the last bin; density = count / (in-range rows of the class * width)."""
    v = F.col(column).cast("double")
    b = F.width_bucket(v, F.lit(lo), F.lit(hi), F.lit(bins))
    b = F.when(v == hi, F.lit(bins)).otherwise(b)
    ok = (F.col("bin") >= 1) & (F.col("bin") <= bins)
    # Out-of-range rows are not counted by the aggregate itself, and the empty groups
    # go after it: a filter on a derived feature would be pushed below the scan's
    # repartition and re-evaluate the whole feature expression there.
    counts = df.select(target, b.alias("bin")).groupBy(target, "bin") \
               .agg(F.count_if(ok).alias("n")).where(F.col("n") > 0)
    per_class = Window.partitionBy(target)  # at most `bins` rows per class
    width = (hi - lo) / bins
    return counts.select(target, "bin",
                         (F.lit(lo) + (F.col("bin") - 1) * width).alias("bin_start"), "n",
                         (F.col("n") / (F.sum("n").over(per_class) * width)).alias("density"))


def box_stats(df: DataFrame, columns, target: str = S.TARGET, whis: float = 1.5) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per (field, class), outliers hidden."""
    long = df.select(target, *[F.col(c).cast("double").alias(c) for c in columns]) \
             .unpivot([target], list(columns), "field", "value") \
             .where(F.col("value").isNotNull())
    # the narrow (field, class, value) table feeds the quartile and whisker passes
    long = cut_lineage(long)
    quart = quantile_columns(long, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                             ["field", target])
    iqr = F.col("q3") - F.col("q1")
    fences = quart.select("field", target, "q1", "median", "q3",
                          (F.col("q1") - whis * iqr).alias("_lo"), (F.col("q3") + whis * iqr).alias("_hi"))
    v = F.col("value").cast("double")
    fences = cut_lineage(fences)
    whiskers = long.join(small_side(fences), ["field", target]).groupBy("field", target).agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("whislo"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whishi"))
    return fences.drop("_lo", "_hi").join(whiskers, ["field", target])


def scale_pos_weight(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """neg/pos; NULL when there are no positives (``compute_scale_pos_weight`` raises)."""
    return df.agg(F.try_divide(F.count_if(F.col(target) == 0).cast("double"),
                               F.nullif(F.count_if(F.col(target) == 1), F.lit(0)).cast("double"))
                  .alias("scale_pos_weight"))


def compute_scale_pos_weight(df: DataFrame, target: str = S.TARGET) -> float:
    value = scale_pos_weight(df, target).first()[0]
    if value is None:
        raise ValueError("no positive samples in y")
    return float(value)


def class_weights(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per class
    return counts.select(target, "n",
                         (F.sum("n").over(everything)
                          / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"))


def feature_block_widths(names: DataFrame) -> DataFrame:
    return names.groupBy("block").agg(F.count(F.lit(1)).alias("n"))


def nonblank_share(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg((~tx.is_blank(column)).cast("double")).alias("nonblank_share"))
