"""Ranking metrics on one table: distinct scores (descending) with positives,
negatives and cumulative true/false positives.

Scores are first counted per (group, score) with map-side combine, then
``running.running_totals`` gives the cumulative counts without a one-task window.
Everything else (average precision, ROC-AUC, F-beta thresholds, the precision
target, operating points, metrics at a threshold) is one grouped aggregation over
that table. ``group_cols`` (model, split, ...) evaluate many score sets at once.

Conventions (those of the reference's metric library): average precision is the
step sum of (delta recall) * precision, not a trapezoid; ROC-AUC counts ties half;
F-beta ties resolve to the lowest threshold; an unreachable precision gives
(1.0, 0.0); undefined ratios are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .running import running_totals


def _div0(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double")),
                      F.lit(0.0))


def score_counts(scores: DataFrame, group_cols=(), score: str = "y_proba",
                 label: str = "y_true") -> DataFrame:
    y = F.col(label)
    return (scores.where(F.col(score).isNotNull())
                  .groupBy(*group_cols, F.col(score).cast("double").alias("threshold"))
                  .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")))


def curve_table(scores: DataFrame, group_cols=(), score: str = "y_proba", label: str = "y_true",
                buckets: int | None = None) -> DataFrame:
    """One row per (group, distinct score): pos, neg, tp, fp (score >= threshold),
    P, N, precision, recall, fpr, tpr."""
    # the counts feed three passes (range bounds, per-range sums, offsets): materialise
    # them once in the checkpoint folder; they are far smaller than the scores
    counts = cut_lineage(score_counts(scores, group_cols, score, label))
    rt = running_totals(counts, "threshold", ["pos", "neg"], group_cols, descending=True,
                        buckets=buckets)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    big_p, big_n = F.col("tot_pos"), F.col("tot_neg")
    return rt.select(
        *group_cols, "_bucket", "threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"),
        big_p.alias("P"), big_n.alias("N"),
        _div0(tp, tp + fp).alias("precision"),
        F.when(big_p == 0, F.lit(1.0)).otherwise(tp / big_p).alias("recall"),
        _div0(fp, big_n).alias("fpr"), _div0(tp, big_p).alias("tpr"))


def _groups(curve: DataFrame, group_cols):
    return curve.groupBy(*group_cols) if group_cols else curve.groupBy()


def pr_curve(curve: DataFrame, group_cols=()) -> DataFrame:
    """All distinct thresholds plus the closing point (precision 1, recall 0)."""
    pts = curve.select(*group_cols, "threshold", "precision", "recall")
    if group_cols:
        ends = curve.select(*group_cols).distinct()
    else:
        ends = curve.sparkSession.range(1).select()
    ends = ends.select(*group_cols, F.lit(None).cast("double").alias("threshold"),
                       F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(ends)


def _keep_corners(curve: DataFrame, group_cols) -> DataFrame:
    """Rows of the curve that are not collinear with both neighbours: a point is
    dropped when the next lower threshold adds the same (pos, neg) as it did. The
    next row comes from ``lead`` inside each (group, range bucket) and, for a
    bucket's last row, from the first row of the next bucket (a per-bucket table)."""
    from pyspark.sql import Window
    part = list(group_cols) + ["_bucket"]
    inside = Window.partitionBy(*part).orderBy(F.desc("threshold"))
    firsts = curve.groupBy(*part).agg(F.max_by(F.struct("pos", "neg"), F.col("threshold")).alias("_f"))
    nxt = Window.partitionBy(*group_cols).orderBy("_bucket") if group_cols else Window.orderBy("_bucket")
    firsts = firsts.select(*part, F.lead("_f").over(nxt).alias("_next_first"))  # buckets rows
    c = curve.withColumn("_next", F.lead(F.struct("pos", "neg")).over(inside)) \
             .join(firsts, part, "left")
    nxt_row = F.coalesce(F.col("_next"), F.col("_next_first"))
    first_row = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    keep = first_row | nxt_row.isNull() | (nxt_row["pos"] != F.col("pos")) | (nxt_row["neg"] != F.col("neg"))
    return c.where(keep).drop("_next", "_next_first")


def roc_curve(curve: DataFrame, group_cols=(), drop_intermediate: bool = False) -> DataFrame:
    """Distinct thresholds plus the origin (threshold +inf); with
    ``drop_intermediate`` only the corners are kept (the reference's plot default)."""
    if drop_intermediate:
        curve = _keep_corners(curve, group_cols)
    pts = curve.select(*group_cols, "threshold", "fpr", "tpr")
    if group_cols:
        origin = curve.select(*group_cols).distinct()
    else:
        origin = curve.sparkSession.range(1).select()
    origin = origin.select(*group_cols, F.lit(float("inf")).alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def _ap() -> Column:
    return F.coalesce(F.sum(F.try_divide(F.col("pos").cast("double"), F.col("P")) * F.col("precision")),
                      F.lit(0.0))


def _auc() -> Column:
    num = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return F.try_divide(num, F.first("P").cast("double") * F.first("N"))


def ranking_summary(curve: DataFrame, group_cols=()) -> DataFrame:
    """average_precision, roc_auc, positives, rows per group."""
    return _groups(curve, group_cols).agg(
        _ap().alias("average_precision"), _auc().alias("roc_auc"),
        F.first("P").alias("positives"), (F.first("P") + F.first("N")).alias("rows"))


def missing_ids(scores: DataFrame, group: str = "model", id_col: str = "job_id", score: str = "y_proba") -> DataFrame:
    """Per model: how many ids some model scores and this one does not (0: identical rows)."""
    ids = scores.where(F.col(score).isNotNull()).select(group, id_col).distinct()
    every = ids.select(id_col).distinct().select(F.count(F.lit(1))).scalar()
    return ids.groupBy(group).agg(F.count(F.lit(1)).alias("_own")) \
              .select(group, (every - F.col("_own")).alias("missing_ids"))


def evaluate(curve: DataFrame, threshold=0.5, group_cols=()) -> DataFrame:
    """The 7-field metric record per group: AP, ROC-AUC and, at ``threshold``
    (a number or a column, e.g. a joined per-group threshold), F1, precision,
    recall, accuracy."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    at = F.col("threshold") >= t
    agg = _groups(curve, group_cols).agg(
        _ap().alias("average_precision"), _auc().alias("roc_auc"),
        F.coalesce(F.sum(F.when(at, F.col("pos"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(at, F.col("neg"))), F.lit(0)).alias("_fp"),
        F.first("P").alias("_P"), F.first("N").alias("_N"), F.first(t).alias("threshold"))
    tp, fp, p, n = F.col("_tp"), F.col("_fp"), F.col("_P"), F.col("_N")
    fn = p - tp
    tn = n - fp
    return agg.select(
        *group_cols, "average_precision", "roc_auc",
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, p).alias("recall"),
        _div0(tp + tn, p + n).alias("accuracy"),
        F.col("threshold").cast("double").alias("threshold"))


def _fbeta(beta: float) -> Column:
    b2 = beta * beta
    p, r = F.col("precision"), F.col("recall")
    den = b2 * p + r
    return F.when(den > 0, (1 + b2) * p * r / den).otherwise(F.lit(0.0))


def tune_threshold(curve: DataFrame, beta: float = 1.0, group_cols=()) -> DataFrame:
    """Threshold maximising F-beta; ties go to the lowest threshold."""
    best = F.max(F.struct(_fbeta(beta).alias("score"), (-F.col("threshold")).alias("neg_t")))
    out = _groups(curve, group_cols).agg(best.alias("_b"))
    return out.select(*group_cols, (-F.col("_b.neg_t")).alias("threshold"),
                      F.col("_b.score").alias("score"))


def threshold_for_precision(curve: DataFrame, min_precision: float = 0.9,
                            group_cols=()) -> DataFrame:
    """Lowest threshold whose precision reaches ``min_precision`` (recall is maximal
    there); (1.0, 0.0) when no threshold reaches it."""
    ok = F.col("precision") >= min_precision
    low = F.min(F.when(ok, F.struct(F.col("threshold"), F.col("recall"))))
    out = _groups(curve, group_cols).agg(low.alias("_b"))
    return out.select(*group_cols,
                      F.coalesce(F.col("_b.threshold"), F.lit(1.0)).alias("threshold"),
                      F.coalesce(F.col("_b.recall"), F.lit(0.0)).alias("recall"))


def operating_points(curve: DataFrame, group_cols=(), min_precision: float = 0.9) -> DataFrame:
    """F1-best, F2-best and lowest-threshold-at-``min_precision`` points, each with
    its precision, recall and false alarms (negatives flagged)."""
    def pick(beta):
        return F.max(F.struct(_fbeta(beta).alias("s"), (-F.col("threshold")).alias("neg_t"),
                              F.col("precision").alias("p"), F.col("recall").alias("r"),
                              F.col("fp").alias("fp")))
    ok = F.col("precision") >= min_precision
    prec = F.min(F.when(ok, F.struct(F.col("threshold").alias("t"), F.col("precision").alias("p"),
                                     F.col("recall").alias("r"), F.col("fp").alias("fp"))))
    agg = _groups(curve, group_cols).agg(pick(1.0).alias("f1"), pick(2.0).alias("f2"),
                                         prec.alias("pr"))

    def row(name, t, p, r, fp):
        return F.struct(F.lit(name).alias("criterion"), t.cast("double").alias("threshold"),
                        p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        fp.cast("long").alias("false_alarms"))
    rows = F.array(
        row("best_f1", -F.col("f1.neg_t"), F.col("f1.p"), F.col("f1.r"), F.col("f1.fp")),
        row("best_f2", -F.col("f2.neg_t"), F.col("f2.p"), F.col("f2.r"), F.col("f2.fp")),
        row(f"precision_{min_precision:g}", F.coalesce(F.col("pr.t"), F.lit(1.0)),
            F.col("pr.p"), F.coalesce(F.col("pr.r"), F.lit(0.0)), F.coalesce(F.col("pr.fp"), F.lit(0))))
    return agg.select(*group_cols, F.explode(rows).alias("o")).select(*group_cols, "o.*")


def metrics_at_threshold(scores: DataFrame, threshold: float = 0.5, group_cols=(),
                         score: str = "y_proba", label: str = "y_true") -> DataFrame:
    """Confusion counts and precision/recall/F1/accuracy at one threshold, straight
    from the score rows (one aggregation, no curve)."""
    y, s = F.col(label), F.col(score)
    pred = s >= threshold
    agg = (scores.groupBy(*group_cols) if group_cols else scores.groupBy()).agg(
        F.count_if((y == 1) & pred).alias("tp"), F.count_if((y != 1) & pred).alias("fp"),
        F.count_if((y == 1) & ~pred).alias("fn"), F.count_if((y != 1) & ~pred).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(*group_cols, "tp", "fp", "fn", "tn",
                      _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"),
                      _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
                      _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def prevalence(scores: DataFrame, label: str = "y_true", group_cols=()) -> DataFrame:
    """The random-ranker AP line."""
    g = scores.groupBy(*group_cols) if group_cols else scores.groupBy()
    return g.agg(F.avg(F.col(label).cast("double")).alias("prevalence"))
