"""Queries for ranking metrics, thresholds, errors and the model comparison.

Scores come from two deterministic scorers over the labelled documents
(``testviews.long_scores``): ``length_score`` (heavily tied) and ``hash_score``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, errors, split
from ..session import small_side
from ..sources.testviews import featured_postings, long_scores, scored_postings
from . import oracle as O
from . import protocol
from .catalog import register

G = ["model"]
_CURVE = O.curve_ctes("scores", G)


def _ws(select_sql, extra=""):
    return O.with_scores(select_sql, _CURVE + ("," + extra if extra else ""))


def _curve(spark, sf_dir):
    return curves.curve_table(long_scores(spark, sf_dir), G)


@register("pr_curve", _ws("""
SELECT model, threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM curve
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM curve"""))
def pr_curve(spark, sf_dir):
    """every distinct threshold plus the closing (1, 0) point, per model."""
    return curves.pr_curve(_curve(spark, sf_dir), G)


@register("roc_curve", _ws("""
SELECT model, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM curve"""))
def roc_curve(spark, sf_dir):
    """ROC points with the origin, per model."""
    return curves.roc_curve(_curve(spark, sf_dir), G)


@register("average_precision", _ws(f"SELECT model, round({O.AP}, 6) AS average_precision "
                                   "FROM curve GROUP BY model"))
def average_precision(spark, sf_dir):
    """F2: step-wise average precision per model."""
    return curves.ranking_summary(_curve(spark, sf_dir), G).select("model", "average_precision")


@register("roc_auc", _ws(f"SELECT model, round({O.AUC}, 6) AS roc_auc FROM curve GROUP BY model"))
def roc_auc(spark, sf_dir):
    """ROC-AUC with ties counted half, per model."""
    return curves.ranking_summary(_curve(spark, sf_dir), G).select("model", "roc_auc")


@register("model_summary", _ws(f"""
SELECT model, round({O.AP}, 6) AS average_precision, round({O.AUC}, 6) AS roc_auc,
       CAST(max("P") AS BIGINT) AS positives, CAST(max("P") + max("N") AS BIGINT) AS "rows",
       (SELECT count(DISTINCT job_id) FROM scores) - (SELECT count(DISTINCT job_id) FROM scores o WHERE o.model = curve.model) AS missing_ids
FROM curve GROUP BY model"""))
def model_summary(spark, sf_dir):
    """AP and ROC-AUC of every model, and whether they scored the same rows (``missing_ids`` 0)."""
    same = curves.missing_ids(long_scores(spark, sf_dir))
    return curves.ranking_summary(_curve(spark, sf_dir), G).join(small_side(same), "model")


@register("metrics_at_threshold", O.with_scores("""
SELECT model, tp, fp, fn, tn,
  round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS "precision",
  round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy
FROM (SELECT model, count(*) FILTER (WHERE y_true = 1 AND y_proba >= 0.5) AS tp,
             count(*) FILTER (WHERE y_true <> 1 AND y_proba >= 0.5) AS fp,
             count(*) FILTER (WHERE y_true = 1 AND y_proba < 0.5) AS fn,
             count(*) FILTER (WHERE y_true <> 1 AND y_proba < 0.5) AS tn FROM scores GROUP BY model)"""))
def metrics_at_threshold(spark, sf_dir):
    """confusion counts and precision/recall/F1/accuracy at 0.5."""
    return curves.metrics_at_threshold(long_scores(spark, sf_dir), 0.5, G)


def _tune_sql(beta):
    return f"""SELECT model, CAST({beta!r} AS DOUBLE) AS beta, threshold, round(score, 6) AS score FROM (
  SELECT model, threshold, {O.fbeta(beta)} AS score,
         row_number() OVER (PARTITION BY model ORDER BY {O.fbeta(beta)} DESC, threshold) AS rn
  FROM curve) WHERE rn = 1"""


@register("tune_fbeta", _ws(_tune_sql(1.0) + "\nUNION ALL\n" + _tune_sql(2.0)))
def tune_fbeta(spark, sf_dir):
    """F1- and F2-maximising thresholds (ties -> lowest threshold)."""
    c = _curve(spark, sf_dir)
    return curves.tune_threshold(c, 1.0, G).withColumn("beta", F.lit(1.0)).unionByName(
        curves.tune_threshold(c, 2.0, G).withColumn("beta", F.lit(2.0)))


def _prec_sql(p):
    return f"""SELECT model, CAST({p!r} AS DOUBLE) AS min_precision,
  coalesce(min(threshold) FILTER (WHERE "precision" >= {p!r}), 1.0) AS threshold,
  round(coalesce(arg_min(recall, threshold) FILTER (WHERE "precision" >= {p!r}), 0.0), 6) AS recall
FROM curve GROUP BY model"""


@register("threshold_for_precision", _ws(_prec_sql(0.2) + "\nUNION ALL\n" + _prec_sql(0.9)))
def threshold_for_precision(spark, sf_dir):
    """F8: lowest threshold reaching a precision (0.2 reachable, 0.9 not -> (1, 0))."""
    c = _curve(spark, sf_dir)
    return curves.threshold_for_precision(c, 0.2, G).withColumn("min_precision", F.lit(0.2)) \
        .unionByName(curves.threshold_for_precision(c, 0.9, G).withColumn("min_precision", F.lit(0.9)))


def _op_sql(name, beta):
    return f"""SELECT model, '{name}' AS criterion, threshold, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, CAST(fp AS BIGINT) AS false_alarms FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY {O.fbeta(beta)} DESC, threshold) AS rn
  FROM curve) WHERE rn = 1"""


@register("operating_points", _ws(
    _op_sql("best_f1", 1.0) + "\nUNION ALL\n" + _op_sql("best_f2", 2.0) + """
UNION ALL
SELECT m.model, 'precision_0.2', coalesce(p.threshold, 1.0), round(p."precision", 6),
       round(coalesce(p.recall, 0.0), 6), CAST(coalesce(p.fp, 0) AS BIGINT)
FROM (SELECT DISTINCT model FROM curve) m LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY threshold) AS rn
                 FROM curve WHERE "precision" >= 0.2) WHERE rn = 1) p USING (model)"""))
def operating_points(spark, sf_dir):
    """F1-best, F2-best and precision-target operating points with false alarms."""
    return curves.operating_points(_curve(spark, sf_dir), G, min_precision=0.2)


@register("prevalence", O.with_scores(
    "SELECT model, round(avg(CAST(y_true AS DOUBLE)), 6) AS prevalence FROM scores GROUP BY model"))
def prevalence(spark, sf_dir):
    """the random-ranker line."""
    return curves.prevalence(long_scores(spark, sf_dir), group_cols=G)


def _length_scores(spark, sf_dir):
    return long_scores(spark, sf_dir).where(F.col("model") == "length_score")


@register("confusion", O.with_scores("""
SELECT g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round(CASE WHEN sum(coalesce(c.n, 0)) OVER (PARTITION BY g.y_true) > 0
             THEN coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.y_true) ELSE 0 END, 6) AS share
FROM (SELECT CAST(a AS BIGINT) AS y_true, CAST(b AS BIGINT) AS y_pred FROM range(2) t(a), range(2) u(b)) g
LEFT JOIN (SELECT y_true, CAST(y_proba >= 0.5 AS INTEGER) AS y_pred, count(*) AS n FROM scores
           WHERE model = 'length_score' GROUP BY ALL) c ON g.y_true = c.y_true AND g.y_pred = c.y_pred"""))
def confusion(spark, sf_dir):
    """2x2 confusion matrix with row shares at 0.5 (length_score)."""
    return errors.confusion_matrix(_length_scores(spark, sf_dir), 0.5)


@register("top_errors", O.with_scores("""
SELECT * FROM (SELECT 'false_negatives' AS kind, y_proba AS predicted_proba, job_id, y_true FROM scores
               WHERE model = 'length_score' AND y_true = 1 AND y_proba < 0.5
               ORDER BY y_proba, job_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'false_positives', y_proba, job_id, y_true FROM scores
               WHERE model = 'length_score' AND y_true <> 1 AND y_proba >= 0.5
               ORDER BY y_proba DESC, job_id LIMIT 10)"""))
def top_errors(spark, sf_dir):
    """G1: ten most confident misses and false alarms at 0.5."""
    s = _length_scores(spark, sf_dir).select("job_id", "y_true", "y_proba")
    fn = errors.top_errors(s, 0.5, "false_negatives", 10, label="y_true")
    fp = errors.top_errors(s, 0.5, "false_positives", 10, label="y_true")
    return fn.withColumn("kind", F.lit("false_negatives")).unionByName(
        fp.withColumn("kind", F.lit("false_positives")))


@register("share_missed", O.with_scores("""
SELECT missed, positives, round(CAST(missed AS DOUBLE) / greatest(positives, 1), 6) AS share_missed
FROM (SELECT count(*) FILTER (WHERE y_true = 1 AND y_proba < 0.5) AS missed,
             count(*) FILTER (WHERE y_true = 1) AS positives FROM scores WHERE model = 'length_score')"""))
def share_missed(spark, sf_dir):
    """Share of positives below the threshold."""
    return errors.share_missed(_length_scores(spark, sf_dir), 0.5)


_COHORT = ["has_company_logo", "has_questions", "company_profile_is_missing",
           "full_text_word_count", "caps_ratio"]


@register("error_cohorts", O.with_postings(
    """SELECT cohort, field, round(mean, 6) AS mean FROM (UNPIVOT w ON """ + ", ".join(_COHORT)
    + " INTO NAME field VALUE mean)",
    extra_ctes="j AS (SELECT f.*, round(CAST(d.n_chars % 1000 AS DOUBLE) / 1000.0, 3) AS y_proba "
    "FROM featured f JOIN documents d ON f.job_id = d.doc_id),\n"
    "w AS (SELECT CASE WHEN fraudulent = 1 AND y_proba < 0.5 THEN 'missed_scams' "
    "WHEN fraudulent = 1 THEN 'caught_scams' ELSE 'real_postings' END AS cohort, "
    + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in _COHORT) + " FROM j GROUP BY cohort)"))
def error_cohorts(spark, sf_dir):
    """Missed vs caught vs real means on five columns."""
    f = featured_postings(spark, sf_dir)
    s = scored_postings(spark, sf_dir).select("job_id", F.col("s1").alias("y_proba"))
    return errors.error_cohorts(f.join(s, "job_id"), 0.5, _COHORT)


# -- protocol over a stratified split of the scored rows -------------------------
def _split_scores(spark, sf_dir):
    jobs = scored_postings(spark, sf_dir).select("job_id", F.col("y_true").alias("fraudulent"))
    assigned = split.stratified_split(jobs, key="arith").select("job_id", "split")
    return long_scores(spark, sf_dir).join(assigned, "job_id")


_PROTO_CTES = ",\n".join([
    O.JOBS, O.split_ctes("jobs"),
    "s AS (SELECT sc.model, a.split, sc.job_id, sc.y_true, sc.y_proba FROM scores sc JOIN assigned a USING (job_id))",
    O.curve_ctes("s", ["model", "split"]),
    f"""tuned AS (SELECT model, threshold AS t FROM (
  SELECT model, threshold, row_number() OVER (PARTITION BY model ORDER BY {O.fbeta(2.0)} DESC, threshold) AS rn
  FROM curve WHERE split = 'val') WHERE rn = 1)""",
    f"""agg AS (SELECT c.model, c.split, {O.AP} AS average_precision, {O.AUC} AS roc_auc,
  coalesce(sum(pos) FILTER (WHERE threshold >= t), 0) AS tp_, coalesce(sum(neg) FILTER (WHERE threshold >= t), 0) AS fp_,
  max("P") AS p_, max("N") AS n_, max(t) AS threshold FROM curve c JOIN tuned USING (model) GROUP BY c.model, c.split)""",
    """metrics AS (SELECT model, split, average_precision, roc_auc,
  CASE WHEN 2 * tp_ + fp_ + (p_ - tp_) > 0 THEN CAST(2 * tp_ AS DOUBLE) / (2 * tp_ + fp_ + (p_ - tp_)) ELSE 0 END AS f1,
  CASE WHEN tp_ + fp_ > 0 THEN CAST(tp_ AS DOUBLE) / (tp_ + fp_) ELSE 0 END AS "precision",
  CASE WHEN p_ > 0 THEN CAST(tp_ AS DOUBLE) / p_ ELSE 0 END AS recall,
  CASE WHEN p_ + n_ > 0 THEN CAST(tp_ + (n_ - fp_) AS DOUBLE) / (p_ + n_) ELSE 0 END AS accuracy,
  threshold FROM agg)"""])


@register("protocol_metrics", O.with_scores("""
SELECT model, split, round(average_precision, 6) AS average_precision, round(roc_auc, 6) AS roc_auc,
  round(f1, 6) AS f1, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(accuracy, 6) AS accuracy, round(threshold, 6) AS threshold FROM metrics""", _PROTO_CTES))
def protocol_metrics(spark, sf_dir):
    """F2 threshold tuned on val, frozen, metrics on every split."""
    return protocol.protocol_metrics(_split_scores(spark, sf_dir))


@register("leaderboard", O.with_scores("""
SELECT model, round(average_precision, 4) AS average_precision, round(roc_auc, 4) AS roc_auc,
  round(f1, 4) AS f1, round("precision", 4) AS "precision", round(recall, 4) AS recall,
  round(threshold, 4) AS threshold FROM metrics WHERE split = 'test'
ORDER BY average_precision DESC, model""", _PROTO_CTES))
def leaderboard(spark, sf_dir):
    """A10: test rows of the experiment table, best AP first, 7 columns."""
    m = protocol.protocol_metrics(_split_scores(spark, sf_dir))
    return protocol.leaderboard(protocol.experiment_rows(m))


@register("train_val_gap", O.with_scores("""
SELECT model, round(max(average_precision) FILTER (WHERE split = 'train')
                    - max(average_precision) FILTER (WHERE split = 'val'), 6) AS average_precision_gap
FROM metrics GROUP BY model""", _PROTO_CTES))
def train_val_gap(spark, sf_dir):
    """train AP minus val AP per model."""
    return protocol.train_val_gap(protocol.protocol_metrics(_split_scores(spark, sf_dir)))


_DELTA = ["average_precision", "roc_auc", "precision", "recall", "f1"]


@register("delta_table", O.with_scores("""
SELECT metric, split, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate,
       round(candidate - baseline, 6) AS delta FROM (
  SELECT metric, split, max(value) FILTER (WHERE model = 'hash_score') AS baseline,
         max(value) FILTER (WHERE model = 'length_score') AS candidate
  FROM (UNPIVOT (SELECT model, split, """ + ", ".join(f'"{c}"' for c in _DELTA) + """ FROM metrics)
        ON """ + ", ".join(f'"{c}"' for c in _DELTA) + """ INTO NAME metric VALUE value)
  GROUP BY metric, split)""", _PROTO_CTES))
def delta_table(spark, sf_dir):
    """baseline vs candidate metrics per split and their difference."""
    m = protocol.protocol_metrics(_split_scores(spark, sf_dir))
    return protocol.delta_table(m, "hash_score", "length_score", _DELTA)


@register("softmax_scores", O.with_scores("""
SELECT model, job_id, round(1.0 / (1.0 + exp((1.0 - y_proba) - y_proba)), 6) AS y_proba FROM scores"""))
def softmax_scores(spark, sf_dir):
    """Two-logit softmax, with (1 - score, score) as the logits."""
    from ..operators.models import logits_to_proba
    s = long_scores(spark, sf_dir).select("model", "job_id", (1.0 - F.col("y_proba")).alias("l0"),
                                          F.col("y_proba").alias("l1"))
    return logits_to_proba(s).select("model", "job_id", "y_proba")


@register("review_queue", O.with_scores("""
SELECT job_id, y_proba FROM scores WHERE model = 'length_score' ORDER BY y_proba DESC, job_id LIMIT 20"""))
def review_queue(spark, sf_dir):
    """The 20 highest-risk postings first (a top-k report, TakeOrdered)."""
    s = _length_scores(spark, sf_dir)
    return s.orderBy(F.desc("y_proba"), F.asc("job_id")).limit(20).select("job_id", "y_proba")



@register("roc_corners", _ws("""
SELECT model, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM (
  SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, lag(pos) OVER w AS pp FROM curve
  WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))
WHERE pp IS NULL OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM curve"""))
def roc_corners(spark, sf_dir):
    """F4 with intermediate (collinear) points dropped, as the reference's ROC plot."""
    return curves.roc_curve(_curve(spark, sf_dir), G, drop_intermediate=True)
