"""Queries for the fitted encoders (H4, H5, B21), embeddings (H10), prompt and
reply tables (B22, B28, I14) and the reproducible draws (C3-C6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import encode, prompts, split
from ..operators import curves
from ..sources.tables import table
from ..sources.testviews import featured_postings, scorer_replies
from . import oracle as O
from .catalog import register

_CATS = S.CATEGORICAL_FEATURES


def _featured_split(spark, sf_dir):
    f = featured_postings(spark, sf_dir)
    a = split.stratified_split(f.select("job_id", "fraudulent"), key="arith").select("job_id", "split")
    return f.join(a, "job_id")


def _train(spark, sf_dir):
    return _featured_split(spark, sf_dir).where(F.col("split") == "train")


_SPLIT = O.split_ctes("featured")
_UNPIV = " UNION ALL ".join(
    f"SELECT {i} AS feature_idx, '{c}' AS feature, job_id, CAST({O.qi(c)} AS VARCHAR) AS category FROM {{src}}"
    for i, c in enumerate(_CATS))
_ONEHOT = _SPLIT + f""",
tr AS (SELECT f.* FROM featured f JOIN assigned a USING (job_id) WHERE a.split = 'train'),
cnt AS (SELECT feature_idx, feature, category, count(*) AS n FROM ({_UNPIV.format(src='tr')})
        WHERE category IS NOT NULL GROUP BY feature_idx, feature, category),
r AS (SELECT *, sum(CASE WHEN n >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY feature_idx) AS nfreq,
             sum(CASE WHEN n < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY feature_idx) AS nrare,
             sum(CASE WHEN n >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY feature_idx ORDER BY category
                                                           ROWS UNBOUNDED PRECEDING) AS fr FROM cnt),
wd AS (SELECT feature_idx, feature, max(nfreq) + CASE WHEN max(nrare) > 0 THEN 1 ELSE 0 END AS width,
              max(nfreq) AS nfreq, max(nrare) AS nrare FROM r GROUP BY feature_idx, feature),
wo AS (SELECT *, coalesce(sum(width) OVER (ORDER BY feature_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
       FROM wd),
mapping AS (SELECT r.feature, r.category,
                   CASE WHEN r.n >= 10 THEN wo.off + r.fr - 1 ELSE wo.off + wo.nfreq END AS slot,
                   CASE WHEN r.n >= 10 THEN r.fr - 1 ELSE wo.nfreq END AS local_slot, r.n < 10 AS rare
            FROM r JOIN wo USING (feature_idx)),
slots AS (SELECT feature, category, slot, local_slot, feature || '_' || category AS name, 0 AS is_infrequent
          FROM mapping WHERE NOT rare
          UNION ALL SELECT feature, NULL, off + nfreq, nfreq, feature || '_infrequent_sklearn', 1 FROM wo WHERE nrare > 0)"""


# fitted on labelled postings, applied to all
_ONEHOT_ALL = ("labelled AS (SELECT * FROM featured WHERE job_id IN (SELECT doc_id FROM labels)),\n"
               + _ONEHOT.replace(_SPLIT, O.split_ctes("labelled")))


def _fit_onehot(spark, sf_dir):
    return encode.fit_onehot(_train(spark, sf_dir), _CATS, min_frequency=10)


@register("onehot_rare", O.with_postings(
    """SELECT feature, category, CAST(slot AS BIGINT) AS slot, CAST(local_slot AS BIGINT) AS local_slot,
       name, CAST(is_infrequent AS BIGINT) AS is_infrequent FROM slots""", _ONEHOT))
def onehot_rare(spark, sf_dir):
    """H4 fit on train: sorted frequent categories, one trailing rare bucket per column."""
    m = _fit_onehot(spark, sf_dir)
    return m.slots.select("feature", "category", "slot", "local_slot", "name", "is_infrequent")


@register("onehot_apply", O.with_postings(
    f"""SELECT a.job_id, a.feature, CAST(CASE WHEN a.category IS NULL THEN NULL
       ELSE coalesce(m.slot, CASE WHEN wo.nrare > 0 THEN wo.off + wo.nfreq END) END AS BIGINT) AS slot
FROM ({_UNPIV.format(src='featured')}) a JOIN wo USING (feature)
LEFT JOIN mapping m ON m.feature = a.feature AND m.category = a.category""", _ONEHOT_ALL, labelled=False))
def onehot_apply(spark, sf_dir):
    """H4/H8 apply on every posting: unseen categories go to the bucket (or none)."""
    m = _fit_onehot(spark, sf_dir)
    enc = m.transform(featured_postings(spark, sf_dir, labelled=False).select("job_id", *_CATS))
    names = [f"slot_{c}" for c in _CATS]
    return enc.select("job_id", *[F.col(n).cast("long").alias(c) for n, c in zip(names, _CATS)]) \
              .unpivot(["job_id"], _CATS, "feature", "slot")


_NUM = S.NUMERIC_FEATURES


@register("standardise", O.with_postings(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
  round(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) < 2.220446049250313e-15 THEN 1.0
             ELSE stddev_pop(CAST({c} AS DOUBLE)) END, 6) AS scale FROM tr""" for c in _NUM),
    _SPLIT + ",\ntr AS (SELECT f.* FROM featured f JOIN assigned a USING (job_id) WHERE a.split = 'train')"))
def standardise(spark, sf_dir):
    """H5 fit on train: mean and population deviation (zero deviation -> 1)."""
    return encode.scaler_stats(_train(spark, sf_dir), _NUM)


@register("standardise_apply", O.with_postings(
    " UNION ALL ".join(
        f"""SELECT f.job_id, '{c}' AS feature, round((CAST(f.{c} AS DOUBLE) - m.mean) / m.scale, 6) AS value
FROM featured f, (SELECT avg(CAST({c} AS DOUBLE)) AS mean,
  CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) < 2.220446049250313e-15 THEN 1.0
       ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS scale FROM tr) m""" for c in _NUM),
    _SPLIT.replace("FROM featured)", "FROM featured WHERE job_id IN (SELECT doc_id FROM labels))", 1)
    + ",\ntr AS (SELECT f.* FROM featured f JOIN assigned a USING (job_id) WHERE a.split = 'train')", labelled=False))
def standardise_apply(spark, sf_dir):
    """H5/H8: the scaler fitted on train, applied to every posting."""
    scaler = encode.fit_scaler(_train(spark, sf_dir), _NUM)
    every = scaler.transform(featured_postings(spark, sf_dir, labelled=False).select("job_id", *_NUM))
    return every.unpivot(["job_id"], _NUM, "feature", "value")


_SVD_K = 20


@register("feature_name_sanitise", O.with_postings(
    f"""SELECT idx, name, block, CASE WHEN rn = 0 THEN clean ELSE clean || '__' || CAST(rn AS VARCHAR) END AS safe_name
FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY idx) - 1 AS rn FROM (
  SELECT *, coalesce(nullif(regexp_replace(regexp_replace(name, '[^0-9a-zA-Z_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''),
                     'feature') AS clean FROM names))""",
    _ONEHOT + f""",
names AS (SELECT CAST(i AS BIGINT) AS idx, 'svd_' || CAST(i AS VARCHAR) AS name, 'svd' AS block FROM range({_SVD_K}) t(i)
  UNION ALL SELECT CAST(slot + {_SVD_K} AS BIGINT), name, 'onehot' FROM slots
  UNION ALL SELECT CAST(i + {_SVD_K} + (SELECT sum(width) FROM wo) AS BIGINT), n, 'numeric'
            FROM (SELECT unnest(range({len(_NUM)})) AS i, unnest([{", ".join(O.q(c) for c in _NUM)}]) AS n))"""))
def feature_name_sanitise(spark, sf_dir):
    """Names of the stacked matrix (svd, one-hot, numeric) made safe and unique."""
    m = _fit_onehot(spark, sf_dir)
    names = encode.feature_names(spark, _SVD_K, m, _NUM)
    return encode.sanitize_names(names)


@register("embedding_l2", """
SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(v[i] / nrm, 6) AS value
FROM (SELECT vec_id, v, generate_subscripts(v, 1) AS i, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm
      FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings))""")
def embedding_l2(spark, sf_dir):
    """H10 on every embedding (stretched by a factor per row, as they have length one), long form."""
    e = table(spark, sf_dir, "embeddings")
    from ..operators.vectors import l2_normalise
    v = l2_normalise(F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)))
    return e.select("vec_id", F.posexplode(v).alias("i", "value"))


@register("embedding_columns", "SELECT vec_id, " + ", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS emb_{i}" for i in range(64)) + " FROM embeddings")
def embedding_columns(spark, sf_dir):
    """H9: every embedding as named columns."""
    from ..operators import vectors
    return vectors.embedding_columns(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 64)


_RENDER = ("substring(concat_ws(chr(10), " + ", ".join(
    f"'{label}: ' || coalesce(nullif({O.strip(f'CAST({O.qi(c)} AS VARCHAR)')}, ''), '(missing)')"
    for label, c in prompts.POSTING_FIELDS) + "), 1, 3000)")


@register("prompt_render", O.with_postings(f"SELECT job_id, {_RENDER} AS prompt FROM featured", labelled=False))
def prompt_render(spark, sf_dir):
    """Every posting rendered as labelled lines, cut at 3,000 characters."""
    return prompts.prompt_table(featured_postings(spark, sf_dir, labelled=False))


@register("reply_parse", "WITH " + O.REPLIES + "\nSELECT job_id, round(fraud_probability, 6) AS fraud_probability, reason FROM parsed")
def reply_parse(spark, sf_dir):
    """Reply JSON parsed, clamped, failures mapped to NULL + reason."""
    return prompts.parse_replies(scorer_replies(spark, sf_dir)).select("job_id", "fraud_probability", "reason")


@register("reply_metrics", "WITH " + O.REPLIES + ",\n" + O.JOBS + """,
s AS (SELECT p.job_id, j.fraudulent AS y_true, p.fraud_probability AS y_proba FROM parsed p JOIN jobs j USING (job_id)),
cuts AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_proba >= 0.5) AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_proba >= 0.5) AS fp,
              count(*) FILTER (WHERE y_true = 1 AND y_proba < 0.5) AS fn, count(*) FILTER (WHERE y_true <> 1 AND y_proba < 0.5) AS tn FROM s),
""" + O.curve_ctes("s") + """
SELECT (SELECT count(*) FROM s WHERE y_proba IS NOT NULL) AS scored, (SELECT count(*) FROM s WHERE y_proba IS NULL) AS unscored,
  round(""" + O.AP + """, 6) AS average_precision, round(""" + O.AUC + """, 6) AS roc_auc,
  (SELECT round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) FROM cuts) AS f1,
  (SELECT round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) FROM cuts) AS "precision",
  (SELECT round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) FROM cuts) AS recall,
  (SELECT round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0), 6) FROM cuts) AS accuracy FROM curve""")
def reply_metrics(spark, sf_dir):
    """Score postings by joining parsed replies; ranking metrics and those at 0.5 over non-NULL scores."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"),
                                                    F.col("toxic").cast("int").alias("y_true"))
    s = prompts.score_with_replies(labels, scorer_replies(spark, sf_dir)) \
               .withColumnRenamed("fraud_probability", "y_proba")
    summary = curves.evaluate(curves.curve_table(s), 0.5)
    scored = s.select(F.count_if(F.col("y_proba").isNotNull())).scalar()
    unscored = s.select(F.count_if(F.col("y_proba").isNull())).scalar()
    return summary.select(scored.alias("scored"), unscored.alias("unscored"), "average_precision", "roc_auc",
                          "f1", "precision", "recall", "accuracy")


def _k1(seed=42):
    return F.pmod(F.col("job_id") * 7919 + seed, F.lit(100003))


def _k2(seed=42):
    return F.pmod(F.col("job_id") * 104729 + seed, F.lit(100019))


def _draw_sql(split_name, quota_sql):
    return O.with_postings(f"""
SELECT job_id, CAST(fraudulent AS BIGINT) AS fraudulent, row_number() OVER (ORDER BY k2, job_id) AS ord
FROM (SELECT a.job_id, a.fraudulent, ((a.job_id * 104729 + 42) % 100019) AS k2,
             row_number() OVER (PARTITION BY a.fraudulent ORDER BY ((a.job_id * 7919 + 42) % 100003), a.job_id) AS rn
      FROM assigned a WHERE a.split = '{split_name}') WHERE rn <= {quota_sql}""", _SPLIT)


@register("few_shot_sample", _draw_sql("train", "4"))
def few_shot_sample(spark, sf_dir):
    """Four training rows per class, reproducible order, then shuffled."""
    tr = _train(spark, sf_dir).select("job_id", "fraudulent")
    return prompts.quota_sample(tr, "fraudulent", 4, _k1(), shuffle_key=_k2())


@register("eval_sample", _draw_sql("val", "CASE WHEN a.fraudulent = 1 THEN 5 ELSE 15 END"
                                   .replace("a.fraudulent", "fraudulent")))
def eval_sample(spark, sf_dir):
    """C4: 5 positives and 15 negatives from validation."""
    va = _featured_split(spark, sf_dir).where(F.col("split") == "val").select("job_id", "fraudulent")
    return prompts.quota_sample(va, "fraudulent", {1: 5, 0: 15}, _k1(), shuffle_key=_k2())


_BLOCK = ("'### Example posting' || chr(10) || " + _RENDER + " || chr(10) || chr(10) || 'Verdict: ' || "
          "CASE WHEN fraudulent = 1 THEN 'FRAUDULENT' ELSE 'LEGITIMATE' END")


@register("few_shot_document", O.with_postings(f"""
SELECT 'Here are labelled examples from the same dataset.' || chr(10) || chr(10)
       || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY ord) AS document
FROM (SELECT f.*, s.ord FROM featured f JOIN smp s USING (job_id))""", _SPLIT + """,
smp AS (SELECT job_id, row_number() OVER (ORDER BY k2, job_id) AS ord FROM (
  SELECT a.job_id, ((a.job_id * 104729 + 42) % 100019) AS k2,
         row_number() OVER (PARTITION BY a.fraudulent ORDER BY ((a.job_id * 7919 + 42) % 100003), a.job_id) AS rn
  FROM assigned a WHERE a.split = 'train') WHERE rn <= 4)"""))
def few_shot_document(spark, sf_dir):
    """The few-shot examples rendered with verdicts into one document."""
    tr = _train(spark, sf_dir)
    smp = prompts.quota_sample(tr.select("job_id", "fraudulent"), "fraudulent", 4, _k1(), shuffle_key=_k2())
    rows = tr.join(smp.select("job_id", "ord"), "job_id")
    return prompts.few_shot_document(rows)


@register("sample_n", O.with_postings("""
SELECT job_id, CAST(fraudulent AS BIGINT) AS fraudulent FROM featured
ORDER BY ((job_id * 7919 + 42) % 100003), job_id LIMIT 100""", labelled=False))
def sample_n(spark, sf_dir):
    """A fixed-size reproducible sample (100 rows, TakeOrdered)."""
    f = featured_postings(spark, sf_dir, labelled=False).select("job_id", "fraudulent")
    return prompts.head_by_hash(f, 100, _k1())


_NAMES_CTES = _ONEHOT + f""",
names AS (SELECT CAST(i AS BIGINT) AS idx, 'svd_' || CAST(i AS VARCHAR) AS name, 'svd' AS block FROM range({_SVD_K}) t(i)
  UNION ALL SELECT CAST(slot + {_SVD_K} AS BIGINT), name, 'onehot' FROM slots
  UNION ALL SELECT CAST(i + {_SVD_K} + (SELECT sum(width) FROM wo) AS BIGINT), n, 'numeric'
            FROM (SELECT unnest(range({len(_NUM)})) AS i, unnest([{", ".join(O.q(c) for c in _NUM)}]) AS n))"""


@register("feature_block_widths", O.with_postings(
    "SELECT block, CAST(count(*) AS BIGINT) AS n FROM names GROUP BY block", _NAMES_CTES))
def feature_block_widths(spark, sf_dir):
    """Width of each block of the stacked matrix."""
    from ..operators.eda import feature_block_widths as widths
    m = _fit_onehot(spark, sf_dir)
    return widths(encode.feature_names(spark, _SVD_K, m, _NUM))
