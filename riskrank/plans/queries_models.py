"""Queries for the models (I1-I8), SVD (H3) and the parameter search.

Training is iterative, so most of these are checked on rows only; the majority
baseline and the search tables have SQL twins.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import booster, curves, models, search, split, trees, vectors
from ..session import stored
from ..sources import io
from ..sources.tables import table
from ..sources.testviews import featured_postings
from . import oracle as O
from . import stages
from . import train as T
from . import tuning
from .catalog import register
from .queries_io import scratch_folder
from .queries_prep import _ONEHOT, _UNPIV

#: The surveyed sizes. The queries take them as arguments, so that tests can pass smaller ones.
TREES, PATIENCE, SVD_COMPONENTS, MAX_ITER, BOOSTER_TRIALS = 1000, 100, 200, 2000, 40


def _with_split(spark, sf_dir, columns=None):
    """The labelled postings with their split; with ``columns``, only these, the id, label and split."""
    f = featured_postings(spark, sf_dir)
    if columns is not None:
        f = f.select(S.ID, S.TARGET, *columns)
    a = split.stratified_split(f.select("job_id", "fraudulent"), key="arith").select("job_id", "split")
    return f.join(a, "job_id")


@register("majority_baseline", O.with_postings("""
SELECT split, round(avg(CAST(fraudulent AS DOUBLE)), 6) AS average_precision, 0.5 AS roc_auc
FROM featured JOIN assigned USING (job_id, fraudulent) WHERE split IN ('val', 'test') GROUP BY split""",
    O.split_ctes("featured")))
def majority_baseline(spark, sf_dir):
    """Always the training majority; AP = prevalence, ROC-AUC = 0.5."""
    df = _with_split(spark, sf_dir)
    maj = models.majority_class(df.where(F.col("split") == "train"))
    s = models.score_majority(df.where(F.col("split").isin("val", "test")), maj) \
              .select("split", F.col("fraudulent").alias("y_true"), "y_proba")
    return curves.ranking_summary(curves.curve_table(s, ["split"]), ["split"]) \
                 .select("split", "average_precision", "roc_auc")


@register("logreg_tfidf")
def logreg_tfidf(spark, sf_dir, max_iter=MAX_ITER):
    """TF-IDF (fit on train) -> balanced logistic regression; val/test scores."""
    df = _with_split(spark, sf_dir, [S.FULL_TEXT]).persist(StorageLevel.MEMORY_AND_DISK)
    train = df.where(F.col("split") == "train")
    return T.tfidf_logreg_scores(train, df.where(F.col("split") != "train"), max_iter=max_iter)


def _embedding_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("job_id"), "embedding", (F.col("label") == 0).cast("int").alias("fraudulent"))
    a = split.stratified_split(e.select("job_id", "fraudulent"), key="arith").select("job_id", "split")
    return vectors.embedding_vectors(e.join(a, "job_id"), "embedding", normalise=True)


@register("logreg_embedding")
def logreg_embedding(spark, sf_dir, max_iter=MAX_ITER):
    """Normalised embeddings -> balanced logistic regression."""
    e = _embedding_rows(spark, sf_dir)
    m = models.fit_logreg(e.where(F.col("split") == "train"), max_iter=max_iter)
    return models.score(m, e.where(F.col("split") != "train")).join(e.select("job_id", "split"), "job_id")


_FITTED: dict = {}


def _once(spark, name, *key, make):
    """``make()`` once a session and key: several queries read the same fitted model."""
    key = (spark.sparkContext.applicationId, name, *key)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


@register("gbt_embedding")
def gbt_embedding(spark, sf_dir, n_trees=TREES):
    """Boosted trees on the embeddings (positive-class weight, all rounds); val/test scores."""
    e = _embedding_rows(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    fit = _once(spark, "gbt_embedding", sf_dir, n_trees, make=lambda: T.embedding_head(
        e.where(F.col("split") == "train"), "trees", n_estimators=n_trees))
    out = trees.score_prefix(fit.boosted, e.where(F.col("split") != "train"), fit.best)
    return out.join(e.select("job_id", "split"), "job_id")


def _meta_matrix(spark, sf_dir, k=SVD_COMPONENTS):
    """The assembled matrix of all labelled postings and the preprocessing fitted on train, once a session and folder."""
    def make():
        # fit and apply both read the split postings: keep them (spilling if needed)
        df = _with_split(spark, sf_dir, [S.FULL_TEXT, *S.CATEGORICAL_FEATURES, *S.NUMERIC_FEATURES]).persist(StorageLevel.MEMORY_AND_DISK)
        art = T.preprocess_fit(df.where(F.col("split") == "train"), svd_components=k, scale_numeric=False)
        matrix = stored(T.preprocess_apply(df, art, also=["split"]), "meta-matrix")
        df.unpersist()
        return matrix, art
    return _once(spark, "meta_matrix", sf_dir, k, make=make)


def _gbt_meta(spark, sf_dir, n_trees=TREES, patience=PATIENCE, k=SVD_COMPONENTS):
    """The matrix, its preprocessing and the early-stopped booster, fitted once a session and folder."""
    def make():
        x, art = _meta_matrix(spark, sf_dir, k)
        fit = booster.fit_boosters(x.where(F.col("split") == "train"), [booster.BoostParams(n_estimators=n_trees)],
                                   x.where(F.col("split") == "val"), patience)[0]
        return x, art, fit
    return _once(spark, "gbt_meta", sf_dir, n_trees, patience, k, make=make)


@register("assembled_matrix", O.with_postings(
    f"""SELECT a.job_id, s.name, CASE WHEN coalesce(m.slot, CASE WHEN wo.nrare > 0 THEN wo.off + wo.nfreq END) = s.slot
       THEN 1.0 ELSE 0.0 END AS value
FROM ({_UNPIV.format(src='featured')}) a JOIN wo USING (feature) JOIN slots s USING (feature)
LEFT JOIN mapping m ON m.feature = a.feature AND m.category = a.category
UNION ALL """ + " UNION ALL ".join(
        f"SELECT job_id, '{c}', round(CAST({c} AS DOUBLE), 6) FROM featured" for c in S.NUMERIC_FEATURES), _ONEHOT))
def assembled_matrix(spark, sf_dir, k=SVD_COMPONENTS):
    """The stacked matrix by cell and name; the one-hot and numeric blocks (the text
    block is that of ``svd_components``)."""
    x, art = _meta_matrix(spark, sf_dir, k)
    return models.matrix_long(x, art.names).where("block <> 'svd'").select("job_id", "name", "value")


@register("saved_pipeline")
def saved_pipeline(spark, sf_dir, n_trees=TREES, patience=PATIENCE, k=SVD_COMPONENTS):
    """Preprocessing and booster saved as one ML pipeline, loaded, and applied to the featured
    postings outside train; ``direct`` is the score without the round trip."""
    x, art, fit = _gbt_meta(spark, sf_dir, n_trees, patience, k)
    matrix = stages.PostingMatrixModel(art)
    matrix.set(matrix.alsoCols, ["split"])
    path = scratch_folder(spark, "pipeline")
    io.save_model(PipelineModel([matrix, stages.TreeHeadModel(fit.boosted.prefix(fit.best))]), path)
    loaded = io.load_model(PipelineModel, path)
    other = _with_split(spark, sf_dir).where(F.col("split") != "train")
    direct = trees.score_prefix(fit.boosted, x.where(F.col("split") != "train"), fit.best, label=None)
    return loaded.transform(other).select("job_id", "split", "y_proba") \
                 .join(direct.withColumnRenamed("y_proba", "direct"), "job_id")


@register("gbt_meta")
def gbt_meta(spark, sf_dir, n_trees=TREES, patience=PATIENCE, k=SVD_COMPONENTS):
    """SVD text block + one-hot + hand-made features -> boosted trees."""
    x, _, fit = _gbt_meta(spark, sf_dir, n_trees, patience, k)
    other = x.where(F.col("split") != "train")
    return trees.score_prefix(fit.boosted, other, fit.best).join(other.select("job_id", "split"), "job_id")


@register("gain_importance")
def gain_importance(spark, sf_dir, n_trees=TREES, patience=PATIENCE, k=SVD_COMPONENTS):
    """Summed gain of the splits up to the best round: top 25 features, top 12 outside the text block."""
    _, art, fit = _gbt_meta(spark, sf_dir, n_trees, patience, k)
    return trees.top_gain(trees.gain_table(fit.boosted.prefix(fit.best), art.names))


@register("svd_components")
def svd_components(spark, sf_dir, k=SVD_COMPONENTS):
    """H3: truncated SVD (k=200) of the training TF-IDF matrix, applied to every posting."""
    _, art = _meta_matrix(spark, sf_dir, k)
    every = featured_postings(spark, sf_dir, labelled=False)
    sv = art.svd.transform_long(art.tfidf.transform_rows(every, "job_id", S.FULL_TEXT), "id", "svd")
    # a posting without a vocabulary term is projected to zeros
    sv = sv.select(F.col("id").alias("job_id"), vectors.vector_to_array("svd").alias("row"))
    row = F.coalesce("row", F.array_repeat(F.lit(0.0), art.svd_components))
    return every.select("job_id").join(sv, "job_id", "left").select("job_id", F.posexplode(row).alias("i", "value"))


@register("gbt_best_prefix")
def gbt_best_prefix(spark, sf_dir, n_trees=TREES, patience=PATIENCE, k=SVD_COMPONENTS):
    """I4: validation AP of every round, and which one the early stop chose."""
    *_, fit = _gbt_meta(spark, sf_dir, n_trees, patience, k)
    return spark.createDataFrame([(n, ap, n == fit.best) for n, ap in fit.history],
                                 "n_trees int, average_precision double, chosen boolean")


@register("gbt_early_stopped")
def gbt_early_stopped(spark, sf_dir, n_trees=TREES, patience=PATIENCE, k=SVD_COMPONENTS):
    """I4: the test postings scored by the prefix that the early stop chose."""
    x, _, fit = _gbt_meta(spark, sf_dir, n_trees, patience, k)
    return trees.score_prefix(fit.boosted, x.where(F.col("split") == "test"), fit.best)


@register("tree_contributions")
def tree_contributions(spark, sf_dir, n_trees=TREES, patience=PATIENCE, k=SVD_COMPONENTS):
    """Mean absolute Shapley value on validation, top 20 features."""
    x, art, fit = _gbt_meta(spark, sf_dir, n_trees, patience, k)
    return trees.contribution_means(trees.contributions(fit.boosted.prefix(fit.best), x.where(F.col("split") == "val")), art.names)


def _booster_search(spark, sf_dir, n_trials, n_estimators, patience):
    def make():
        e = _embedding_rows(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        folder = scratch_folder(spark, "booster")
        trials = tuning.booster_search(e.where(F.col("split") == "train"), e.where(F.col("split") == "val"), n_trials,
                                       n_estimators, patience, log_path=f"{folder}/log")
        return e, trials, folder
    return _once(spark, "booster_search", sf_dir, n_trials, n_estimators, patience, make=make)


@register("booster_search_report")
def booster_search_report(spark, sf_dir, n_trials=BOOSTER_TRIALS, n_estimators=TREES, patience=PATIENCE):
    """Search over the booster's seven parameters, refit of the best trial, F2 threshold
    tuned on val, one report a split."""
    e, trials, folder = _booster_search(spark, sf_dir, n_trials, n_estimators, patience)
    return tuning.refit_best(trials, e.where(F.col("split") == "train"), e, "booster_tuned", f"{folder}/log",
                             f"{folder}/scores", n_estimators, patience)


@register("booster_param_effect")
def booster_param_effect(spark, sf_dir, n_trials=BOOSTER_TRIALS, n_estimators=TREES, patience=PATIENCE):
    """Per parameter of the booster's search, share of AP variance explained by its quartile bin."""
    return search.param_effect(_booster_search(spark, sf_dir, n_trials, n_estimators, patience)[1], names=tuning.NAMES)


_TRIALS = 40
_RULE_FEATURES = [feature for _, feature, *_ in search.SPACE]


@register("random_search", search.trials_sql(_TRIALS))
def random_search(spark, sf_dir):
    """Seeded random search over a linear risk rule's weights, val AP per trial
    (all trials scored in one grouped pass)."""
    return search.linear_rule_search(_with_split(spark, sf_dir, _RULE_FEATURES), _TRIALS)


@register("trial_best_so_far", search.best_so_far_sql(_TRIALS))
def trial_best_so_far(spark, sf_dir):
    """Running best val AP over the trial order."""
    return search.best_so_far(search.linear_rule_search(_with_split(spark, sf_dir, _RULE_FEATURES), _TRIALS))


@register("param_effect", search.param_effect_sql(_TRIALS))
def param_effect(spark, sf_dir):
    """Per parameter, share of AP variance explained by its quartile bin."""
    return search.param_effect(search.linear_rule_search(_with_split(spark, sf_dir, _RULE_FEATURES), _TRIALS))


@register("top_coefficients")
def top_coefficients(spark, sf_dir, max_iter=MAX_ITER):
    """20 most positive and 20 most negative TF-IDF logistic coefficients."""
    df = _with_split(spark, sf_dir, [S.FULL_TEXT]).persist(StorageLevel.MEMORY_AND_DISK)
    train = df.where(F.col("split") == "train")
    vec, m = T.tfidf_logreg(train, max_iter=max_iter)
    return models.coefficient_table(m.coefficients, vec.vocabulary, 20)


@register("best_trial_report")
def best_trial_report(spark, sf_dir):
    """The best trial's rule, F2 threshold tuned on val and frozen, every split."""
    from . import protocol
    df = _with_split(spark, sf_dir, _RULE_FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    best = search.best_trial(search.linear_rule_search(df, _TRIALS))
    return protocol.protocol_metrics(search.rule_scores(df, best))


def _contrib_sql():
    feats = [(name, feat) for name, feat, *_ in search.SPACE]
    parts = " UNION ALL ".join(
        f"SELECT '{feat}' AS feature, round(avg(abs(best.{name} * (CAST(v.{feat} AS DOUBLE) - mu.{feat}))), 6) "
        f"AS mean_abs_contribution FROM val v, best, mu" for name, feat in feats)
    return O.with_postings(parts, search._trials_ctes(_TRIALS) + """,
best AS (SELECT * FROM trials ORDER BY val_ap DESC, trial LIMIT 1),
mu AS (SELECT """ + ", ".join(f"avg(CAST({feat} AS DOUBLE)) AS {feat}" for _, feat in feats) + " FROM val)")


@register("contribution_summary", _contrib_sql())
def contribution_summary(spark, sf_dir):
    """Mean absolute contribution w * (x - mean) of the best rule on validation."""
    df = _with_split(spark, sf_dir, _RULE_FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    best = search.best_trial(search.linear_rule_search(df, _TRIALS))
    return search.contribution_summary(df.where(F.col("split") == "val"), best)
