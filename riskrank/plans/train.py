"""Fit-on-train / apply-elsewhere feature preprocessing (H7, H8) and the model
runs built on it (I2, I3, I5, I6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import booster, encode, models, newton, tfidf


@dataclass
class Artifacts:
    tfidf: tfidf.TfidfModel
    svd: models.SvdModel | None
    onehot: encode.OneHotModel
    scaler: encode.ScalerModel | None
    names: DataFrame
    svd_components: int


def preprocess_fit(train: DataFrame, svd_components: int = 200, scale_numeric: bool = True,
                   tfidf_params: tfidf.TfidfParams | None = None, id_col: str = S.ID) -> Artifacts:
    vec = tfidf.fit(train, id_col, S.FULL_TEXT, tfidf_params)
    svd = None
    if svd_components:
        weights = vec.transform_rows(train, id_col, S.FULL_TEXT)
        svd = models.fit_svd(weights, vec.vocab_size, min(svd_components, max(vec.vocab_size - 1, 1)))
        svd_components = svd.components.shape[1]
    onehot = encode.fit_onehot(train, S.CATEGORICAL_FEATURES, min_frequency=10)
    scaler = encode.fit_scaler(train, S.NUMERIC_FEATURES) if scale_numeric else None
    names = encode.sanitize_names(encode.feature_names(train.sparkSession, svd_components, onehot,
                                                       S.NUMERIC_FEATURES))
    return Artifacts(vec, svd, onehot, scaler, names, svd_components)


def preprocess_apply(df: DataFrame, art: Artifacts, id_col: str = S.ID, label: str = S.TARGET, also=()) -> DataFrame:
    """(id, label, ``also``, features): svd block, one-hot block, numeric block. Nothing refits."""
    own = [id_col] + ([label] if label in df.columns else []) + list(also)
    rows = art.onehot.transform(df)
    rows = models.onehot_vector(rows, [f"slot_{c}" for c in S.CATEGORICAL_FEATURES], art.onehot.n_slots)
    if art.scaler is not None:
        rows = art.scaler.transform(rows)
    keep = own + ["onehot"] + S.NUMERIC_FEATURES
    rows = rows.select(*[F.col(c).cast("double") if c in S.NUMERIC_FEATURES else F.col(c) for c in keep])
    inputs = ["onehot"] + S.NUMERIC_FEATURES
    sizes = {"onehot": art.onehot.n_slots}
    if art.svd is not None:
        sv = art.svd.transform_long(art.tfidf.transform_rows(df, id_col, S.FULL_TEXT), "id", "svd")
        # a posting with no vocabulary term has an all-zero TF-IDF row, so its
        # projection is the zero vector
        zero = array_to_vector(F.array_repeat(F.lit(0.0), art.svd_components))
        rows = rows.join(sv.withColumnRenamed("id", id_col), id_col, "left") \
                   .withColumn("svd", F.coalesce(F.col("svd"), zero))
        inputs = ["svd"] + inputs
        sizes["svd"] = art.svd_components
    return models.assemble(rows, inputs, sizes=sizes).select(*own, "features")


def tfidf_logreg(train: DataFrame, C: float = 1.0, max_iter: int = 2000, params: tfidf.TfidfParams | None = None,
                 id_col: str = S.ID) -> tuple[tfidf.TfidfModel, newton.SparseLogistic]:
    """TF-IDF fitted on train -> balanced logistic regression, intercept penalised."""
    vec = tfidf.fit(train, id_col, S.FULL_TEXT, params)
    rows = vec.transform_rows(train, id_col, S.FULL_TEXT).join(train.select(F.col(id_col).alias("id"), S.TARGET), "id")
    return vec, newton.fit(rows, vec.vocab_size, C, max_iter=max_iter)


def tfidf_logreg_scores(train: DataFrame, others: DataFrame, C: float = 1.0, max_iter: int = 2000,
                        params: tfidf.TfidfParams | None = None, id_col: str = S.ID) -> DataFrame:
    """Scores for ``others`` (id, split, y_true, y_proba) by a model fitted on ``train``."""
    vec, model = tfidf_logreg(train, C, max_iter, params, id_col)
    scored = model.scores(vec.transform_rows(others, id_col, S.FULL_TEXT)).withColumnRenamed("id", id_col)
    return scored.join(others.select(id_col, "split", S.TARGET), id_col).select(
        id_col, "split", F.col(S.TARGET).cast("int").alias("y_true"), "y_proba")


def embedding_head(train: DataFrame, kind: str = "logistic", val: DataFrame | None = None, n_estimators: int = 1000,
                   patience: int = 100, max_iter: int = 2000):
    """A classifier on embedding vectors: ``logistic`` (balanced) or ``trees`` (stopped early
    on ``val``, when given)."""
    if kind == "logistic":
        return models.fit_logreg(train, max_iter=max_iter)
    if kind == "trees":
        return booster.fit_boosters(train, [booster.BoostParams(n_estimators=n_estimators)], val, patience)[0]
    raise ValueError(f"unknown kind of head: {kind!r} (logistic or trees)")


def save_artifacts(art: Artifacts, path: str) -> str:
    """Write the fitted bundle as Parquet tables plus one small JSON of scalars."""
    import dataclasses
    import json
    import os

    import numpy as np
    spark = art.names.sparkSession
    art.tfidf.vocabulary.write.mode("overwrite").parquet(os.path.join(path, "vocabulary"))
    art.onehot.mapping.write.mode("overwrite").parquet(os.path.join(path, "onehot_mapping"))
    art.onehot.widths.write.mode("overwrite").parquet(os.path.join(path, "onehot_widths"))
    art.onehot.slots.write.mode("overwrite").parquet(os.path.join(path, "onehot_slots"))
    art.names.write.mode("overwrite").parquet(os.path.join(path, "feature_names"))
    if art.scaler is not None:
        art.scaler.stats.write.mode("overwrite").parquet(os.path.join(path, "scaler"))
    if art.svd is not None:
        comp = art.svd.components
        spark.createDataFrame([(i, comp[i].tolist()) for i in range(comp.shape[0])],
                              "term_id long, v array<double>") \
             .write.mode("overwrite").parquet(os.path.join(path, "svd_components"))
    meta = {"n_docs": art.tfidf.n_docs, "vocab_size": art.tfidf.vocab_size,
            "tfidf_params": dataclasses.asdict(art.tfidf.params),
            "onehot_columns": art.onehot.columns, "n_slots": art.onehot.n_slots,
            "n_categories": art.onehot.n_categories, "svd_components": art.svd_components,
            "singular_values": None if art.svd is None else np.asarray(art.svd.singular_values).tolist(),
            "has_scaler": art.scaler is not None}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
         .write.mode("overwrite").text(os.path.join(path, "meta"))
    return path


def load_artifacts(spark, path: str) -> Artifacts:
    import json
    import os

    import numpy as np
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    p = meta["tfidf_params"]
    params = tfidf.TfidfParams(**{**p, "ngram_range": tuple(p["ngram_range"]),
                                  "stop_words": None if p["stop_words"] is None else tuple(p["stop_words"])})
    vec = tfidf.TfidfModel(spark.read.parquet(os.path.join(path, "vocabulary")), meta["n_docs"], params,
                           meta["vocab_size"])
    onehot = encode.OneHotModel(meta["onehot_columns"], spark.read.parquet(os.path.join(path, "onehot_slots")),
                                spark.read.parquet(os.path.join(path, "onehot_mapping")),
                                spark.read.parquet(os.path.join(path, "onehot_widths")),
                                meta["n_slots"], meta["n_categories"])
    scaler = None
    if meta["has_scaler"]:
        stats = spark.read.parquet(os.path.join(path, "scaler"))
        scaler = encode.ScalerModel(stats, {r["feature"]: (r["mean"], r["scale"]) for r in stats.collect()})
    svd = None
    if meta["singular_values"] is not None:
        rows = sorted(spark.read.parquet(os.path.join(path, "svd_components")).collect(), key=lambda r: r[0])
        svd = models.SvdModel(np.array([r["v"] for r in rows]), np.array(meta["singular_values"]))
    return Artifacts(vec, svd, onehot, scaler, spark.read.parquet(os.path.join(path, "feature_names")),
                     meta["svd_components"])
