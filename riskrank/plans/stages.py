"""The fitted chain as Spark ML stages (A13, H7, H8): ``Pipeline.fit`` fits the feature matrix and
a head, ``PipelineModel.save`` writes both, ``PipelineModel.load`` gives a model that scores new rows.

A stage keeps its fitted tables as Parquet next to its parameters. Any Spark ML classifier can
stand in the place of ``TreeHead``.
"""

from __future__ import annotations

import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import booster, trees
from . import train as T


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.save_tables(os.path.join(path, "tables"))


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.load_tables(self.sparkSession, os.path.join(path, "tables"))
        return stage


class _StoredModel(Model, MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _MatrixParams(Params):
    idCol = Param(Params._dummy(), "idCol", "record id", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label, kept where the rows have it", TypeConverters.toString)
    alsoCols = Param(Params._dummy(), "alsoCols", "columns kept where the rows have them", TypeConverters.toListString)
    svdComponents = Param(Params._dummy(), "svdComponents", "size of the text block (0: none)", TypeConverters.toInt)
    scaleNumeric = Param(Params._dummy(), "scaleNumeric", "standardise the numeric block", TypeConverters.toBoolean)
    validationIndicatorCol = Param(Params._dummy(), "validationIndicatorCol", "rows where it is true fit nothing",
                                   TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol=S.ID, labelCol=S.TARGET, alsoCols=[], svdComponents=200, scaleNumeric=True)


class PostingMatrix(Estimator, _MatrixParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits TF-IDF + SVD, the rare-bucket one-hot and the scaler on featured postings."""

    @keyword_only
    def __init__(self, *, idCol=S.ID, labelCol=S.TARGET, alsoCols=(), svdComponents=200, scaleNumeric=True,
                 validationIndicatorCol=None, tfidf_params=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if k != "tfidf_params" and v is not None}
        self._set(**given)
        self.tfidf_params = tfidf_params

    def _fit(self, rows: DataFrame) -> PostingMatrixModel:
        if self.isSet(self.validationIndicatorCol):
            rows = rows.where(~F.col(self.getOrDefault(self.validationIndicatorCol)))
        art = T.preprocess_fit(rows, self.getOrDefault(self.svdComponents), self.getOrDefault(self.scaleNumeric),
                               self.tfidf_params, self.getOrDefault(self.idCol))
        return self._copyValues(PostingMatrixModel(art))


class PostingMatrixModel(_StoredModel, _MatrixParams):
    """Featured postings -> id, label, kept columns, ``features``."""

    def __init__(self, artifacts: T.Artifacts | None = None):
        super().__init__()
        self.artifacts = artifacts

    def _transform(self, rows: DataFrame) -> DataFrame:
        wanted = list(self.getOrDefault(self.alsoCols))
        if self.isSet(self.validationIndicatorCol):
            wanted.append(self.getOrDefault(self.validationIndicatorCol))
        also = [c for c in dict.fromkeys(wanted) if c in rows.columns]
        return T.preprocess_apply(rows, self.artifacts, self.getOrDefault(self.idCol), self.getOrDefault(self.labelCol), also)

    def save_tables(self, path: str) -> None:
        T.save_artifacts(self.artifacts, path)

    def load_tables(self, spark: SparkSession, path: str) -> None:
        self.artifacts = T.load_artifacts(spark, path)


class _TreeParams(Params):
    idCol, labelCol, validationIndicatorCol = _MatrixParams.idCol, _MatrixParams.labelCol, _MatrixParams.validationIndicatorCol
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "output: positive probability", TypeConverters.toString)
    nEstimators = Param(Params._dummy(), "nEstimators", "trees at most", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "rounds without a better validation rank before the stop", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol=S.ID, labelCol=S.TARGET, featuresCol="features", probabilityCol="y_proba",
                         nEstimators=1000, patience=100)


class TreeHead(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees, stopped early on the rows of ``validationIndicatorCol`` where it is given."""

    @keyword_only
    def __init__(self, *, idCol=S.ID, labelCol=S.TARGET, featuresCol="features", probabilityCol="y_proba", nEstimators=1000,
                 patience=100, validationIndicatorCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, rows: DataFrame) -> TreeHeadModel:
        val = None
        if self.isSet(self.validationIndicatorCol):
            held = F.col(self.getOrDefault(self.validationIndicatorCol))
            rows, val = rows.where(~held), rows.where(held)
        fit = booster.fit_boosters(rows, [booster.BoostParams(n_estimators=self.getOrDefault(self.nEstimators))], val,
                                   self.getOrDefault(self.patience), id_col=self.getOrDefault(self.idCol),
                                   label=self.getOrDefault(self.labelCol), features=self.getOrDefault(self.featuresCol))[0]
        return self._copyValues(TreeHeadModel(fit.boosted.prefix(fit.best)))


class TreeHeadModel(_StoredModel, _TreeParams):
    """Adds ``probabilityCol``; every other column stays."""

    def __init__(self, boosted: trees.Boosted | None = None):
        super().__init__()
        self.boosted = boosted

    def _transform(self, rows: DataFrame) -> DataFrame:
        proba = trees.proba_column(rows.sparkSession, self.boosted, self.getOrDefault(self.featuresCol))
        return rows.withColumn(self.getOrDefault(self.probabilityCol), proba)

    def save_tables(self, path: str) -> None:
        spark = SparkSession.active()
        self.boosted.nodes(spark).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        spark.createDataFrame([(float(self.boosted.base), len(self.boosted.trees))], "base double, n_trees int") \
             .write.mode("overwrite").parquet(os.path.join(path, "model"))

    def load_tables(self, spark: SparkSession, path: str) -> None:
        base, n = spark.read.parquet(os.path.join(path, "model")).first()
        self.boosted = trees.from_nodes(spark.read.parquet(os.path.join(path, "nodes")), base, n)
