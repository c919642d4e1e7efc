"""Score incoming postings as a stream.

``readStream`` over a folder of raw posting files -> cleaning and row features ->
one-hot (stream-static broadcast joins against the fitted category map) ->
optional scaling -> vector -> fitted classifier -> decision at a frozen
threshold, written in append mode with a checkpoint in the shared folder. Every
step is row-local, so no state is kept; global ranking metrics stay batch.

``start_pipeline`` scores with a saved ML pipeline, text block included: exact copies that arrive
within the watermark are dropped (the only state: one row hash each), and every micro-batch is
written to its own ``batch_id`` folder, so that a batch that runs again replaces itself.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import encode, models
from ..operators.clean import clean_postings
from ..operators.dedupe import row_hash
from ..operators.features import add_all_features


def row_features(stream: DataFrame, onehot: encode.OneHotModel, scaler: encode.ScalerModel | None) -> DataFrame:
    rows = stream.transform(clean_postings).transform(add_all_features)
    rows = onehot.transform(rows)
    rows = models.onehot_vector(rows, [f"slot_{c}" for c in S.CATEGORICAL_FEATURES], onehot.n_slots)
    if scaler is not None:
        rows = scaler.transform(rows)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in S.NUMERIC_FEATURES})
    return models.assemble(rows, ["onehot"] + S.NUMERIC_FEATURES, sizes={"onehot": onehot.n_slots})


def fit_row_model(train: DataFrame, n_trees: int = 50):
    """A boosted-tree model on the row-local features only (no text block), so the
    stream needs no per-document aggregation."""
    featured = train.transform(clean_postings).transform(add_all_features)
    onehot = encode.fit_onehot(featured, S.CATEGORICAL_FEATURES, min_frequency=10)
    feats = row_features(train, onehot, None)
    model = models.fit_gbt(feats, params=models.GbtParams(n_estimators=n_trees))
    return onehot, model


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, onehot, model, threshold: float,
                  checkpoint_dir: str | None = None, available_now: bool = True,
                  schema=S.RAW_SCHEMA):
    base = checkpoint_dir or spark.sparkContext.getCheckpointDir()
    own = "stream-scorer-" + hashlib.md5(sink_dir.encode()).hexdigest()  # one per sink
    stream = spark.readStream.schema(schema).parquet(source_dir)
    scored = models.positive_proba(model.transform(row_features(stream, onehot, None)))
    out = scored.select(S.ID, "y_proba", (F.col("y_proba") >= threshold).cast("int").alias("y_pred"))
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", os.path.join(base, own)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(sink_dir)


def write_batch(batch: DataFrame, batch_id: int, model, sink_dir: str, threshold: float) -> None:
    """Score one micro-batch with ``model`` (features and ``y_proba`` from featured postings) and
    replace its folder."""
    featured = batch.transform(clean_postings).transform(add_all_features).persist()  # row and text blocks read it
    scored = model.transform(featured).select(S.ID, "y_proba", (F.col("y_proba") >= threshold).cast("int").alias("y_pred"))
    scored.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))
    featured.unpersist()


def start_pipeline(spark: SparkSession, source_dir: str, sink_dir: str, model, threshold: float, checkpoint_dir: str | None = None,
                   delay: str = "1 day", available_now: bool = True, schema=S.RAW_SCHEMA):
    """Score a folder of raw postings with a (loaded) ``PipelineModel``.

    A posting equal to an earlier one in all columns but the id is dropped when its file came
    within ``delay`` of the earlier one's; of copies in one micro-batch any one stays. The event
    time is the file's, so a replay after a failure sees the same times."""
    base = checkpoint_dir or spark.sparkContext.getCheckpointDir()
    own = "stream-pipeline-" + hashlib.md5(sink_dir.encode()).hexdigest()  # one per sink
    rows = spark.readStream.schema(schema).parquet(source_dir)
    content = [c for c in schema.names if c != S.ID]
    fresh = rows.select("*", F.col("_metadata.file_modification_time").alias("_seen"), row_hash(rows, content).alias("_row_hash")) \
                .withWatermark("_seen", delay).dropDuplicatesWithinWatermark(["_row_hash"]).select(*schema.names)
    writer = (fresh.writeStream.outputMode("append").option("checkpointLocation", os.path.join(base, own))
              .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, model, sink_dir, threshold)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
