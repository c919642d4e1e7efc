"""The streaming scorer processes a folder of raw postings and appends scores."""

import os
import tempfile

from pyspark.sql import functions as F

from pyspark.ml import Pipeline, PipelineModel

from riskrank import schema as S
from riskrank.operators.clean import clean_postings
from riskrank.operators.features import add_all_features
from riskrank.operators.tfidf import TfidfParams
from riskrank.plans import stages
from riskrank.sources.testviews import raw_postings
from riskrank.streaming import scorer


def test_stream_scores_all_rows(spark):
    raw = raw_postings(spark, "/root/testdata/sf0.001").select(*S.RAW_COLUMNS)
    d = tempfile.mkdtemp(prefix="riskrank-stream-")
    src, sink, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    raw.write.parquet(src)
    onehot, model = scorer.fit_row_model(raw.transform(lambda x: x), n_trees=3)
    q = scorer.start_scoring(spark, src, sink, onehot, model, 0.5, checkpoint_dir=ck)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == raw.count()
    assert out.where(F.col("y_proba").isNull()).count() == 0


def test_saved_pipeline_scores_a_restarted_stream(spark):
    raw = raw_postings(spark, "/root/testdata/sf0.001").select(*S.RAW_COLUMNS).cache()
    featured = raw.transform(clean_postings).transform(add_all_features)
    fitted = Pipeline(stages=[stages.PostingMatrix(svdComponents=4, tfidf_params=TfidfParams(max_features=200)),
                              stages.TreeHead(nEstimators=5)]).fit(featured)
    d = tempfile.mkdtemp(prefix="riskrank-stream-")
    src, sink, ck, saved = (os.path.join(d, x) for x in ("in", "out", "ck", "model"))
    fitted.write().overwrite().save(saved)
    loaded = PipelineModel.load(saved)
    direct = {r.job_id: r.y_proba for r in fitted.transform(featured).collect()}
    again = {r.job_id: r.y_proba for r in loaded.transform(featured).collect()}
    assert direct == again and len(set(direct.values())) > 1

    first, rest = raw.where("job_id % 2 = 0"), raw.where("job_id % 2 = 1")
    copies = first.withColumn("job_id", F.col("job_id") + 10_000_000)
    first.unionByName(copies.limit(5)).write.mode("append").parquet(src)
    scorer.start_pipeline(spark, src, sink, loaded, 0.5, checkpoint_dir=ck).awaitTermination(300)
    rest.unionByName(copies).write.mode("append").parquet(src)  # copies of rows scored before the restart
    scorer.start_pipeline(spark, src, sink, loaded, 0.5, checkpoint_dir=ck).awaitTermination(300)
    content = [c for c in S.RAW_COLUMNS if c != "job_id"]
    out = spark.read.parquet(sink)
    found = {r.job_id % 10_000_000: r.y_proba for r in out.collect()}
    assert out.count() == raw.select(*content).distinct().count() == len(found)
    assert all(direct[i] == p for i, p in found.items())

    # a micro-batch that runs again replaces itself
    last = max(int(f.split("=")[1]) for f in os.listdir(sink) if f.startswith("batch_id="))
    ids = [r.job_id for r in out.where(f"batch_id = {last}").collect()]
    scorer.write_batch(rest.where(F.col("job_id").isin(ids)), last, loaded, sink, 0.5)
    assert spark.read.parquet(sink).count() == len(found)
