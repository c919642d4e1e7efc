"""Queries that go through the sources and sinks (A1-A4, A6-A9, A11, A12, D5): write to the
shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources.tables import table
from ..sources.testviews import long_scores, raw_postings
from . import oracle as O
from . import protocol
from .catalog import register


def scratch_folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@register("score_store", O.with_scores("""
SELECT job_id, y_true, y_proba, CASE model WHEN 'hash_score' THEN 'Hash' ELSE model END AS model, 'test' AS split FROM scores"""))
def score_store(spark, sf_dir):
    """Save each model's scores twice (the second replaces the first), scan them, with an alias."""
    path, scores = scratch_folder(spark, "scores"), long_scores(spark, sf_dir)
    for model in ("length_score", "length_score", "hash_score"):
        io.save_scores(scores.where(F.col("model") == model), path, model)
    return io.scan_scores(spark, path, "test", {"hash_score": "Hash"}) \
             .select("job_id", "y_true", "y_proba", "model", "split")


@register("split_store", """
SELECT doc_id AS job_id, coalesce(text, '') AS description, CAST(doc_id % 2 AS BIGINT) AS fraudulent
FROM documents WHERE doc_id % 20 >= 14 AND doc_id % 20 < 17""")
def split_store(spark, sf_dir):
    """A2-A4: one table partitioned by split; one split read back, projected."""
    path, i = scratch_folder(spark, "splits"), F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        i.alias("job_id"), F.col("text").alias("description"), (i % 2).alias("fraudulent"),
        F.when(i % 20 < 14, "train").when(i % 20 < 17, "val").otherwise("test").alias("split"))
    io.save_splits(docs, path)
    return io.load_split(spark, path, "val", ["job_id", "description", "fraudulent"])


@register("embedding_cache", """
SELECT vec_id AS job_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS pass, CAST(len(embedding) AS BIGINT) AS dims
FROM embeddings""")
def embedding_cache(spark, sf_dir):
    """A first run caches a third of the ids; a second one encodes only the others."""
    path = scratch_folder(spark, "embedding-cache")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")

    def encoder(nth):
        return lambda todo: todo.select("job_id", F.lit(nth).alias("pass"), F.size("embedding").alias("dims"))
    io.encode_cached(spark, path, rows.where("job_id % 3 = 0"), encoder(1))
    return io.encode_cached(spark, path, rows, encoder(2)).select("job_id", "pass", "dims")


_CSV_TEXT = [c for c in S.RAW_COLUMNS if c not in ("job_id", "telecommuting", "has_company_logo", "has_questions", "fraudulent")]


@register("postings_csv", O.with_postings("SELECT job_id, telecommuting, has_company_logo, has_questions, fraudulent, "
          + ", ".join(f"CASE WHEN {O.qi(c)} IN ({', '.join(O.q(t) for t in io.NA_TOKENS)}) THEN NULL ELSE {O.qi(c)} END AS {O.qi(c)}"
                      for c in _CSV_TEXT) + " FROM raw_postings", labelled=False))
def postings_csv(spark, sf_dir):
    """A1: every posting written as quoted CSV and read back; blank and NA cells become NULL."""
    path = scratch_folder(spark, "csv")
    raw_postings(spark, sf_dir, labelled=False).select(*S.RAW_COLUMNS).write.option("header", True) \
        .option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.read_postings_csv(spark, path)


@register("experiment_log", O.with_scores("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_models, 'hash_score_tuned' AS matching,
       max(average_precision) AS best_ap
FROM (SELECT model, round(""" + O.AP + """, 6) AS average_precision FROM curve GROUP BY model)""",
    O.curve_ctes("scores", ["model"])))
def experiment_log(spark, sf_dir):
    """A row a model is appended to the log; the log is read, best first, and checked."""
    path, scores = scratch_folder(spark, "log"), long_scores(spark, sf_dir).withColumn("split", F.lit("val"))
    for r in protocol.protocol_metrics(scores).collect():  # a row a model
        name = "hash_score_tuned" if r["model"] == "hash_score" else r["model"]
        io.log_experiment(spark, path, name, {c: r[c] for c in S.METRIC_COLUMNS}, "val")
    log = io.load_experiments(spark, path, "val")
    best = F.lit(log.first()["average_precision"])
    return io.log_check(log).select("rows", "null_models", F.array_join("matching_models", ",").alias("matching"),
                                    F.round(best, 6).alias("best_ap"))
