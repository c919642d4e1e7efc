"""Maps the driver's tables onto the posting schema.

``postings`` = documents joined to labels on ``doc_id`` (only labelled documents, or all of
them with a null label for operators that need none); every posting column is a deterministic expression of the document row, so the same view can be written
in DuckDB SQL for the oracle (``plans.oracle.POSTINGS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import narrow_side, text_batches
from .tables import table


def raw_postings(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents", spread_key="doc_id").select("doc_id", "text", "lang", "source")
    labels = narrow_side(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    d = docs.join(labels, "doc_id", "inner" if labelled else "left")
    i = F.col("doc_id")
    lines = F.split(F.col("text"), "\n")
    blank2 = F.lit("  ")
    return d.select(
        i.alias("job_id"),
        F.get(lines, 0).alias("title"),
        F.concat_ws(", ", F.upper("lang"),
                    F.when(i % 3 == 0, F.lit("")).otherwise(F.col("source")),
                    F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("City"), (i % 7).cast("string")))
                    ).alias("location"),
        F.when(i % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("department"),
        F.when(i % 6 == 0, F.concat(((20 + i % 50) * 1000).cast("string"), F.lit("-"),
                                    ((30 + i % 60) * 1000).cast("string")))
         .when(i % 6 == 1, F.lit("negotiable")).alias("salary_range"),
        F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, blank2)
         .otherwise(F.get(lines, 1)).alias("company_profile"),
        F.col("text").alias("description"),
        F.get(lines, 2).alias("requirements"),
        F.get(lines, 3).alias("benefits"),
        (i % 2).cast("int").alias("telecommuting"),
        F.col("quality").cast("int").alias("has_company_logo"),
        (i % 3 == 0).cast("int").alias("has_questions"),
        F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 5 == 1, blank2)
         .otherwise(F.col("lang")).alias("employment_type"),
        F.concat(F.lit("L"), (i % 4).cast("string")).alias("required_experience"),
        F.concat(F.lit("E"), (i % 3).cast("string")).alias("required_education"),
        F.col("source").alias("industry"),
        F.col("source").alias("function"),
        F.col("toxic").cast("int").alias("fraudulent"),
    )


def featured_postings(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    from ..operators.clean import clean_postings
    from ..operators.features import add_all_features
    return raw_postings(spark, sf_dir, labelled).transform(clean_postings).transform(add_all_features)


def scored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deterministic scorers over the labelled documents (for ranking metrics):
    ``length_score`` is heavily tied, ``hash_score`` is a second model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = docs.join(labels, "doc_id")
    base = d.select(F.col("doc_id").alias("job_id"), F.col("toxic").cast("int").alias("y_true"),
                    F.round((F.col("n_chars") % 1000) / 1000.0, 3).alias("s1"),
                    ((F.col("doc_id") * 37 % 101) / 101.0).alias("s2"))
    return base


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, job_id, y_true, y_proba) for both scorers."""
    b = scored_postings(spark, sf_dir)
    return b.select(F.explode(F.array(
        F.struct(F.lit("length_score").alias("model"), F.col("job_id"), F.col("y_true"),
                 F.col("s1").alias("y_proba")),
        F.struct(F.lit("hash_score").alias("model"), F.col("job_id"), F.col("y_true"),
                 F.col("s2").alias("y_proba")))).alias("r")).select("r.*")


def scorer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of an external scorer, one per document, with every failure
    shape: refusals, truncations, no text, bad JSON, a missing number, values
    outside [0, 1]."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    i = F.col("doc_id")
    prob = ((F.col("n_chars") % 150) / 100.0).cast("string")
    body = (F.when(i % 17 == 0, F.lit(None).cast("string"))
             .when(i % 19 == 0, F.lit("not json {"))
             .when(i % 23 == 0, F.concat(F.lit('{"reason": "'), F.col("source"), F.lit('"}')))
             .otherwise(F.concat(F.lit('{"fraud_probability": '), prob, F.lit(', "reason": "'),
                                 F.col("source"), F.lit('"}'))))
    stop = F.when(i % 11 == 0, F.lit("refusal")).when(i % 13 == 0, F.lit("max_tokens")) \
            .otherwise(F.lit("end_turn"))
    return d.select(i.alias("job_id"), stop.alias("stop_reason"), body.alias("body"))
