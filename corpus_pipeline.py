"""Corpus pipeline: quality classifier, SimHash near-dedup, substring dedup, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result in the shared folder and reads it back as the next stage's documents. All stages
but the last return the columns of ``documents``. Null ids, null and empty texts, repeated
rows, empty tables and extra columns pass every stage; a stage's operator states its rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskrank.llm import chunks, mixing, pieces, simhash, subword
from riskrank.llm.common import row_key, written
from riskrank.llm.queries import MIX_WEIGHTS, crc_of, domain_of, table

#: Share of the input's tokens that the mix keeps, and how often a document may be in it.
FRACTION, MAX_EPOCHS = 0.8, 1


def _packed(docs: DataFrame):
    """All columns in one struct, out of the way of a stage's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier predicts as good (6)."""
    odds = subword.fit_quality(docs, table(spark, sf_dir, "labels"), crc_of("id", 5) != 0)
    score = subword.quality_score(F.col("row.text").cast("string"), odds)
    return docs.select(_packed(docs)).where(score >= subword.THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (3): that with the smallest id.

    A null id is the largest; of rows equal in id and text, one stays."""
    keep = simhash.near_duplicates(docs).groupBy("class_fp") \
                  .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    keep = written(keep.select(F.col("first.row_key").alias("kept")), "near-dedup-keep")
    rows = docs.select(_packed(docs), row_key("doc_id", "text").alias("key"))
    return rows.join(keep, rows["key"] == keep["kept"], "left_semi").dropDuplicates(["key"]).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that an earlier document (or place) holds (7); rows all stay."""
    out = chunks.without_repeats(docs)
    length = F.when(F.col("n_removed_chunks") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("clean"), "n_chars": length}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the documents of the mix to target weights (10)."""
    out = mixing.select_mix(docs, domain_of(F.col("source")), FRACTION, MIX_WEIGHTS, MAX_EPOCHS)
    return out.where("copies > 0").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts as pieces (8): ``doc_id, ids, n_tokens, round_trip``."""
    return pieces.encode(docs, pieces.Pieces.from_model())


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup),
          ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", tokens)]

#: SQL cannot express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
