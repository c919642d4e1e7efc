"""Readers and writers: raw postings CSV (A1), splits (A2-A4), scores (A6, A7),
the experiment log (A8-A11), the compute-once embedding cache (A12, D5) and
fitted artifacts (A13). Everything is partitioned Parquet/CSV written by Spark;
readers prune by partition (split, model) and by column.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

# Cell texts the reference's CSV reader turns into missing values.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# -- A1 -----------------------------------------------------------------------
def read_postings_csv(spark: SparkSession, path: str, schema=S.RAW_SCHEMA) -> DataFrame:
    """Raw postings with an explicit schema; quoted newlines and doubled quotes
    parse; NA-like cells become NULL in string columns."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} not found")
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    strings = [f.name for f in schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(F.col(c).isin(NA_TOKENS), F.lit(None)).otherwise(F.col(c))
                           for c in strings})


# -- A2 / A3 / A4 --------------------------------------------------------------
def save_splits(df: DataFrame, out_dir: str, split_col: str = "split", target: str = S.TARGET) -> DataFrame:
    """One table partitioned by split; returns the per-split summary (rows, rate)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(out_dir)
    saved = df.sparkSession.read.parquet(out_dir)
    return saved.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"),
                                        F.avg(target).alias("positive_rate"))


def load_split(spark: SparkSession, out_dir: str, name: str, columns=None) -> DataFrame:
    """One split (partition pruning), optionally projected; blanks restored."""
    if not _exists(spark, os.path.join(out_dir, f"split={name}")):
        raise FileNotFoundError(f"split {name} is not in {out_dir}")
    df = restore_blanks(spark.read.parquet(out_dir).where(F.col("split") == name))
    return df.select(*columns) if columns else df


def load_splits(spark: SparkSession, out_dir: str):
    """All splits, in the order of ``S.SPLITS``."""
    return tuple(load_split(spark, out_dir, name) for name in S.SPLITS)


def restore_blanks(df: DataFrame) -> DataFrame:
    """Text columns NULL -> '', categories NULL -> 'Unknown' (Parquet keeps both
    already; this repairs tables that went through CSV)."""
    text = [c for c in S.TEXT_COLUMNS + [S.FULL_TEXT] if c in df.columns]
    cats = [c for c in S.CATEGORICAL_FEATURES if c in df.columns]
    return df.fillna("", subset=text).fillna("Unknown", subset=cats) if (text or cats) else df


# -- A6 / A7 --------------------------------------------------------------------
def save_scores(scores: DataFrame, out_dir: str, model: str, split: str = "test") -> None:
    """(job_id, y_true, y_proba) of one model/split, id kept, partitioned. Saving again
    replaces that model's rows of that split."""
    (scores.select("job_id", F.col("y_true").cast("int"), F.col("y_proba").cast("double"))
           .withColumn("model", F.lit(model)).withColumn("split", F.lit(split))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("model", "split").parquet(out_dir))


def scan_scores(spark: SparkSession, out_dir: str, split: str = "test", aliases: dict | None = None) -> DataFrame:
    """All models' scores of a split; names mapped through ``aliases``."""
    if not _exists(spark, out_dir):
        return spark.createDataFrame([], S.SCORE_SCHEMA)
    df = spark.read.parquet(out_dir).where(F.col("split") == split)
    if aliases:
        m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        df = df.withColumn("model", F.coalesce(m[F.col("model")], F.col("model")))
    return df


def scan_score_csvs(spark: SparkSession, pattern: str, aliases: dict | None = None) -> DataFrame:
    """Flat ``predictions_<model>_test.csv`` files: the model name comes from the
    file path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    if not at.getFileSystem(conf).globStatus(at):
        return spark.createDataFrame([], "y_true int, y_proba double, model string")
    df = spark.read.option("header", True).schema("y_true int, y_proba double").csv(pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"predictions_(.+)_test\.csv$", 1)
    df = df.withColumn("model", name)
    if aliases:
        m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        df = df.withColumn("model", F.coalesce(m[F.col("model")], F.col("model")))
    return df


# -- A8 - A11 -------------------------------------------------------------------
def log_experiment(spark: SparkSession, path: str, name: str, metrics: dict, split: str = "val",
                   notes: str = "") -> dict:
    """Append one row (fixed 11 columns; missing metrics -> NULL)."""
    texts = {"model": name, "split": split, "notes": notes}
    values = {c: F.lit(texts[c]) if c in texts else F.lit(metrics.get(c)) for c in S.EXPERIMENT_COLUMNS}
    values["timestamp"] = F.date_trunc("second", F.current_timestamp())
    one = spark.range(1).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in S.EXPERIMENT_SCHEMA])
    row = one.first().asDict()
    spark.createDataFrame([tuple(row.values())], S.EXPERIMENT_SCHEMA).write.mode("append").parquet(path)
    return row


def log_experiments(spark: SparkSession, path: str, entries: list[tuple], split: str = "val") -> None:
    """Append a row for each ``(name, metrics, notes)`` in one write."""
    now = spark.range(1).select(F.date_trunc("second", F.current_timestamp()).alias("now")).first()["now"]
    rows = []
    for name, metrics, notes in entries:
        own = {"model": name, "split": split, "notes": notes, "timestamp": now}
        rows.append(tuple(own[c] if c in own else None if metrics.get(c) is None else float(metrics[c]) for c in S.EXPERIMENT_SCHEMA.names))
    spark.createDataFrame(rows, S.EXPERIMENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_experiments(spark: SparkSession, path: str, split: str | None = "val") -> DataFrame:
    """Best average precision first; one split (None = all); empty table when absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], S.EXPERIMENT_SCHEMA)
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.orderBy(F.desc("average_precision"), F.asc("model"))


def log_check(log: DataFrame, token: str = "_tuned") -> DataFrame:
    """Rows, NULL model names, and the models whose name contains ``token``."""
    return log.agg(F.count(F.lit(1)).alias("rows"),
                   F.count_if(F.col("model").isNull()).alias("null_models"),
                   F.array_sort(F.collect_set(F.when(F.col("model").contains(token), F.col("model"))))
                   .alias("matching_models"))


# -- A12 / D5 -------------------------------------------------------------------
def encode_cached(spark: SparkSession, cache_path: str, rows: DataFrame, encoder,
                  id_col: str = S.ID) -> DataFrame:
    """Compute-once embeddings keyed by id: only ids missing from the cache
    (a left-anti join) go through ``encoder`` (DataFrame -> (id, embedding));
    the new rows are appended and the full cached set for ``rows`` returned."""
    if _exists(spark, cache_path):
        cached = spark.read.parquet(cache_path)
        todo = rows.join(cached.select(id_col), id_col, "left_anti")
    else:
        todo = rows
    new = encoder(todo)
    new.write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path).join(rows.select(id_col), id_col, "left_semi")


# -- A13 ------------------------------------------------------------------------
def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(cls, path: str):
    return cls.load(path)
