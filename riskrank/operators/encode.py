"""Fitted encoders: one-hot with a rare bucket, population standardisation and
safe feature names. Fit = a small artifact DataFrame; apply = broadcast joins or
literal arithmetic, row-local, no shuffle of the data being encoded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

INFREQUENT = "infrequent_sklearn"


def _long_categories(df: DataFrame, columns) -> DataFrame:
    items = F.array(*[F.struct(F.lit(i).alias("feature_idx"), F.lit(c).alias("feature"),
                               F.col(c).cast("string").alias("category"))
                      for i, c in enumerate(columns)])
    return df.select(F.explode(items).alias("x")).select("x.*")


@dataclass
class OneHotModel:
    columns: list
    slots: DataFrame       # feature_idx, feature, category, slot, local_slot, name, is_infrequent
    mapping: DataFrame     # feature, category, slot, local_slot (categories with a slot of their own)
    widths: DataFrame      # feature_idx, feature, width, offset, bucket_slot
    n_slots: int
    n_categories: int

    def transform(self, df: DataFrame, prefix: str = "slot_") -> DataFrame:
        """One ``slot_<column>`` per encoded column: the global slot index, the rare
        bucket for rare and unseen categories, NULL (all zeros) when the column has none."""
        out = df
        widths = {r["feature"]: r for r in self.widths.collect()}  # one row per column
        for c in self.columns:
            m = self.mapping.where(F.col("feature") == c) \
                    .select(F.col("category").alias(f"_cat_{c}"), F.col("slot").alias(f"_slot_{c}"))
            out = out.join(m, F.col(c).cast("string") == F.col(f"_cat_{c}"), "left")
            bucket = widths[c]["bucket_slot"]
            fill = F.lit(bucket) if bucket is not None else F.lit(None).cast("int")
            out = out.withColumn(f"{prefix}{c}",
                                 F.when(F.col(c).isNull(), F.lit(None).cast("int"))
                                  .otherwise(F.coalesce(F.col(f"_slot_{c}"), fill)).cast("int")) \
                     .drop(f"_cat_{c}", f"_slot_{c}")
        return out


def fit_onehot(df: DataFrame, columns, min_frequency: int = 10) -> OneHotModel:
    """Per column: categories with >= ``min_frequency`` rows get their own slot in
    sorted order; rarer ones share one trailing bucket."""
    columns = list(columns)
    counts = _long_categories(df, columns).where(F.col("category").isNotNull()) \
        .groupBy("feature_idx", "feature", "category").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "categories")
    rare = F.col("n") < min_frequency
    widths = counts.groupBy("feature_idx", "feature").agg(F.count_if(~rare).alias("_nfreq"),
                                                          F.count_if(rare).alias("_nrare")) \
                   .withColumn("width", F.col("_nfreq") + F.when(F.col("_nrare") > 0, 1).otherwise(0))
    cols_order = Window.orderBy("feature_idx").rowsBetween(Window.unboundedPreceding, -1)  # one row per column
    widths = widths.withColumn("offset", F.coalesce(F.sum("width").over(cols_order), F.lit(0))) \
                   .withColumn("bucket_slot", F.when(F.col("_nrare") > 0, F.col("offset") + F.col("_nfreq"))) \
                   .select("feature_idx", "feature", "width", "offset", "bucket_slot")
    widths = stored(widths, "widths")
    # only categories with a slot are ordered: as many as the encoded matrix has columns
    slot = F.row_number().over(Window.partitionBy("feature_idx").orderBy("category")) - 1
    mapping = counts.where(~rare).withColumn("local_slot", slot) \
                    .join(F.broadcast(widths.select("feature_idx", "offset")), "feature_idx") \
                    .select("feature_idx", "feature", "category",
                            (F.col("offset") + F.col("local_slot")).cast("int").alias("slot"),
                            F.col("local_slot").cast("int").alias("local_slot"))
    mapping = stored(mapping, "onehot")
    freq = mapping.select(
        "feature_idx", "feature", "category", "slot", "local_slot",
        F.concat_ws("_", "feature", "category").alias("name"), F.lit(False).alias("is_infrequent"))
    bucket = widths.where(F.col("bucket_slot").isNotNull()).select(
        "feature_idx", "feature", F.lit(None).cast("string").alias("category"),
        F.col("bucket_slot").cast("int").alias("slot"),
        (F.col("bucket_slot") - F.col("offset")).cast("int").alias("local_slot"),
        F.concat(F.col("feature"), F.lit("_" + INFREQUENT)).alias("name"),
        F.lit(True).alias("is_infrequent"))
    slots = freq.unionByName(bucket)
    n_slots = int(widths.agg(F.sum("width")).first()[0] or 0)
    n_cat = mapping.count()
    return OneHotModel(columns, slots, mapping.select("feature", "category", "slot", "local_slot"),
                       widths, n_slots, n_cat)


@dataclass
class ScalerModel:
    stats: DataFrame  # feature, mean, scale
    values: dict      # feature -> (mean, scale), model-sized

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({
            f"{c}{suffix}": (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
            for c, (m, s) in self.values.items()})


def fit_scaler(df: DataFrame, columns) -> ScalerModel:
    """Mean and population standard deviation per column (one aggregation);
    a zero (or near-zero) deviation scales by 1."""
    columns = list(columns)
    row = df.agg(*[e for c in columns for e in (
        F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))]).first()
    values = {}
    for c in columns:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        m = 0.0 if m is None else float(m)
        s = 1.0 if (s is None or s < 10 * 2.220446049250313e-16) else float(s)
        values[c] = (m, s)
    spark = df.sparkSession
    stats = spark.createDataFrame([(c, v[0], v[1]) for c, v in values.items()],
                                  "feature string, mean double, scale double")
    return ScalerModel(stats, values)


def scaler_stats(df: DataFrame, columns) -> DataFrame:
    """The scaler's statistics as a lazily evaluated table (feature, mean, scale)."""
    wide = df.agg(*[e for c in columns for e in (
        F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"))
        for c in columns])).alias("x")).select("x.*")
    return long.withColumn("scale", F.when(F.col("std") < 10 * 2.220446049250313e-16, F.lit(1.0))
                                     .otherwise(F.col("std"))).drop("std")


def sanitize_names(names: DataFrame, name_col: str = "name", order_col: str = "idx",
                   out: str = "safe_name") -> DataFrame:
    """Non-alphanumerics -> '_', strip '_', empty -> 'feature'; repeats get '__<n>'
    in index order."""
    cleaned = F.regexp_replace(F.regexp_replace(F.col(name_col), "[^0-9a-zA-Z_]+", "_"), "^_+|_+$", "")
    cleaned = F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("feature"))
    same = Window.partitionBy("_clean").orderBy(order_col)  # groups of equal names
    with_clean = names.withColumn("_clean", cleaned)
    n = F.row_number().over(same) - 1
    return with_clean.withColumn(out, F.when(n == 0, F.col("_clean"))
                                       .otherwise(F.concat(F.col("_clean"), F.lit("__"), n.cast("string")))) \
                     .drop("_clean")


def feature_names(spark, svd_components: int, onehot: OneHotModel, numeric) -> DataFrame:
    """(idx, name, block) for the stacked matrix: svd, one-hot, numeric."""
    svd = spark.range(svd_components).select(
        F.col("id").cast("long").alias("idx"), F.concat(F.lit("svd_"), F.col("id").cast("string")).alias("name"),
        F.lit("svd").alias("block"))
    oh = onehot.slots.select((F.col("slot") + svd_components).cast("long").alias("idx"), "name",
                             F.lit("onehot").alias("block"))
    base = svd_components + onehot.n_slots
    num = spark.createDataFrame([(base + i, c, "numeric") for i, c in enumerate(numeric)],
                                "idx long, name string, block string")
    return svd.unionByName(oh).unionByName(num)
