"""Reproducible stratified train/val/test split with exact quotas.

Quotas follow the reference's library: ``n_test = ceil(test_size * n)``; per class
the train share is allocated by largest remainder and the rest is test; val is
then cut from train+val with ``val_size / (1 - test_size)``. (Ties between equal
remainders go to the lower class label here; the library breaks them at random.)

Rows are ordered inside each class by a seeded hash of the id (ties by id), so the
split does not depend on partitioning. Finding the q-th row of a class needs no
global sort:

1. the hash's top bits give ``2**bucket_bits`` buckets; rows are counted per
   (class, bucket) (narrow key columns only, map-side combined);
2. a running count over the buckets of each class (bounded table) finds the one
   bucket holding each cut;
3. only the rows of those boundary buckets (about 2 / 2**bucket_bits of a class)
   are ranked, giving the cut key;
4. every row is labelled by comparing its (hash, id) with its class's cuts, a
   broadcast join against a table of at most 2 rows per class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

MAX_CLASSES = 10_000


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Largest-remainder allocation of ``n_draws`` over classes (floors first)."""
    total = sum(counts.values())
    cont = {c: counts[c] / total * n_draws for c in counts}
    floored = {c: math.floor(v) for c, v in cont.items()}
    need = int(n_draws - sum(floored.values()))
    for c in sorted(counts, key=lambda c: (-(cont[c] - floored[c]), c))[:max(need, 0)]:
        floored[c] += 1
    return floored


def split_quotas(counts: dict, test_size: float, val_size: float) -> dict:
    """Per class (test, val) counts."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train_first = approximate_mode(counts, n - n_test)
    test_c = {c: counts[c] - train_first[c] for c in counts}
    rest = {c: counts[c] - test_c[c] for c in counts}
    n_rest = sum(rest.values())
    n_val = math.ceil(val_size / (1.0 - test_size) * n_rest)
    train_c = approximate_mode(rest, n_rest - n_val) if n_rest else {c: 0 for c in rest}
    return {c: (test_c[c], rest[c] - train_c[c]) for c in counts}


def order_key(id_col: str, seed: int, kind: str = "xxhash64") -> tuple[Column, int]:
    """(key column, key bit width). ``arith`` is a small multiplicative hash that
    SQL engines without xxhash64 can reproduce (used by the oracle check)."""
    if kind == "xxhash64":
        return F.xxhash64(F.col(id_col), F.lit(seed)), 64
    if kind == "arith":
        return F.pmod(F.col(id_col) * 7919 + seed, F.lit(100003)), 17
    raise ValueError(kind)


def stratified_split(df: DataFrame, test_size: float = 0.15, val_size: float = 0.15,
                     seed: int = 42, target: str = S.TARGET, id_col: str = S.ID,
                     key: str = "xxhash64", bucket_bits: int = 16, out: str = "split") -> DataFrame:
    spark = df.sparkSession
    k, width = order_key(id_col, seed, key)
    shift = max(width - bucket_bits, 0)
    keys = df.select(F.col(target).alias("_c"), F.col(id_col).alias("_id"), k.alias("_k")) \
             .withColumn("_b", F.shiftright("_k", shift))
    per_bucket = keys.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_n"))
    # one class more than the limit at most comes to the driver
    class_rows = per_bucket.groupBy("_c").agg(F.sum("_n").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(class_rows) > MAX_CLASSES:
        raise ValueError("too many classes to stratify on")
    counts = {r["_c"]: int(r["n"]) for r in class_rows}
    if not counts:
        return df.withColumn(out, F.lit(None).cast("string"))
    quotas = split_quotas(counts, test_size, val_size)
    cut_rows = [(c, 1, q[0]) for c, q in quotas.items()] + \
               [(c, 2, q[0] + q[1]) for c, q in quotas.items()]
    cut_type = df.schema[target].dataType.simpleString()
    cuts = spark.createDataFrame(cut_rows, f"_c {cut_type}, _cut int, _pos long")

    within = Window.partitionBy("_c").orderBy("_b")  # at most 2**bucket_bits rows per class
    spans = per_bucket.withColumn("_end", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0))) \
                      .withColumn("_start", F.col("_end") - F.col("_n"))
    hits = spans.join(F.broadcast(cuts), "_c") \
                .where((F.col("_start") < F.col("_pos")) & (F.col("_pos") <= F.col("_end")))
    edge_rows = keys.join(F.broadcast(hits.select("_c", "_b", "_start").distinct()), ["_c", "_b"])
    ranked = edge_rows.withColumn(
        "_rank", F.col("_start") + F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_k", "_id")))
    cut_keys = ranked.join(F.broadcast(hits.select("_c", "_b", "_cut", "_pos")), ["_c", "_b"]) \
                     .where(F.col("_rank") == F.col("_pos")) \
                     .groupBy("_c").agg(
                         F.max(F.when(F.col("_cut") == 1, F.struct("_k", "_id"))).alias("_t"),
                         F.max(F.when(F.col("_cut") == 2, F.struct("_k", "_id"))).alias("_v"))
    me = F.struct(k.alias("_k"), F.col(id_col).alias("_id"))
    label = (F.when(F.col("_t").isNotNull() & (me <= F.col("_t")), F.lit("test"))
              .when(F.col("_v").isNotNull() & (me <= F.col("_v")), F.lit("val"))
              .otherwise(F.lit("train")))
    # cut_keys has at most one row per class (checked above)
    out_df = df.join(F.broadcast(cut_keys.withColumnRenamed("_c", target)), target, "left")
    return out_df.withColumn(out, label).drop("_t", "_v").select(*df.columns, out)
