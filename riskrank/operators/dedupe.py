"""Exact de-duplication on every column except the id.

Rows are counted by a 256-bit hash of the other columns, so the first shuffle carries
hashes only. Rows whose hash occurs once are kept as they are; only the others are compared
in full (``groupBy`` with ``min(id)``: NULLs compare equal, the smallest id survives, and
partial aggregation leaves one row a task of a copy group that holds a third of the
table). The repeated hashes are written to the shared folder: Spark broadcasts them if
their bytes allow, and joins by hash if not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import stored

_HASH = "_row_hash"


def row_hash(df: DataFrame, columns) -> Column:
    """SHA-256 of the columns' values; NULL differs from every value, -0.0 equals 0.0."""
    def value(c):
        kind = df.schema[c].dataType.simpleString()
        col = F.col(f"`{c}`")
        if kind in ("float", "double"):
            return col + F.lit(0.0)
        return col.cast("string") if kind.startswith("timestamp") else col
    packed = F.struct(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return F.sha2(F.to_json(packed), 256)


def drop_duplicates_except_id(df: DataFrame, id_col: str = S.ID, key_cols=None) -> DataFrame:
    keys = list(key_cols or [c for c in df.columns if c != id_col])
    hashed = df.withColumn(_HASH, row_hash(df, keys))
    repeated = stored(hashed.groupBy(_HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_HASH), "copies")
    single = hashed.join(repeated, _HASH, "left_anti")
    copies = hashed.join(repeated, _HASH, "left_semi").groupBy(*keys).agg(F.min(id_col).alias(id_col))
    return single.select(*df.columns).unionByName(copies.select(*df.columns))


def duplicate_report(df: DataFrame, id_col: str = S.ID, key_cols=None) -> DataFrame:
    """One row: rows before, rows after, rows dropped. Only hashes are shuffled."""
    keys = list(key_cols or [c for c in df.columns if c != id_col])
    groups = df.select(row_hash(df, keys).alias(_HASH)).groupBy(_HASH).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.sum("copies").alias("before"), F.count(F.lit(1)).alias("after")) \
                 .withColumn("dropped", F.col("before") - F.col("after"))
