"""Array/vector helpers for embedding tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2_normalise(arr: Column) -> Column:
    """Divide an array by its Euclidean norm (zero vectors stay zero)."""
    a = F.transform(arr, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def embedding_vectors(df: DataFrame, array_col: str, out: str = "features",
                      normalise: bool = False) -> DataFrame:
    """Embedding array -> ML vector (named ``emb_i`` by position)."""
    a = l2_normalise(F.col(array_col)) if normalise else F.transform(array_col, lambda x: x.cast("double"))
    return df.withColumn(out, array_to_vector(a))


def embedding_columns(df: DataFrame, array_col: str, width: int, prefix: str = "emb") -> DataFrame:
    """The array as named columns ``emb_0`` to ``emb_{width - 1}``; shorter arrays end in nulls."""
    keep = [c for c in df.columns if c != array_col]
    return df.select(*keep, *[F.get(array_col, F.lit(i)).cast("double").alias(f"{prefix}_{i}") for i in range(width)])
