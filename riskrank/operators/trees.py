"""Boosted trees as a node table: scores of a prefix (I4), summed gain (I8, G2) and exact
Shapley values (I12).

Trees are model-sized arrays that travel with the task; rows stay distributed and are walked
in Arrow batches, one vectorised step a tree level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S


@dataclass
class Tree:
    """Node arrays of one tree, indexed by node; ``feature`` is -1 at a leaf. ``rows`` counts the training
    rows of the round at each node."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray | None = None
    rows: np.ndarray | None = None


@dataclass
class Boosted:
    """Trees in boosting order (values already times the learning rate) and the first margin."""
    trees: list
    base: float

    def prefix(self, n_trees: int) -> Boosted:
        return Boosted(self.trees[:n_trees], self.base)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value, gain, rows): one row a node."""
        rows = [(i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n]),
                 float(t.gain[n]), int(round(t.rows[n]))) for i, t in enumerate(self.trees) for n in range(len(t.feature))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, "
                                           "value double, gain double, rows long")


def from_nodes(nodes: DataFrame, base: float, n_trees: int) -> Boosted:
    """The model of a node table (``Boosted.nodes``); model-sized."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    parts = {i: t for i, t in table.groupby("tree")}
    return Boosted([Tree(*(parts[i][c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "gain", "rows")))
                    for i in range(n_trees)], base)


def pack(boosted: Boosted) -> tuple:
    """The model as plain arrays: broadcast values are unpickled where this package may not be."""
    return boosted.base, [(t.feature, t.threshold, t.left, t.right, t.value, t.gain, t.rows) for t in boosted.trees]


def unpack(packed: tuple) -> Boosted:
    return Boosted([Tree(*t) for t in packed[1]], packed[0])


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row. A value up to the threshold goes left; NaN goes right."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        feature = tree.feature[at[rows]]
        rows = rows[feature >= 0]
        node, feature = at[rows], feature[feature >= 0]
        at[rows] = np.where(x[rows, feature] <= tree.threshold[node], tree.left[node], tree.right[node])
    return at


def leaf_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    return tree.value[leaf_of(tree, x)]


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score_prefix(boosted: Boosted, rows: DataFrame, n_trees: int, id_col: str = S.ID, label: str | None = S.TARGET,
                 features: str = "features") -> DataFrame:
    """(id, y_true, y_proba) by the first ``n_trees`` trees; without ``label`` (id, y_proba)."""
    held = rows.sparkSession.sparkContext.broadcast(pack(boosted.prefix(n_trees)))  # model-sized

    def walk(batches):
        import pyarrow as pa
        model = unpack(held.value)
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1)) if b.num_rows else np.zeros((0, 1))
            margin = sum((leaf_values(t, x) for t in model.trees), np.full(len(x), model.base))
            keep = list(range(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(1.0 / (1.0 + np.exp(-margin)))],
                                             names=[*(b.schema.names[k] for k in keep), "y_proba"])

    own = [F.col(id_col)] + ([F.col(label).cast("int").alias("y_true")] if label else [])
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(*own, vector_to_array(features).alias("_x")) \
               .mapInArrow(walk, f"{id_col} {kind}, " + ("y_true int, " if label else "") + "y_proba double")


def proba_column(spark: SparkSession, boosted: Boosted, features: str = "features") -> Column:
    """The positive probability of each row by all trees, next to the row's other columns."""
    held = spark.sparkContext.broadcast(pack(boosted))  # model-sized

    @F.pandas_udf("double")
    def walk(rows: pd.Series) -> pd.Series:
        model = unpack(held.value)
        x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 1))
        margin = sum((leaf_values(t, x) for t in model.trees), np.full(len(x), model.base))
        return pd.Series(1.0 / (1.0 + np.exp(-margin)))
    return walk(vector_to_array(features))


def gain_table(boosted: Boosted, names: DataFrame) -> DataFrame:
    """(feature, block, gain): the summed gain of a feature's splits; 0 for unused features."""
    gains = boosted.nodes(names.sparkSession).where("left >= 0").groupBy(F.col("feature").cast("long").alias("idx")) \
                   .agg(F.sum("gain").alias("gain"))
    return names.join(F.broadcast(gains), "idx", "left") \
                .select(F.col("safe_name").alias("feature"), "block", F.coalesce("gain", F.lit(0.0)).alias("gain"))


def top_gain(gains: DataFrame, n: int = 25, n_outside: int = 12, text_block: str = "svd") -> DataFrame:
    """(listing, rank, feature, gain): the top ``n`` features, and the top ``n_outside`` that are
    not of the text block. One row a feature comes in, so the two windows are model-sized."""
    both = F.array(F.lit("all"), F.when(F.col("block") != text_block, F.lit("outside text")))
    lists = gains.select(F.explode(F.array_compact(both)).alias("listing"), "feature", "gain")
    rank = Window.partitionBy("listing").orderBy(F.desc("gain"), F.asc("feature"))
    cut = F.when(F.col("listing") == "all", n).otherwise(n_outside)
    return lists.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= cut) \
                .select("listing", "rank", "feature", "gain")


# -- Shapley values -----------------------------------------------------------
def leaf_paths(tree: Tree) -> list[tuple]:
    """For each leaf with a path: ``(value, features, shares, lows, highs)``. A feature's splits on the
    path are merged: its share is the product of the splits' shares of rows, and a row follows
    them when low < x <= high (NaN follows when high is infinite)."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        if tree.feature[node] < 0:
            if path:
                shares, lows, highs = zip(*path.values())
                out.append((float(tree.value[node]), np.array(list(path)), np.array(shares), np.array(lows), np.array(highs)))
            continue
        f, cut = int(tree.feature[node]), float(tree.threshold[node])
        share, low, high = path.get(f, (1.0, -np.inf, np.inf))
        for child, a, b in ((tree.left[node], low, min(high, cut)), (tree.right[node], max(low, cut), high)):
            stack.append((int(child), {**path, f: (share * tree.rows[child] / tree.rows[node], a, b)}))
    return out


def expected_value(tree: Tree) -> float:
    """The mean of the leaf values, weighted by their training rows."""
    leaf = tree.feature < 0
    return float((tree.value[leaf] * tree.rows[leaf]).sum() / tree.rows[leaf].sum())


def shapley_of(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values (rows x features) of the summed trees.

    A leaf that a set of known features reaches with the shares of the others gives feature i
    ``value * (follows_i - share_i)`` times the integral over t from 0 to 1 of the product over its
    path's other features of ``share * (1 - t) + follows * t``: the weights of the subsets are
    that integral's coefficients. The product is a polynomial in t, so Gauss-Legendre nodes give
    its exact integral."""
    out = np.zeros(x.shape)
    for tree in trees:
        for value, features, shares, lows, highs in leaf_paths(tree):
            own = x[:, features]
            follows = ((own > lows) | np.isneginf(lows)) & (own <= highs)
            follows |= np.isnan(own) & np.isposinf(highs)
            nodes, weights = np.polynomial.legendre.leggauss(len(features) // 2 + 1)
            t = (nodes + 1.0) / 2.0
            parts = shares[None, :, None] * (1.0 - t) + follows[:, :, None] * t
            others = np.prod(parts, axis=1, keepdims=True) / parts
            out[:, features] += value * (follows - shares) * (others @ (weights / 2.0))
    return out


def contributions(boosted: Boosted, rows: DataFrame, id_col: str = S.ID, features: str = "features") -> DataFrame:
    """(id, margin, base, contributions): Shapley values per feature; with ``base`` (the expected margin)
    they add up to the margin."""
    held = rows.sparkSession.sparkContext.broadcast(pack(boosted))  # model-sized

    def walk(batches):
        import pyarrow as pa
        model = unpack(held.value)
        base = model.base + sum(expected_value(t) for t in model.trees)
        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else np.zeros((0, 1))
            for at in range(0, len(x), 2048):
                part = x[at:at + 2048]
                phi = shapley_of(model.trees, part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(phi.sum(axis=1) + base), pa.array(np.full(len(part), base)), lists],
                    names=[id_col, "margin", "base", "contributions"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, vector_to_array(features).alias("_x")) \
               .mapInArrow(walk, f"{id_col} {kind}, margin double, base double, contributions array<double>")


def contribution_means(parts: DataFrame, names: DataFrame, n: int = 20) -> DataFrame:
    """(rank, feature, mean_abs_contribution) of the ``n`` features that move margins most."""
    size = F.transform("contributions", F.abs)
    means = parts.agg(vector_to_array(Summarizer.mean(array_to_vector(size))).alias("m"))
    means = means.select(F.posexplode("m").alias("idx", "mean_abs_contribution"))
    named = names.select("idx", F.col("safe_name").alias("feature")).join(F.broadcast(means), "idx")
    rank = Window.orderBy(F.desc("mean_abs_contribution"), F.asc("feature"))  # one row a feature
    return named.select(F.row_number().over(rank).alias("rank"), "feature", "mean_abs_contribution") \
                .where(F.col("rank") <= n)
