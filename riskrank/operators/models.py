"""Model training and scoring on Spark ML.

* majority baseline: a literal probability column;
* embeddings -> balanced logistic regression: ``C`` maps to
  ``regParam = 1 / (C * sum(weights))``, the intercept is not penalised, no
  standardisation (for TF-IDF see ``newton``);
* a depth-wise ``GBTClassifier`` for the stream scorer (see ``booster`` for the
  leaf-wise one);
* truncated SVD: randomised range finder, one pass over X per power iteration
  (no centring), components sign-fixed so each one's largest entry is positive;
  projection ``X V`` is a sparse product of Arrow batches with the broadcast
  component matrix.

Every score table keeps the row id; nothing is aligned by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .booster import _arrow_blocks
from .eda import class_weights
from .newton import _rows_of


def positive_proba(pred: DataFrame, out: str = "y_proba") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


# -- I1 -----------------------------------------------------------------------
def majority_class(df: DataFrame, label: str = S.TARGET) -> int:
    row = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")) \
            .orderBy(F.desc("n"), F.asc(label)).first()
    return int(row[label])


def score_majority(df: DataFrame, majority: int, out: str = "y_proba") -> DataFrame:
    return df.withColumn(out, F.lit(1.0 if majority == 1 else 0.0))


# -- I2 / I5 ------------------------------------------------------------------
def fit_logreg(df: DataFrame, features: str = "features", label: str = S.TARGET, C: float = 1.0,
               max_iter: int = 200, balanced: bool = True, tol: float = 1e-4):
    data = df.withColumn("_label", F.col(label).cast("double"))
    if balanced:
        w = class_weights(df, label).select(label, F.col("weight").alias("_w"))
        data = data.join(F.broadcast(w), label)  # one row per class
        total = data.agg(F.sum("_w")).first()[0]
    else:
        data = data.withColumn("_w", F.lit(1.0))
        total = data.count()
    lr = LogisticRegression(featuresCol=features, labelCol="_label", weightCol="_w",
                            regParam=1.0 / (C * total), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=tol)
    return lr.fit(data)


# -- I3 / I6 ------------------------------------------------------------------
@dataclass
class GbtParams:
    n_estimators: int = 1000
    learning_rate: float = 0.05
    max_depth: int = 6
    min_child_samples: int = 20
    subsample: float = 0.8
    colsample: float = 0.8
    seed: int = 42
    max_bins: int = 64


def fit_gbt(df: DataFrame, features: str = "features", label: str = S.TARGET,
            params: GbtParams | None = None, scale_pos_weight: float | None = None):
    p = params or GbtParams()
    data = df.withColumn("_label", F.col(label).cast("double"))
    if scale_pos_weight is None:
        from .eda import compute_scale_pos_weight
        scale_pos_weight = compute_scale_pos_weight(df, label)
    data = data.withColumn("_w", F.when(F.col(label) == 1, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(featuresCol=features, labelCol="_label", weightCol="_w",
                        maxIter=p.n_estimators, stepSize=p.learning_rate, maxDepth=p.max_depth,
                        minInstancesPerNode=p.min_child_samples, subsamplingRate=p.subsample,
                        featureSubsetStrategy=str(p.colsample), seed=p.seed, maxBins=p.max_bins)
    return gbt.fit(data)


def score(model, df: DataFrame, id_col: str = S.ID, label: str | None = S.TARGET) -> DataFrame:
    """(id, y_true, y_proba) for any fitted probabilistic classifier."""
    pred = positive_proba(model.transform(df))
    cols = [id_col] + ([F.col(label).cast("int").alias("y_true")] if label else []) + ["y_proba"]
    return pred.select(*cols)


# -- H3 -----------------------------------------------------------------------
def _grouped(weights: DataFrame, id_col: str, index_col: str, value_col: str) -> DataFrame:
    """(id, _i, _v): a row a document; the long table (id, index, value) is gathered, rows that have
    their lists already pass as they are."""
    if "_i" in weights.columns:
        return weights
    return weights.groupBy(id_col).agg(F.collect_list(index_col).alias("_i"), F.collect_list(value_col).alias("_v"))


@dataclass
class SvdModel:
    components: np.ndarray  # (n_terms, k), sign-fixed
    singular_values: np.ndarray

    def transform_long(self, weights: DataFrame, id_col: str = "id", out: str = "svd",
                       index_col: str = "term_id", value_col: str = "weight") -> DataFrame:
        """X V from the long TF-IDF table (id, term_id, weight): each document's entries are gathered
        (unless they are lists already), then Arrow batches are projected by one sparse product against
        the broadcast components (vocabulary x k, bounded by ``max_features``)."""
        comp = weights.sparkSession.sparkContext.broadcast(self.components)
        k = self.components.shape[1]
        grouped = _grouped(weights, id_col, index_col, value_col)

        def project(batches):
            for b in batches:
                n, row, index, value = _rows_of(b, 1)
                y = _row_sums(row, index, value, comp.value, np.zeros((n, k)))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))],
                                                 names=[id_col, "_arr"])

        projected = grouped.select(F.col(id_col).cast("long").alias(id_col), "_i", "_v") \
                           .mapInArrow(project, f"{id_col} long, _arr array<double>")
        return projected.select(id_col, array_to_vector("_arr").alias(out))


MAX_SKETCH_CELLS = 200_000_000  # 1.6 GB of doubles per broadcast matrix
CHUNK_CELLS = 1 << 17  # cells of a product at a time: they stay in the cache
TERMS_A_RANGE = 1024


def _row_sums(row: np.ndarray, index: np.ndarray, value: np.ndarray, m: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Add ``value * m[index]`` to the rows of ``out`` that ``row`` (ascending) names."""
    step = max(1, CHUNK_CELLS // max(m.shape[1], 1))
    for at in range(0, len(row), step):
        r = row[at:at + step]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[first]] += np.add.reduceat(m[index[at:at + step]] * value[at:at + step, None], first, axis=0)
    return out


def _sparse_blocks(grouped: DataFrame) -> RDD:
    """Blocks ``(lengths, index, value)`` of the rows' entries, 12 bytes an entry; in as many partitions as
    there are task slots at most, since each sends a matrix of the model's size in every pass."""
    def pack(batches):
        for b in batches:
            n, row, index, value = _rows_of(b, 0)
            if len(row):
                yield np.bincount(row, minlength=n).astype(np.int32), index.astype(np.int32), value
    blocks = _arrow_blocks(grouped.select("_i", "_v"), pack)
    return blocks.coalesce(max(1, min(blocks.getNumPartitions(), blocks.context.defaultParallelism)))


def _gram_and_xty(blocks: RDD, m_bc, n_terms: int, width: int):
    """One pass over X: with Y = X M, return G = Y^T Y (width x width) and Z = X^T Y (n_terms x width).
    A task adds up both over its blocks (n_terms x width cells, as the broadcast M); the sums of tasks
    meet by ranges of terms on the executors, and the driver receives model-sized matrices only."""
    def partials(held):
        gram, z = np.zeros((width, width)), None
        for lengths, index, value in held:
            row = np.repeat(np.arange(len(lengths)), lengths)
            y = _row_sums(row, index, value, m_bc.value, np.zeros((len(lengths), width)))
            gram += y.T @ y
            by_term = np.argsort(index, kind="stable")
            z = _row_sums(index[by_term], row[by_term], value[by_term], y, np.zeros((n_terms, width)) if z is None else z)
        if z is not None:
            yield -1, gram
            for i in range(-(-n_terms // TERMS_A_RANGE)):
                yield i, z[i * TERMS_A_RANGE:(i + 1) * TERMS_A_RANGE]

    ranges = min(blocks.context.defaultParallelism, -(-n_terms // TERMS_A_RANGE) + 1)
    sums = blocks.mapPartitions(partials).reduceByKey(lambda a, b: a + b, ranges)
    summed = dict(sums.collect())
    sums._jrdd.rdd().cleanShuffleDependencies(False)  # the pass's shuffle files, which else stay until the driver collects garbage
    if not summed:
        return np.zeros((width, width)), np.zeros((n_terms, width))
    gram = summed.pop(-1)
    return gram, np.concatenate([summed[i] for i in sorted(summed)])


def fit_svd(weights: DataFrame, n_terms: int, k: int, n_oversamples: int = 10, n_iter: int = 5,
            seed: int = 42, id_col: str = "id", index_col: str = "term_id",
            value_col: str = "weight") -> SvdModel:
    """Randomised truncated SVD (no centring) of the long matrix (id, index, value).

    Range finder with ``n_iter`` power iterations and ``k + n_oversamples`` columns.
    Every iteration is one pass over X (``_gram_and_xty``); the driver only
    orthonormalises the n_terms x width matrix. The final pass gives G = Y^T Y and
    Z = X^T Y, so Q = Y G^(-1/2) and B = Q^T X = G^(-1/2) Z^T without another pass;
    the small B is decomposed on the driver. Signs: each component's largest entry
    is positive."""
    sc = weights.sparkSession.sparkContext
    width = min(k + n_oversamples, n_terms)
    if n_terms * width > MAX_SKETCH_CELLS:  # the sketch and components are broadcast
        raise ValueError(f"{n_terms} terms x {width} columns is too large to broadcast; "
                         "bound the vocabulary (max_features) or lower k")
    blocks = _sparse_blocks(_grouped(weights, id_col, index_col, value_col)).persist(StorageLevel.MEMORY_AND_DISK)
    rng = np.random.default_rng(seed)
    m_mat = rng.standard_normal((n_terms, width))
    for it in range(n_iter + 1):
        m_bc = sc.broadcast(m_mat)
        gram, z_mat = _gram_and_xty(blocks, m_bc, n_terms, width)
        m_bc.destroy()
        if it < n_iter:
            m_mat, _ = np.linalg.qr(z_mat)
    blocks.unpersist()
    evals, w = np.linalg.eigh(gram)
    keep = evals > max(evals.max(), 0.0) * 1e-12
    t = w[:, keep] / np.sqrt(evals[keep])
    b = t.T @ z_mat.T
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    v = vt[:k].T
    signs = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    signs[signs == 0] = 1.0
    return SvdModel(v * signs, s[:k])


def assemble(df: DataFrame, inputs, out: str = "features", sizes: dict | None = None) -> DataFrame:
    """VectorAssembler; vector inputs declare their length (``sizes``) so missing
    blocks can be kept as NaN."""
    from pyspark.ml.feature import VectorSizeHint
    for col, n in (sizes or {}).items():
        df = VectorSizeHint(inputCol=col, size=n, handleInvalid="optimistic").transform(df)
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid="keep").transform(df)


def onehot_vector(df: DataFrame, slot_cols, width: int, out: str = "onehot") -> DataFrame:
    """Dense 0/1 vector of ``width`` from per-column global slot indices (NULL = none): runs of
    zeros up to each slot in turn, then the rest."""
    s = F.array_sort(F.array_compact(F.array(*[F.col(c).cast("int") for c in slot_cols])))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda i: F.when(i > 0, F.get(s, i - 1)).otherwise(F.lit(-1))
    runs = F.flatten(F.transform(s, lambda x, i: F.concat(zeros(x - before(i) - 1), F.array(F.lit(1.0)))))
    arr = F.concat(runs, zeros(F.lit(width - 1) - F.coalesce(F.array_max(s), F.lit(-1))))
    if width == 0:
        arr = F.array().cast("array<double>")
    return df.withColumn(out, array_to_vector(arr))


def matrix_long(matrix: DataFrame, names: DataFrame, id_col: str = S.ID, features: str = "features") -> DataFrame:
    """(id, idx, name, block, value): the assembled matrix by cell, named by ``feature_names``."""
    cells = matrix.select(id_col, F.posexplode(vector_to_array(features)).alias("idx", "value"))
    return cells.join(names.select(F.col("idx").cast("int").alias("idx"), "name", "block"), "idx") \
                .select(id_col, "idx", "name", "block", "value")


# -- B27 ----------------------------------------------------------------------
def logits_to_proba(df: DataFrame, l0: str = "l0", l1: str = "l1", out: str = "y_proba") -> DataFrame:
    """Positive-class probability of a two-logit softmax: 1 / (1 + exp(l0 - l1))."""
    return df.withColumn(out, 1.0 / (1.0 + F.exp(F.col(l0) - F.col(l1))))


# -- G3 -----------------------------------------------------------------------
def coefficient_table(coefs: np.ndarray, vocabulary: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most positive and ``n`` most negative coefficients by term (model-
    sized: one row per vocabulary term)."""
    spark = vocabulary.sparkSession
    c = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(coefs)], "term_id long, coef double")
    named = c.join(vocabulary.select(F.col("term_id").cast("long"), "term"), "term_id")
    pos = named.orderBy(F.desc("coef"), F.asc("term")).limit(n).withColumn("side", F.lit("positive"))
    neg = named.orderBy(F.asc("coef"), F.asc("term")).limit(n).withColumn("side", F.lit("negative"))
    return pos.unionByName(neg)
