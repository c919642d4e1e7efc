"""Logistic regression on sparse rows with the intercept inside the penalty.

Minimises ``|w|^2 / 2 + C * sum(weight * log(1 + exp(-+ z)))`` where ``z = x . w`` and every row has a
last feature of 1, whose coefficient is the intercept. A truncated Newton method: conjugate
gradients on Hessian-vector products, then a step along the direction. Rows are packed once into blocks
of compressed sparse rows and persisted; every gradient, product or line search is one pass over them, whose partial
sums (a vector of the number of features) are merged on the executors, when there are many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .booster import _arrow_blocks
from .eda import class_weights

STEPS = 0.5 ** np.arange(12)


@dataclass
class SparseLogistic:
    coefficients: np.ndarray
    intercept: float
    gradient_norm: float  # at the answer
    start_norm: float     # at zero
    iterations: int

    def scores(self, rows: DataFrame, out: str = "y_proba", index: str = "_i", value: str = "_v") -> DataFrame:
        """``rows`` (index and value lists) without the lists, and the positive probability."""
        held = rows.sparkSession.sparkContext.broadcast((self.coefficients, self.intercept))  # model-sized
        keep = [c for c in rows.columns if c not in (index, value)]

        def run(batches):
            w, b = held.value
            for batch in batches:
                block = _rows_of(batch, batch.num_columns - 2)
                z = _dot(block, w) + b
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(1.0 / (1.0 + np.exp(-z)))], names=[*keep, out])
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select(*keep, index, value).mapInArrow(run, f"{kinds}, {out} double")


def _rows_of(batch: pa.RecordBatch, at: int) -> tuple:
    """(number of rows, row of each entry, indices, values) of the lists at columns ``at`` and the next."""
    lengths = np.diff(batch.column(at).offsets.to_numpy())
    index = batch.column(at).flatten().to_numpy().astype(np.int64)
    return len(lengths), np.repeat(np.arange(len(lengths)), lengths), index, batch.column(at + 1).flatten().to_numpy()


def _dot(block: tuple, w: np.ndarray) -> np.ndarray:
    n, row, index, value = block[:4]
    return np.bincount(row, value * w[index], n)


def _back(block: tuple, u: np.ndarray, size: int) -> np.ndarray:
    """The rows summed with weights ``u``; the last entry belongs to the feature 1."""
    _, row, index, value = block[:4]
    return np.append(np.bincount(index, value * u[row], size - 1), u.sum())


def _sum(blocks: RDD, fn) -> np.ndarray:
    def part(items):
        total = None
        for b in items:
            total = fn(b) if total is None else total + fn(b)
        if total is not None:
            yield total
    parts = blocks.mapPartitions(part)
    return parts.treeReduce(lambda a, b: a + b, depth=1 if parts.getNumPartitions() <= 16 else 2)


def fit(rows: DataFrame, size: int, C: float = 1.0, label: str = S.TARGET, balanced: bool = True, max_iter: int = 2000,
        tol: float = 1e-8, index: str = "_i", value: str = "_v") -> SparseLogistic:
    """Fit on ``rows`` (index and value lists below ``size``, and the label); stops when the
    gradient is ``tol`` times that at zero. Rows without entries count by their intercept."""
    if balanced:
        w = class_weights(rows, label).select(label, F.col("weight").alias("_w"))  # a row a class
        rows = rows.join(F.broadcast(w), label)
    else:
        rows = rows.withColumn("_w", F.lit(1.0))

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield (*_rows_of(b, 2), np.where(b.column(0).to_numpy() == 1, 1.0, -1.0), b.column(1).to_numpy())
    blocks = _arrow_blocks(rows.select(F.col(label).cast("int"), "_w", index, value), pack).persist(StorageLevel.MEMORY_AND_DISK)
    n = size + 1
    x = np.zeros(n)
    start = norm = None
    it = 0
    while True:
        def slope(b, x=x):
            z = _dot(b, x[:-1]) + x[-1]
            pull = 1.0 / (1.0 + np.exp(b[4] * z))
            return _back(b, -b[5] * b[4] * pull, n)
        grad = x + C * _sum(blocks, slope)
        norm = float(np.linalg.norm(grad))
        start = norm if start is None else start
        if norm <= tol * start or it == max_iter:
            break
        it += 1

        def product(v, x=x):
            def part(b):
                p = 1.0 / (1.0 + np.exp(-_dot(b, x[:-1]) - x[-1]))
                return _back(b, b[5] * p * (1.0 - p) * (_dot(b, v[:-1]) + v[-1]), n)
            return v + C * _sum(blocks, part)
        step, left, toward = np.zeros(n), -grad, -grad
        most = min(0.1, np.sqrt(norm / start)) * norm
        for _ in range(200):
            if np.linalg.norm(left) <= most:
                break
            curve = product(toward)
            a = (left @ left) / (toward @ curve)
            step, after = step + a * toward, left - a * curve
            toward, left = after + (after @ after) / (left @ left) * toward, after

        def losses(b, x=x, step=step):
            z, d = _dot(b, x[:-1]) + x[-1], _dot(b, step[:-1]) + step[-1]
            return np.array([(b[5] * np.logaddexp(0.0, -b[4] * (z + t * d))).sum() for t in (0.0, *STEPS)])
        values = C * _sum(blocks, losses) + 0.5 * np.array([((x + t * step) ** 2).sum() for t in (0.0, *STEPS)])
        falls = np.flatnonzero(values[1:] <= values[0] + 1e-4 * STEPS * (grad @ step) + 1e-12 * abs(values[0]))
        if not len(falls):
            break  # no step helps beyond rounding
        x = x + STEPS[falls[0]] * step
    blocks.unpersist()
    return SparseLogistic(x[:-1], float(x[-1]), norm, start, it)
