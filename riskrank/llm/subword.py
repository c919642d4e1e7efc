"""Quality classifier: supervised subword embeddings.

Every word, character n-gram (3 to 5 bytes, inside a word and its borders) and repeated
word pair of a text is hashed to one of ``BUCKETS`` rows of an embedding matrix. A document
is the mean of its rows; a softmax layer gives the class probabilities. Both are learned by
numpy stochastic gradient descent, one document a step, with a falling learning rate.

The model is linear in the mean, so for scoring each row is folded with the output layer
into one number (its share of the log odds), and a document's score is the sigmoid of the
mean of its features' numbers. Features are read with numpy over the bytes of whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, hash_sample, map_texts

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = 3
RATE = 1.0
SEED = 6
#: Learn from so many labelled rows at most: those with the smallest hash of their id.
SAMPLE_ROWS = 4000
THRESHOLD = 0.3
#: Texts are read in stretches of so many bytes, cut at white space.
STRETCH = 1 << 20

SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Shared features: the end of every text, a word equal to the one before.
END, AGAIN = 0, 1


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(47)).astype(np.int64) % (BUCKETS - 2) + 2


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def stretch_features(text: bytes) -> np.ndarray:
    """Feature rows of one stretch; runs of white space count as one border."""
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    space = SPACES[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    data, space = data[keep], space[keep]
    b = np.where(space, 32, data).astype(np.uint64)
    # words: differences of one running polynomial hash
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * _powers(PRIME, len(b)), out=prefix[1:])
    borders = np.flatnonzero(space)
    start, end = borders[:-1] + 1, borders[1:]
    words = (prefix[end] - prefix[start]) * _powers(INVERSE, len(b))[start]
    out = [_bucket(words, 1)]
    again = int((words[1:] == words[:-1]).sum())
    if again:
        out.append(np.full(again, AGAIN))
    before = np.concatenate([[0], np.cumsum(space)])
    gram = b.copy()
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * PRIME + b[n - 1:] if len(gram) > 1 else gram[:0]
        if n in GRAMS and len(gram):
            i = np.arange(len(gram))
            whole = before[i + n - 1] == before[i + 1]  # no border inside
            out.append(_bucket(gram[whole], n))
    return np.concatenate(out)


def stretches(text: bytes) -> list[bytes]:
    """A text cut at white space into stretches of about ``STRETCH`` bytes."""
    out, at = [], 0
    while len(text) - at > STRETCH:
        cut = max(text.rfind(s, at + 1, at + STRETCH) for s in (b" ", b"\n", b"\t"))
        cut = cut if cut > at else at + STRETCH
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, counts) of a text, the end included."""
    counts = np.zeros(0, np.int64)
    for part in stretches(text or b""):
        c = np.bincount(stretch_features(part), minlength=1)
        if len(c) < len(counts):
            c = np.pad(c, (0, len(counts) - len(c)))
        c[:len(counts)] += counts
        counts = c
    counts = counts if len(counts) else np.zeros(1, np.int64)
    counts[END] += 1
    rows = np.flatnonzero(counts)
    return rows, counts[rows]


def train_rows(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality",
               id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rows, counts, label`` of the sample: labelled documents that ``learn`` (a condition on the
    id) lets in, the ``sample_rows`` with the smallest hash of their id. Of documents that share an
    id, that with the smallest hash of its text counts."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")) \
                  .where(F.col("id").isNotNull() & F.col("label").isNotNull())
    known = hash_sample(known.where(learn), "id", sample_rows, SEED)
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    # one row an id (that with the smallest hash), so at most sample_rows rows reach the driver
    some = some.join(F.broadcast(known.select("id").distinct()), "id", "left_semi").groupBy("id") \
               .agg(F.min(F.struct(F.xxhash64("t").alias("spot"), "t")).alias("first"))
    rows = some.join(F.broadcast(known), "id").select("id", "label", F.col("first.t").alias("t"))

    def run(batch):
        found = [document_features(t) for t in byte_texts(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r.astype("i4") for r, _ in found], pa.list_(pa.int32())),
             pa.array([c.astype("i4") for _, c in found], pa.list_(pa.int32())), batch.column(1)],
            names=["id", "rows", "counts", "label"])
    return map_texts(rows, run, "id long, rows array<int>, counts array<int>, label int")


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE,
        dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """Learn the embeddings and the output layer; gives each row's share of the log odds.
    Without samples, or with one class only, the result is constant."""
    rng = np.random.default_rng(seed)
    classes = {y for _, _, y in samples}
    if len(classes) < 2:
        return np.full(BUCKETS, 4.0 if classes == {1} else -4.0 if classes == {0} else 0.0, np.float32)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = np.zeros((2, dim), np.float32)
    steps, at = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            rows, counts, label = samples[i]
            now = rate * (1 - at / steps)
            at += 1
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ table[rows]
            z = output @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= now * np.outer(p, mean)
            # rows share the step by their weight in the mean, scaled to the usual one-hot size
            table[rows] -= (now * len(rows) ** 0.5) * np.outer(share, back)
    return (table @ (output[1] - output[0])).astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> np.ndarray:
    """Fit on the bounded sample; labels other than 0 and 1 count as 1."""
    rows = train_rows(docs, labels, learn, **options).orderBy("id", "label").toArrow()
    samples = [(np.asarray(r.values), np.asarray(c.values).astype(np.float64), int(y.as_py() != 0))
               for r, c, y in zip(rows["rows"], rows["counts"], rows["label"])]
    return fit(samples)


def score_texts(texts: list, odds: np.ndarray) -> np.ndarray:
    """Probability of class 1 of each text."""
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        total, n = float(odds[END]), 1
        for part in stretches(text or b""):
            rows = stretch_features(part)
            total += float(odds[rows].sum(dtype=np.float64))
            n += len(rows)
        out[i] = 1 / (1 + np.exp(-np.clip(total / n, -60, 60)))
    return out


def score(docs: DataFrame, odds: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row. Null and empty texts are scored by the end
    feature alone. Labels, other columns and the id are no inputs. Repeated rows stay
    repeated. ``odds`` has a fixed size and is shipped with the tasks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batch):
        p = score_texts(byte_texts(batch.column(1)), odds)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype("i4"))],
                                          names=["doc_id", "score", "predicted"])
    return map_texts(rows, run, "doc_id long, score double, predicted int")


def quality_score(text: Column, odds: np.ndarray) -> Column:
    """The same score as a column, for filters that keep whole rows."""
    @F.arrow_udf("double")
    def run(texts):
        return pa.array(score_texts(byte_texts(texts), odds))
    return run(text)
