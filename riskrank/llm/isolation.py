"""Quality rules by an isolation forest on rule statistics.

Each text is reduced to rule statistics (lengths, symbols, repeated lines and word windows,
letter case and the like). A forest of random trees is grown on small samples: a tree splits
a random statistic at a random value until rows are alone. Rows that differ from the bulk
are alone after few splits, so a short mean path marks an anomalous document. The path
length under which a document is rejected is calibrated on labelled rows.

Every tree gets ``TREE_ROWS`` rows of all documents, by a hash of the row and the tree. The threshold
comes from the exact scores of all labelled rows that the base rules let through. Nothing else is
sampled; statistics and scores cover every row and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_totals
from .common import map_texts, written

TREES, TREE_ROWS = 200, 256
#: Calibration keeps this share of the good labelled rows at least.
KEEP_GOOD = 0.99
SEED = 1
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b".,;:!?'\"()-"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_again",
         "n_distinct", "n_upper", "n_digits", "n_marks", "longest")


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first included."""
    import xxhash
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(window))))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, n)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def rule_statistics(text: str | None) -> tuple:
    """The statistics of one text, in the order of ``STATS``; all 0 for null or no words and lines."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen, dup_lines, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    gone = lambda chars: len(data) - len(data.translate(None, chars))
    return (len(words), len(text) - gone(b" \t\n\r\x0b\x0c"), gone(SYMBOLS), dup_lines, repeated_words(words), lines,
            sum(a == b for a, b in zip(words, words[1:])), len(set(words)), gone(UPPER), gone(DIGITS), gone(MARKS),
            max(map(len, words), default=0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the rule statistics of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batch):
        found = np.array([rule_statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], names=["doc_id", *STATS])
    return map_texts(rows, run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: sizes on a log scale, the rest as rates."""
    s = {k: v.astype(np.float64) for k, v in stats.items()}
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    chars = np.maximum(s["word_chars"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines,
                     s["n_repeat_words"] / words, s["n_again"] / words, s["n_distinct"] / words, s["n_upper"] / chars,
                     s["n_digits"] / chars, s["n_marks"] / words, np.log1p(s["longest"])], axis=1)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of a search that fails in a tree of ``n`` rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random isolation trees as arrays: ``feature`` (-1: leaf), ``split``, ``left``, ``length``."""

    def __init__(self, samples: list[np.ndarray], seed: int = SEED):
        """A tree for each sample of rows; all samples have the same size."""
        rng = np.random.default_rng(seed)
        self.feature, self.split, self.left, self.length, self.roots = [], [], [], [], []
        take = len(samples[0]) if samples else 0
        self.usual = float(mean_path(np.array(take))) or 1.0
        for sample in samples:
            self.roots.append(len(self.feature))
            self._grow(rng, sample, int(np.ceil(np.log2(max(take, 2)))))
        self.feature, self.left, self.roots = (np.array(v, np.int64) for v in (self.feature, self.left, self.roots))
        self.split, self.length = (np.array(v, np.float64) for v in (self.split, self.length))

    def _node(self) -> int:
        for column, value in ((self.feature, -1), (self.split, 0.0), (self.left, 0), (self.length, 0.0)):
            column.append(value)
        return len(self.feature) - 1

    def _grow(self, rng, sample, limit):
        todo = [(self._node(), sample, 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(open_):
                self.length[at] = depth + float(mean_path(np.array(len(rows))))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            goes = rows[:, f] < cut
            self.feature[at], self.split[at] = f, cut
            self.left[at] = self._node()  # the right child is the next node
            right = self._node()
            todo += [(self.left[at], rows[goes], depth + 1), (right, rows[~goes], depth + 1)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores, 0 to 1; a shorter mean path gives a higher score."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = self.left[node] + (x[rows, self.feature[node]] >= self.split[node])
            total += self.length[at]
        return 2.0 ** (-total / max(len(self.roots), 1) / self.usual)


def tree_samples(stats: DataFrame, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> list[np.ndarray]:
    """Features of the ``rows`` rows (all, if fewer) with the smallest hash for each tree. Rows are told
    apart by ``row``, so equal rows are drawn one by one. A bound on the hash comes first: about
    twice as many rows as needed are ordered."""
    n = stats.count()
    bound = np.uint64(min(2.0 * rows / max(n, 1), 1.0) * (2 ** 64 - 2048)) if n > 2 * rows else np.uint64(2 ** 64 - 1)

    def draw(batches):
        for batch in batches:
            key = batch.column(len(STATS)).to_numpy().astype(np.uint64)
            for tree in range(trees):
                z = key + np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2 ** 64)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
                z ^= z >> np.uint64(31)
                at = np.flatnonzero(z <= bound)
                if len(at):
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(at), tree, np.int32)), pa.array((z[at] >> np.uint64(1)).astype(np.int64))],
                                                     names=[*batch.schema.names, "tree", "spot"])
    drawn = stats.select(*STATS, "row").mapInArrow(draw, ", ".join(f"{s} long" for s in STATS) + ", row long, tree int, spot long")
    order = Window.partitionBy("tree").orderBy("spot", "row")  # about 2 * rows rows a tree
    some = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).orderBy("tree", "k").toArrow()
    x, tree = features(_arrays(some)), np.asarray(some["tree"])  # trees * rows rows at most
    return [x[tree == t] for t in range(trees)] if n else []


def calibrate(scored: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """Highest score kept, from all rows (``anomaly``, ``good``): of the cuts that keep ``keep_good`` of the
    good rows, the one that rejects the largest share of bad rows less the share of good rows.
    Infinity (reject nothing) without both kinds of rows or when no cut helps."""
    counts = scored.groupBy("anomaly").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    totals = running_totals(written(counts, "score-counts"), "anomaly", ["good", "bad"])
    lost, caught = (F.lit(1.0) - F.try_divide(F.col(f"cum_{c}"), F.col(f"tot_{c}")) for c in ("good", "bad"))
    best = totals.select("anomaly", lost.alias("lost"), (caught - lost).alias("gain")) \
                 .where((F.col("lost") <= 1 - keep_good) & (F.col("gain") > 0)).orderBy(F.desc("gain"), "anomaly").first()
    return float("inf") if best is None else best["anomaly"]


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    return {s: np.asarray(table[s]) for s in STATS}


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality") -> DataFrame:
    """One row a document: ``doc_id``, the statistics, ``base_failed`` (fewer than 10 words, or
    more than a fifth of the words in repeated windows), ``anomaly`` (the forest's score) and ``kept``.

    Null texts count as empty. Null ids are scored and never labelled; null labels are left
    out; rows repeated stay repeated. Without documents the result is empty, without labels
    of both kinds the forest rejects nothing. Other columns are not read."""
    stats = statistics(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    stats = written(stats, "rule-statistics")
    forest = Forest(tree_samples(stats))

    def run(batches):
        for batch in batches:
            scores = forest.scores(features({s: np.asarray(batch.column(s)) for s in STATS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "anomaly"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = stats.drop("row").mapInArrow(run, stats.drop("row").schema.simpleString()[7:-1].replace(":", " ") + ", anomaly double")
    scored = written(scored.withColumn("base_failed", failed), "rule-scores")
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col).cast("int") != 0).alias("good")).dropna().distinct()
    marked = scored.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("id")).select("anomaly", "good")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(calibrate(marked))))
