"""Leaf-wise boosted trees on binned features.

The feature matrix is binned once, one byte a cell, and kept as blocks of rows with their
margins. A round grows one tree: each pass over the blocks adds up gradient, hessian and
row counts per (leaf, feature, bin) for the leaves that need it; of two siblings only the
smaller one is counted, the other is the parent's histogram less that. Blocks' sums are merged
on the executors (a tree of merges, when there are many), so the driver gets one histogram a leaf, whatever
the number of rows. It holds at most ``num_leaves`` histograms of features x bins.

Growth is best-first: the leaf with the largest gain is split next, until there are
``num_leaves``. A pass asks for all leaves that the splits known so far would reach. A node of
``SMALL_ROWS`` rows and ``SMALL_CELLS`` cells (bytes) at most is finished in one go: its rows meet in one task, which grows the subtree below
it (by the same rule, as far as ``num_leaves`` would go) and returns the splits. So a tree takes as
many passes as it has levels of large nodes, and one more. Several boosters (``params``) grow side by side in the same passes.
If all rows are few (``_fits_a_task``), a task fits a booster: it grows up to ``ROUNDS_A_JOB`` trees, judges each on the
validation rows and stops by itself. The largest boosters start first, and a free core takes the next.

With validation rows, the fit stops after ``patience`` rounds without a better average
precision. No round can end the fit before ``best so far + patience``, so in fits by passes validation margins
advance, and the rounds since then are judged in one grouped pass (for ``SMALL_ROWS`` rows at most a task ranks them
for ``ROUNDS_A_TASK`` rounds; for more, by ``curves``), exactly when that round is reached: no tree is fitted after the stop.

Margins are persisted with the blocks whenever they advance; every ``CUT_ROUNDS`` times the lineage is cut.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir, stored
from . import curves
from .trees import Boosted, Tree, leaf_of, leaf_values, pack, unpack

BLOCK_BYTES = 8 << 20
LEAST_BLOCK_BYTES = 1 << 20
SMALL_ROWS = 1 << 17
SMALL_CELLS = 16 << 20
FEW_ROWS = 8192
CHUNK_CELLS = 1 << 16
#: Columns of so many bins at least are counted in pairs.
PAIRED_BINS = 16
ROUNDS_A_JOB = 250
ROUNDS_A_TASK = 25
CUT_ROUNDS = 25


@dataclass(frozen=True)
class BoostParams:
    n_estimators: int = 1000
    learning_rate: float = 0.05
    num_leaves: int = 63
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    subsample: float = 0.8
    colsample: float = 0.8
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    seed: int = 42


@dataclass
class Fit:
    """``best`` is the number of trees of the best round (all, without validation rows);
    ``history`` has every judged (n_trees, average precision)."""
    boosted: Boosted
    best: int
    history: list = field(default_factory=list)


# -- binning ------------------------------------------------------------------
def bin_bounds(rows: DataFrame, features: str = "features", bins: int = 64) -> list[np.ndarray]:
    """For each feature the upper bounds of its bins but the last, from quantiles of all rows.
    A value is in the first bin whose bound is not below it; NaN is in the last bin."""
    probs = [i / bins for i in range(bins)]
    cells = rows.select(F.posexplode(vector_to_array(features)).alias("feature", "value"))
    real = F.when(~F.isnan("value"), F.col("value"))
    table = cells.groupBy("feature").agg(F.percentile_approx(real, probs, 10000).alias("cuts"), F.max(real).alias("top"),
                                         F.max(F.isnan("value")).alias("missing"))
    width = rows.select(F.max(F.size(vector_to_array(features)))).first()[0] or 0
    out = [np.zeros(0)] * width
    for r in table.collect():  # a row a feature
        cuts = np.unique(np.array(r["cuts"] or [], float))
        if r["top"] is not None:  # with missing values, the last bin is theirs
            out[r["feature"]] = np.append(cuts[cuts < r["top"]], [r["top"]] * r["missing"])
    return out


def binned_blocks(rows: DataFrame, bounds: list[np.ndarray], weight: float, n_boosters: int, start: list[float],
                  id_col: str = S.ID, label: str = S.TARGET, features: str = "features", n_rows: int = 0, unknown: int | None = None) -> RDD:
    """Blocks ``(x, y, w, key, margins)``: bins (rows x features, one byte each), labels (``unknown``, when given, stands
    for null), weights, row keys for sampling, and a margin for each booster."""
    held = rows.sparkSession.sparkContext.broadcast(bounds)  # features x bins
    y = (F.col(label) == 1).cast("int")
    data = rows.select(F.xxhash64(F.col(id_col)).alias("key"), (y if unknown is None else F.coalesce(y, F.lit(unknown))).alias("y"),
                       vector_to_array(features).alias("x"))
    size = n_rows * max(len(bounds), 1)
    blocks = max(1, -(-size // BLOCK_BYTES), min(-(-size // LEAST_BLOCK_BYTES), rows.sparkSession.sparkContext.defaultParallelism))
    if data.rdd.getNumPartitions() > blocks:
        data = data.coalesce(blocks)

    def pack(batches):
        bounds = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cells = np.empty(x.shape, np.uint8, order="F")  # histograms read a feature at a time
            for j, cuts in enumerate(bounds):
                cells[:, j] = np.searchsorted(cuts, x[:, j], side="left")
            y = b.column(1).to_numpy()
            yield (cells, y.astype(np.float64), np.where(y == 1, weight, 1.0), b.column(0).to_numpy().astype(np.uint64),
                   np.tile(np.array(start, float)[:, None], (1, b.num_rows)))
    return _arrow_blocks(data, pack)


def _arrow_blocks(data: DataFrame, pack) -> RDD:
    """``pack`` over the Arrow batches of each partition, its blocks as elements of an RDD."""
    import pickle

    import pyarrow as pa

    def run(batches):
        for block in pack(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])
    return data.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


# -- one pass -----------------------------------------------------------------
def _in_bag(key: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Rows drawn for a round, by a hash of the row's key: the same under any partitioning."""
    if share >= 1.0:
        return np.ones(len(key), bool)
    z = key + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) < np.uint64(int(share * (2 ** 64 - 1)))


def _histogram(x: np.ndarray, rows: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, near=None, paired=None) -> np.ndarray:
    """Sums of gradient, hessian and rows per (feature, bin): 3 x features x bins. Sums are added up in the order of
    ``rows``, gradient and hessian as one complex number. ``near`` gives the cells of some rows, where they lie together;
    columns in ``paired`` (``_pairs``) are counted two at a time, in a table of bins x bins, where rows are many."""
    both = g[rows] + 1j * h[rows]
    if len(rows) > FEW_ROWS:  # a feature at a time: its bins stay in the cache
        sums, n, done = np.zeros((len(columns), bins), complex), np.empty((len(columns), bins)), set()
        if paired is not None and len(rows) > 2 * bins * bins:
            for a, b, joint in paired:
                cells, table = joint.take(rows).astype(np.intp), np.zeros((bins, bins), complex)
                np.add.at(table.ravel(), cells, both)
                sums[a], sums[b] = table.sum(axis=1), table.sum(axis=0)
                table = np.bincount(cells, None, bins * bins).reshape(bins, bins)
                n[a], n[b] = table.sum(axis=1), table.sum(axis=0)
                done |= {a, b}
        for at, j in enumerate(columns):
            if at not in done:
                cells = x.T[j].take(rows).astype(np.intp)
                np.add.at(sums[at], cells, both)
                n[at] = np.bincount(cells, None, bins)
        return np.stack([sums.real, sums.imag, n])
    own = np.ascontiguousarray(x.T.take(rows, axis=1).T[:, columns]) if near is None else near(rows)
    size, first = len(columns) * bins, np.arange(len(columns)) * bins
    sums, n, step = np.zeros(size, complex), np.zeros(size), max(1, CHUNK_CELLS // max(1, len(columns)))
    for at in range(0, len(rows), step):
        cells = (own[at:at + step] + first).ravel()
        np.add.at(sums, cells, np.repeat(both[at:at + step], len(columns)))
        n += np.bincount(cells, None, size)
    return np.stack([sums.real, sums.imag, n]).reshape(3, len(columns), bins)


def _plain(across: np.ndarray, bounds: list) -> np.ndarray:
    """Which columns (rows of ``across``) are counted one by one: those of few bins and those that equal another. Their
    sums are added up in the same order, so equal splits have equal gains to the bit, and the first feature wins."""
    seen, plain = {}, np.array([len(b) + 1 < PAIRED_BINS for b in bounds], bool)
    for j in np.flatnonzero(~plain):
        first = seen.setdefault(hash(across[j].tobytes()), j)
        plain[[first, j]] |= first != j
    return plain


def _pairs(across: np.ndarray, plain: np.ndarray, bins: int) -> list:
    """``(a, b, joint bins)`` of the columns that are not ``plain``, two at a time."""
    wide = np.flatnonzero(~plain)
    return [(a, b, across[a] * np.uint16(bins) + across[b]) for a, b in zip(wide[::2], wide[1::2])]


def _pass(state: RDD, asked: dict, bins: int) -> dict:
    """Histograms ``{(booster, node): 3 x features x bins}`` of the nodes asked for:
    ``{booster: (tree so far, nodes, columns, seed, round, subsample)}``."""
    def count(blocks):
        out = {}
        for x, y, w, key, margins in blocks:
            for i, (tree, nodes, columns, seed, turn, share) in asked.items():
                p = 1.0 / (1.0 + np.exp(-margins[i]))
                g, h = w * (p - y), w * p * (1.0 - p)
                rows = np.flatnonzero(_in_bag(key, seed, turn, share))
                at = leaf_of(tree, x[rows])
                for node in nodes:
                    part = _histogram(x, rows[at == node], columns, g, h, bins)
                    out[i, node] = out[i, node] + part if (i, node) in out else part
        yield out

    def merge(a, b):
        for k, v in b.items():
            a[k] = a[k] + v if k in a else v
        return a
    parts = state.mapPartitions(count)
    return parts.treeReduce(merge, depth=1 if parts.getNumPartitions() <= 16 else 2)


def _finish_pass(state: RDD, asked: dict, params: list, bins: int) -> dict:
    """Subtrees ``{(booster, node): arrays}`` of small nodes, each grown in a task of its own."""
    def send(blocks):
        for x, y, w, key, margins in blocks:
            for i, (tree, nodes, columns, seed, turn, share) in asked.items():
                p = 1.0 / (1.0 + np.exp(-margins[i]))
                rows = np.flatnonzero(_in_bag(key, seed, turn, share))
                at = leaf_of(tree, x[rows])
                for node in nodes:
                    own = rows[at == node]
                    if len(own):
                        yield (i, node), (x[np.ix_(own, columns)], (w * (p - y))[own], (w * p * (1.0 - p))[own])

    def grow(item):
        key, parts = item
        x, g, h = (np.concatenate(a) for a in zip(*parts))
        return key, _grow_here(params[key[0]], x, g, h, bins)
    n = min(sum(len(a[1]) for a in asked.values()), state.context.defaultParallelism)
    return dict(state.mapPartitions(send).groupByKey(n).map(grow).collect())


def _fit_here(p: BoostParams, parts: list, judged: list, bounds: list, bins: int, base: float, before: list, best: tuple,
              patience: int | None) -> tuple[list, list]:
    """``[(tree, tree over bins)]`` of up to ``ROUNDS_A_JOB`` rounds after the trees ``before``, and the average precision of
    each on the ``judged`` rows (those of a known label); ``best`` is the (number of trees, precision) of the best round so far."""
    def gathered(parts):
        key = np.concatenate([block[3] for block in parts])
        order = np.argsort(key, kind="stable")  # the same sums in any order of arrival
        across = np.concatenate([block[0].T for block in parts], axis=1).take(order, axis=1)  # read a feature at a time
        margin = np.full(len(key), base)
        for tree in before:
            margin = margin + _values_here(tree, across)
        return across, margin, *(np.concatenate([block[k] for block in parts])[order] for k in (1, 2, 3))
    across, margin, y, w, key = gathered(parts)
    if judged:
        other, other_margin, truth, *_ = gathered(judged)
        known = truth >= 0
    plain, rows_first = _plain(across, bounds), np.ascontiguousarray(across.T)
    out, precisions, first = [], [], len(before)
    for turn in range(first, min(first + ROUNDS_A_JOB, p.n_estimators)):
        if patience is not None and turn >= best[0] + patience:
            break
        q = 1.0 / (1.0 + np.exp(-margin))
        rows = np.flatnonzero(_in_bag(key, p.seed, turn, p.subsample))
        columns = _columns(p, len(across), turn)
        own = across[columns]
        tree = _Growing(p, columns, turn)
        tree.graft(0, *_grow_here(p, own.T, w * (q - y), w * q * (1.0 - q), bins, rows,
                                  lambda some, columns=columns: rows_first.take(some, axis=0).take(columns, axis=1),
                                  _pairs(own, plain[columns], bins)))
        out.append(tree.finish(bounds))
        margin = margin + _values_here(out[-1][1], across)
        if judged:
            other_margin = other_margin + _values_here(out[-1][1], other)
            precisions.append(_precision(truth[known] == 1, other_margin[known]))
            if not best[0] or precisions[-1] > best[1]:
                best = (turn + 1, precisions[-1])
    return out, precisions


def _whole_fits(state: RDD, judged: RDD | None, fits: list, over_bins: list, active: list, params: list, patience: int, bounds,
                bins: int) -> dict:
    """``{booster: (pairs, precisions)}`` of the next rounds of the active boosters, where all rows are few
    (``_fits_a_task``); a task a booster, those of the smallest steps (and so most rounds) first."""
    order = sorted(active, key=lambda i: params[i].learning_rate)
    held = state.context.broadcast({i: ([_arrays(t) for t in over_bins[i]], fits[i].boosted.base,
                                        (fits[i].best, dict(fits[i].history).get(fits[i].best, 0.0))) for i in active})  # model-sized
    blocks = state.map(lambda block: (0, block))
    if judged is not None:
        blocks = blocks.union(judged.map(lambda block: (1, block)))
    stop = None if judged is None else patience

    def send(blocks):
        for kind, block in blocks:
            for at in range(len(order)):
                yield at, (kind, block[:4])

    def grow(item):
        i, parts = order[item[0]], ([], [])
        for kind, block in item[1]:
            parts[kind].append(block)
        before, base, best = held.value[i]
        pairs, precisions = _fit_here(params[i], *parts, bounds.value, bins, base, [Tree(*t) for t in before], best, stop)
        return i, ([tuple(_arrays(t) for t in pair) for pair in pairs], precisions)
    grown = blocks.mapPartitions(send).groupByKey(len(order), partitionFunc=int).map(grow).collect()
    return {i: ([tuple(Tree(*t) for t in pair) for pair in pairs], precisions) for i, (pairs, precisions) in grown}


def _arrays(t: Tree) -> tuple:
    return t.feature, t.threshold, t.left, t.right, t.value, t.gain, t.rows


def _small(width: int) -> int:
    """So many rows of ``width`` features at most meet in one task of a pass."""
    return min(SMALL_ROWS, SMALL_CELLS // max(width, 1))


def _fits_a_task(n: int, width: int) -> bool:
    """Whether a task holds all rows (four bytes a cell or so) and grows trees on them sooner than a job a level would."""
    return n <= min(2 * SMALL_ROWS, 4 * SMALL_CELLS // max(width, 1))


def _grow_here(p: BoostParams, x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, drawn: np.ndarray | None = None, near=None, paired=None) -> tuple:
    """The nodes of a tree over these rows alone (of them the ``drawn`` ones); features are columns of ``x``. Each node
    keeps the list of its rows, and only nodes that are split get their children counted."""
    if near is None and x.flags.c_contiguous:
        near = functools.partial(x.take, axis=0)
    x, columns = np.asfortranarray(x), np.arange(x.shape[1])  # read a feature at a time
    tree = _Growing(p, columns, 0, 0)
    rows, heap, leaves, least = {0: np.arange(len(x)) if drawn is None else drawn}, [], 1, 2 * p.min_child_samples - 0.5
    tree.tell({0: _histogram(x, rows[0], columns, g, h, bins, near, paired)})
    if tree.split[0]:
        heap = [(-tree.split[0][0], 0)]
    while heap and leaves < p.num_leaves:
        _, node = heapq.heappop(heap)
        tree._open(node)
        leaves += 1
        own, whole, pair = rows.pop(node), tree.hist[node], (tree.left[node], tree.right[node])
        tree.hist[node] = None
        n = [tree.sums[c][2] for c in pair]
        if leaves == p.num_leaves or max(n) <= least:  # no child is split
            tree.split[pair[0]] = tree.split[pair[1]] = False
            continue
        goes = x.T[tree.feature[node]].take(own) <= tree.bin[node]
        rows[pair[0]], rows[pair[1]] = own[goes], own[~goes]
        fewer = int(n[1] < n[0])
        hist = _histogram(x, rows[pair[fewer]], columns, g, h, bins, near, paired)
        both = [hist, whole - hist] if fewer == 0 else [whole - hist, hist]
        able = [k for k in (0, 1) if n[k] > least]
        found = dict(zip(able, _best_splits(p, np.stack([both[k] for k in able]), np.stack([tree.sums[pair[k]] for k in able]))))
        for k, c in enumerate(pair):
            tree.split[c] = found.get(k) or False
            if tree.split[c]:
                tree.hist[c] = both[k]
                heapq.heappush(heap, (-tree.split[c][0], c))
            else:
                del rows[c]
    return tree.bin, tree.left, tree.right, tree.sums, tree.split


def _values_here(tree: Tree, across: np.ndarray) -> np.ndarray:
    """The leaf value of each row of a tree over bins; ``across`` is features x rows."""
    out = np.empty(across.shape[1])
    stack = [(0, np.arange(len(out)))]
    while stack:
        node, rows = stack.pop()
        if tree.feature[node] < 0:
            out[rows] = tree.value[node]
            continue
        goes = across[tree.feature[node]].take(rows) <= tree.threshold[node]
        stack += [(tree.left[node], rows[goes]), (tree.right[node], rows[~goes])]
    return out


def _best_splits(p: BoostParams, hist: np.ndarray, sums: np.ndarray) -> list:
    """For each node (histograms nodes x 3 x features x bins) the split with the largest gain (ties: the
    first feature, then bin) as (gain, column, bin, left sums); None if there is none."""
    left = np.cumsum(hist[..., :-1], axis=3)
    right = sums[:, :2, None, None] - left[:, :2]
    fits = (left[:, 2] >= p.min_child_samples - 0.5) & (left[:, 2] <= sums[:, 2, None, None] - (p.min_child_samples - 0.5))
    fits &= (left[:, 1] >= p.min_child_weight) & (right[:, 1] >= p.min_child_weight)

    def score(g, h):
        over = g if p.reg_alpha == 0 else np.maximum(np.abs(g) - p.reg_alpha, 0.0)
        over = over * over
        over /= h + p.reg_lambda
        return over
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left[:, 0], left[:, 1])
        gain += score(right[:, 0], right[:, 1])
        gain -= score(sums[:, 0], sums[:, 1])[:, None, None]
    gain[~fits] = -np.inf
    gain = gain.reshape(len(hist), -1)
    out = []
    for k in range(len(hist)):
        at = int(np.argmax(gain[k])) if gain.shape[1] else -1
        if at < 0 or not gain[k, at] > 1e-12:
            out.append(None)
            continue
        j, b = divmod(at, left.shape[3])
        out.append((float(gain[k, at]), j, b, left[k, :, j, b]))
    return out


# -- one tree -----------------------------------------------------------------
class _Growing:
    """A tree while it grows. Nodes beyond the final leaves may be known; ``finish`` leaves them out."""

    def __init__(self, params: BoostParams, columns: np.ndarray, turn: int, small: int = 0, n_rows: int | None = None):
        self.p, self.columns, self.turn, self.small, self.n_rows = params, columns, turn, small, n_rows
        self.feature, self.bin, self.left, self.right = [-1], [0], [-1], [-1]
        self.sums, self.split, self.hist = [None], [None], [None]  # split: (gain, column, bin, left sums)

    def partial(self) -> Tree:
        return Tree(*(np.array(a) for a in (self.feature, self.bin, self.left, self.right)), np.zeros(len(self.bin)))

    def _know(self, node: int, hist) -> None:
        self.split[node] = False if hist is None else _best_splits(self.p, hist[None], self.sums[node][None])[0] or False
        self.hist[node] = hist if self.split[node] else None

    def _walk(self):
        """Best-first over what is known: the split nodes in order, and those whose children are not known."""
        heap, done, unknown, leaves = [], [], [], 1
        if self.split[0]:
            heap = [(-self.split[0][0], 0)]
        while heap and leaves < self.p.num_leaves:
            _, node = heapq.heappop(heap)
            done.append(node)
            leaves += 1
            children = (self.left[node], self.right[node])
            if children[0] < 0 or self.split[children[0]] is None:
                unknown.append(node)
                continue
            for c in children:
                if self.split[c]:
                    heapq.heappush(heap, (-self.split[c][0], c))
        return done, unknown

    def ask(self) -> tuple[list[int], list[int]]:
        """Nodes whose histogram the next pass has to count, and small nodes that it has to finish; none
        when the tree is final."""
        if self.sums[0] is None:
            return ([], [0]) if self.n_rows is not None and self.n_rows <= self.small else ([0], [])
        while True:
            asked, small, settled = [], [], False
            for node in self._walk()[1]:
                if self.left[node] < 0:
                    self._open(node)
                pair = (self.left[node], self.right[node])
                rows = [self.sums[c][2] for c in pair]
                if max(rows) > max(self.small, 2 * self.p.min_child_samples - 0.5):
                    asked.append(pair[int(rows[1] < rows[0])])
                    continue
                self.hist[node] = None
                for c, n in zip(pair, rows):
                    if self.split[c] is None and n >= 2 * self.p.min_child_samples - 0.5:
                        small.append(c)
                    elif self.split[c] is None:  # too few rows to split
                        self._know(c, None)
                        settled = True
            if asked or small or not settled:
                return asked, small

    def _open(self, node: int) -> None:
        _, j, b, sums = self.split[node]
        self.feature[node], self.bin[node] = int(self.columns[j]), b
        for side, s in ((self.left, sums), (self.right, self.sums[node] - sums)):
            side[node] = len(self.feature)
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.sums.append(s)
            self.split.append(None)
            self.hist.append(None)

    def tell(self, found: dict) -> None:
        """Take the histograms of the nodes asked for."""
        for node, hist in found.items():
            if node == 0:
                self.sums[0] = hist[:, 0, :].sum(axis=1)
                self._know(0, hist)
                continue
            parent = next(i for i in range(len(self.left)) if node in (self.left[i], self.right[i]))
            other = self.left[parent] + self.right[parent] - node
            whole = self.hist[parent]
            self._know(node, hist)
            self._know(other, whole - hist)
            self.hist[parent] = None

    def graft(self, node: int, bins: list, left: list, right: list, sums: list, split: list) -> None:
        """Take the subtree that was grown below ``node``."""
        shift = len(self.feature) - 1
        if self.sums[node] is None:
            self.sums[node] = sums[0]
        for k in range(len(bins)):
            inner = left[k] >= 0
            new = (int(self.columns[split[k][1]]) if inner else -1, bins[k], left[k] + shift if inner else -1,
                   right[k] + shift if inner else -1, sums[k], split[k] or False, None)
            for values, v in zip((self.feature, self.bin, self.left, self.right, self.sums, self.split, self.hist), new):
                if k:
                    values.append(v)
                elif values is not self.sums:
                    values[node] = v

    def finish(self, bounds: list[np.ndarray]) -> tuple[Tree, Tree]:
        """The tree with thresholds on values, and the same tree with bins as thresholds."""
        chosen = set(self._walk()[0])
        new, order = {0: 0}, [0]
        for node in order:  # breadth first
            if node in chosen:
                for c in (self.left[node], self.right[node]):
                    new[c] = len(order)
                    order.append(c)
        inner = np.array([n in chosen for n in order])
        g, h, rows = np.array([self.sums[n] for n in order]).T
        value = -np.sign(g) * np.maximum(np.abs(g) - self.p.reg_alpha, 0.0) / np.maximum(h + self.p.reg_lambda, 1e-300)
        feature = np.array([self.feature[n] if n in chosen else -1 for n in order])
        bin_at = np.array([self.bin[n] if n in chosen else 0 for n in order])
        left = np.array([new[self.left[n]] if n in chosen else -1 for n in order])
        right = np.array([new[self.right[n]] if n in chosen else -1 for n in order])
        cut = np.array([bounds[f][b] if f >= 0 else 0.0 for f, b in zip(feature, bin_at)])
        gain = np.array([self.split[n][0] if n in chosen else 0.0 for n in order])
        value = value * self.p.learning_rate
        tree = Tree(feature, cut, left, right, value, gain, rows)
        assert (left[inner] > 0).all()
        return tree, Tree(feature, bin_at, left, right, value, gain, rows)


# -- the fit ------------------------------------------------------------------
def fit_boosters(train: DataFrame, params: list[BoostParams], val: DataFrame | None = None, patience: int = 100,
                 scale_pos_weight: float | None = None, bins: int = 64, id_col: str = S.ID, label: str = S.TARGET,
                 features: str = "features") -> list[Fit]:
    """Fit one booster for each of ``params`` on the same rows, in shared passes.

    ``scale_pos_weight`` is negatives over positives, when not given. Rows with a label other
    than 1 are negatives; rows without positives (or negatives) give boosters without trees.
    NaN goes right at every split. Rows of equal id are drawn together."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    if not 2 <= bins <= 255:
        raise ValueError("bins, and one for missing values, are kept in one byte: 2 to 255")
    n, positives = train.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(label) == 1).cast("long")), F.lit(0))).first()
    if not 0 < positives < n:
        return [Fit(Boosted([], 0.0), 0) for _ in params]
    weight = (n - positives) / positives if scale_pos_weight is None else scale_pos_weight
    share = weight * positives / (weight * positives + n - positives)
    base = float(np.log(share / (1.0 - share)))
    bounds = bin_bounds(train, features, bins)
    width = max((len(b) for b in bounds), default=0) + 1
    state = binned_blocks(train, bounds, weight, len(params), [base] * len(params), id_col, label, features, n) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    fits = [Fit(Boosted([], base), 0) for _ in params]
    n_val = 0 if val is None else val.count()
    if _fits_a_task(n, len(bounds)) and _fits_a_task(2 * n_val, len(bounds)):
        judged = None if val is None else binned_blocks(val, bounds, 1.0, 0, [], id_col, label, features, n_val, -1) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        _fit_in_tasks(state, judged, fits, params, patience, bounds, width)
        for blocks in (state, judged):
            if blocks is not None:
                blocks.unpersist()
        return fits
    judge = None if val is None else _Judge(val, fits, patience, label, features)
    active, turn, before = list(range(len(params))), 0, None
    advances = 0
    while active:
        new = _one_round(state, active, params, turn, bounds, width, n)
        for i, pairs in new.items():
            fits[i].boosted.trees += [tree for tree, _ in pairs]
        turn += 1
        if before is not None:
            before.unpersist()
        active = [i for i in active if turn < params[i].n_estimators]
        if judge is not None:
            active = judge.still(active, turn)
        if active:
            advances += 1
            before, state = state, _advance(state, {i: [t for _, t in new[i]] for i in active}, advances)
    if before is not None:
        before.unpersist()
    state.unpersist()
    if judge is None:
        for f in fits:
            f.best = len(f.boosted.trees)
    return fits


def _fit_in_tasks(state: RDD, judged: RDD | None, fits: list[Fit], params: list, patience: int, bounds: list, width: int) -> None:
    """Grow all of ``fits`` to their ends, each in one task at a time."""
    held = state.context.broadcast(bounds)  # features x bins
    over_bins, active = [[] for _ in params], [i for i, p in enumerate(params) if p.n_estimators > 0]
    while active:
        for i, (pairs, precisions) in _whole_fits(state, judged, fits, over_bins, active, params, patience, held, width).items():
            f = fits[i]
            for k, value in enumerate(precisions, len(f.boosted.trees) + 1):
                if not f.best or value > dict(f.history)[f.best]:
                    f.best = k
                f.history.append((k, value))
            f.boosted.trees += [tree for tree, _ in pairs]
            over_bins[i] += [tree for _, tree in pairs]
        active = [i for i in active if len(fits[i].boosted.trees) < params[i].n_estimators
                  and (judged is None or len(fits[i].boosted.trees) < fits[i].best + patience)]
    if judged is None:
        for f in fits:
            f.best = len(f.boosted.trees)


def _one_round(state: RDD, active: list, params: list, turn: int, bounds: list, width: int, n: int) -> dict:
    """``{booster: [(tree, tree over bins)]}`` of one round."""
    growing = {i: _Growing(params[i], _columns(params[i], len(bounds), turn), turn, _small(len(bounds)), n) for i in active}
    while True:
        wants = {i: t.ask() for i, t in growing.items()}
        asked, small = ({i: (growing[i].partial(), nodes[kind], growing[i].columns, params[i].seed, turn, params[i].subsample)
                         for i, nodes in wants.items() if nodes[kind]} for kind in (0, 1))
        if not asked and not small:
            return {i: [t.finish(bounds)] for i, t in growing.items()}
        if asked:
            found = _pass(state, asked, width)
            for i in asked:
                growing[i].tell({node: h for (j, node), h in found.items() if j == i})
        if small:
            for (i, node), arrays in _finish_pass(state, small, params, width).items():
                growing[i].graft(node, *arrays)


def _columns(p: BoostParams, n: int, turn: int) -> np.ndarray:
    """The features that a round may split on."""
    take = max(1, int(p.colsample * n + 0.5))
    return np.sort(np.random.default_rng([p.seed, turn]).permutation(n)[:take])


def _advance(state: RDD, trees: dict, steps: int) -> RDD:
    def step(block):
        x, y, w, key, margins = block
        margins = margins.copy()
        for i, grown in trees.items():
            for tree in grown:
                margins[i] += _values_here(tree, x.T)
        return x, y, w, key, margins
    after = state.map(step).persist(StorageLevel.MEMORY_AND_DISK)
    if steps % CUT_ROUNDS == 0:
        after.checkpoint()
    return after


def _precision(y: np.ndarray, s: np.ndarray) -> float:
    """The average precision of the scores ``s``; rows of equal score count as one threshold, as in ``curves``."""
    if not y.any():
        return 0.0
    order = np.argsort(-s, kind="stable")
    ends = np.flatnonzero(np.append(s[order][1:] != s[order][:-1], True)[:len(s)])
    hits = np.cumsum(y[order])[ends]
    return float((np.diff(hits, prepend=0) / hits[-1] * (hits / (ends + 1))).sum())


def _precision_table(rows: DataFrame, n_rounds: int) -> DataFrame:
    """(at, average_precision): that of each of the ``n_rounds`` scores in ``steps``; for ``SMALL_ROWS`` rows at
    most, since a task ranks all rows for a few rounds. Rows of equal score count as one threshold, as in ``curves``."""
    def judge(table):
        import pyarrow as pa
        y = table["y_true"].to_numpy()
        known = ~np.isnan(y.astype(float))
        y = y[known] == 1
        steps = table["steps"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)[known]
        out = []
        out += [_precision(y, s) for s in steps.T]
        first = table["part"][0].as_py() * ROUNDS_A_TASK
        return pa.table({"at": pa.array(range(first, first + len(out)), pa.int32()), "average_precision": pa.array(out, pa.float64())})
    parts = F.array(*[F.slice("steps", k + 1, ROUNDS_A_TASK) for k in range(0, n_rounds, ROUNDS_A_TASK)])
    return rows.select("y_true", F.posexplode(parts).alias("part", "steps")).groupBy("part") \
               .applyInArrow(judge, "at int, average_precision double")


class _Judge:
    """Validation margins and the average precision of every round."""

    def __init__(self, val: DataFrame, fits: list[Fit], patience: int, label: str, features: str):
        self.fits, self.patience, self.done = fits, patience, [0] * len(fits)
        start = F.array(*[F.lit(f.boosted.base) for f in fits])
        self.rows = stored(val.select((F.col(label) == 1).cast("int").alias("y_true"), vector_to_array(features).alias("x"),
                                      start.alias("margins")), "val-margins")
        self.few = self.rows.count() <= SMALL_ROWS

    def still(self, active: list[int], turn: int) -> list[int]:
        """The boosters that go on after ``turn`` rounds."""
        behind = [i for i, f in enumerate(self.fits) if self.done[i] < len(f.boosted.trees) == turn]
        if any(turn >= self.fits[i].best + self.patience or i not in active for i in behind):
            self._advance(behind)  # one pass judges all: those not due yet learn their best sooner
        return [i for i in active if turn < self.fits[i].best + self.patience]

    def _advance(self, due: list[int]) -> None:
        fresh = {i: self.fits[i].boosted.trees[self.done[i]:] for i in due}
        held = self.rows.sparkSession.sparkContext.broadcast({i: pack(Boosted(ts, 0.0)) for i, ts in fresh.items()})

        def walk(batches):
            import pyarrow as pa
            models = {i: unpack(m).trees for i, m in held.value.items()}
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                margins = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy()
                steps = {i: margins[:, i:i + 1] + np.cumsum(np.stack([leaf_values(t, x) for t in ts], axis=1), axis=1)
                         for i, ts in models.items()}
                for i, s in steps.items():
                    margins[:, i] = s[:, -1]
                flat = np.concatenate(list(steps.values()), axis=1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                         for m in (margins, flat)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["y_true", "x", "margins", "steps"])

        rows = stored(self.rows.mapInArrow(walk, "y_true int, x array<double>, margins array<double>, steps array<double>"), "val-margins")
        rounds = [(i, self.done[i] + k + 1) for i, ts in fresh.items() for k in range(len(ts))]
        if self.few:
            ap = [(*rounds[r["at"]], r["average_precision"]) for r in _precision_table(rows, len(rounds)).collect()]
        else:
            keys = F.array(*[F.struct(F.lit(i).alias("booster"), F.lit(k).alias("n_trees")) for i, k in rounds])
            scores = rows.select("y_true", F.explode(F.arrays_zip(keys.alias("key"), F.col("steps").alias("y_proba"))).alias("s")) \
                         .select("y_true", "s.key.booster", "s.key.n_trees", "s.y_proba")
            by = ["booster", "n_trees"]
            ap = curves.ranking_summary(curves.curve_table(scores, by), by).select(*by, "average_precision").collect()
        for i, k, value in sorted(tuple(r) for r in ap):  # a row a booster and round
            f = self.fits[i]
            if not f.best or value > dict(f.history)[f.best]:
                f.best = k
            f.history.append((k, value))
        for i in due:
            self.done[i] = len(self.fits[i].boosted.trees)
        self.rows = rows.drop("steps")
