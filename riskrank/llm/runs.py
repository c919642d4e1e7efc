"""Periodic runs of words by suffix trees.

A run is a stretch of words with smallest period q that neither neighbour extends and that is
at least ``max(MIN_WORDS, MIN_EXPONENT * q)`` words long. For a stretch of words, Ukkonen's
suffix tree is built, and another one of the reversed stretch. An Euler tour of each tree
with range minima over blocks gives the longest common extension of any two positions, to
the right or to the left, in constant time. Each position starts its longest Lyndon word in
the word order and in the reversed order (the next smaller suffix, from the order of the
leaves); one of the two is a root of every run there. Roots are extended in both directions,
and those whose extension is long enough are the runs.

Trees are built only where a run can be. In a run of four periods or more, each 5-gram
occurs twice and each 3-gram three times, so words outside such grams cut a text into stretches
that no run crosses. Counting again inside the stretches, until nothing changes, leaves mostly
true runs. A tree holds about 300 bytes a word of its stretch, one stretch at a time.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, map_texts

MIN_WORDS, MIN_EXPONENT = 6, 4
#: (n, times): every n-gram inside a run of at least 4 periods and 6 words occurs so often in it.
GRAMS = ((5, 2), (3, 3))
BLOCK = 16
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _covered(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int, times: int):
    """The parts of the stretches that are covered by n-grams occurring ``times`` in their stretch."""
    at, part = _spread(starts, lengths), np.repeat(np.arange(len(starts), dtype=np.uint64), lengths)
    last = np.repeat(starts + lengths, lengths) - n
    whole = np.flatnonzero(at <= last)
    key = part[whole]
    for k in range(n):  # a collision only keeps words that need not be kept
        key = (key ^ words[at[whole] + k]) * _ODD
        key ^= key >> np.uint64(29)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hits = whole[counts[inverse] >= times]
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + n, -1)
    inside = np.cumsum(cover[:-1]) > 0
    first = inside & np.concatenate([[True], ~inside[:-1] | (part[1:] != part[:-1])])
    final = inside & np.concatenate([~inside[1:] | (part[1:] != part[:-1]), [True]])
    begin, end = np.flatnonzero(first), np.flatnonzero(final)
    keep = end - begin + 1 >= MIN_WORDS
    return at[begin[keep]], (end - begin + 1)[keep]


def stretches(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """``(starts, lengths)`` of the parts of the given texts (ranges of ``words``) that can hold
    runs; every run lies within one part."""
    words = words.astype(np.uint64)
    keep = lengths >= MIN_WORDS
    starts, lengths, left = starts[keep], lengths[keep], -1
    while len(starts) and left != lengths.sum():
        left = lengths.sum()
        for n, times in GRAMS:
            if len(starts):
                starts, lengths = _covered(words, starts, lengths, n, times)
    return starts, lengths


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (all above 0), with 0 as the end symbol.

    ``order`` and ``back`` are the places of the suffixes in the order of the symbols and in
    their reversed order (the end comes first in both); ``extension`` is the longest common
    extension of pairs of positions."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.n, base = len(symbols), max(s) + 1
        start, end, edges = self._ukkonen(s, base)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        del edges
        parent, symbol = keys // base, keys % base
        lengths = np.asarray(end) - np.asarray(start)
        self.order = self._tour(parent, np.where(symbol == 0, -1, symbol), child, lengths, True)
        self.back = self._tour(parent, np.where(symbol == 0, -base, -symbol), child, lengths, False)

    @staticmethod
    def _ukkonen(s: list[int], base: int):
        n = len(s)
        start, end, link, edges = [0], [0], [0], {}
        node = edge = length = todo = 0
        for i, c in enumerate(s):
            todo += 1
            fresh = 0
            while todo:
                if not length:
                    edge = i
                key = node * base + s[edge]
                to = edges.get(key)
                if to is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    begin, stop = start[to], end[to]
                    size = (stop if stop <= i else i + 1) - begin
                    if length >= size:
                        edge += size
                        length -= size
                        node = to
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(start)
                    start += (begin, i)
                    end += (begin + length, n)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * base + c] = split + 1
                    start[to] = begin + length
                    edges[split * base + s[begin + length]] = to
                    if fresh:
                        link[fresh] = split
                    fresh = split
                todo -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - todo + 1
        return start, end, edges

    def _tour(self, parent, symbol, child, lengths, euler: bool) -> np.ndarray:
        """Walk the tree, children by ``symbol``: the place of each suffix among the leaves. With
        ``euler``, also keep the depths along the tour and each leaf's place on it."""
        by = np.lexsort((symbol, parent))
        nodes = len(lengths)
        first = np.searchsorted(parent[by], np.arange(nodes + 1)).tolist()
        child, lengths = child[by].tolist(), lengths.tolist()
        total, leaves, depths, spots = self.n + 1, [], [], []
        stack, path = [0], [0]
        nexts = first[:-1]
        while stack:
            node, depth = stack[-1], path[-1]
            if euler:
                depths.append(depth)
            at = nexts[node]
            if at == first[node + 1]:
                if at == first[node]:
                    leaves.append(total - depth)
                    spots.append(len(depths) - 1)
                stack.pop()
                path.pop()
            else:
                nexts[node] = at + 1
                stack.append(child[at])
                path.append(depth + lengths[child[at]])
        place = np.empty(total, np.int64)
        place[leaves] = np.arange(total)
        if euler:
            self.spot = np.empty(total, np.int64)
            self.spot[leaves] = spots
            self._minima(np.array(depths, np.int32))
        return place[:self.n]

    def _minima(self, depths: np.ndarray) -> None:
        """Range minima in constant time: within blocks from both sides, and over blocks by
        doubling."""
        blocks = -(-len(depths) // BLOCK)
        grid = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        grid[:len(depths)] = depths
        grid = grid.reshape(blocks, BLOCK)
        self.grid = grid
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 ** len(self.table) <= blocks:
            last, step = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b`` (a != b): the
        depth of the leaves' lowest common ancestor."""
        x, y = self.spot[a], self.spot[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        out = np.minimum(self.behind[low], self.ahead[high])
        first, last = low // BLOCK + 1, high // BLOCK
        same = np.flatnonzero(first > last)
        if len(same):  # both on one block: at most BLOCK depths between them
            columns = np.arange(BLOCK)
            rows = self.grid[last[same]]
            held = (columns >= (low[same] % BLOCK)[:, None]) & (columns <= (high[same] % BLOCK)[:, None])
            out[same] = np.where(held, rows, np.iinfo(np.int32).max).min(axis=1)
        far = np.flatnonzero(first < last)
        level = np.frexp((last - first)[far].astype(float))[1] - 1
        for k in np.unique(level).tolist():
            pick = far[level == k]
            row = self.table[k]
            out[pick] = np.minimum(out[pick], np.minimum(row[first[pick]], row[last[pick] - 2 ** k]))
        return out.astype(np.int64)


def _next_smaller(place: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller (the length, if none): the end of the
    longest Lyndon word that starts there."""
    place = place.tolist()
    out, open_ = [len(place)] * len(place), []
    for i, p in enumerate(place):
        while open_ and place[open_[-1]] > p:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(words, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence of whole numbers, by start and period."""
    n = len(words)
    if n < min_words:
        return []
    symbols = (np.unique(words, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(symbols)
    ends = [_next_smaller(tree.order), _next_smaller(tree.back)]
    at = np.concatenate([np.arange(n)] * 2)
    period = np.concatenate(ends) - at
    pick = (at + period < n) & (period * min_exponent <= n)
    at, period = at[pick], period[pick]
    right = tree.extension(at, at + period)
    del tree
    pick = right >= period  # a run's first root is followed by another
    at, period, right = at[pick], period[pick], right[pick]
    left = np.zeros(len(at), np.int64)
    inner = at > 0
    if inner.any():
        mirror = SuffixTree(symbols[::-1])
        left[inner] = mirror.extension(n - at[inner], n - at[inner] - period[inner])
    length = left + period + right
    pick = length >= np.maximum(min_words, min_exponent * period)
    found = np.unique(np.stack([(at - left)[pick], period[pick], length[pick]], axis=1), axis=0)
    return [(int(s), int(size), int(p)) for s, p, size in found]


def _row(doc_id, words: list, runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """One row a document: ``SCHEMA``'s number of runs, the run with the largest exponent (ties:
    the smallest start, then period), digests of all runs and of the text without the words
    after each run's first period.

    ``rewrite(doc_id, words) -> words`` may change the words (bytes) first. Null and empty
    texts have no words and no run; rows with null or repeated ids are each their own
    document; other columns are not read."""
    def find(batch):
        ids = batch.column(0).to_pylist()
        texts = [t.split() if t else [] for t in byte_texts(batch.column(1))]
        if rewrite is not None:
            texts = [rewrite(i, t) for i, t in zip(ids, texts)]
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        names = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        words = np.fromiter((names[w] for t in texts for w in t), np.int64, int(lengths.sum()))
        runs = [[] for _ in texts]
        for start, length in zip(*(x.tolist() for x in stretches(words, starts, lengths))):
            doc = int(np.searchsorted(starts + lengths, start, side="right"))
            shift = start - int(starts[doc])
            runs[doc] += [(s + shift, size, p) for s, size, p in runs_of(words[start:start + length])]
        rows = [_row(i, t, sorted(r, key=lambda x: (x[0], x[2]))) for i, t, r in zip(ids, texts, runs)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, find, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
