"""Ranked lexical search over a length-stratified index.

A document of n terms has the normaliser ``m = 50 + (50 * n * N) div L`` (N documents hold
terms, L of them in all). Documents of equal m form a stratum. The index holds blocks of a
stratum's documents: for each term, its postings by tf. Within a stratum a posting's impact
depends on tf alone, so impacts are computed once per tf and weighed once per term.

A block's largest tf of each term bounds the score of any document in it. A search task
reads its blocks in groups, orders each group by its largest bound and leaves out, for each item, the
blocks whose bound is below the item's lowest kept score. Bounds hold with certainty, so
results are exact. Tasks return at most ``k`` documents an item.

The index holds postings of the items' terms only; counts, lengths and document frequencies
cover all documents. Items are searched in sets of at most ``SET_BYTES`` of text, whatever
their number; a set's terms are broadcast. Arithmetic is in whole numbers of 64 bits.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, map_texts, written

TOP = 50
#: Items are searched in sets of about so many bytes of text.
SET_BYTES = 8 << 20
#: Documents and postings of a block, and blocks whose bounds are ordered together.
BLOCK_DOCS, BLOCK_POSTINGS, GROUP = 1024, 1 << 18, 64
#: Terms: ASCII letters (lower-cased), digits and all other characters beyond ASCII.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "m long, docs array<long>, terms binary, tfs binary, at binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def count_terms(docs: DataFrame, numbers: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs``: the number of all terms of each document, and how often it
    holds each term of ``numbers`` (term -> number)."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batch):
        get = held.value.get
        n, ends, terms, tfs = [], [0], [], []
        for text in byte_texts(batch.column(1)):
            words = terms_of(text)
            n.append(len(words))
            hits = np.array([i for i in map(get, words) if i is not None], np.int32)
            found, times = np.unique(hits, return_counts=True)
            terms.append(found)
            tfs.append(times.astype(np.int32))
            ends.append(ends[-1] + len(found))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for x in (terms, tfs)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, count, "doc_id long, n long, terms array<int>, tfs array<int>")


def build_index(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The blocks of all strata (``INDEX``), written; documents without an indexed term are in none.

    Rows are dealt by (m, row number), so a stratum with most documents is spread as well."""
    m = F.expr(f"50L + (50L * n * {n_docs}L) div {n_terms}L")
    rows = counts.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs",
                                                    F.monotonically_increasing_id().alias("spot"))
    rows = rows.repartitionByRange("m", "spot").sortWithinPartitions("m", "spot").select("m", "doc_id", "terms", "tfs")

    def blocks(batches):
        for batch in batches:
            ms, ids = batch.column(0).to_numpy(), batch.column(1)
            ends = batch.column(2).offsets.to_numpy()
            terms, tfs = (batch.column(c).values.to_numpy() for c in (2, 3))
            start, out = 0, []
            while start < len(ms):
                stop = min(int(np.searchsorted(ms, ms[start], side="right")), start + BLOCK_DOCS)
                stop = max(start + 1, min(stop, int(np.searchsorted(ends, ends[start] + BLOCK_POSTINGS, side="right")) - 1))
                at = np.repeat(np.arange(stop - start, dtype=np.int32), np.diff(ends[start:stop + 1]))
                t, f = terms[ends[start]:ends[stop]], tfs[ends[start]:ends[stop]]
                by = np.lexsort((at, f, t))
                out.append((int(ms[start]), ids.slice(start, stop - start).to_pylist(), *(x[by].astype("<i4").tobytes() for x in (t, f, at))))
                start = stop
            if out:
                types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=[c.split()[0] for c in INDEX.split(", ")])
    return written(rows.mapInArrow(blocks, INDEX), "strata")


class Block:
    """One block of a stratum, ready for scoring; postings are ordered by term, then tf."""

    def __init__(self, m: int, docs: list, terms: bytes, tfs: bytes, at: bytes, weights: np.ndarray):
        terms, tfs, self.at = (np.frombuffer(x, "<i4") for x in (terms, tfs, at))
        self.ids = np.array([0 if d is None else d for d in docs], np.int64)
        self.null = np.array([d is None for d in docs], bool)
        levels, which = np.unique(tfs, return_inverse=True)
        levels = levels.astype(np.int64)
        impacts = 1_000_000_000 * levels // (1000 * levels + 20 * m)  # once per tf
        self.parts = weights[terms] * impacts[which]
        self.terms, first = np.unique(terms, return_index=True)
        self.ends = np.append(first, len(terms))
        self.most = self.parts[self.ends[1:] - 1]  # of a term's postings the last has the largest tf

    def places(self, n_terms: int) -> np.ndarray:
        """For each term its number in the block; -1 if absent."""
        out = np.full(n_terms, -1, np.int64)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def bounds(self, items: Items) -> np.ndarray:
        """For each item the largest score that a document here can have."""
        most = np.zeros(items.n_terms, np.int64)
        most[self.terms] = self.most
        return np.add.reduceat(np.append(most[items.terms], 0), items.starts[:-1]) * (np.diff(items.starts) > 0)

    def scores(self, places: np.ndarray) -> np.ndarray:
        """Scores of all documents here for an item with the terms at ``places``."""
        out = np.zeros(len(self.ids), np.int64)
        for p in places.tolist():  # a document is in a term's postings once
            s, e = self.ends[p], self.ends[p + 1]
            out[self.at[s:e]] += self.parts[s:e]
        return out


class Items:
    """The terms of a set of items, as ranges of one array."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, n_terms: int):
        self.starts, self.terms, self.n_terms = starts, terms, n_terms


def item_terms(texts: list, numbers: dict) -> tuple:
    """The arguments of ``Items``; broadcast as plain arrays."""
    own = [sorted({numbers[t] for t in terms_of(x)}) for x in texts]
    return np.cumsum([0, *map(len, own)]), np.array([t for o in own for t in o], np.int64), len(numbers)


class Best:
    """The ``k`` best documents of an item so far: highest score, then smallest id (null last)."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document with a lower score than this can't enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        pick = np.flatnonzero(score >= self.least)
        if len(pick) > self.k:
            pick = pick[score[pick] >= np.partition(score[pick], -self.k)[-self.k]]
        if len(pick):
            score, ids, null = (np.concatenate([a, b[pick]]) for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
            by = np.lexsort((ids, null, -score))[:self.k]
            self.score, self.ids, self.null = score[by], ids[by], null[by]


def visit(blocks: list[Block], items: Items, best: list[Best]) -> int:
    """Score the blocks in order of their bounds; returns how many (block, item) pairs were scored."""
    bounds, scored = [b.bounds(items) for b in blocks], 0
    for i in sorted(range(len(blocks)), key=lambda i: -int(bounds[i].max())):
        block, bound = blocks[i], bounds[i]
        places = block.places(items.n_terms)
        for item in np.flatnonzero(bound > 0).tolist():
            if bound[item] < best[item].least:
                continue
            own = places[items.terms[items.starts[item]:items.starts[item + 1]]]
            best[item].add(block.scores(own[own >= 0]), block.ids, block.null)
            scored += 1
    return scored


def _search_set(docs: DataFrame, items: list, k: int, columns: dict) -> DataFrame | None:
    """The ``k`` best documents of each item of a bounded set of (id, text) rows."""
    numbers = {t: i for i, t in enumerate(sorted({t for _, text in items for t in terms_of(text)}))}
    counts = written(count_terms(docs, numbers, **columns), "term-counts")
    n_docs, n_terms = counts.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not numbers:
        return None
    df = np.zeros(len(numbers), np.int64)  # a row a term of the set
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r["t"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    index = build_index(counts, n_docs, n_terms)
    held = docs.sparkSession.sparkContext.broadcast((weights, item_terms([text for _, text in items], numbers)))

    def search(batches):
        weights, items = held.value[0], Items(*held.value[1])
        best, group = [Best(k) for _ in items.starts[1:]], []
        for batch in batches:
            for i in range(batch.num_rows):
                group.append(Block(*(c[i].as_py() for c in batch.columns), weights))
                if len(group) == GROUP:
                    visit(group, items, best)
                    group = []
        visit(group, items, best)
        for i, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i, np.int32)), pa.array(b.ids, mask=b.null),
                                                  pa.array(b.score)], names=["item", "doc_id", "score"])

    found = index.mapInArrow(search, "item int, doc_id long, score long")
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, item_id: str = "item_id", item_text: str = "text",
           **columns) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents with the highest
    scores above 0 (all, if fewer), equal scores by ascending doc_id.

    Items are the distinct rows of (id, text); two texts under one id are two items. Null and empty
    texts, and items without a term, give no row. Documents with a null id rank behind those of
    equal score; rows that share an id are each a document. Empty tables give an empty result.
    Other columns are not read. Of equal documents under one id any comes first (the rows are alike)."""
    spark = docs.sparkSession
    items = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")) \
                   .where("text IS NOT NULL").distinct()
    items = written(items, "items")
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    sets = -(-total // SET_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(sets, 1)))
    found = []
    for s in range(sets):
        rows = [(r["item_id"], r["text"].encode()) for r in items.where(part == s).collect()]  # SET_BYTES
        out = _search_set(docs, rows, k, columns) if rows else None
        if out is not None:
            found.append(out)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
