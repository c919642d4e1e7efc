"""TF-IDF in long form: ``(id, term, tf)`` -> vocabulary -> ``(id, term_id, weight)``.

Semantics of the reference's vectoriser: lower-case, strip accents, tokens of two
or more word characters, English stop words removed *before* n-grams, uni+bigrams,
document frequency in [min_df, max_df * n_docs], then the ``max_features`` terms
with the largest total count (ties by term); term ids in alphabetical order;
sublinear tf ``1 + ln(tf)``; smoothed idf ``ln((1 + n) / (1 + df)) + 1``; L2 row norm.

Plan: terms are counted where the document lies, in Arrow batches, and no text moves. A task numbers the words it
meets; an n-gram is a 64-bit code of word numbers, sorted and counted as such, and is spelled out once a task's counts go on. Fitting sends
one row per (batch, term) to the only shuffle, the per-term totals. Applying looks the terms up in
the vocabulary, which travels with the tasks when it has ``BROADCAST_TERMS`` terms at most (its size is
checked), and normalises each document in place; a larger vocabulary is joined by term instead,
with the same result. The vocabulary is written to the shared folder: later transforms never re-run the fit.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored
from .running import running_totals

#: Terms are ordered by their first so many characters, then within them.
PREFIX = 3
#: Vocabularies of so many terms at most travel with the tasks.
BROADCAST_TERMS = 200_000
#: A task sends its counts on when it holds so many.
FLUSH = 100_000
#: So many counts of (document, term) are summed at once, in 16 bytes each.
HELD_COUNTS = 1_000_000
#: A task forgets the words it has numbered when they are so many.
HELD_WORDS = 200_000
TOKEN = re.compile(r"\w{2,}")
STOP, UNKNOWN = -2, -1
_RES = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources")


def english_stop_words() -> list[str]:
    with open(os.path.join(_RES, "english_stop_words.txt"), encoding="utf-8") as fh:
        return [w for line in fh if not line.startswith("#") for w in line.split()]


@dataclass
class TfidfParams:
    max_features: int | None = 50000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 3
    max_df: float = 0.9
    sublinear_tf: bool = True
    strip_accents: bool = True
    lowercase: bool = True
    stop_words: tuple[str, ...] | None = None  # None -> the English list

    def words(self):
        return english_stop_words() if self.stop_words is None else list(self.stop_words)


def _tokens(params: TfidfParams):
    """``text -> list`` of the words, stop words included, of an already lower-cased text (None: none).
    Python's ``\\w`` is the word class of ``functions.text``."""
    accents = params.strip_accents

    def tokens(text):
        if text is None:
            return []
        if accents and not text.isascii():
            text = unicodedata.normalize("NFKD", text)
            for c in set(text):
                if unicodedata.combining(c):
                    text = text.replace(c, "")
        return TOKEN.findall(text)
    return tokens


def _terms(params: TfidfParams):
    """``text -> list`` of the n-grams, with repeats, of an already lower-cased text (None: no terms)."""
    stop, (low, high), split = frozenset(params.words()), params.ngram_range, _tokens(params)

    def terms(text):
        tokens = [t for t in split(text) if t not in stop]
        out = tokens if low <= 1 <= high else []
        return out + [a + " " + b for a, b in zip(tokens, tokens[1:])] if low <= 2 <= high else out
    return terms


def _codes(numbers: np.ndarray, ngram_range: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ascending, and how often each occurs) of the n-grams of a text's word numbers: stop words go first, and no
    n-gram has an unknown word. A code is the first word's number, then that of the second and one (0: no second)."""
    low, high = ngram_range
    own = numbers[numbers != STOP]
    parts = [own[own >= 0] << 32] if low <= 1 <= high else []
    if low <= 2 <= high and len(own) > 1:
        first, second = own[:-1], own[1:]
        both = (first >= 0) & (second >= 0)
        parts.append((first[both] << 32) + second[both] + 1)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    codes.sort()
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
    return codes[starts], np.diff(np.append(starts, len(codes)))


class _Words(dict):
    """Numbers words as they come; stop words are ``STOP``."""

    def __init__(self, stop):
        super().__init__(zip(stop, repeat(STOP)))
        self.stop, self.met = stop, []

    def __missing__(self, word):
        self[word] = n = len(self.met)
        self.met.append(word)
        return n

    def forget(self):
        self.clear()
        self.__init__(self.stop)

    def spell(self, codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The terms of some codes, and the order in which they come."""
        met, second = pa.array(self.met, pa.string()), (codes & 0xFFFFFFFF) - 1
        one, two = np.flatnonzero(second < 0), np.flatnonzero(second >= 0)
        word = lambda n: met.take(pa.array(n))
        return pa.concat_arrays([word(codes[one] >> 32), pc.binary_join_element_wise(word(codes[two] >> 32), word(second[two]), " ")]), \
            np.append(one, two)


def _counter(params: TfidfParams):
    """``text -> Counter`` of its n-grams."""
    terms = _terms(params)
    return lambda text: Counter(terms(text))


def _texts(docs: DataFrame, text_col: str, params: TfidfParams, *keys) -> DataFrame:
    text = F.col(text_col)
    return docs.select(*keys, (F.lower(text) if params.lowercase else text).alias("_text"))


def doc_terms(docs: DataFrame, id_col: str, text_col: str, params: TfidfParams) -> DataFrame:
    """(id, term, tf) with one row per distinct term of a document (a row of ``docs``)."""
    count, kind = _counter(params), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, terms, tfs = [], [], []
            for i, text in enumerate(batch.column(1)):
                found = count(text.as_py())
                ids += [i] * len(found)
                terms += found.keys()
                tfs += found.values()
                if len(terms) >= FLUSH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(terms, pa.string()),
                                                      pa.array(tfs, pa.int64())], names=["id", "term", "tf"])
                    ids, terms, tfs = [], [], []
    return _texts(docs, text_col, params, F.col(id_col).alias("id")).mapInArrow(run, f"id {kind}, term string, tf long")


def partial_stats(docs: DataFrame, text_col: str, params: TfidfParams, class_col: str | None = None) -> DataFrame:
    """(cls, term, df, total) of parts of the rows, to be summed per (cls, term)."""
    split, stop, ngrams = _tokens(params), params.words(), tuple(params.ngram_range)
    cls = F.col(class_col) if class_col else F.lit(0)
    rows = _texts(docs, text_col, params, cls.alias("cls"))
    kind = rows.schema["cls"].dataType.simpleString()

    def run(batches):
        words, held, types, size = _Words(stop), {}, None, 0  # held: codes and counts of each document, a class

        def flush():
            for c, parts in held.items():
                codes, counts = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(codes)
                codes, counts = codes[order], counts[order]
                starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
                terms, at = words.spell(codes[starts])
                df, total = np.diff(np.append(starts, len(codes)))[at], np.add.reduceat(counts, starts)[at] if len(starts) else counts
                for k in range(0, len(terms), FLUSH):
                    n = min(FLUSH, len(terms) - k)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * n, types), terms.slice(k, n), pa.array(df[k:k + n]), pa.array(total[k:k + n])],
                                                     names=["cls", "term", "df", "total"])
            held.clear()
            if len(words) > HELD_WORDS:
                words.forget()
        for batch in batches:
            types = batch.schema.types[0]
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = split(text.as_py())
                codes, counts = _codes(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)), ngrams)
                if len(codes):
                    held.setdefault(c, []).append((codes, counts))
                    size += len(codes)
                if size >= HELD_COUNTS:
                    yield from flush()
                    size = 0
        yield from flush()
    return rows.mapInArrow(run, f"cls {kind}, term string, df long, total long")


def term_stats(docs: DataFrame, text_col: str, params: TfidfParams) -> DataFrame:
    """(term, df, total) over all documents. The tasks' counts are dealt by term as they are: most terms of a task are
    its own, so that a hash table of them in front of the exchange takes memory and saves few rows."""
    return partial_stats(docs, text_col, params).repartition("term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _before(rows: DataFrame, key: str) -> DataFrame:
    """(key, _before, _n): rows of smaller keys and of the key itself. One row a key is ordered."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return n.select(key, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"), "_n")


def most_frequent(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms with the largest total (ties by term), without merging every task's
    best in one task: the total at which the cut falls is found from counts per total, and of
    the terms with just that total only those with the cut's first characters are ranked."""
    stats = stored(stats, "term-stats")
    per_total = stats.groupBy("total").agg(F.count(F.lit(1)).alias("_n"))
    cut = running_totals(per_total, "total", ["_n"], descending=True).where(F.col("cum__n") >= n) \
        .orderBy(F.desc("total")).select("total", (n - F.col("cum__n") + F.col("_n")).alias("take")).first()
    if cut is None:
        return stats
    ties = stats.where(F.col("total") == cut["total"]).withColumn("_p", F.substring("term", 1, PREFIX))
    left = F.lit(cut["take"]) - F.col("_before")
    spans = _before(ties, "_p").where(left > 0)
    whole = ties.join(spans.where(F.col("_n") <= left).select("_p"), "_p", "left_semi")
    edge = ties.join(spans.where(F.col("_n") > left).select("_p", left.alias("_left")), "_p")  # one prefix
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("term"))
    edge = edge.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    chosen = whole.select(*stats.columns).unionByName(edge.select(*stats.columns))
    return stats.where(F.col("total") > cut["total"]).unionByName(chosen)


def select_vocabulary(stats: DataFrame, n_docs: int, params: TfidfParams) -> DataFrame:
    """Frequency window, top ``max_features`` by total count, alphabetical ids, idf."""
    max_count = params.max_df if isinstance(params.max_df, int) else params.max_df * n_docs
    kept = stats.where((F.col("df") >= params.min_df) & (F.col("df") <= F.lit(float(max_count))))
    if params.max_features is not None:
        kept = most_frequent(kept, params.max_features)
    # ids in the order of the terms: those with equal first characters are ranked together,
    # after as many as come before them
    first = F.substring("term", 1, PREFIX).alias("_p")
    kept = kept.select("*", first)
    before = _before(kept, "_p").withColumnRenamed("_before", "_offset")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("term"))
    return kept.join(before, "_p").select(
        "term", (rank + F.col("_offset") - 1).cast("int").alias("term_id"), "df", "total",
        (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


@dataclass
class TfidfModel:
    vocabulary: DataFrame  # term, term_id, df, total, idf
    n_docs: int
    params: TfidfParams
    vocab_size: int

    def weights_from_terms(self, terms: DataFrame) -> DataFrame:
        """(id, term_id, weight): sublinear tf * idf, L2-normalised per id; terms are joined by term."""
        j = terms.join(self.vocabulary.select("term", "term_id", "idf"), "term")
        tf = (1.0 + F.log(F.col("tf"))) if self.params.sublinear_tf else F.col("tf").cast("double")
        w = j.select("id", "term_id", (tf * F.col("idf")).alias("_w"))
        per_doc = Window.partitionBy("id")  # a document's own terms
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(per_doc))
        return w.select("id", "term_id", (F.col("_w") / norm).alias("weight"))

    def transform(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, term_id, weight); a document without a vocabulary term has no row."""
        if self.vocab_size > BROADCAST_TERMS:
            return self.weights_from_terms(doc_terms(docs, id_col, text_col, self.params))
        rows = self.transform_rows(docs, id_col, text_col)
        return rows.select("id", F.explode(F.arrays_zip("_i", "_v")).alias("w")) \
                   .select("id", F.col("w._i").alias("term_id"), F.col("w._v").alias("weight"))

    def transform_rows(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, _i, _v): a row a document with its term ids, ascending, and their weights."""
        if self.vocab_size > BROADCAST_TERMS:
            long = self.weights_from_terms(doc_terms(docs, id_col, text_col, self.params))
            own = long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("w"))
            found = own.select("id", F.col("w.term_id").alias("_i"), F.col("w.weight").alias("_v"))
            return docs.select(F.col(id_col).alias("id")).join(found, "id", "left").select(
                "id", F.coalesce("_i", F.array().cast("array<int>")).alias("_i"), F.coalesce("_v", F.array().cast("array<double>")).alias("_v"))
        table = self.vocabulary.select("term", "term_id", "idf").toArrow()  # BROADCAST_TERMS rows at most
        numbers, pairs = _Words(()), [t.split(" ") for t in table["term"].to_pylist()]
        codes = np.array([(numbers[t[0]] << 32) + (numbers[t[1]] + 1 if len(t) > 1 else 0) for t in pairs], np.int64)
        weights = np.zeros(table.num_rows)
        weights[table["term_id"].to_numpy()] = table["idf"].to_numpy()
        order = np.argsort(codes)
        held = docs.sparkSession.sparkContext.broadcast(
            (dict(numbers) | dict.fromkeys(self.params.words(), STOP), codes[order], table["term_id"].to_numpy()[order].astype(np.int64), weights))
        split, ngrams, sublinear, kind = _tokens(self.params), tuple(self.params.ngram_range), self.params.sublinear_tf, \
            docs.schema[id_col].dataType.simpleString()

        def run(batches):
            numbers, codes, ids, weights = held.value
            for batch in batches:
                start, index, value, ends = 0, [], [], [0]
                for i, text in enumerate(batch.column(1)):
                    tokens = split(text.as_py())
                    own, tf = _codes(np.fromiter(map(numbers.get, tokens, repeat(UNKNOWN)), np.int64, len(tokens)), ngrams)
                    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                    terms, tf = ids[at[known]], tf[known]
                    by_id = np.argsort(terms)
                    terms, tf = terms[by_id], tf[by_id]
                    w = (1.0 + np.log(tf) if sublinear else tf.astype(float)) * weights[terms]
                    index.append(terms.astype(np.int32))
                    value.append(w / np.sqrt((w * w).sum()) if len(w) else w)
                    ends.append(ends[-1] + len(w))
                    if ends[-1] >= FLUSH or i == batch.num_rows - 1:
                        offsets = pa.array(ends, pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(start, i + 1 - start), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(index))),
                             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(value)))], names=["id", "_i", "_v"])
                        start, index, value, ends = i + 1, [], [], [0]
        return _texts(docs, text_col, self.params, F.col(id_col).alias("id")) \
            .mapInArrow(run, f"id {kind}, _i array<int>, _v array<double>")


def fit(docs: DataFrame, id_col: str, text_col: str, params: TfidfParams | None = None) -> TfidfModel:
    params = params or TfidfParams()
    n_docs = docs.count()
    vocab = select_vocabulary(term_stats(docs, text_col, params), n_docs, params)
    vocab = stored(vocab, "vocabulary")  # fitted artifact: later transforms never re-run the fit
    size = vocab.count()
    return TfidfModel(vocab, n_docs, params, size)


def top_ngrams(docs: DataFrame, text_col: str, class_col: str, n: int = 15, ngram=(2, 2),
               min_df: int = 3, stop_words=None) -> DataFrame:
    """Per class: the n most frequent n-grams (lower-cased, stop words out, document
    frequency >= ``min_df`` within the class), ties by term. The per-class top-n
    uses ``row_number() <= n``, which Spark limits per task before the shuffle."""
    params = TfidfParams(ngram_range=ngram, strip_accents=False, stop_words=stop_words)
    stats = partial_stats(docs, text_col, params, class_col).repartition("cls", "term").groupBy(F.col("cls").alias("_cls"), "term") \
        .agg(F.sum("total").alias("count"), F.sum("df").alias("df"))
    rank = Window.partitionBy("_cls").orderBy(F.desc("count"), F.asc("term"))
    top = stats.where(F.col("df") >= min_df).withColumn("rank", F.row_number().over(rank)) \
               .where(F.col("rank") <= n)
    return top.select(F.col("_cls").alias(class_col), "rank", "term", "count")


# word-frequency tokens: a word character followed by word characters or apostrophes
WORD_FREQ_TOKEN = f"[{tx.WORD}][{tx.WORD}']*"


def word_frequencies(docs: DataFrame, text_col: str, class_col: str, top: int = 200,
                     stop_words=None) -> DataFrame:
    """Word counts per class for a word cloud: lower-cased words, trailing "'s"
    removed, pure numbers and stop words dropped; the ``top`` most frequent per class."""
    words = english_stop_words() if stop_words is None else list(stop_words)
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))),
                                F.lit(WORD_FREQ_TOKEN), F.lit(0))
    toks = F.transform(toks, lambda w: F.regexp_replace(w, "'s$", ""))
    toks = F.filter(toks, lambda w: ~w.rlike(f"^{tx.DIGIT}+$") & (F.length(w) > 0) & ~w.isin(words))
    ex = docs.select(F.col(class_col).alias("_cls"), F.explode(toks).alias("word"))
    counts = ex.groupBy("_cls", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("_cls").orderBy(F.desc("n"), F.asc("word"))
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top) \
                 .select(F.col("_cls").alias(class_col), "rank", "word", "n")
