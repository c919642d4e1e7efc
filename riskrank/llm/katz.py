"""Language-model scoring: Katz backoff over n-gram tables partitioned by context.

Tokens are a text's words and one end. Training counts of every order are Good-Turing
discounted up to ``MAX_DISCOUNTED`` (Katz 1987); the freed mass of a context goes to its
unseen successors in proportion to the next lower order, with a backoff weight that makes
the context's probabilities sum to one exactly. Words not seen in training are one class,
with the freed mass of the unigrams.

The n-gram tables are never in one place, and the rows that move are n-grams that differ
within a block of documents, not tokens:

1. Texts are tokenised once into *blocks* (about ``BLOCK_TOKENS`` tokens, words numbered
   within the block), a table bucketed by block.
2. For each order, a block sends each distinct n-gram once, with its training count and its
   probability at the next lower order, to the partition of the n-gram's context. The
   partition adds up counts over all blocks, and per context the number of successors seen
   1 .. ``MAX_DISCOUNTED`` times and the lower-order mass of all seen ones. It answers with
   those numbers for the n-grams that the block asked for. (A context's total is its count
   as an n-gram of the order below, which the block has by then.)
   Successor numbers and mass are answered only for contexts that may back off in the block
   (one of its n-grams is not in the block's training texts) or have no successor seen once.
3. Blocks join the answers and evaluate each token recursively: discounted count, or backoff
   weight times the lower order.

A context with more than a partition's usual share of the tokens (there can be no more of
them than partitions) is spread over all partitions by n-gram; its partial sums are added
up, and this list, one row a hot context, is shipped to the blocks.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - binds pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, shared_path, sliced, written

ORDER = 2
MAX_DISCOUNTED = 5
BLOCK_TOKENS = 2_000_000
#: Tokens for each partition of the n-gram tables.
PART_TOKENS = 1_500_000
END = b"\n"  # no word
START = np.uint64(0x5851F42D4C957F2D)
NO_LONG, NO_INT, NO_SHORT = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16)

BLOCK = ("block long, n_tokens long, docs array<long>, sizes array<int>, train array<boolean>, vocab array<long>, "
         "ids array<int>")
ASK = ("part long, block long, keys array<long>, counts array<short>, cwide array<int>, ctxs array<long>, runs array<int>, n_cold long, "
       "needs array<boolean>, pvals array<double>, pcodes array<short>, pwide array<int>")
REPLY = ("kind string, block long, part long, keys array<long>, counts array<short>, cwide array<int>, has array<boolean>, "
         "seen array<int>, mass array<double>")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Discounts:
    """Good-Turing factors from counts of counts ``n[r - 1]``, r = 1 .. MAX_DISCOUNTED + 1.

    The largest cut-off whose factors all lie in (0, 1] is used. When the counts of counts
    allow none, all counts are scaled by one factor that frees max(n_1, 1) of total + 1."""

    def __init__(self, n: list[int], total: int):
        self.low, self.rest = np.ones(MAX_DISCOUNTED + 1), 1.0
        for k in range(MAX_DISCOUNTED, 0, -1):
            if min(n[:k + 1]) <= 0:
                continue
            a = (k + 1) * n[k] / n[0]
            if a >= 1:
                continue
            d = [((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d) and d[0] < 1:
                self.low[1:k + 1] = d
                return
        self.rest = 1 - max(n[0], 1) / (total + 1) if total else 1.0
        self.rest = self.rest if self.rest > 0 else 1 / (total + 1)
        self.low[:] = self.rest

    def factor(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= MAX_DISCOUNTED, self.low[np.minimum(c, MAX_DISCOUNTED)], self.rest)

    def kept(self, total: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Discounted count of contexts: ``seen[:, r - 1]`` successors were seen r times."""
        r = np.arange(1, MAX_DISCOUNTED + 1)
        return seen @ (self.low[1:] * r) + self.rest * (total - seen @ r)


class Model:
    """What is known after each order: unigram totals, discounts, hot contexts."""

    def __init__(self, parts: int, docs: int):
        self.parts, self.docs = parts, docs  # training documents: how often a text starts
        self.tokens = self.words = 0
        self.unigram_total, self.seen_mass = 1, 0.0
        self.discounts: list[Discounts] = []
        self.hot: list[tuple] = []

    def spread_over(self) -> float:
        """A context that is more frequent than this is spread over all partitions."""
        return max(1000.0, self.tokens / self.parts)


def _arrays(columns: dict) -> list[pa.Array]:
    return [pa.array([v]) if not isinstance(v, np.ndarray) else
            pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in columns.values()]


def _fitted(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as shorts when all fit, else as ints; the other array is empty."""
    wide = len(v) and v.max() >= 1 << 15
    return (NO_SHORT, v.astype(np.int32)) if wide else (v.astype(np.int16), NO_INT)


def _either(table: pa.Table, narrow: str, wide: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``_fitted`` split, and how many each row has."""
    a, b = (table[c].combine_chunks() for c in (narrow, wide))
    n, m = (np.asarray(pa.compute.list_value_length(x)).astype(np.int64) for x in (a, b))
    out, short = np.empty(int((n + m).sum()), np.int64), np.repeat(n > 0, n + m)
    out[short], out[~short] = np.asarray(a.flatten()), np.asarray(b.flatten())
    return out, n + m


def _row(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_arrays(columns), names=list(columns))


class Block:
    """The tokens of a block, and what the tables answered about their n-grams."""

    def __init__(self, row: pa.Table, model: Model):
        one = lambda name: np.asarray(row[name].combine_chunks().flatten())
        self.model, self.number = model, row["block"][0].as_py()
        self.vocab, self.ids = one("vocab").view("u8"), one("ids")
        self.sizes, self.train = one("sizes"), np.asarray(row["train"].combine_chunks().flatten())
        self.docs = row["docs"].combine_chunks().flatten()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.learns = np.repeat(self.train, self.sizes)
        self.gram, self.keys, self.level = self.ids, self.vocab, 1
        self.local = np.bincount(self.gram[self.learns], minlength=len(self.keys))

    def _next_level(self):
        """Number the n-grams of the next order: context (an n-gram of this order) and word."""
        code = np.empty(len(self.ids), np.int64)
        code[1:] = self.gram[:-1]
        code[self.starts] = -1
        code += 1
        code *= len(self.vocab)
        code += self.ids
        code, first, gram = np.unique(code, return_index=True, return_inverse=True)
        self.lower = self.p[self.gram[first]]
        self.gram = gram.astype(np.int32)
        del gram
        ctx = code // len(self.vocab) - 1
        word = self.vocab[code % len(self.vocab)]
        self.ctx = np.where(ctx >= 0, self.keys[ctx], START)
        often = np.where(ctx >= 0, self.counts[ctx], self.model.docs)  # a token follows every context
        self.keys = _mix(self.ctx * np.uint64(0x2545F4914F6CDD1D) ^ word)
        self.level += 1
        hot = often > self.model.spread_over()
        part = (_mix(np.where(hot, self.keys, self.ctx)) % np.uint64(self.model.parts)).astype(np.int64)
        self.order = np.lexsort((self.ctx, hot, part))
        self.local = np.bincount(self.gram[self.learns], minlength=len(self.keys))
        self.part, self.hot, self.often = part[self.order], hot[self.order], often[self.order]
        ctx = self.ctx[self.order]
        new = np.ones(len(ctx), bool)  # where the context runs start
        new[1:] = (ctx[1:] != ctx[:-1]) | (self.part[1:] != self.part[:-1])
        self.run_starts = np.flatnonzero(new)
        self.needs = np.maximum.reduceat(self.local[self.order] == 0, self.run_starts)

    def _level_one(self):
        part = (_mix(self.keys) % np.uint64(self.model.parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order]

    def asks(self, order: int):
        """Messages to the partitions of the tables of ``order``; lower orders are absorbed."""
        if order == 1:
            self._level_one()
        else:
            self._next_level()
        for part in np.unique(self.part).tolist():
            a, b = np.searchsorted(self.part, [part, part + 1])
            at = self.order[a:b]
            counts = _fitted(self.local[at])
            row = {"part": part, "block": self.number, "keys": self.keys[at].view("i8"), "counts": counts[0], "cwide": counts[1]}
            if order == 1:
                row |= {"ctxs": NO_LONG, "runs": NO_INT, "n_cold": 0, "needs": np.zeros(0, bool), "pvals": np.zeros(0),
                        "pcodes": NO_SHORT, "pwide": NO_INT}
            else:
                runs = slice(*np.searchsorted(self.run_starts, [a, b]))
                r = self.run_starts[runs]
                learnt = self.local[at] > 0  # another block has an n-gram's mass if this one does not
                values, codes = np.unique(self.lower[at][learnt], return_inverse=True)
                codes = _fitted(codes)
                row |= {"ctxs": self.ctx[self.order[r]].view("i8"), "runs": np.diff(np.append(r, b)).astype(np.int32),
                        "n_cold": int((~self.hot[r]).sum()), "needs": self.needs[runs], "pvals": values,
                        "pcodes": codes[0], "pwide": codes[1]}
            yield row

    def absorb(self, order: int, replies: pa.Table):
        """Take in the answers for ``order`` and work out each token's probability."""
        if order == 1:
            self._level_one()
        else:
            self._next_level()
        replies = replies.sort_by("part")
        flat = lambda name: np.asarray(replies[name].combine_chunks().flatten())
        d = self.model.discounts[order - 1]
        self.counts = np.empty(len(self.keys), np.int64)
        if order == 1:
            self.counts[self.order] = _either(replies, "counts", "cwide")[0]
            c, unseen = self.counts, 1 - self.model.seen_mass
            self.p = np.where(c > 0, d.factor(c) * c / self.model.unigram_total, unseen)
            return
        sizes = np.diff(np.append(self.run_starts, len(self.order)))
        self.counts[self.order] = _either(replies, "counts", "cwide")[0]
        total, full = self.often[self.run_starts], flat("has").copy()
        seen, mass = np.zeros((len(total), MAX_DISCOUNTED), np.int64), np.zeros(len(total))
        seen[full], mass[full] = flat("seen").reshape(-1, MAX_DISCOUNTED), flat("mass")
        keys, hot_seen, hot_mass = self.model.hot[order - 1]
        hot = np.flatnonzero(self.hot[self.run_starts])
        if len(hot):
            at = np.searchsorted(keys, self.ctx[self.order[self.run_starts[hot]]])
            full[hot], seen[hot], mass[hot] = True, hot_seen[at], hot_mass[at]
        left = total - d.kept(total, seen)
        bare = full & (left <= 1e-9 * total)  # no successor is discounted: one count more, for the unseen
        whole = np.where(bare, total + 1.0, total)
        back = np.where(bare, 1.0, left) / np.maximum(whole, 1) / np.maximum(1 - mass, 1e-300)
        whole, back, known = (np.repeat(v, sizes) for v in (whole, back, total > 0))
        c, lower = self.counts[self.order], self.lower[self.order]
        self.p = np.empty(len(c))
        self.p[self.order] = np.where(c > 0, d.factor(c) * c / np.maximum(whole, 1), np.where(known, back * lower, lower))


def _count(table: pa.Table) -> pa.Table:
    """One partition of an order's tables: add up what all blocks sent, answer each."""
    flat = lambda name: np.asarray(table[name].combine_chunks().flatten())
    size = lambda name: np.asarray(pa.compute.list_value_length(table[name].combine_chunks()))
    keys, counts = flat("keys"), _either(table, "counts", "cwide")[0]
    n_keys, n_ctxs, n_vals = size("keys"), size("ctxs"), size("pvals")
    unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
    c = np.bincount(of, weights=counts, minlength=len(unique)).astype(np.int64)
    tallies = np.array([*(int((c == r).sum()) for r in range(1, MAX_DISCOUNTED + 2)), int((c > 0).sum()), int(c.sum())])
    nothing = {"keys": NO_LONG, "counts": NO_SHORT, "cwide": NO_INT, "has": np.zeros(0, bool), "seen": NO_INT, "mass": np.zeros(0)}
    row = lambda kind, block, part, **v: _row(**({"kind": kind, "block": block, "part": part} | nothing | v))
    out = [row("tally", -1, 0, keys=tallies)]
    blocks, parts = table["block"].to_pylist(), table["part"].to_pylist()
    key_ends, ctx_ends = np.cumsum(n_keys), np.cumsum(n_ctxs)
    answers = [dict(zip(("counts", "cwide"), _fitted(c[of[e - n:e]]))) for e, n in zip(key_ends, n_keys)]
    if not n_ctxs.sum():
        return pa.Table.from_batches(out + [row("reply", *to, **mine) for *to, mine in zip(blocks, parts, answers)])
    ctxs, needs = flat("ctxs"), flat("needs")
    ctx = np.repeat(ctxs, flat("runs"))[first]
    codes, n_codes = _either(table, "pcodes", "pwide")
    lower = np.zeros(len(unique))
    lower[of[counts > 0]] = flat("pvals")[codes + np.repeat(np.cumsum(n_vals) - n_vals, n_codes)]
    known, of_ctx = np.unique(ctx, return_inverse=True)
    seen = np.stack([np.bincount(of_ctx[c == r], minlength=len(known)) for r in range(1, MAX_DISCOUNTED + 1)], axis=1).astype(np.int32)
    mass = np.bincount(of_ctx, weights=lower, minlength=len(known))
    bare = seen[:, 0] == 0  # without a successor seen once, none may be discounted
    hot = []
    for i, block in enumerate(blocks):
        mine = slice(ctx_ends[i] - n_ctxs[i], ctx_ends[i])
        hot.append(ctxs[mine][table["n_cold"][i].as_py():])
        which = np.searchsorted(known, ctxs[mine])
        has = needs[mine] | bare[which]
        out.append(row("reply", block, parts[i], **answers[i], has=has, seen=seen[which[has]].ravel(), mass=mass[which[has]]))
    hot = np.unique(np.concatenate(hot))
    if len(hot):
        at = np.searchsorted(known, hot)
        out.append(row("hot", -1, parts[0], keys=hot, seen=seen[at].ravel(), mass=mass[at]))
    return pa.Table.from_batches(out)


def token_blocks(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts as blocks of numbered words; a table bucketed by block."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.col(text_col).cast("string").alias("t"))

    def run(batches):
        import xxhash

        def close():
            vocab = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), "u8", len(number)).view("i8")
            lists = [pa.array([v], t) for v, t in ((docs_, pa.list_(pa.int64())), (sizes, pa.list_(pa.int32())),
                                                   (learns, pa.list_(pa.bool_())))]
            flat = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
                    for v in (vocab, np.frombuffer(ids, np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([len(ids)]), *lists, *flat],
                                              names=[f.split()[0] for f in BLOCK.split(", ")])
        docs_, sizes, learns, ids, number = [], [], [], array("i"), {END: 0}
        for batch in sliced(batches, 2):
            for doc, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                words = text.lower().split() if text else []
                if ids and len(ids) + len(words) >= BLOCK_TOKENS:
                    yield close()
                    docs_, sizes, learns, ids, number = [], [], [], array("i"), {END: 0}
                ids.extend([number.setdefault(w, len(number)) for w in words])
                ids.append(0)
                docs_.append(doc)
                sizes.append(len(words) + 1)
                learns.append(learn)
        if ids:
            yield close()
    spark = docs.sparkSession
    blocks = rows.mapInArrow(run, BLOCK)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    name = f"katz_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").option("compression", "zstd") \
          .option("path", shared_path(spark, "katz-blocks")).saveAsTable(name)
    return spark.table(name)


def _replies(tables: list[DataFrame]) -> DataFrame:
    out = None
    for order, t in enumerate(tables, 1):
        rows = t.where("kind = 'reply'").select("block", F.lit(order).alias("level"), "part", "counts", "cwide", "has", "seen", "mass")
        out = rows if out is None else out.unionAll(rows)
    return out


def count_tables(blocks: DataFrame, model: Model, order: int) -> list[DataFrame]:
    """The answers of each order's tables (written), and the model's totals along the way."""
    tables: list[DataFrame] = []
    names = [f.split()[0] for f in ASK.split(", ")]
    def asking(level):
        def ask(left, right):
            out = []
            for i in range(left.num_rows):
                block = Block(left.slice(i, 1), model)
                for done in range(1, level):
                    block.absorb(done, right.filter(pa.compute.equal(right["level"], done)))
                out += [_row(**{n: row[n] for n in names}) for row in block.asks(level)]
            return pa.Table.from_batches(out)
        return ask

    def first(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for row in Block(pa.Table.from_batches([batch.slice(i, 1)]), model).asks(1):
                    yield _row(**{n: row[n] for n in names})
    for level in range(1, order + 1):
        if level == 1:
            asks = blocks.mapInArrow(first, ASK)
        else:
            asks = blocks.groupBy("block").cogroup(_replies(tables).groupBy("block")).applyInArrow(asking(level), ASK)
        answered = written(asks.groupBy("part").applyInArrow(_count, REPLY), f"katz-{level}grams")
        tally = {r["pos"]: r["n"] for r in answered.where("kind = 'tally'").select(F.posexplode("keys").alias("pos", "n"))
                 .groupBy("pos").agg(F.sum("n").alias("n")).collect()}
        n = [tally.get(i, 0) for i in range(MAX_DISCOUNTED + 3)]
        d = Discounts(n[:MAX_DISCOUNTED + 1], n[-1])
        model.discounts.append(d)
        if level == 1:
            model.words, model.tokens = n[-2], n[-1]
            seen = np.array(n[:MAX_DISCOUNTED])[None, :]
            kept = float(d.kept(np.array([model.tokens]), seen)[0])
            bare = kept >= model.tokens  # no count is discounted: one count more, for the unseen
            model.unigram_total = max(model.tokens + bare, 1)
            model.seen_mass = kept / model.unigram_total
        model.hot.append(_hot_contexts(answered))
        tables.append(answered)
    return tables


def _hot_contexts(answered: DataFrame) -> tuple:
    """Sums of the spread contexts; a row each, no more than there are partitions."""
    parts = answered.where("kind = 'hot'").select(F.posexplode("keys").alias("pos", "key"), "seen", "mass")
    k = MAX_DISCOUNTED
    one = parts.select("key", F.get("mass", F.col("pos")).alias("mass"),
                       *[F.get("seen", F.col("pos") * k + r).alias(f"s{r}") for r in range(k)])
    rows = one.groupBy("key").agg(F.sum("mass").alias("mass"),
                                  *[F.sum(f"s{r}").alias(f"s{r}") for r in range(k)]).toArrow()
    keys = np.asarray(rows["key"]).view("u8")
    at = np.argsort(keys)
    seen = np.stack([np.asarray(rows[f"s{r}"]) for r in range(k)], axis=1).reshape(-1, k)
    return keys[at], seen[at], np.asarray(rows["mass"])[at]


def lm_scores(docs: DataFrame, train: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_tokens, n_known`` (tokens seen in training), ``train_tokens``, ``base_score``
    (log10 probability under add-one unigrams with one class for unknown words), ``score``
    (log10 probability under the Katz model).

    ``train``: condition for rows to learn from (null: no). Null texts are empty: one token,
    the end. Repeated rows stay repeated and count as often. Without training rows every
    token has probability one of the unknown class (scores 0). Other columns are not read."""
    blocks = token_blocks(docs, train, id_col, text_col)
    size = blocks.select(F.sum("n_tokens").alias("n"), F.sum(F.size(F.filter("train", lambda t: t))).alias("docs")).first()
    if not size["n"]:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // PART_TOKENS))
    model = Model(parts, size["docs"])
    tables = count_tables(blocks, model, order)

    def evaluate(left, right):
        out = []
        for i in range(left.num_rows):
            block = Block(left.slice(i, 1), model)
            block.absorb(1, right.filter(pa.compute.equal(right["level"], 1)))
            c = block.counts[block.ids]
            base = np.log10((c + 1) / (model.tokens + (model.words + 1)))
            for level in range(2, order + 1):
                block.absorb(level, right.filter(pa.compute.equal(right["level"], level)))
            per_doc = lambda v, s=block.starts: np.add.reduceat(v, s)
            n = len(block.sizes)
            out.append(pa.RecordBatch.from_arrays(
                [block.docs, pa.array(block.sizes.astype(np.int64)), pa.array(per_doc((c > 0).astype(np.int64))),
                 pa.array(np.full(n, model.tokens, np.int64)), pa.array(per_doc(base)), pa.array(per_doc(np.log10(block.p)[block.gram]))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out)
    return blocks.groupBy("block").cogroup(_replies(tables).groupBy("block")) \
                 .applyInArrow(evaluate, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
