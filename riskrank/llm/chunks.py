"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text (the sum of a random value per byte, shifted
left once for each byte since; 16 bits wide, so it looks back 16 bytes). A chunk ends where
a run of white space ends and the hash falls below a threshold: chunks are whole words, and text
inserted before a passage does not move the ends inside it. White-space-free stretches (as in
Chinese or encoded blocks) are cut at byte positions by the same hash, and at a fixed length in
the last resort.

Repeats are found by digest over the whole corpus: the first occurrence (smallest doc_id,
then position) stays, later ones are removed, also within one document (``within``). Since a
short chunk can recur by chance, the digests are those of windows: from each chunk on, the shortest series
of consecutive chunks with ``min_run_words`` words or ``min_run_bytes`` bytes. A chunk is removed when a
window over it occurred before as a whole, or when it follows such a window as it follows the
first occurrence (at most two chunks, told by 12 bits each). So a repeated run loses all but, at times, its last
few words; chunks that recur one by one, in different places, stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, hash_sample, map_texts, row_key, written

#: One white-space position in so many ends a chunk (about so many words a chunk).
WORDS_A_CHUNK = 5
MIN_RUN_WORDS, MIN_RUN_BYTES = 12, 200
#: White-space-free stretches: cuts by hash beyond the first length, by force at the second.
LONG, LONGEST = 128, 2048
#: A byte in so many of such a stretch is a cut.
BYTES_A_CUT = 64
GEAR_SEED = 7
#: Odd factor of the window digests and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C13
INVERSE = pow(FACTOR, -1, 1 << 64)
BLOCK = 1 << 22
#: Digests with this share of a sample's windows are dealt to so many tasks; so many digests at most.
HOT_SAMPLE, HOT_SHARE, HOT_SLOTS, HOT_DIGESTS = 1000, 1 / 2000, 64, 256

GEAR = np.random.default_rng(GEAR_SEED).integers(0, 1 << 16, 256, dtype=np.uint16)
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: sum of GEAR[byte j back] << j over 16 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def chunk_ends(text: bytes, words: int = WORDS_A_CHUNK) -> np.ndarray:
    """End offsets of the chunks of a text (the last is its length); empty for no text."""
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    limit = np.uint16((1 << 16) // words - 1) if words > 1 else np.uint16((1 << 16) - 1)
    found, gaps = [], []
    for at in range(0, len(data), BLOCK):  # bounded memory; 15 bytes of look-back across blocks
        back = min(at, 15)
        block = data[at - back:at + BLOCK]
        follows = ~SPACES[data[at - back + 1:at + BLOCK + 1]]  # a chunk starts with a word
        space = SPACES[block]
        space[:len(follows)] &= follows
        hits = np.flatnonzero(space & (gear_hash(block) <= limit))
        found.append(hits[hits >= back] + (at - back) + 1)
    ends = np.unique(np.append(np.concatenate(found), len(data)))
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(starts[ends - starts > LONG].tolist(), ends[ends - starts > LONG].tolist()):
        edges = np.concatenate([[s - 1], np.flatnonzero(SPACES[data[s:e]]) + s, [e]])
        for k in np.flatnonzero(np.diff(edges) > LONG + 1).tolist():
            gaps += _cut_long(data, int(edges[k]) + 1, int(edges[k + 1]))
    return np.union1d(ends, np.array(gaps, np.int64)) if gaps else ends


def _cut_long(data: np.ndarray, start: int, end: int) -> list[int]:
    """Cuts inside a white-space-free stretch: at hash hits on character starts, one in
    ``BYTES_A_CUT`` bytes, and after ``LONGEST`` bytes at the latest."""
    cuts = []
    for at in range(start, end, BLOCK):
        back = min(at - start, 15)
        block = data[at - back:min(end, at + BLOCK)]
        hits = np.flatnonzero((gear_hash(block) < (1 << 16) // BYTES_A_CUT) & ((block & 0xC0) != 0x80))
        cuts += [c for c in (hits[hits >= back] + (at - back)).tolist() if c > start]
    out, last = [], start
    for c in [*cuts, end]:
        while c - last > LONGEST:
            last += LONGEST
            while last > 0 and data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if c < end:
            out.append(c)
            last = c
    return out


def word_chunks(text: bytes, words: int = WORDS_A_CHUNK) -> list[tuple[int, int]]:
    """(start, end) of the chunks that hold a word."""
    ends = chunk_ends(text, words).tolist()
    return [(a, b) for a, b in zip([0, *ends[:-1]], ends) if not text[a:b].isspace()]


def chunk_digests(text: bytes, words: int = WORDS_A_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, words, bytes) of the chunks that hold a word. The digest is XXH3-64 of the chunk's words,
    so the white space around and between them does not count; nor does it in ``bytes``."""
    import xxhash
    parts = [text[a:b].split() for a, b in word_chunks(text, words)]
    joined = [b" ".join(p) for p in parts]
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, joined), "u8", len(parts)).view("i8")
    return digests, np.fromiter(map(len, parts), np.int64, len(parts)), np.fromiter(map(len, joined), np.int64, len(parts))


def run_windows(digests: np.ndarray, words: np.ndarray, size: np.ndarray, min_words: int = MIN_RUN_WORDS,
                min_bytes: int = MIN_RUN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, digest) of the windows of a text's chunks: from each chunk on the shortest
    series of ``min_words`` words or ``min_bytes`` bytes. The digest is a polynomial of the chunk
    digests modulo 2^64, so it does not depend on the place."""
    n = len(digests)
    first, last = np.arange(n), np.full(n, n)
    for sizes, least in ((words, min_words), (size, min_bytes)):
        total = np.append(0, np.cumsum(sizes))
        last = np.minimum(last, np.searchsorted(total, total[:-1] + least) - 1)
    first, last = first[last < n], last[last < n]
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(n, f, np.uint64))) for f in (FACTOR, INVERSE))
    sums = np.append(np.uint64(0), np.cumsum(digests.view("u8") * power[:n]))
    return first, last, ((sums[last + 1] - sums[first]) * back[first]).view("i8")


def window_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_A_CHUNK,
                 min_run_words: int = MIN_RUN_WORDS, min_run_bytes: int = MIN_RUN_BYTES) -> DataFrame:
    """``(id, rid, place, digest)``: a row for each window. ``rid`` is the row key; ``place`` holds the
    number of the first chunk (32 bits; chunks with a word count), how many follow it in the window (8) and 12
    bits (0: none) of each of the two chunks after it."""
    if not 0 < min_run_words <= 256:
        raise ValueError("a window has 1 to 256 words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"),
                       F.col(text_col).cast("string").alias("t"))

    def run(batch):
        who, place, digest = [], [], []
        for i, text in enumerate(byte_texts(batch.column(2))):
            d, w, size = chunk_digests(text or b"", words)
            first, last, found = run_windows(d, w, size, min_run_words, min_run_bytes)
            marks = np.concatenate([(d.view("u8") % np.uint64(4095)).astype(np.int64) + 1, [0, 0, 0]])
            who.append(np.full(len(found), i))
            place.append((first << 32) + ((last - first) << 24) + (marks[last + 1] << 12) + marks[last + 2])
            digest.append(found)
        take = np.concatenate(who)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)),
             pa.array(np.concatenate(place)), pa.array(np.concatenate(digest))], names=["id", "rid", "place", "digest"])
    return map_texts(rows, run, "id long, rid long, place long, digest long")


def _hot_digests(docs: DataFrame, id_col: str, text_col: str, words: int, min_run_words: int, min_run_bytes: int) -> list[int]:
    """Digests that make up a large share of the windows of a sample of rows: ``HOT_DIGESTS`` at most. They only
    say which windows are dealt to several tasks; results do not depend on them."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), row_key(id_col, text_col).alias("key"))
    found = window_table(hash_sample(some, "key", HOT_SAMPLE, GEAR_SEED), "id", "t", words, min_run_words, min_run_bytes) \
        .groupBy("digest").count()
    found = written(found, "chunk-sample")
    least = max(HOT_SHARE * (found.agg(F.sum("count")).first()[0] or 0), 8)
    return [r[0] for r in found.where(F.col("count") >= least).orderBy(F.desc("count"), "digest").limit(HOT_DIGESTS).collect()]


def duplicate_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_A_CHUNK,
                   min_run_words: int = MIN_RUN_WORDS, min_run_bytes: int = MIN_RUN_BYTES, within: bool = True) -> DataFrame:
    """``(rid, runs)``: for each row with something to remove, the runs of chunks under windows
    that occurred before, as structs (first, last chunk number). A window that overlaps its own
    first occurrence is part of that."""
    hot = _hot_digests(docs, id_col, text_col, words, min_run_words, min_run_bytes)
    slot = F.when(F.col("digest").isin(hot), F.pmod(F.xxhash64("rid", "place"), F.lit(HOT_SLOTS)).cast("int") + 1).otherwise(0)
    # windows are dealt once; heads and join read that one exchange: all sides need the same columns and filters,
    # so the keys are never null, nor constant (the join would deal windows and heads again)
    windows = window_table(docs, id_col, text_col, words, min_run_words, min_run_bytes).where(F.col("digest").isNotNull())
    if hot:
        windows = windows.withColumn("slot", F.coalesce(slot, F.lit(0)))
    keys = ["digest", "slot"] if hot else ["digest"]
    windows = windows.repartition(*keys)
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "rid", "place")
    of_head = [F.min(order).alias("head"), F.count(F.lit(1)).alias("n")] + ([F.max("slot").alias("spread")] if hot else [])
    heads = windows.groupBy(*[F.col(k).alias(f"head_{k}") for k in keys]).agg(*of_head)
    if hot:  # the slots of a hot digest share their head: a row a hot digest
        top = heads.where("spread > 0").groupBy(F.col("head_digest").alias("t")).agg(F.min("head").alias("first"), F.sum("n").alias("total"))
        heads = heads.join(F.broadcast(top), heads["head_digest"] == top["t"], "left") \
                     .select("head_digest", "head_slot", F.coalesce("first", "head").alias("head"), F.coalesce("total", "n").alias("n"))
    heads = heads.where("n > 1")
    head_rid, head_place = F.col("head.rid"), F.col("head.place")

    def part(place, shift: int, bits: int):
        return F.shiftright(place, shift).bitwiseAND(F.lit((1 << bits) - 1))
    head_last = F.shiftright(head_place, 32) + part(head_place, 24, 8)
    elsewhere = F.col("rid") != head_rid
    later = windows.join(heads, [windows[k] == heads[f"head_{k}"] for k in keys]).where(order > F.col("head")) \
                   .where(elsewhere | (F.lit(within) & (F.shiftright("place", 32) > head_last)))
    same = [(part("place", at, 12) > 0) & (part("place", at, 12) == part(head_place, at, 12)) for at in (12, 0)]
    more = F.when(same[0], F.when(same[1], 2).otherwise(1)).otherwise(0)
    span = F.shiftright("place", 32) * F.lit(1 << 32) + F.shiftright("place", 32) + part("place", 24, 8) + more
    # windows of one document: bounded by the document itself
    marks = later.groupBy("rid").agg(F.collect_set(span).alias("marks"))

    def run(batches):
        for batch in batches:
            runs = []
            for marked in batch.column(1).to_pylist():
                found = []
                for first, last in (divmod(m, 1 << 32) for m in sorted(marked)):
                    if found and first <= found[-1]["last"] + 1:
                        found[-1]["last"] = max(last, found[-1]["last"])
                    else:
                        found.append({"first": first, "last": last})
                runs.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                names=["rid", "runs"])
    return marks.mapInArrow(run, "rid long, runs array<struct<first:int,last:int>>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_A_CHUNK,
                    min_run_words: int = MIN_RUN_WORDS, min_run_bytes: int = MIN_RUN_BYTES, within: bool = True) -> DataFrame:
    """``row`` (the input row as a struct), ``clean`` (its text without repeated runs),
    ``n_removed_chunks``, ``n_removed_words`` (0 and 0 where nothing is removed).

    Null texts stay null, empty texts stay empty. Rows repeated with the same id and text are
    the same document: they get the same result. A null id counts as the largest. Removing
    takes whole chunks, so the rest keeps its bytes and order. With ``within`` a run that occurred
    earlier in the same document goes too."""
    runs = written(duplicate_runs(docs, id_col, text_col, words, min_run_words, min_run_bytes, within), "chunk-runs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       row_key(id_col, text_col).alias("key"))
    text = F.col("row").getField(text_col).cast("string")

    @F.arrow_udf("struct<clean:string,chunks:long,words:long>")
    def cut(texts, cuts):
        out = [_without(t, c, words) for t, c in zip(byte_texts(texts), cuts.to_pylist())]
        return pa.array(out, pa.struct([("clean", pa.string()), ("chunks", pa.int64()), ("words", pa.int64())]))
    found = F.col("runs").isNotNull()
    # the runs grow with the input: dealt with the texts at every size, not broadcast below some threshold
    both = rows.join(runs.hint("merge"), rows["key"] == runs["rid"], "left") \
               .withColumn("cut", cut(F.when(found, text), F.col("runs")))  # only rows with runs go to Python
    return both.select("row", F.when(found, F.col("cut.clean")).otherwise(text).alias("clean"),
                       F.when(found, F.col("cut.chunks")).otherwise(0).alias("n_removed_chunks"),
                       F.when(found, F.col("cut.words")).otherwise(0).alias("n_removed_words"))


def _without(text: bytes | None, runs: list | None, words: int) -> dict | None:
    """The text without the chunk runs, and how many chunks and words went."""
    if text is None or runs is None:
        return None
    spots = word_chunks(text, words)
    kept, at, chunks, lost = [], 0, 0, 0
    for r in runs:
        a, b = spots[r["first"]][0], spots[r["last"]][1]
        kept.append(text[at:a])
        lost += len(text[a:b].split())
        chunks += r["last"] - r["first"] + 1
        at = b
    kept.append(text[at:])
    return {"clean": b"".join(kept).decode(), "chunks": chunks, "words": lost}
