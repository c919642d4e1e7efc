"""SimHash near-duplicates through pivot distance tables.

``fingerprints`` gives each text a 64-bit SimHash of its word shingles. Linking all
fingerprints at ``max_bits`` or fewer differing bits works on distinct fingerprints:

* The 64 bits are cut into ``max_bits + 2`` parts. Each part has its own reference
  fingerprints (pivots), and the Hamming distances from every value of the part to all
  its pivots are computed beforehand. The pivots are drawn until they resolve the part:
  no two values have the same row of distances.
* ``max_bits`` differing bits touch at most ``max_bits`` parts, so two linked
  fingerprints have the same pivot distances (coordinate difference 0) in at least two
  parts. The distances of each pair of parts are therefore a join key.
* Inside a bucket (equal key), pairs are discarded when any coordinate of the remaining
  pivots differs by more than ``max_bits`` (triangle inequality), and the survivors are
  verified on the fingerprints themselves. No link is lost and none is false.

The fingerprints of buckets over ``bucket_rows`` are dealt again with twice as many parts,
keyed by all but ``max_bits`` of them; the buckets of that second level agree in 48 of 64
bits (at the default), so they hold 65,536 fingerprints at most. Buckets emit one link a
fingerprint to their local component's root, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, components, map_texts, row_key, written

BITS = 64
PIVOTS_PER_PART = 24
WHOLE_PIVOTS = 16
PIVOT_SEED = 20
BUCKET_ROWS = 2048


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """Fingerprint of one text; 0 when it has no word."""
    import xxhash
    from itertools import repeat
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        part = words[at:min(n, at + (1 << 15)) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
                  .sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, row_key, fp)`` for every row of ``docs``; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row_key"),
                       F.col(text_col).cast("string").alias("t"))

    def run(batch):
        fps = np.array([simhash(t, shingle) for t in byte_texts(batch.column(2))], "u8").view("i8")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["id", "row_key", "fp"])
    return map_texts(rows, run, "id long, row_key long, fp long")


def part_bounds(width: int, parts: int, base: int = 0) -> list[tuple[int, int]]:
    """(first bit, bits) of ``parts`` nearly equal parts of ``width`` bits."""
    cuts = [round(width * i / parts) for i in range(parts + 1)]
    return [(base + a, b - a) for a, b in zip(cuts, cuts[1:])]


def distance_table(bits: int, pivots: int = PIVOTS_PER_PART, seed: int = PIVOT_SEED) -> np.ndarray:
    """Hamming distances of all values of ``bits`` bits to so many references that no two
    values have equal rows; (2**bits, pivots)."""
    values = np.arange(1 << bits, dtype=np.uint32)
    rng = np.random.default_rng(seed + bits)
    while True:
        refs = rng.integers(0, 1 << bits, pivots, dtype=np.uint32)
        table = np.bitwise_count(values[:, None] ^ refs[None, :]).astype(np.uint8)
        if len(np.unique(table, axis=0)) == len(values):
            return table
        pivots += 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of small integers."""
    h = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    for j in range(rows.shape[1]):
        h = _mix(h ^ rows[:, j].astype(np.uint64))
    return h


class PivotTables:
    """Pivot distance tables of the parts, and the whole-width pivots."""

    def __init__(self, bounds: list[tuple[int, int]], whole: int = WHOLE_PIVOTS, seed: int = PIVOT_SEED):
        self.bounds = bounds
        self.hashes = {b: _row_hash(distance_table(b)) for b in {b for _, b in bounds}}
        self.whole = np.random.default_rng(seed).integers(0, 1 << 64, whole, dtype=np.uint64)

    def part_keys(self, fps: np.ndarray) -> np.ndarray:
        """Hash of the pivot distances of every part: (rows, parts)."""
        return np.stack([self.hashes[b][((fps >> np.uint64(at)) & np.uint64((1 << b) - 1)).astype(np.int64)]
                         for at, b in self.bounds], axis=1)

    def coordinates(self, fps: np.ndarray) -> np.ndarray:
        """Distances to the whole-width pivots: (pivots, rows)."""
        return np.bitwise_count(fps[None, :] ^ self.whole[:, None]).astype(np.int8)


def bucket_links(keys: np.ndarray, fps: np.ndarray, coords: np.ndarray, max_bits: int) -> tuple:
    """Verified pairs (i, j) of rows with equal keys. Rows of a key are swept in the order of
    their first coordinate; a pair is dropped as soon as one coordinate is too far."""
    order = np.lexsort((coords[0], keys))
    k, c0 = keys[order], coords[0][order].astype(np.int16)
    alive = np.arange(len(order))
    left, right = [], []
    step = 1
    while len(alive):
        alive = alive[alive + step < len(order)]
        alive = alive[(k[alive] == k[alive + step]) & (c0[alive + step] - c0[alive] <= max_bits)]
        i, j = order[alive], order[alive + step]
        for c in coords[1:]:
            near = np.abs(c[i] - c[j]) <= max_bits
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        left.append(i[near])
        right.append(j[near])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (order[:0], order[:0])


def local_roots(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Smallest ``order`` value reachable from each of ``n`` rows over the pairs (i, j)."""
    label = order.copy()
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (before == label).all():
            break
    return label


def _link_buckets(bucketed: DataFrame, tables: PivotTables, max_bits: int) -> DataFrame:
    """``(key, fp)`` rows -> spanning links ``(a, b)`` inside each key."""
    def run(batches):
        held = None

        def links(keys, fps):
            u = fps.view("u8")
            i, j = bucket_links(keys, u, tables.coordinates(u), max_bits)
            root = local_roots(len(fps), i, j, fps)
            # a row takes part in pairs of its own key only, so the roots are per bucket
            moved = root != fps
            return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(root[moved])], names=["a", "b"])

        for batch in batches:
            keys, fps = (np.asarray(batch.column(x)) for x in ("key", "fp"))
            if held is not None:
                keys, fps = np.concatenate([held[0], keys]), np.concatenate([held[1], fps])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut:
                yield links(keys[:cut], fps[:cut])
            held = keys[cut:].copy(), fps[cut:].copy()
        if held is not None and len(held[0]):
            yield links(*held)
    return bucketed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _deal(fps: DataFrame, tables: PivotTables, groups: list[tuple[int, ...]]) -> DataFrame:
    """``(key, fp)``: one row for each group of parts, keyed by the parts' pivot distances."""
    def run(batches):
        for batch in batches:
            parts = tables.part_keys(np.asarray(batch.column(0)).view("u8"))
            for g, members in enumerate(groups):
                key = np.full(len(parts), g + 1, np.uint64)
                for p in members:
                    key = _mix(key ^ parts[:, p])
                yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), batch.column(0)], names=["key", "fp"])
    return fps.select("fp").mapInArrow(run, "key long, fp long")


def near_links(fps: DataFrame, max_bits: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spanning links ``(a, b)`` of distinct fingerprints ``(fp)`` whose components are
    those of all pairs at ``max_bits`` or fewer differing bits."""
    tables = PivotTables(part_bounds(BITS, max_bits + 2))
    dealt = written(_deal(fps, tables, list(combinations(range(max_bits + 2), 2))), "simhash-buckets")
    sizes = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                         .select(F.col("key").alias("k"), "n"), "simhash-sizes")
    joined = dealt.join(sizes, dealt["key"] == sizes["k"])
    links = _link_buckets(joined.where(F.col("n") <= bucket_rows).select("key", "fp"), tables, max_bits)
    if not sizes.where(F.col("n") > bucket_rows).head(1):
        return links
    # fingerprints of large buckets: twice as many parts, of which linked pairs share all but
    # max_bits. Such a key leaves max_bits small parts open, which bounds its bucket.
    parts = 2 * (max_bits + 2)
    fine = PivotTables(part_bounds(BITS, parts))
    big = joined.where(F.col("n") > bucket_rows).select("fp").distinct()
    return links.union(_link_buckets(_deal(big, fine, list(combinations(range(parts), parts - max_bits))),
                                     fine, max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row a document: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable over links of at most ``max_bits`` differing bits), ``class_fp`` (the
    class's smallest fingerprint) and ``row_key`` (equal for rows equal in id and text).

    Null and empty texts have fingerprint zero and link like any other. Null ids are
    ignored as component ids (null when a component has no other). Repeated rows stay
    repeated. Other columns of ``docs`` are not read."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    heads = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = components(near_links(heads.select("fp"), max_bits, bucket_rows), "simhash-components")
    named = heads.join(roots, heads["fp"] == roots["node"], "left") \
                 .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-roots")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = written(named.join(lows, "root").select(F.col("fp").alias("f"), "root", "component_id"), "simhash-classes")
    return rows.join(classes, rows["fp"] == classes["f"]) \
               .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id", F.col("root").alias("class_fp"), "row_key")
