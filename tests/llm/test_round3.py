"""Token records, periodic runs and ranked search against brute-force versions."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskrank.llm import queries as Q
from riskrank.llm import records, runs, strata

TABLE = "/root/testdata/sf0.001"


def token_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# -- 11 -----------------------------------------------------------------------
def bitwise_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ 0x82F63B78 if crc & 1 else crc >> 1
    return crc ^ 0xFFFFFFFF


def test_crc32c_is_that_of_the_standard():
    rng = random.Random(1)
    payloads = [rng.randbytes(2 * n) for n in (0, 1, 4, 31, 32, 33, 64, 700, 0)]
    assert bitwise_crc32c(b"123456789") == 0xE3069283
    assert records.crc32c(payloads).tolist() == [bitwise_crc32c(p) for p in payloads]
    assert records.crc32c([]).tolist() == []


def test_frames_round_trip_and_damage_is_found():
    payloads = [b"", b"ab", b"x" * 500]
    data = b"".join(records.frames(payloads))
    spots = [(0, 16), (16, 18), (34, 516)]
    assert records.payloads_of(data, spots) == payloads
    assert struct.unpack("<Q", data[16:24])[0] == 2
    for at in (17, 26, 28, 33, 300):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            records.payloads_of(bytes(bad), spots)


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(token_path())
    tokenizer.encode_special_tokens = True
    encode, rng = records.Encoder(token_path()), random.Random(3)
    for _ in range(300):
        texts = ["".join(rng.choice("ab '\n\t\x1c  é1,.中　\x85<|endoftext|>s\r\n") for _ in range(rng.randint(0, 25))) for _ in range(30)]
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def expected_tokens(rows):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(token_path())
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_records_follow_the_ids(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    out = Q.QUERIES["op11_token_records"](spark, TABLE)
    assert sorted(map(tuple, out.collect())) == expected_tokens(rows)


def test_records_of_messy_rows_and_shuffled_reads(spark, messy, nothing):
    index = records.write_records(messy, token_path()).cache()
    back = [r.asDict() for r in records.read_records(index).collect()]
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in back) == Counter((i, e[3]) for i, e in zip(
        [i for i, _ in rows], expected_tokens(rows)))
    back.sort(key=lambda r: r["start"])
    assert [r["start"] for r in back] == [0, *np.cumsum([r["n_tokens"] for r in back])[:-1].tolist()]
    ids = [r["doc_id"] for r in back]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in back)
    few = index.where("start % 3 = 0").orderBy(F.rand(1))
    assert sorted(r["start"] for r in records.read_records(few).collect()) == [r["start"] for r in back if r["start"] % 3 == 0]
    assert records.read_records(records.write_records(nothing, token_path())).count() == 0


def test_reads_are_dealt_by_bytes(spark, messy, monkeypatch):
    monkeypatch.setattr(records, "READ_BYTES", 1 << 10)
    index = records.write_records(messy, token_path())
    total = index.agg(F.sum("length")).first()[0]
    assert records.read_records(index).rdd.getNumPartitions() >= 2
    assert records.read_records(index).count() == messy.count() and total > 2 << 10


# -- 12 -----------------------------------------------------------------------
def brute_runs(w):
    found, n = [], len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                s = w[i:j + p]
                if not any(all(s[k] == s[k + q] for k in range(len(s) - q)) for q in range(1, p)):
                    found.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 2)):
        period = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(w))
        w[at:at] = (period * 9)[:rng.randint(3, 50)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = random_words(rng)
        assert runs.runs_of(np.array(w, np.int64)) == brute_runs(w)


def test_stretches_hold_every_run():
    rng = random.Random(6)
    texts = [random_words(rng) for _ in range(800)]
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    words = np.array([x for t in texts for x in t], np.int64)
    got = []
    for s, n in zip(*(x.tolist() for x in runs.stretches(words, starts, lengths))):
        got += [(a + s, b, c) for a, b, c in runs.runs_of(words[s:s + n])]
    assert sorted(got) == sorted((a + s, b, c) for s, t in zip(starts.tolist(), texts) for a, b, c in brute_runs(t))


def test_extensions_of_a_tree():
    rng = random.Random(7)
    w = [rng.randrange(1, 3) for _ in range(400)]
    tree = runs.SuffixTree(w)
    a = np.array([rng.randrange(400) for _ in range(2000)])
    b = (a + np.array([rng.randrange(1, 400) for _ in range(2000)])) % 400

    def lce(i, j):
        k = 0
        while max(i, j) + k < 400 and w[i + k] == w[j + k]:
            k += 1
        return k
    assert tree.extension(a, b).tolist() == [lce(i, j) for i, j in zip(a.tolist(), b.tolist())]
    by = sorted(range(400), key=lambda i: w[i:])
    assert [1 + by.index(i) for i in range(400)] == tree.order.tolist()


def brute_row(doc_id, words):
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in found)]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_periodic_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    expected = []
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n < 3000:  # brute force takes the square of the length
            expected.append(brute_row(r["doc_id"], words))
    out = {tuple(r)[0]: tuple(r) for r in Q.QUERIES["op12_periodic_runs"](spark, TABLE).collect()}
    assert len(out) == docs.count() and [out[e[0]] for e in expected] == expected
    assert sum(e[1] > 0 for e in expected) > 5


def test_periodic_runs_of_messy_rows(spark, messy, nothing):
    def key(r):
        return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    out = sorted((tuple(r) for r in runs.periodic_runs(messy).collect()), key=key)
    assert out == sorted((brute_row(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
                          for r in messy.collect()), key=key)
    assert any(r[1] for r in out)
    assert runs.periodic_runs(nothing).count() == 0


# -- 13 -----------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=50):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    big_n, big_l = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c, n in counts:
            m = 50 + 50 * n * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(plain_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, block", [(50, 1024), (3, 1024), (2, 2)])
def test_ranked_search_of_messy_rows(spark, messy, nothing, monkeypatch, k, block):
    monkeypatch.setattr(strata, "BLOCK_DOCS", block)
    monkeypatch.setattr(strata, "GROUP", 3)
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    items = [(1, docs[2][1]), (2, "one TWO w"), (3, ""), (5, "É中文 x ü"), (6, docs[9][1][:900]), (7, "absentword"), (8, "w w"), (9, None)]
    queries = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("score", F.lit(1))
    assert sorted(tuple(r) for r in strata.search(messy, queries, k).collect()) == brute_search(docs, items, k)
    assert strata.search(nothing, queries).count() == 0
    assert strata.search(messy, queries.limit(0)).count() == 0


def test_items_in_sets_give_the_same(spark, messy, monkeypatch):
    queries = messy.where("doc_id < 14").select(F.col("doc_id").alias("item_id"), "text").dropDuplicates(["item_id"])
    whole = sorted(map(tuple, strata.search(messy, queries, 5).collect()))
    monkeypatch.setattr(strata, "SET_BYTES", 20_000)
    assert sorted(map(tuple, strata.search(messy, queries, 5).collect())) == whole and whole


def test_bounds_leave_blocks_out():
    """Bounds are never below a score, and low blocks are not scored."""
    rng = np.random.default_rng(1)
    weights = np.array([500, 900, 3000], np.int64)
    blocks = []
    for m in range(60, 160):
        terms, tfs, at = rng.integers(0, 3, 8), rng.integers(1, 5, 8), np.arange(8)
        by = np.lexsort((at, tfs, terms))
        blocks.append(strata.Block(m, list(range(m * 10, m * 10 + 8)), *(x[by].astype("<i4").tobytes() for x in (terms, tfs, at)), weights))
    items = strata.Items(*strata.item_terms([b"a b", b"c"], {b"a": 0, b"b": 1, b"c": 2}))
    for b in blocks:
        places = b.places(3)
        for i, terms in enumerate(([0, 1], [2])):
            assert b.scores(np.array([places[t] for t in terms if places[t] >= 0], int)).max(initial=0) <= b.bounds(items)[i]
    best = [strata.Best(5), strata.Best(5)]
    assert 0 < strata.visit(blocks, items, best) < len(blocks)
