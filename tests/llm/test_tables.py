"""Sharding, SimHash, WARC, neighbours, mixing and the pipeline against plain Python and SQL."""

import hashlib
import os
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SCHEMA, messy_rows, prose
from oracle_compare import compare
from riskrank.llm import mixing, neighbours, queries, sharding, simhash, warc

ROWS = [(r[0], r[1]) for r in messy_rows()]
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert not compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_lookup_table_is_balanced_and_stable():
    shards = [(f"s{i}", 1) for i in range(10)]
    table = sharding.fill_table(shards, 2053)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(shards[:-1], 2053)
    moved = sum(a != b for a, b in zip(table, fewer) if a != "s9")
    assert moved / 2053 < 0.15
    weighted = Counter(sharding.fill_table([("a", 3), ("b", 1)], 2053))
    assert 2.9 < weighted["a"] / weighted["b"] < 3.1
    for bad in ([], [("a", 1), ("a", 1)], [("a", 0)]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 2048)


def test_placement(messy, nothing):
    out = sharding.place(messy, "doc_id", queries.SHARDS)
    rows = out.collect()
    table = sharding.fill_table(queries.SHARDS)
    assert len(rows) == len(ROWS) and out.columns == [c for c in messy.columns if c != "slot"] + ["slot", "shard"]
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(nothing, "doc_id", queries.SHARDS).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def brute_simhash(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps, bits=2):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints_and_classes(messy, nothing):
    got = simhash.near_duplicates(messy).collect()
    assert len(got) == len(ROWS)
    fps = {(i, brute_simhash(t)) for i, t in ROWS}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == fps
    root = brute_roots([f for _, f in fps])
    low = defaultdict(lambda: None)
    for i, f in fps:
        if i is not None and (low[root[f]] is None or i < low[root[f]]):
            low[root[f]] = i
    for r in got:
        assert r.component_id == low[root[int(r.fingerprint, 16)]]
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("bucket_rows", [2048, 3])
def test_pivot_tables_lose_no_link(spark, bucket_rows):
    """Random fingerprints, chains of near ones, and a dense group, in one and in two levels."""
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 1 << 64, 150, dtype=np.uint64).tolist())
    for f in list(fps)[:30]:
        for _ in range(4):  # steps of up to three bits
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    base = int(rng.integers(0, 1 << 63))
    fps |= {base ^ int(x) for x in rng.integers(0, 256, 60)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    links = simhash.near_links(df, 2, bucket_rows)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(links).collect()}
    want = brute_roots(fps)
    classes = lambda root: {frozenset(v) for v in _groups(root).values()}
    assert classes({f: got.get(f, f) for f in fps}) == classes(want)


def _groups(root):
    out = defaultdict(set)
    for f, r in root.items():
        out[r].add(f)
    return out


def test_distance_tables_resolve_and_bound():
    t = simhash.distance_table(8)
    assert len(np.unique(t, axis=0)) == 256
    x = np.arange(256)
    far = np.abs(t[:, None].astype(int) - t[None]).max(axis=2)
    assert (far <= np.bitwise_count((x[:, None] ^ x[None]).astype(np.uint8))).all()


def test_warc_round_trip(spark):
    big = prose(1, 400)
    rows = [(1, "http://a/é x", big), (5, "http://b", big), (5, "http://b", big), (3, None, big), (None, "http://n", big),
            (7, "u", None), (8, "u", ""), (9, "u", "small"), (10, "u", "small"), (11, "bad\r\nurl", big + "ü\r\n\r\n" + big),
            (12, "u", prose(2, 90000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("x")).repartition(3)
    index = warc.write_archives(df)
    assert index.count() == len(rows)
    got = warc.read_records(index).collect()
    html = {r[0]: (r[2] or "").encode() for r in rows}
    html[None] = big.encode()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(1, "revisit", 5): 1, (3, "revisit", 5): 1, (None, "revisit", 5): 1, (5, "response", None): 2,
                             **{(i, "response", None): 1 for i in (7, 8, 9, 10, 11, 12)}})
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == html[r.page_id]
    total = index.agg(F.sum("length")).first()[0]
    huge = index.withColumn("length", F.lit(warc.TASK_BYTES))  # tasks follow the bytes of the records
    assert warc.read_tasks(index) == max(1, min(spark.sparkContext.defaultParallelism, total // warc.MIN_TASK_BYTES))
    assert warc.read_tasks(huge) == max(index.count(), spark.sparkContext.defaultParallelism)
    assert warc.read_tasks(index.where("false")) == 1
    some = warc.read_records(index.where("page_id in (3, 9)")).collect()
    assert {r.page_id for r in some} == {3, 9}
    assert warc.read_records(warc.write_archives(df.where("false"))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[10:60] = x[10]
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (None, rows[1][1]), (904, [1.0]), rows[3], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).repartition(3)
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = neighbours.exact_scores(np.repeat(x[q:q + 1], 900, axis=0), x)
        best = sorted((-s[v], v) for v in range(900) if v != q)[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(v != q and sc == s[v] for v, sc in found)
        hits += len({v for v, _ in found} & {v for _, v in best})
    assert hits / (20 * len(got)) >= 0.9
    for q, found in got.items():  # of the equal vectors, the smallest ids
        tied = [v for v, _ in found if 10 <= v < 60]
        assert tied == [v for v in range(10, 60) if v != q][:len(tied)]
    few = neighbours.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert {r.vec_id for r in few} == {1, 2, 3, 4}
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_neighbours_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 8)), rng.normal(size=(5, 3))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*x, *y])] + [(65, [1.0] * 9), (0, [9.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id").isin(0, 20, 60, 65), k=3, probes=10 ** 6).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q, others in ((0, x), (20, x)):
        assert got.pop(q) == sorted((v for v in range(60) if v != q), key=lambda v: -others[v] @ others[q])[:3]
    scores = {61 + i: v @ y[0] for i, v in enumerate(y[1:])} | {0: 9 * y[0].sum()}
    assert got.pop(60) == sorted(scores, key=lambda v: -scores[v])[:3]
    assert not got  # the longest vector has no other of its length


def brute_share(budget, children):
    """Water filling by rounds: (capacity, weight) -> budgets."""
    got, open_ = {}, dict(children)
    while open_:
        level = budget / sum(w for _, w in open_.values())
        full = {k for k, (cap, w) in open_.items() if cap <= w * level + 1e-12}
        if not full:
            return got | {k: w * level for k, (_, w) in open_.items()}
        for k in full:
            got[k] = open_[k][0]
            budget -= open_.pop(k)[0]
    return got


def test_budgets(spark):
    rng = np.random.default_rng(2)
    leaves = [(d, lang, s, int(rng.integers(1, 5000))) for d in "abc" for lang in ("de", "en") for s in ("x", "y", "z")]
    weights = {"domain": {"a": 3.0}, "lang": {"en": 5.0}, "source": {"x": 0.2}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r for r in mixing.leaf_budgets(df, 0.9, weights, 2).collect()}

    def down(path, budget):
        if len(path) == 3:
            return {path: budget}
        level = mixing.LEVELS[len(path)]
        children = {}
        for leaf in leaves:
            if leaf[:len(path)] == path:
                k = leaf[len(path)]
                children[k] = (children.get(k, (0, 0))[0] + 2 * leaf[3], weights[level].get(k, 1.0))
        out = {}
        for k, b in brute_share(budget, children).items():
            out |= down((*path, k), b)
        return out
    total = int(sum(leaf[3] for leaf in leaves) * 0.9)
    for path, budget in down((), total).items():
        assert abs(got[path].budget - budget) < 1.001 and got[path].budget <= 2 * got[path].tokens
    assert abs(sum(r.budget for r in got.values()) - total) <= len(leaves)


def test_mix(messy, nothing):
    out = mixing.select_mix(messy, queries.domain_of(F.col("source")), 0.5, {"lang": {"en": 3.0}}, 2)
    rows = out.select("row.*", "n_tokens", "epochs", "in_prefix", "copies", F.col("domain").alias("d"), F.col("lang").alias("l"),
                      F.col("source").alias("s")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.n_tokens == len((r.text or "").encode().split()) and r.copies == r.epochs + r.in_prefix <= 2
        assert r.n_tokens or not r.copies
    taken = sum(r.copies * r.n_tokens for r in rows)
    assert 0.45 * sum(r.n_tokens for r in rows) <= taken <= 1.6 * sum(r.n_tokens for r in rows)
    assert mixing.select_mix(nothing, F.lit("a"), 0.5).count() == 0


def test_pipeline_stages(spark, messy, nothing, tmp_path):
    import corpus_pipeline as P
    os.symlink(f"{SF}/labels.parquet", tmp_path / "labels.parquet")
    for docs in (messy, nothing):
        rows = docs
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, rows, str(tmp_path))
            if i < len(P.STAGES) - 1:
                assert out.schema.simpleString().replace("bigint", "long") == rows.schema.simpleString().replace("bigint", "long")
            rows = P.written(out, "t")
        assert (rows.count() > 0) == (docs is messy)


def test_near_dedup_stage_keeps_one_of_each_group(spark, messy):
    import corpus_pipeline as P
    kept = P.near_dedup(spark, messy, "").select("doc_id", "text").collect()
    fps = [brute_simhash(r.text) for r in kept]
    root = brute_roots([brute_simhash(t) for _, t in ROWS])
    classes = Counter(root[f] for f in fps)
    assert set(classes) == set(root.values()) and max(classes.values()) == 1


def test_pipeline_run(spark):
    import corpus_pipeline as P
    out = P.run(spark, SF)
    assert 0 < out.count() <= 200 and out.where("not round_trip").count() == 0
    assert SCHEMA
