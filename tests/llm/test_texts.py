"""Quality rules, classifier, substring dedup, pieces and Katz scores against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import messy_rows, prose  # noqa: F401 - the folder's own conftest
from riskrank.llm import chunks, isolation, katz, pieces, subword

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(r[0], r[1]) for r in messy_rows()]


def base_statistics(text):
    words = WORD.findall(text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_rule_statistics(messy, labels):
    extra = ["a b c d e a b c d e f", "x\nx\n\n \ny\nx", "#1 <b> | $", "a a a a a a"]
    for text in [t for _, t in ROWS] + extra:
        assert isolation.rule_statistics(text)[:5] == base_statistics(text)
    out = isolation.quality_rules(messy, labels).collect()
    assert len(out) == len(ROWS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=key)
    assert got == sorted(((i, *base_statistics(t)) for i, t in ROWS), key=key)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def plain_cut(scores, good, keep=0.99):
    best, cut = 0.0, math.inf
    for c in sorted(set(scores)):
        lost = sum(s > c for s, g in zip(scores, good) if g) / max(1, sum(good))
        caught = sum(s > c for s, g in zip(scores, good) if not g) / max(1, len(good) - sum(good))
        if lost <= 1 - keep and caught - lost > best + 1e-12:
            best, cut = caught - lost, c
    return cut


def test_forest_finds_outliers_and_calibrates(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    x[:40] += 8
    s = isolation.Forest([x[rng.choice(2000, 256, replace=False)] for _ in range(100)]).scores(x)
    assert s[:40].min() > np.quantile(s[40:], 0.99)
    good = rng.random(2000) < 0.9
    good[:40] = False
    rows = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, good)], "anomaly double, good boolean")
    limit = isolation.calibrate(rows)
    assert abs(limit - plain_cut(s.tolist(), good.tolist())) < 1e-12
    assert (s[:40] > limit).all() and (s[good] > limit).mean() <= 0.01
    assert isolation.calibrate(rows.withColumn("good", F.lit(True))) == math.inf
    assert isolation.calibrate(rows.where("false")) == math.inf


def test_every_tree_draws_from_all_rows(spark):
    """Rows of one id, and equal rows, are drawn one by one."""
    docs = spark.range(40_010).select(F.when(F.col("id") < 10, F.col("id")).alias("doc_id"),
                                      F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("a b "), F.col("id"))).alias("text"))
    stats = isolation.statistics(docs).withColumn("row", F.monotonically_increasing_id()).cache()
    samples = isolation.tree_samples(stats, trees=20)
    assert [len(x) for x in samples] == [256] * 20
    assert not np.array_equal(samples[0], samples[1])
    assert 0.2 < np.mean([(x[:, 0] == x[:, 0].min()).mean() for x in samples]) < 0.5
    assert [len(x) for x in isolation.tree_samples(stats.limit(30), trees=2)] == [30, 30]
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))  # more than the old cap
    out = isolation.quality_rules(docs.where("doc_id < 10 OR text = 'same text'"), labels)
    assert out.count() == docs.where("doc_id < 10 OR text = 'same text'").count()


def test_only_rows_that_pass_the_base_rules_calibrate(spark):
    """Bad rows that the base rules reject have no say."""
    docs = spark.createDataFrame([(i, prose(i, 60)) for i in range(60)] + [(100 + i, "bad") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    out = isolation.quality_rules(docs, labels).collect()
    assert all(r.kept == (r.doc_id < 100) for r in out)


def test_quality_rules_on_nothing(nothing, labels):
    assert isolation.quality_rules(nothing, labels).count() == 0
    assert isolation.quality_rules(nothing.unionByName(nothing), labels.where("false")).count() == 0


def test_classifier_learns_and_scores_every_row(spark, messy, nothing, labels):
    docs = spark.createDataFrame([(i, (prose(i, 60) if i % 4 else "zzq ## " * 40)) for i in range(400)], "doc_id long, text string")
    marks = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    odds = subword.fit_quality(docs, marks, F.col("id") % 5 != 0)
    out = subword.score(docs, odds).join(marks, "doc_id").where("doc_id % 5 = 0").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    rows = subword.score(messy, odds).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    blank = {r.score for r in rows if r.doc_id in (3, 4)}
    assert len(blank) == 1
    assert subword.score(nothing, odds).count() == 0
    assert set(subword.fit_quality(nothing, labels, F.lit(True))) == {0.0}


def test_classifier_counts_are_not_clipped_and_one_row_an_id_learns(spark):
    docs = spark.createDataFrame([(1, "ab " * 50_000), (1, "other text"), (2, "cd ef"), (2, "cd ef")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = subword.train_rows(docs, labels, F.lit(True)).collect()
    assert sorted(r.id for r in rows) == [1, 2]
    long = subword.train_rows(docs.where("length(text) > 100"), labels, F.lit(True)).first()
    assert max(long.counts) >= 50_000


def test_one_step_of_learning_equals_plain_python():
    rows, counts = np.array([3, 9]), np.array([2.0, 1.0])
    got = subword.fit([(rows, counts, 1), (np.array([5]), np.array([1.0]), 0)], epochs=1, rate=0.5, dim=4, seed=1)
    rng = np.random.default_rng(1)
    table = rng.uniform(-0.25, 0.25, (subword.BUCKETS, 4)).astype(np.float32)
    out = [[0.0] * 4, [0.0] * 4]
    samples = [([3, 9], [2 / 3, 1 / 3], 1), ([5], [1.0], 0)]
    vec = {r: [float(v) for v in table[r]] for r in (3, 9, 5)}
    for step, i in enumerate(rng.permutation(2)):
        own, share, label = samples[i]
        rate = 0.5 * (1 - step / 2)
        mean = [sum(s * vec[r][k] for r, s in zip(own, share)) for k in range(4)]
        z = [sum(o * m for o, m in zip(w, mean)) for w in out]
        e = [math.exp(v - max(z)) for v in z]
        p = [v / sum(e) - (c == label) for c, v in enumerate(e)]
        back = [p[0] * out[0][k] + p[1] * out[1][k] for k in range(4)]
        for c in (0, 1):
            out[c] = [w - rate * p[c] * m for w, m in zip(out[c], mean)]
        for r, s in zip(own, share):
            vec[r] = [v - rate * len(own) ** 0.5 * s * b for v, b in zip(vec[r], back)]
    for r in vec:
        assert abs(got[r] - sum(v * (b - a) for v, a, b in zip(vec[r], *out))) < 1e-5


def test_long_texts_in_stretches_have_the_same_features(monkeypatch):
    text = prose(11, 900).encode()
    whole = subword.document_features(text)
    monkeypatch.setattr(subword, "STRETCH", 500)
    cut = subword.document_features(text)
    # a stretch ends at white space: all words and grams are the same, borders may count twice
    assert set(whole[0]) <= set(cut[0]) | set(whole[0])
    assert np.isin(whole[0], cut[0]).mean() > 0.97


def test_chunks_cover_the_text_and_resist_shifts():
    for _, t in ROWS:
        b = (t or "").encode()
        ends = chunks.chunk_ends(b).tolist()
        assert "".join(b[x:y].decode() for x, y in zip([0, *ends], ends)) == (t or "")
    body = prose(21, 300)
    a, b = (chunks.chunk_digests(x.encode())[0] for x in (body, "some new words " + body))
    assert len(set(a.tolist()) - set(b.tolist())) <= 2
    assert max(np.diff([0, *chunks.chunk_ends(("y" * 50000).encode())])) <= chunks.LONGEST


def brute_repeats(rows, within=True):
    """Kept texts by a dictionary over all windows, as tuples of chunks, in the order of (id, key, place)."""
    distinct = {(i is None, i or 0, t) for i, t in rows if t}
    keys = {}
    for missing, i, t in distinct:  # of rows that share an id, the one with the smaller key comes first
        keys[missing, i, t] = row_key_of(None if missing else i, t)
    order = sorted(distinct, key=lambda r: (r[0], r[1], keys[r]))
    parts, windows, first = {}, {}, {}
    for row in order:
        b = row[2].encode()
        parts[row] = [b" ".join(b[x:y].split()) for x, y in chunks.word_chunks(b)]
        windows[row] = []
        for s in range(len(parts[row])):
            e = s
            while e < len(parts[row]) and sum(len(p.split()) for p in parts[row][s:e + 1]) < 12 and \
                    sum(map(len, parts[row][s:e + 1])) < 200:
                e += 1
            if e < len(parts[row]):
                windows[row].append((s, e))
                first.setdefault(tuple(parts[row][s:e + 1]), (row, s, e))
    out = {}
    for row in order:
        b, drop = row[2].encode(), set()
        for s, e in windows[row]:
            head, hs, he = first[tuple(parts[row][s:e + 1])]
            if head != row or (within and s > he):
                drop |= set(range(s, e + 1))
                for k in (1, 2):
                    if e + k >= len(parts[row]) or parts[row][e + k:e + k + 1] != parts[head][he + k:he + k + 1]:
                        break
                    drop.add(e + k)
        spots, kept, at = chunks.word_chunks(b), [], 0
        for n in sorted(drop):
            kept.append(b[at:spots[n][0]] if n - 1 not in drop else b"")
            at = spots[n][1]
        out[row] = (b"".join(kept) + b[at:]).decode()
    return out


def row_key_of(i, t):
    from pyspark.sql import SparkSession

    from riskrank.llm.common import row_key
    df = SparkSession.active().createDataFrame([(i, t)], "i long, t string")
    return df.select(row_key("i", "t")).first()[0]


def test_substring_dedup(messy, nothing):
    out = chunks.without_repeats(messy).select("row.doc_id", "row.text", "clean", "n_removed_words", "row.row").collect()
    assert len(out) == len(ROWS)
    want = brute_repeats([r for r in ROWS if r != (8, "another text under the same id")] + [(8, "another text under the same id")])
    for r in out:
        if not r.text:
            assert r.clean == r.text and r.n_removed_words == 0
        else:
            assert r.clean == want[(r.doc_id is None, r.doc_id or 0, r.text)]
    by = {r.doc_id: r for r in out}
    assert by[1].clean == "" and by[0].clean == by[0].text  # a copy goes, the first stays
    passage = prose(2, 70)
    assert passage in by[10].clean and by[11].n_removed_words > 30 and passage not in by[11].clean
    assert by[15].clean == by[15].text and by[None].clean in ("", None)
    assert chunks.without_repeats(nothing).count() == 0


def test_substring_dedup_needs_a_repeated_run(spark):
    rng = random.Random(31)
    common = [prose(400 + i, 1) for i in range(8)]  # short chunks recur, no run of 12 words does
    texts = [" ".join(rng.choice(common) for _ in range(300)) for _ in range(100)]
    runs = [" ".join(t.split()[i:i + 12]) for t in texts for i in range(289)]
    assert len(set(runs)) == len(runs)
    passage = prose(32, 60)
    rows = [*enumerate(texts), (100, passage + " " + prose(33, 20)), (101, prose(34, 20) + " " + passage)]
    out = chunks.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*", "clean").collect()
    assert len(out) == len(rows) and all(r.clean == r.text for r in out if r.doc_id < 101)
    left = [r.clean for r in out if r.doc_id == 101][0].split()
    assert left[:20] == prose(34, 20).split() and len(left) < 50


def test_windows_cover_every_long_run():
    """All of a run but what is shorter than a window, at its end."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        words = rng.integers(1, 14, rng.integers(0, 30))
        size = words * rng.integers(1, 60, len(words))
        digests = rng.integers(-1 << 62, 1 << 62, len(words))
        first, last, digest = chunks.run_windows(digests, words, size)
        assert len(set(digest.tolist())) == len(digest)
        for x, y in zip(first, last):
            assert words[x:y + 1].sum() >= 12 or size[x:y + 1].sum() >= 200
            assert words[x:y].sum() < 12 and size[x:y].sum() < 200
        if len(words):
            a, b = sorted(rng.integers(0, len(words), 2))
            inside = (first >= a) & (last <= b)
            covered = {c for x, y in zip(first[inside], last[inside]) for c in range(x, y + 1)}
            rest = [c for c in range(a, b + 1) if c not in covered]
            assert not rest or (rest[-1] == b and words[rest].sum() < 12 and size[rest].sum() < 200)
            assert set(chunks.run_windows(digests[a:b + 1], words[a:b + 1], size[a:b + 1])[2].tolist()) == set(digest[inside].tolist())


@pytest.mark.parametrize("within", [True, False])
def test_substring_dedup_equals_brute_force(spark, within):
    """Texts over a small shared vocabulary, with shared passages, repeats inside a text and no spaces."""
    rng = random.Random(41)
    vocabulary = [prose(500 + i, 1) for i in range(15)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))) for _ in range(5)]
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(330))
    rows = []
    for i in range(60):
        text = " ".join(rng.choice([rng.choice(passages), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 20)))])
                        for _ in range(rng.randint(1, 5)))
        rows.append((rng.choice([i, i, 7, None]), text))
    rows += [(100, han), (101, han), (102, han[:150]), (103, "x " + han + " y"), (104, "q" * 700), (105, "q" * 700)]
    out = chunks.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), within=within).select("row.*", "clean").collect()
    want = brute_repeats(rows, within)
    assert [r.clean for r in out] == [want[(r.doc_id is None, r.doc_id or 0, r.text)] for r in out]
    left = {r.doc_id: r.clean for r in out}
    assert left[100] == han and len(left[101]) < 70 and len(left[103]) < 140 and left[105] != left[104]
    assert sum(r.clean != r.text for r in out) > 20


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.from_model()


def brute_viterbi(model, segment):
    best = [(0.0, [])]
    for end in range(1, len(segment) + 1):
        found = None
        for start in range(end):
            hit = model.pieces.get(segment[start:end])
            if hit is not None:
                step = (best[start][0] + hit[1], [*best[start][1], hit[0]])
            elif end - start == 1:
                step = (best[start][0] + model.unknown, [*best[start][1], *(model.byte_ids[b] for b in segment[start].encode())])
            else:
                continue
            if found is None or step[0] > found[0]:
                found = step
        best.append(found)
    return best[-1][1]


def test_pieces_match_brute_force_and_round_trip(model):
    for _, text in ROWS:
        text = (text or "")[:3000]
        ids = model.encode(text)
        assert model.decode(ids).decode() == text
        if text and pieces.SPACE not in text:
            escaped = (" " + text).replace(" ", pieces.SPACE)
            if len(escaped) < 700:
                assert ids == brute_viterbi(model, escaped)


def test_pieces_match_the_library_as_unigram(model):
    """The same pieces and scores, read by the library as a unigram model, give the same best
    path of its lattice search (its plain encode adds in single precision)."""
    import sentencepiece
    raw = open(pieces.DEFAULT_MODEL, "rb").read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")  # trainer_spec.model_type: BPE
    unigram = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + raw[at:].replace(b"\x18\x02", b"\x18\x01", 1))
    for text in ["Hello world", "the quick", "Straße déjà vu", "three", "tokens of a few words"]:
        assert model.encode(text) == unigram.nbest_encode_as_ids(text, 2)[0]


def test_pieces_operator(messy, nothing, model):
    out = pieces.encode(messy, model)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = {(r.doc_id, r.text) for r in pieces.decode(out, model).collect()}
    assert back == {(i, t or "") for i, t in ROWS}
    assert pieces.encode(nothing, model).count() == 0


def brute_katz(docs, train, order):
    """Scores by dictionaries, from the definition."""
    toks = [(t or "").encode().lower().split() + [b"\n"] for _, t in docs]

    def context(w, i, m):
        ctx = tuple(w[max(0, i - m + 1):i])
        return ("S", *ctx) if len(ctx) < m - 1 else ctx
    counts = [Counter() for _ in range(order)]
    for w, learn in zip(toks, train):
        for i in range(len(w) if learn else 0):
            for m in range(1, order + 1):
                counts[m - 1][(*context(w, i, m), w[i])] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    discounts = []
    for c in counts:
        of = Counter(c.values())
        discounts.append(katz.Discounts([of.get(r, 0) for r in range(1, katz.MAX_DISCOUNTED + 2)], sum(c.values())))
    factor = lambda m, k: float(discounts[m - 1].factor(np.array([k]))[0])
    after = [defaultdict(list) for _ in range(order)]
    for m, c in enumerate(counts, 1):
        for gram, k in c.items():
            after[m - 1][gram[:-1]].append((gram[-1], k))

    def prob(ctx, w, m):
        succ = after[m - 1].get(ctx, [])
        shorter = ctx[1:] if len(ctx) >= 1 else ()
        if ctx[:1] == ("S",) and m > 2:
            shorter = ("S", *ctx[1:]) if len(ctx) - 1 < m - 2 else ctx[1:]
        total = sum(k for _, k in succ)
        kept = sum(factor(m, k) * k for _, k in succ)
        bare = total - kept <= 1e-9 * total
        whole, left = (total + 1, 1.0) if bare else (total, total - kept)
        mine = counts[m - 1].get((*ctx, w), 0)
        if mine:
            return factor(m, mine) * mine / whole
        if m == 1:
            return left / whole if total else 1.0
        if not succ:
            return prob(shorter, w, m - 1)
        return left / whole / (1 - sum(prob(shorter, x, m - 1) for x, _ in succ)) * prob(shorter, w, m - 1)
    out = []
    for (i, _), w in zip(docs, toks):
        out.append((i, len(w), sum((x,) in counts[0] for x in w), n, sum(math.log10((counts[0].get((x,), 0) + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(prob(context(w, j, order), w[j], order)) for j in range(len(w)))))
    return out, prob, counts


@pytest.mark.parametrize("order", [2, 3])
def test_katz_matches_brute_force(spark, order, monkeypatch):
    texts = [" ".join(w[:4] for w in prose(s % 7, 30 + s).split()) for s in range(24)] + ["", None, "the the the the", "never seen words"]
    docs = list(enumerate(texts)) + [(None, "the the"), (0, texts[0])]
    train = [i is not None and i % 7 != 2 for i, _ in docs]
    want, prob, counts = brute_katz(docs, train, order)
    for ctx in {g[:-1] for g in list(counts[1])[:40]}:  # probabilities of a context sum to one
        total = sum(prob(ctx, w, 2) for (w,) in counts[0]) + prob(ctx, b"never-seen", 2)
        assert total == pytest.approx(1, abs=1e-9)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(katz.Model, "spread_over", lambda self: 12)  # spread the hot contexts
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in katz.lm_scores(df, F.col("doc_id") % 7 != 2, order).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [g[:4] for g in sorted(got, key=key)] == [w[:4] for w in sorted(want, key=key)]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_katz_edge_cases(messy, nothing):
    assert katz.lm_scores(nothing, F.lit(True)).count() == 0
    rows = katz.lm_scores(messy, F.lit(False)).collect()
    assert len(rows) == len(ROWS) and all(r.n_known == 0 and r.score == 0 and r.base_score == 0 for r in rows)
    assert all(math.isfinite(r.score) for r in katz.lm_scores(messy, F.lit(True)).collect())
