"""Split quotas and stability; encoders' edge cases; names; replies; draws."""

import pytest
from pyspark.sql import functions as F

from riskrank.operators import dedupe, encode, prompts, split, tfidf


def _data(spark, n=2000, pos_every=20):
    return spark.createDataFrame([(i, int(i % pos_every == 0)) for i in range(n)],
                                 "job_id long, fraudulent int")


def test_split_quotas_disjoint_and_stable(spark):
    df = _data(spark)
    a = split.stratified_split(df).select("job_id", "split")
    rows = {r.job_id: r.split for r in a.collect()}
    assert len(rows) == 2000
    counts = a.groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in counts}
    q = split.split_quotas({0: 1900, 1: 100}, 0.15, 0.15)
    assert sizes["test"] == q[0][0] + q[1][0] == 300
    assert sizes["val"] == q[0][1] + q[1][1]
    b = split.stratified_split(df.repartition(11)).select("job_id", "split")
    assert {r.job_id: r.split for r in b.collect()} == rows
    c = split.stratified_split(df.repartition(3), bucket_bits=4).select("job_id", "split")
    assert {r.job_id: r.split for r in c.collect()} == rows


def test_reference_split_sizes():
    q = split.split_quotas({0: 17599 - 850, 1: 850}, 0.15, 0.15)
    test = sum(v[0] for v in q.values())
    val = sum(v[1] for v in q.values())
    assert (17599 - test - val, val, test) == (12319, 2640, 2640)


def test_onehot_rare_bucket(spark):
    rows = [("a",)] * 10 + [("b",)] * 9 + [("c",)] * 12
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(rows)], "job_id long, k string, z string")
    m = encode.fit_onehot(df, ["k", "z"], min_frequency=10)
    slots = {(r.feature, r.category): r.slot for r in m.slots.collect()}
    assert slots == {("k", "a"): 0, ("k", "c"): 1, ("k", None): 2, ("z", "x"): 3}
    new = spark.createDataFrame([(1, "b", "x"), (2, "zz", "y"), (3, None, "x")], "job_id long, k string, z string")
    got = {r.job_id: (r.slot_k, r.slot_z) for r in m.transform(new).collect()}
    assert got == {1: (2, 3), 2: (2, None), 3: (None, 3)}


def test_scaler_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = encode.fit_scaler(df, ["a", "b"])
    assert m.values == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    out = m.transform(df).collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.b for r in out] == [0.0, 0.0]


def test_sanitize_names(spark):
    names = spark.createDataFrame([(0, "Health, A"), (1, "Health; A"), (2, "&&&"), (3, "ok")],
                                  "idx long, name string")
    got = [r.safe_name for r in encode.sanitize_names(names).orderBy("idx").collect()]
    assert got == ["Health_A", "Health_A__1", "feature", "ok"]


def test_reply_parsing(spark):
    rows = [(1, "end_turn", '{"fraud_probability": 0.3, "reason": "ok"}'),
            (2, "end_turn", '{"fraud_probability": 1.4, "reason": "hi"}'),
            (3, "end_turn", "nope {"),
            (4, "end_turn", '{"reason": "no number"}'),
            (5, "refusal", None), (6, "max_tokens", '{"fraud_probability": 0.1'),
            (7, "end_turn", None)]
    df = spark.createDataFrame(rows, "job_id long, stop_reason string, body string")
    got = {r.job_id: (r.fraud_probability, r.reason) for r in prompts.parse_replies(df).collect()}
    assert got == {1: (0.3, "ok"), 2: (1.0, "hi"), 3: (None, "unparseable JSON"), 4: (None, "no number"),
                   5: (None, "refused"), 6: (None, "truncated at max_tokens"),
                   7: (None, "no text block returned")}


def test_quota_sample_and_render(spark):
    df = _data(spark, 400)
    s = prompts.quota_sample(df, "fraudulent", {1: 5, 0: 15}, F.xxhash64("job_id", F.lit(42)))
    c = {r.fraudulent: r["count"] for r in s.groupBy("fraudulent").count().collect()}
    assert c == {1: 5, 0: 15}
    assert sorted(r.ord for r in s.collect()) == list(range(1, 21))
    p = spark.createDataFrame([(1, "T", None, "  ", 1)], "job_id long, title string, location string, "
                              "department string, has_company_logo int")
    fields = [("Title", "title"), ("Location", "location"), ("Department", "department"),
              ("Has company logo", "has_company_logo")]
    txt = p.select(prompts.render_posting(30, fields).alias("t")).first().t
    full = "Title: T\nLocation: (missing)\nDepartment: (missing)\nHas company logo: 1"
    assert txt == full[:30]


def test_svd_projection_matches_numpy(spark):
    import numpy as np
    from riskrank.operators.models import SvdModel
    rng = np.random.default_rng(0)
    comp = rng.normal(size=(6, 3))
    m = SvdModel(comp, np.ones(3))
    long = spark.createDataFrame([(1, 0, 0.5), (1, 4, 2.0), (2, 5, -1.0), (3, 1, 1.0), (3, 1, 0.0)],
                                 "id long, term_id int, weight double")
    got = {r.id: r.svd.toArray() for r in m.transform_long(long).collect()}
    assert np.allclose(got[1], 0.5 * comp[0] + 2.0 * comp[4])
    assert np.allclose(got[2], -comp[5])
    assert np.allclose(got[3], comp[1])
    lists = spark.createDataFrame([(1, [0, 4], [0.5, 2.0]), (2, [5], [-1.0]), (3, [1], [1.0])], "id long, _i array<int>, _v array<double>")
    got2 = {r.id: r.svd.toArray() for r in m.transform_long(lists).collect()}
    assert all(np.allclose(got[i], got2[i]) for i in got)


def test_randomized_svd_matches_numpy(spark):
    import numpy as np
    from riskrank.operators.models import fit_svd
    rng = np.random.default_rng(1)
    x = rng.random((60, 25)) * (rng.random((60, 25)) < 0.3)
    x[:, 3] += 2.0 * x[:, 7]  # a dominant direction
    rows = [(i, j, float(x[i, j])) for i in range(60) for j in range(25) if x[i, j] != 0]
    long = spark.createDataFrame(rows, "id long, term_id int, weight double")
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    v = vt[:5].T
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(5)])
    exact = fit_svd(long, 25, 5, n_oversamples=20, n_iter=2)  # sketch spans every term
    assert np.allclose(exact.singular_values, s[:5], rtol=1e-9)
    assert np.allclose(exact.components, v, atol=1e-8)
    approx = fit_svd(long, 25, 5, n_oversamples=10, n_iter=5)  # default oversampling
    assert np.allclose(approx.singular_values, s[:5], rtol=1e-3)
    assert abs(approx.singular_values[0] - s[0]) < 1e-9


def test_svd_of_lists_over_many_terms_and_tasks(spark, monkeypatch):
    import numpy as np
    from riskrank.operators import models
    rng = np.random.default_rng(2)
    x = rng.random((40, 2500)) * (rng.random((40, 2500)) < 0.05)
    x[5] = x[17] = 0.0  # rows without entries
    x[:, :3] *= 4.0
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    lists = spark.createDataFrame(rows, "id long, _i array<int>, _v array<double>").repartition(5)
    s, vt = np.linalg.svd(x, full_matrices=False)[1:]
    got = models.fit_svd(lists, 2500, 6, n_oversamples=34, n_iter=2)  # the sketch spans every row
    assert np.allclose(got.singular_values, s[:6], rtol=1e-9)
    assert np.allclose(np.abs(got.components), np.abs(vt[:6].T), atol=1e-8)
    proj = {r.id: r.svd.toArray() for r in got.transform_long(lists).collect()}
    assert len(proj) == 40 and all(np.allclose(proj[i], x[i] @ got.components) for i in proj)
    # products cut into pieces inside a row give the same sums
    row, index = np.nonzero(x)
    m = rng.standard_normal((2500, 7))
    monkeypatch.setattr(models, "CHUNK_CELLS", 7 * 13)
    assert np.allclose(models._row_sums(row, index, x[row, index], m, np.zeros((40, 7))), x @ m)


@pytest.mark.parametrize("n", [1, 4, 7, 11, 40, 100])
def test_most_frequent_terms_are_cut_inside_ties_by_term(spark, n):
    terms = [(f"{a}{b}", 1, t) for a in ("a", "abc", "abd", "zé") for b in ("", "x", "yy", "zzz", "é")
             for t in [3 if a != "abc" else 5]] + [("top", 1, 9)]
    got = tfidf.most_frequent(spark.createDataFrame(terms, "term string, df long, total long"), n).collect()
    want = sorted(terms, key=lambda r: (-r[2], r[0].encode()))[:n]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_exact_dedupe_compares_only_rows_with_a_repeated_hash(spark):
    rows = [(1, "a", None), (2, "a", None), (2, "a", None), (3, "a", "null"), (4, None, "a"), (None, "b", "b"),
            (7, "b", "b"), (8, "", None), (9, None, None), (5, "x", "y"), (5, "x", "y")]
    df = spark.createDataFrame(rows, "job_id long, p string, q string")
    got = sorted(dedupe.drop_duplicates_except_id(df).collect(), key=repr)
    assert got == sorted(df.groupBy("p", "q").agg({"job_id": "min"}).select("min(job_id)", "p", "q").collect(), key=repr)
    assert tuple(dedupe.duplicate_report(df).first()) == (11, 7, 4)
    assert dedupe.drop_duplicates_except_id(df.limit(0)).count() == 0


def test_rare_and_unseen_categories_share_the_bucket(spark):
    df = spark.createDataFrame([("b",)] * 3 + [("a",)] * 2 + [("c",)] + [(None,)], "k string")
    m = encode.fit_onehot(df, ["k"], min_frequency=2)
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "k string")
    assert {r["k"]: r["slot_k"] for r in m.transform(new).collect()} == {"a": 0, "b": 1, "c": 2, "new": 2, None: None}
    assert m.n_slots == 3
