"""Ranking metrics: the hand-checked example, invariances and edge cases."""

import pytest
from pyspark.sql import functions as F

from riskrank.operators import curves, running

EXAMPLE = [(0.9, 1), (0.8, 0), (0.8, 1), (0.6, 0), (0.5, 1), (0.4, 0), (0.2, 0)]


def _scores(spark, pairs, extra=None):
    rows = [(i, float(s), int(y)) for i, (s, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "job_id long, y_proba double, y_true int")


def test_hand_example(spark):
    c = curves.curve_table(_scores(spark, EXAMPLE))
    r = curves.ranking_summary(c).first()
    assert r.average_precision == pytest.approx(0.755556, abs=1e-6)
    assert r.roc_auc == pytest.approx(0.791667, abs=1e-6)


def test_monotone_invariance_and_buckets(spark):
    import random
    rnd = random.Random(7)
    pairs = [(round(rnd.random(), 2), int(rnd.random() < 0.1)) for _ in range(3000)]
    s = _scores(spark, pairs)
    base = None
    for b in (1, 4, 17):
        r = curves.ranking_summary(curves.curve_table(s, buckets=b)).first()
        if base is None:
            base = r
        assert r.average_precision == pytest.approx(base.average_precision, abs=1e-12)
        assert r.roc_auc == pytest.approx(base.roc_auc, abs=1e-12)
    t = s.withColumn("y_proba", F.col("y_proba") * 3 + 1)
    r2 = curves.ranking_summary(curves.curve_table(t)).first()
    assert r2.average_precision == pytest.approx(base.average_precision, abs=1e-12)
    # brute force AP / AUC
    P = sum(y for _, y in pairs)
    N = len(pairs) - P
    ap = 0.0
    for thr in sorted({sc for sc, _ in pairs}, reverse=True):
        tp = sum(1 for sc, y in pairs if sc >= thr and y == 1)
        fl = sum(1 for sc, _ in pairs if sc >= thr)
        pos = sum(1 for sc, y in pairs if sc == thr and y == 1)
        ap += pos / P * tp / fl
    auc = sum((1.0 if a > b else 0.5 if a == b else 0.0)
              for a, ya in pairs if ya == 1 for b, yb in pairs if yb == 0) / (P * N)
    assert base.average_precision == pytest.approx(ap, abs=1e-9)
    assert base.roc_auc == pytest.approx(auc, abs=1e-9)


def test_constant_score_ap_is_prevalence(spark):
    pairs = [(0.3, 1), (0.3, 0), (0.3, 0), (0.3, 0)]
    r = curves.ranking_summary(curves.curve_table(_scores(spark, pairs))).first()
    assert r.average_precision == pytest.approx(0.25)
    assert r.roc_auc == pytest.approx(0.5)


def test_thresholds(spark):
    c = curves.curve_table(_scores(spark, EXAMPLE))
    assert tuple(curves.threshold_for_precision(c, 0.99).first()) == (0.9, pytest.approx(1 / 3))
    assert tuple(curves.threshold_for_precision(c, 1.01).first()) == (1.0, 0.0)
    # ties in F-beta go to the lowest threshold: two tied scores
    tied = [(0.7, 1), (0.6, 1), (0.2, 0)]
    c2 = curves.curve_table(_scores(spark, tied))
    r = curves.tune_threshold(c2, 1.0).first()
    assert r.threshold == 0.6 and r.score == pytest.approx(1.0)
    # all-equal scores: the only threshold
    c3 = curves.curve_table(_scores(spark, [(0.5, 1), (0.5, 0)]))
    assert curves.tune_threshold(c3, 2.0).first().threshold == 0.5


def test_evaluate_at_threshold(spark):
    c = curves.curve_table(_scores(spark, EXAMPLE))
    r = curves.evaluate(c, 0.5).first()
    # flagged: 0.9/1 0.8/0 0.8/1 0.6/0 0.5/1 -> tp 3 fp 2 fn 0 tn 2
    assert r.precision == pytest.approx(0.6) and r.recall == pytest.approx(1.0)
    assert r.f1 == pytest.approx(0.75) and r.accuracy == pytest.approx(5 / 7)
    m = curves.metrics_at_threshold(_scores(spark, EXAMPLE), 0.5).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 2, 0, 2)


def test_exact_quantiles_skewed_group(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    hot = rng.integers(0, 50, 5000)          # one group holding most rows
    cold = rng.normal(size=300)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): r.value for r in running.exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"], buckets=7).collect()}
    for g, arr in (("hot", hot.astype(float)), ("cold", cold)):
        for p in (0.25, 0.5, 0.9):
            assert got[(g, p)] == pytest.approx(float(np.quantile(arr, p)), abs=1e-9)


def test_roc_corners_across_buckets(spark):
    import random
    rnd = random.Random(11)
    pairs = [(round(rnd.random(), 1), int(rnd.random() < 0.3)) for _ in range(400)]
    pairs += [(0.05 * k, 0) for k in range(20)]  # runs of pure negatives -> collinear points
    s = _scores(spark, pairs)
    got = sorted(r.threshold for r in curves.roc_curve(curves.curve_table(s, buckets=6),
                                                       drop_intermediate=True).collect())
    thr = sorted({sc for sc, _ in pairs}, reverse=True)
    pos = [sum(1 for sc, y in pairs if sc == t and y == 1) for t in thr]
    neg = [sum(1 for sc, y in pairs if sc == t and y != 1) for t in thr]
    keep = [t for i, t in enumerate(thr)
            if i == 0 or i == len(thr) - 1 or pos[i + 1] != pos[i] or neg[i + 1] != neg[i]]
    assert got == sorted(keep + [float("inf")])


def test_running_totals_of_many_groups_with_a_hot_one(spark):
    """Beyond the broadcast size the groups share one range exchange: a group with half of the
    rows is cut into many ranges, and sums, NULL group included, stay exact."""
    from riskrank.operators.running import bucket_by_range, exact_quantiles, running_totals
    n, groups = 60_000, 3_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 1001 == 0, F.lit(None)).otherwise(F.col("id") % groups).alias("g"),
        (F.col("id") * 7919 % 100_003).alias("v"), (F.col("id") % 5).alias("n"))
    pdf = rows.toPandas()
    buckets = bucket_by_range(rows, "v", ["g"], 16)
    assert buckets.where("g = 0").groupBy("_bucket").count().agg(F.max("count")).first()[0] < n // 5
    for descending in (False, True):
        got = running_totals(rows, "v", ["n"], ["g"], descending, buckets=16).toPandas()
        order = pdf.sort_values("v", ascending=not descending)
        want = order.assign(cum=order.groupby("g", dropna=False)["n"].cumsum(),
                            tot=order.groupby("g", dropna=False)["n"].transform("sum"))
        both = got.merge(want, on=["g", "v"], suffixes=("", "_w"))
        assert len(got) == len(both) == n
        assert (both["cum_n"] == both["cum"]).all() and (both["tot_n"] == both["tot"]).all()
    q = exact_quantiles(rows.where("g is not null"), "v", [0.5], ["g"]).toPandas().set_index("g")["value"]
    want = pdf.dropna().groupby("g")["v"].median()
    assert len(q) == len(want) and (q.sort_index() - want.sort_index()).abs().max() < 1e-9
