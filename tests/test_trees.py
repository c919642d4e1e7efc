"""The booster against a plain one, early stopping, gains, Shapley values and the search."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskrank.operators import booster, search, trees
from riskrank.plans import train as T
from riskrank.plans import tuning

SMALL = {"n_estimators": 6, "min_child_samples": 5, "num_leaves": 6}


@pytest.fixture(scope="module")
def rows(spark):
    u = [(F.xxhash64("job_id", F.lit(j)) % 1000 / 1000.0).alias(f"x{j}") for j in range(3)]
    df = spark.range(300).withColumnRenamed("id", "job_id").select("job_id", *u)
    return df.withColumn("fraudulent", (F.col("x0") + 0.3 * F.col("x1") > 0.2).cast("int")) \
             .withColumn("features", array_to_vector(F.array("x0", "x1", "x2"))) \
             .withColumn("split", F.when(F.col("job_id") % 5 == 0, "val").when(F.col("job_id") % 5 == 1, "test")
                         .otherwise("train")).repartition(3).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return booster.fit_boosters(rows.where("split = 'train'"), [booster.BoostParams(**SMALL)])[0]


def matrix(df):
    got = df.orderBy("job_id").collect()
    return np.array([r["features"].toArray() for r in got]), np.array([r["fraudulent"] for r in got])


def plain_booster(x, y, cuts, p, weight):
    """One leaf at a time, one split at a time, over Python lists; all rows and columns."""
    share = weight * y.mean() / (weight * y.mean() + 1 - y.mean())
    margin = np.full(len(y), math.log(share / (1 - share)))
    w = np.where(y == 1, weight, 1.0)

    def score(g, h):
        return max(abs(g) - p.reg_alpha, 0) ** 2 / (h + p.reg_lambda)

    def best(idx, g, h):
        found = None
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                left, right = [i for i in idx if x[i, f] <= cut], [i for i in idx if x[i, f] > cut]
                if min(len(left), len(right)) < p.min_child_samples or min(h[left].sum(), h[right].sum()) < p.min_child_weight:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[idx].sum(), h[idx].sum())
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left, right)
        return found
    for _ in range(p.n_estimators):
        q = 1 / (1 + np.exp(-margin))
        g, h = w * (q - y), w * q * (1 - q)
        leaves = [(list(range(len(y))), best(list(range(len(y))), g, h))]
        while len(leaves) < p.num_leaves and any(b for _, b in leaves):
            at = max((i for i, (_, b) in enumerate(leaves) if b), key=lambda i: leaves[i][1][0])
            _, (_, left, right) = leaves.pop(at)
            leaves += [(left, best(left, g, h)), (right, best(right, g, h))]
        for idx, _ in leaves:
            total = g[idx].sum()
            margin[idx] -= p.learning_rate * math.copysign(max(abs(total) - p.reg_alpha, 0), total) / (h[idx].sum() + p.reg_lambda)
    return margin


@pytest.mark.parametrize("small_rows", [4096, 40, 0])
@pytest.mark.parametrize("extra", [{}, {"reg_alpha": 0.4, "reg_lambda": 0.1, "num_leaves": 4}])
def test_booster_equals_a_plain_one(rows, monkeypatch, small_rows, extra):
    monkeypatch.setattr(booster, "SMALL_ROWS", small_rows)
    p = booster.BoostParams(**{**SMALL, "subsample": 1.0, "colsample": 1.0, "learning_rate": 0.3, **extra})
    part = rows.where("job_id < 200")
    fit = booster.fit_boosters(part, [p], bins=16)[0]
    x, y = matrix(part)
    want = plain_booster(x, y, booster.bin_bounds(part, bins=16), p, (y == 0).sum() / (y == 1).sum())
    got = sum((trees.leaf_values(t, x) for t in fit.boosted.trees), np.full(len(x), fit.boosted.base))
    assert len(fit.boosted.trees) == fit.best == p.n_estimators
    assert np.abs(got - want).max() < 1e-9
    assert max((t.feature < 0).sum() for t in fit.boosted.trees) <= p.num_leaves


def test_growing_by_passes_and_in_one_task_give_the_same(rows, monkeypatch):
    p = [booster.BoostParams(**SMALL), booster.BoostParams(**{**SMALL, "learning_rate": 0.2, "seed": 7})]
    part = rows.where("split = 'train'")
    one = booster.fit_boosters(part, p)
    monkeypatch.setattr(booster, "SMALL_ROWS", 0)
    monkeypatch.setattr(booster, "BLOCK_BYTES", 100)
    two = booster.fit_boosters(part.repartition(7), p)
    x, _ = matrix(rows)
    for a, b in zip(one, two):
        for s, t in zip(a.boosted.trees, b.boosted.trees):
            assert np.allclose(trees.leaf_values(s, x), trees.leaf_values(t, x))
    alone = booster.fit_boosters(part, p[1:])[0]
    assert all(np.allclose(trees.leaf_values(s, x), trees.leaf_values(t, x)) for s, t in zip(one[1].boosted.trees, alone.boosted.trees))


def test_missing_values_go_right_and_one_class_gives_no_tree(spark):
    rng = np.random.default_rng(2)
    data = [(i, float("nan") if i % 4 == 0 else float(rng.normal()), int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(data, "job_id long, x double, fraudulent int").withColumn("features", array_to_vector(F.array("x")))
    fit = booster.fit_boosters(df, [booster.BoostParams(**SMALL)])[0]
    scores = {r["job_id"]: r["y_proba"] for r in trees.score_prefix(fit.boosted, df, fit.best).collect()}
    assert min(scores[i] for i in range(0, 120, 4)) > max(scores[i] for i in range(120) if i % 4)
    none = booster.fit_boosters(df.where("fraudulent = 0"), [booster.BoostParams(**SMALL)])[0]
    assert none.boosted.trees == [] and none.best == 0
    assert booster.fit_boosters(df.limit(0), [booster.BoostParams(**SMALL)])[0].best == 0


def average_precision(scores):
    total, hits, seen, out = sum(y for _, y in scores), 0, 0, 0.0
    for cut in sorted({p for p, _ in scores}, reverse=True):
        new = [y for p, y in scores if p == cut]
        hits, seen = hits + sum(new), seen + len(new)
        out += sum(new) / total * hits / seen
    return out


def test_the_stop_is_inside_the_loop(rows):
    p = [booster.BoostParams(**{**SMALL, "n_estimators": 40}), booster.BoostParams(**{**SMALL, "n_estimators": 40, "learning_rate": 0.5})]
    val = rows.where("split = 'val'")
    for fit in booster.fit_boosters(rows.where("split = 'train'"), p, val, patience=4):
        n = len(fit.boosted.trees)
        assert [k for k, _ in fit.history] == list(range(1, n + 1))
        aps = [average_precision([(r["y_proba"], r["y_true"]) for r in trees.score_prefix(fit.boosted, val, k).collect()])
               for k in range(1, n + 1)]
        assert np.allclose([ap for _, ap in fit.history], aps)
        assert fit.best == aps.index(max(aps)) + 1 and n == min(40, fit.best + 4)
        for k in range(1, n):  # no earlier round could have ended it
            assert k < aps[:k].index(max(aps[:k])) + 1 + 4


def test_gain_ranks_the_feature_that_decides_first(spark, fitted):
    names = spark.createDataFrame([(0, "svd_0", "svd"), (1, "b", "numeric"), (2, "c", "numeric")],
                                  "idx long, safe_name string, block string")
    top = trees.top_gain(trees.gain_table(fitted.boosted, names), 2, 1).collect()
    assert [(r["listing"], r["rank"], r["feature"]) for r in sorted(top, key=lambda r: (r["listing"], r["rank"]))] \
        == [("all", 1, "svd_0"), ("all", 2, "b"), ("outside text", 1, "b")]


def known_value(tree, x, known):
    """The expected leaf value of a row when only the features in ``known`` are known."""
    def at(node):
        if tree.feature[node] < 0:
            return tree.value[node]
        left, right = int(tree.left[node]), int(tree.right[node])
        if tree.feature[node] in known:
            return at(left if x[tree.feature[node]] <= tree.threshold[node] else right)
        return (at(left) * tree.rows[left] + at(right) * tree.rows[right]) / tree.rows[node]
    return at(0)


def test_shapley_values_equal_the_sum_over_all_subsets(rows, fitted):
    x, _ = matrix(rows.where("job_id < 25"))
    x[3, 0] = np.nan
    got = trees.shapley_of(fitted.boosted.trees, x)
    n = x.shape[1]
    for r in range(len(x)):
        for i in range(n):
            want = 0.0
            others = [j for j in range(n) if j != i]
            for size in range(n):
                for s in itertools.combinations(others, size):
                    share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    want += share * sum(known_value(t, x[r], {*s, i}) - known_value(t, x[r], set(s)) for t in fitted.boosted.trees)
            assert abs(got[r, i] - want) < 1e-9


def test_contributions_and_base_add_up_to_the_margin(rows, fitted):
    proba = {r["job_id"]: r["y_proba"] for r in trees.score_prefix(fitted.boosted, rows, 6).collect()}
    out = trees.contributions(fitted.boosted, rows).collect()
    assert len(out) == 300
    for r in out:
        margin = sum(r["contributions"]) + r["base"]
        assert abs(margin - r["margin"]) < 1e-9 and abs(1 / (1 + math.exp(-margin)) - proba[r["job_id"]]) < 1e-9


def test_embedding_head_kinds(rows):
    part = rows.where("split = 'train'")
    assert len(T.embedding_head(part, "trees", n_estimators=2).boosted.trees) == 2
    assert T.embedding_head(part, "logistic", max_iter=5).coefficients.size == 3
    with pytest.raises(ValueError, match="unknown kind"):
        T.embedding_head(part, "forest")


def test_draws_are_uncorrelated_and_inside_their_ranges():
    rows = [search.booster_params(t) for t in range(400)]
    draws = np.array([[search.draw(t, j) for j in range(7)] for t in range(400)])
    assert np.abs(np.corrcoef(draws.T) - np.eye(7)).max() < 0.2
    for name, low, high, *kind in search.BOOSTER_SPACE:
        values = [r[name] for r in rows]
        assert low <= min(values) and max(values) <= high and (not kind[1] or isinstance(values[0], int))
        for v in values[:20]:
            back = search.scaled(search.unscaled(v, low, high, *kind), low, high, *kind)
            assert back == v if kind[1] else abs(back - v) < 1e-9 * high


def test_parzen_densities_integrate_to_one_and_samples_follow_them():
    for points in ([], [0.5], [0.0, 0.1, 0.15, 1.0]):
        p = search.Parzen(points)
        grid = (np.arange(4000) + 0.5) / 4000
        density = np.array([p.density(x) for x in grid])
        assert abs(density.mean() - 1.0) < 1e-3
        samples = np.array([p.sample((i + 0.5) / 60, (j + 0.5) / 60) for i in range(60) for j in range(60)])
        assert abs(samples.mean() - (grid * density).mean()) < 0.02 and 0 <= samples.min() and samples.max() <= 1


def test_parzen_search_beats_random_draws():
    """A known optimum: later trials come nearer to it than the random ones."""
    def score(v):
        return -abs(math.log(v["learning_rate"] / 0.05)) - abs(v["subsample"] - 0.9) * 5
    done = []
    for t in range(80):
        v = search.tpe_params(done, t)
        done.append((v, score(v)))
    assert np.mean([s for _, s in done[40:]]) > np.mean([s for _, s in done[:10]]) + 0.3
    assert [search.tpe_params(done[:20], 20) for _ in range(2)][0] == search.tpe_params(done[:20], 20)


def test_search_refit_logs_and_saves(spark, rows, tmp_path, monkeypatch):
    from riskrank.sources import io
    monkeypatch.setattr(tuning, "STARTUP", 2)
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    log, scores = str(tmp_path / "log"), str(tmp_path / "scores")
    calls = []
    real = booster.fit_boosters
    monkeypatch.setattr(booster, "fit_boosters", lambda *a, **k: calls.append(len(a[1])) or real(*a, **k))
    trials = tuning.booster_search(train, val, n_trials=4, n_estimators=3, log_path=log)
    assert [r["trial"] for r in trials.collect()] == [0, 1, 2, 3] and calls == [2, 2]
    report = tuning.refit_best(trials, train, rows, "tuned", log, scores, n_estimators=3).collect()
    assert {r["split"] for r in report} >= {"val", "test"}
    assert io.load_experiments(spark, log, None).count() == 4 + len(report)
    assert io.scan_scores(spark, scores).count() == rows.where("split = 'test'").count()
    effect = {r["param"]: r["effect"] for r in search.param_effect(trials, names=tuning.NAMES).collect()}
    assert set(effect) == set(tuning.NAMES) and all(0 <= v <= 1 + 1e-9 for v in effect.values())


def test_registered_tree_queries_give_rows(spark):
    """Whole runs on the smallest tables: the early stop fires, and all queries share one fit."""
    from riskrank.plans import queries_models as Q
    sf = "/root/testdata/sf0.001"
    history = Q.gbt_best_prefix(spark, sf, patience=10, k=5).collect()
    best = [r["n_trees"] for r in history if r["chosen"]]
    assert len(best) == 1 and len(history) == best[0] + 10 < 1000
    n_fits = len(Q._FITTED)
    assert Q.gbt_meta(spark, sf, patience=10, k=5).count() > 0
    assert Q.gain_importance(spark, sf, patience=10, k=5).count() == 37
    assert Q.tree_contributions(spark, sf, patience=10, k=5).count() == 20
    assert Q.gbt_early_stopped(spark, sf, patience=10, k=5).count() > 0
    assert len(Q._FITTED) == n_fits


def test_columns_counted_in_pairs_or_row_by_row_have_the_same_sums(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 20, (3000, 5)), rng.integers(0, 2, 3000)]).astype(np.uint8)
    x[:, 3] = x[:, 1]
    g, h, rows, columns = rng.normal(size=3000), rng.random(3000), np.arange(0, 3000, 2), np.arange(6)
    want = booster._histogram(x, rows, columns, g, h, 21)
    across = np.ascontiguousarray(x.T)
    plain = booster._plain(across, [np.arange(19.0)] * 5 + [np.arange(1.0)])
    assert list(plain) == [False, True, False, True, False, True]  # equal columns and those of few bins
    assert np.array_equal(want, booster._histogram(x, rows, columns, g, h, 21, lambda r: x[r]))
    monkeypatch.setattr(booster, "FEW_ROWS", 10)
    got = booster._histogram(across.T, rows, columns, g, h, 21, None, booster._pairs(across, plain, 21))
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12) and np.array_equal(got[2], want[2])
    assert np.array_equal(got[:, 1], got[:, 3])  # equal features keep equal sums: the first one wins


def test_a_fit_of_few_rows_is_one_job_a_stretch_of_rounds(rows, monkeypatch):
    """A task stops by itself, and later stretches go on where the earlier ones ended."""
    p = [booster.BoostParams(**{**SMALL, "n_estimators": 30}), booster.BoostParams(**{**SMALL, "n_estimators": 30, "learning_rate": 0.5})]
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'").withColumn(
        "fraudulent", F.when(F.col("job_id") % 10 > 0, F.col("fraudulent")))  # labels that are not known count for nothing
    jobs, real = [], booster._whole_fits
    monkeypatch.setattr(booster, "_whole_fits", lambda *a: jobs.append(1) or real(*a))
    one = booster.fit_boosters(train, p, val, patience=6)
    assert len(jobs) == 1
    monkeypatch.setattr(booster, "ROUNDS_A_JOB", 4)
    two = booster.fit_boosters(train, p, val, patience=6)
    monkeypatch.setattr(booster, "SMALL_ROWS", 0)
    three = booster.fit_boosters(train, p, val, patience=6)
    for a, b, c in zip(one, two, three):
        assert a.best == b.best == c.best and len(a.boosted.trees) == len(b.boosted.trees) == len(c.boosted.trees)
        assert a.history == b.history and np.allclose(a.history, c.history)
    empty = booster.fit_boosters(train, p[:1], val.limit(0), patience=6)[0]
    assert empty.history == [] and empty.best == 0
