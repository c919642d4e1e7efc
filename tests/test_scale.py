"""Steps whose time or space grew faster than they had to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskrank import schema as S
from riskrank.functions import text as tx
from riskrank.operators import booster, curves, features, models, tfidf
from riskrank.plans import queries_models

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_counts_copy_no_text_at_every_match(spark):
    assert "regexp_extract_all" not in _plan(E.queries()["text_lengths"](spark, SF))


def test_words_and_spaces_are_those_of_str_split(spark):
    texts = ["a\x1cb\u2003 c", " \u3000 ", "", None, "x\u200by  z", "\x85 one\ttwo\n\n three "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", tx.word_count("t").alias("n"), tx.squish("t").alias("s")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len((t or "").split()) for t in texts]
    assert [r["s"] for r in got] == [None if t is None else " ".join(t.split()) for t in texts]


def test_contact_patterns_on_a_long_run_and_at_their_edges(spark):
    texts = ["x" * 100_000, "+a.b-c@d.ee", "@d.ee", "a@b", "#EMAIL_0f#", "HTTP://a", "wWw.b", "www", "20 K", "a20k", "Per Hour", "super hour"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {S.FULL_TEXT} string")
    got = features.add_text_pattern_features(df).orderBy("i").collect()
    assert [r["i"] for r in got if r["has_email"]] == [1, 4]
    assert [r["i"] for r in got if r["has_url"]] == [5, 6]
    assert [r["i"] for r in got if r["has_money"]] == [8, 10]


def test_terms_of_two_classes_and_none(spark):
    rows = [("red fox red", 0), ("red hen", 1), (None, 1), ("red fox", None)]
    df = spark.createDataFrame(rows, "t string, c int").coalesce(1)
    got = {(r["cls"], r["term"]): (r["df"], r["total"]) for r in tfidf.partial_stats(df, "t", tfidf.TfidfParams(), "c").collect()}
    assert got == {(0, "red"): (1, 2), (0, "fox"): (1, 1), (0, "red fox"): (1, 1), (0, "fox red"): (1, 1), (1, "red"): (1, 1),
                   (1, "hen"): (1, 1), (1, "red hen"): (1, 1), (None, "red"): (1, 1), (None, "fox"): (1, 1), (None, "red fox"): (1, 1)}


def test_some_thousand_rows_need_no_job_a_round(spark, monkeypatch):
    def one_round(*a):
        pytest.fail("a job a round")
    rows = spark.range(6000).select(F.col("id").alias(S.ID), (F.col("id") % 7 == 0).cast("int").alias(S.TARGET),
                                    F.array((F.col("id") % 13).cast("double"), (F.col("id") % 7).cast("double")).alias("a"))
    rows = rows.select(S.ID, S.TARGET, models.array_to_vector("a").alias("features"))
    monkeypatch.setattr(booster, "_one_round", one_round)
    fit = booster.fit_boosters(rows, [booster.BoostParams(n_estimators=3, num_leaves=7)])[0]
    assert fit.best == 3


def test_histograms_of_few_and_many_rows_are_equal(monkeypatch):
    rng = np.random.default_rng(0)
    x, g, h = rng.integers(0, 9, (700, 5)).astype(np.uint8), rng.random(700), rng.random(700)
    many = booster._histogram(x, np.arange(0, 700), np.array([0, 2, 4]), g, h, 9)
    monkeypatch.setattr(booster, "FEW_ROWS", 10_000)
    assert np.array_equal(many, booster._histogram(x, np.arange(0, 700), np.array([0, 2, 4]), g, h, 9))


def test_svd_blocks_are_12_bytes_an_entry_in_few_partitions(spark):
    long = spark.range(4000).select((F.col("id") % 400).alias("id"), F.floor(F.col("id") / 400).cast("int").alias("term_id"), F.lit(0.5).alias("weight"))
    blocks = models._sparse_blocks(models._grouped(long.repartition(40), "id", "term_id", "weight").repartition(40))
    assert blocks.getNumPartitions() <= spark.sparkContext.defaultParallelism
    sizes = blocks.map(lambda b: (sum(a.nbytes for a in b), len(b[0]), len(b[1]))).collect()
    assert sum(n for *_, n in sizes) == 4000
    assert all(size <= 12 * entries + 4 * rows for size, rows, entries in sizes)


def test_rule_search_computes_its_own_features_only(spark):
    plan = _plan(queries_models._with_split(spark, SF, queries_models._RULE_FEATURES))
    assert "word_count" not in plan and "has_email" not in plan


def test_a_task_grows_only_what_a_tree_needs(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (900, 4)).astype(np.uint8), rng.random(900)
    counted, plain, p = [], booster._histogram, booster.BoostParams(num_leaves=8, min_child_samples=5)
    monkeypatch.setattr(booster, "_histogram", lambda *a: counted.append(len(a[1])) or plain(*a))
    tree = booster._Growing(p, np.arange(4), 0)
    tree.graft(0, *booster._grow_here(p, x, 0.5 - y, np.full(900, 0.25), 9))
    done = tree.finish([np.arange(9.0)] * 4)[1]
    assert (done.feature < 0).sum() == 8
    assert len(counted) <= 7  # the root and the smaller child of each split but the last
    assert np.array_equal(booster._values_here(done, np.ascontiguousarray(x.T)), booster.leaf_values(done, x))


@pytest.mark.parametrize("rounds", [1, 25, 60])
def test_average_precision_of_rounds_equals_the_curves(spark, rounds):
    rng = np.random.default_rng(4)
    data = [(None if k % 17 == 0 else int(k % 5 == 0), [float(v) for v in rng.integers(0, 30, rounds)]) for k in range(120)]
    rows = spark.createDataFrame(data, "y_true int, steps array<double>").repartition(3)
    got = {r["at"]: r["average_precision"] for r in booster._precision_table(rows, rounds).collect()}
    scores = rows.select("y_true", F.posexplode("steps").alias("at", "y_proba"))
    want = curves.ranking_summary(curves.curve_table(scores, ["at"]), ["at"]).collect()
    assert len(got) == len(want) == rounds
    assert all(abs(got[r["at"]] - r["average_precision"]) < 1e-12 for r in want)
    none = booster._precision_table(rows.where("y_true = 0"), rounds).collect()
    assert [r["average_precision"] for r in none] == [0.0] * rounds
    assert booster._precision_table(rows.limit(0), rounds).count() == 0
