"""Driver contract: entry() runs, every oracle has a query, queries build plans."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "average_precision" in df.columns


def test_registry_consistent():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 60


def test_queries_on_smallest_tables(spark):
    qs = E.queries()
    cheap = ["full_text", "class_balance", "median_by_class", "pr_curve", "stratified_split",
             "tfidf_vocab", "onehot_apply", "reply_parse", "few_shot_document", "random_search"]
    for name in cheap:
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0
