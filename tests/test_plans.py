"""Physical-plan properties the scale design relies on (checked with explain)."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tfidf_weights_shuffle_no_text(spark):
    plan = _plan(E.queries()["tfidf_weights"](spark, SF))
    # terms are counted and weighed where the document lies
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    assert "hashpartitioning(id#" not in plan


def test_per_class_top_k_is_limited_before_the_shuffle(spark):
    plan = _plan(E.queries()["top_bigrams"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_reads_only_needed_columns(spark):
    # class counts need the id and the label only: the text column is never read
    plan = _plan(E.queries()["class_balance"](spark, SF))
    docs_scans = [line for line in plan.splitlines() if "documents.parquet" in line and "ReadSchema" in line]
    assert docs_scans and all("text" not in line.split("ReadSchema:")[1] for line in docs_scans)


def test_histogram_filter_stays_above_the_aggregate(spark):
    plan = _plan(E.queries()["length_histogram"](spark, SF))
    scan_side = plan.split("Exchange hashpartitioning(doc_id")[-1]
    assert "width_bucket" not in scan_side


def test_grouped_running_totals_exchange_on_group_and_bucket(spark):
    """No model's scores meet in one task: rows get their bucket before the first exchange."""
    from pyspark.sql import functions as F

    from riskrank.operators.running import bucket_by_range
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    plan = _plan(bucket_by_range(df, "v", ["g"], 8))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(g" not in plan


def test_exact_dedupe_shuffles_no_text_of_rows_without_a_copy(spark):
    plan = _plan(E.queries()["dedupe_exact"](spark, SF))
    # the one exchange is that of the copies' full comparison; both joins with the hashes are broadcast
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 2
    assert plan.index("LeftAnti") < plan.index("Exchange hashpartitioning") < plan.index("LeftSemi")
