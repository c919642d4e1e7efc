"""Readers and writers: CSV NA tokens, split round trip, score scan, experiment log."""

import os
import tempfile

from pyspark.sql import functions as F

from riskrank import schema as S
from riskrank.sources import io


def test_csv_reader_na_tokens_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="riskrank-io-")
    path = os.path.join(d, "raw.csv")
    header = ",".join(S.RAW_COLUMNS)
    row1 = ['1', '"Title, with comma"', 'NA', 'null', '', '"multi\nline ""quoted"""', 'desc', 'N/A', 'b',
            '0', '1', '0', 'Full-time', 'Entry level', "Bachelor's", 'IT', 'Eng', '0']
    with open(path, "w") as fh:
        fh.write(header + "\n" + ",".join(row1) + "\n")
    r = io.read_postings_csv(spark, path).first()
    assert r.title == "Title, with comma"
    assert r.location is None and r.department is None and r.salary_range is None and r.requirements is None
    assert r.company_profile == 'multi\nline "quoted"'
    assert r.fraudulent == 0


def test_split_round_trip_and_log(spark):
    d = tempfile.mkdtemp(prefix="riskrank-io-")
    df = spark.createDataFrame([(i, i % 2, "s" if i % 3 else None, ["train", "val", "test"][i % 3])
                                for i in range(30)], "job_id long, fraudulent int, title string, split string")
    summary = {r.split: r.n for r in io.save_splits(df, os.path.join(d, "splits")).collect()}
    assert summary == {"train": 10, "val": 10, "test": 10}
    v = io.load_split(spark, os.path.join(d, "splits"), "val")
    assert v.count() == 10 and v.where(F.col("title").isNull()).count() == 0
    log = os.path.join(d, "log")
    assert io.load_experiments(spark, log).count() == 0
    io.log_experiment(spark, log, "m1", {"average_precision": 0.5, "roc_auc": 0.6}, "val")
    io.log_experiment(spark, log, "m2_tuned", {"average_precision": 0.7}, "val")
    got = [r.model for r in io.load_experiments(spark, log).collect()]
    assert got == ["m2_tuned", "m1"]
    chk = io.log_check(spark.read.parquet(log)).first()
    assert chk.rows == 2 and chk.null_models == 0 and chk.matching_models == ["m2_tuned"]


def test_scores_scan_and_cache(spark):
    d = tempfile.mkdtemp(prefix="riskrank-io-")
    s = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "job_id long, y_true int, y_proba double")
    io.save_scores(s, os.path.join(d, "scores"), "distilbert")
    out = io.scan_scores(spark, os.path.join(d, "scores"), aliases={"distilbert": "distilbert_finetuned"})
    assert {r.model for r in out.collect()} == {"distilbert_finetuned"}
    calls = []

    def enc(rows):
        calls.append(rows.count())
        return rows.select("job_id", F.array(F.lit(1.0)).alias("embedding"))
    ids = spark.createDataFrame([(1,), (2,)], "job_id long")
    cache = os.path.join(d, "cache")
    io.encode_cached(spark, cache, ids, enc)
    more = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    got = io.encode_cached(spark, cache, more, enc)
    assert calls == [2, 1] and got.count() == 3


def test_artifacts_round_trip(spark):
    import numpy as np
    from riskrank.plans import train as T
    from riskrank.sources.testviews import featured_postings
    d = tempfile.mkdtemp(prefix="riskrank-art-")
    f = featured_postings(spark, "/root/testdata/sf0.001")
    art = T.preprocess_fit(f, svd_components=3)
    T.save_artifacts(art, d)
    back = T.load_artifacts(spark, d)
    a = {r.job_id: r.features.toArray() for r in T.preprocess_apply(f, art).collect()}
    b = {r.job_id: r.features.toArray() for r in T.preprocess_apply(f, back).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_missing_split_raises_and_no_score_files_give_no_rows(spark, tmp_path):
    import pytest

    from riskrank.sources import io
    df = spark.createDataFrame([(1, "train", 0)], "job_id long, split string, fraudulent int")
    io.save_splits(df, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        io.load_split(spark, str(tmp_path / "s"), "val")
    assert io.scan_score_csvs(spark, str(tmp_path / "predictions_*_test.csv")).count() == 0


def test_search_draws_are_uncorrelated():
    import numpy as np

    from riskrank.operators.search import SPACE, draw
    u = np.array([[draw(t, j) for j in range(len(SPACE))] for t in range(500)])
    assert np.abs(np.corrcoef(u.T) - np.eye(len(SPACE))).max() < 0.2


def test_texts_without_terms_keep_their_row(spark):
    import numpy as np

    from riskrank.operators.newton import SparseLogistic
    rows = spark.createDataFrame([(1, [0, 2], [1.0, 0.5]), (2, [], [])], "id long, _i array<int>, _v array<double>")
    model = SparseLogistic(np.array([2.0, 9.0, -1.0, 9.0]), 0.25, 0.0, 1.0, 1)
    out = {r.id: r.y_proba for r in model.scores(rows).collect()}
    assert abs(out[1] - 1 / (1 + np.exp(-1.75))) < 1e-12 and abs(out[2] - 1 / (1 + np.exp(-0.25))) < 1e-12


def test_registered_pipeline_survives_the_round_trip(spark):
    from riskrank.plans import catalog
    catalog.load_all()
    rows = catalog.QUERIES["saved_pipeline"](spark, "/root/testdata/sf0.001", n_trees=5, patience=5, k=4).collect()
    assert rows and {r.split for r in rows} == {"val", "test"}
    assert all(abs(r.y_proba - r.direct) <= 1e-6 for r in rows)


def test_entries_logged_together_equal_those_logged_alone(spark, tmp_path):
    entries = [("a", {"average_precision": 0.25}, "x"), ("b", {"average_precision": 1, "f1": None}, "")]
    io.log_experiments(spark, str(tmp_path / "one"), entries)
    for name, metrics, notes in entries:
        io.log_experiment(spark, str(tmp_path / "two"), name, metrics, "val", notes)
    one, two = (io.load_experiments(spark, str(tmp_path / k)).drop("timestamp").collect() for k in ("one", "two"))
    assert one == two and len(one) == 2
    assert len(list((tmp_path / "one").glob("part-*.parquet"))) == 1
