"""Terms are counted where the documents lie."""

import pytest
from pyspark.sql import functions as F

from riskrank.operators import tfidf


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["The café owner paid café staff", "cafe staff paid the owner twice", "", None, "a b c", "staff paid staff paid staff",
             "Owner of the CAFÉ", "naïve staff"] * 3
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, cls int").repartition(4).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(text, params):
    import re
    import unicodedata
    t = (text or "").lower()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    tokens = [w for w in re.findall(r"\w\w+", t) if w not in set(params.words())]
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def test_counts_equal_plain_ones(docs, monkeypatch):
    params = tfidf.TfidfParams(min_df=1, max_df=1.0)
    for flush in (100_000, 2):
        monkeypatch.setattr(tfidf, "FLUSH", flush)
        got = sorted((r["id"], r["term"], r["tf"]) for r in tfidf.doc_terms(docs, "id", "text", params).collect())
        want, df, total = [], {}, {}
        for r in docs.collect():
            terms = plain(r["text"], params)
            for t in set(terms):
                want.append((r["id"], t, terms.count(t)))
                df[t], total[t] = df.get(t, 0) + 1, total.get(t, 0) + terms.count(t)
        assert got == sorted(want)
        stats = {r["term"]: (r["df"], r["total"]) for r in tfidf.term_stats(docs, "text", params).collect()}
        assert stats == {t: (df[t], total[t]) for t in df}


def test_weights_do_not_depend_on_how_the_vocabulary_travels(docs, monkeypatch):
    model = tfidf.fit(docs, "id", "text", tfidf.TfidfParams(min_df=1, max_df=1.0))
    own = {(r["id"], r["term_id"]): r["weight"] for r in model.transform(docs, "id", "text").collect()}
    rows = {r["id"]: (list(r["_i"]), list(r["_v"])) for r in model.transform_rows(docs, "id", "text").collect()}
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", 0)
    joined = {(r["id"], r["term_id"]): r["weight"] for r in model.transform(docs, "id", "text").collect()}
    assert own.keys() == joined.keys() and all(abs(own[k] - joined[k]) < 1e-12 for k in own)
    again = {r["id"]: (list(r["_i"]), list(r["_v"])) for r in model.transform_rows(docs, "id", "text").collect()}
    assert len(rows) == docs.count() and {k: v[0] for k, v in rows.items()} == {k: v[0] for k, v in again.items()}
    assert all(v[0] == sorted(v[0]) for v in rows.values()) and rows[2] == ([], [])


def test_no_text_is_shuffled(docs):
    params = tfidf.TfidfParams(min_df=1, max_df=1.0)
    fresh = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    stats = plan(tfidf.term_stats(fresh, "text", params))
    assert stats.count("Exchange") == 1 and "term" in stats[stats.index("Exchange"):].splitlines()[0]
    model = tfidf.fit(fresh, "id", "text", params)
    assert "Exchange" not in plan(model.transform(fresh, "id", "text"))
    top = plan(tfidf.top_ngrams(fresh, "text", "cls"))
    below = top[top.rindex("MapInArrow"):]
    assert "MapInArrow" in top and "Exchange" not in below


def test_top_ngrams_by_class(docs):
    out = tfidf.top_ngrams(docs, "text", "cls", n=2, min_df=1).collect()
    params = tfidf.TfidfParams(ngram_range=(2, 2))
    for cls in (0, 1):
        counts = {}
        for r in docs.where(F.col("cls") == cls).collect():
            text = (r["text"] or "").lower()
            tokens = [w for w in tfidf.TOKEN.findall(text) if w not in set(params.words())]
            for a, b in zip(tokens, tokens[1:]):
                counts[f"{a} {b}"] = counts.get(f"{a} {b}", 0) + 1
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]
        assert [(r["term"], r["count"]) for r in sorted((r for r in out if r["cls"] == cls), key=lambda r: r["rank"])] == want


def test_counts_of_words_numbered_anew_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Red fox red fox"), (2, "the red élan élan fox"), (3, None), (4, "of"), (5, "fox x red")], "id long, text string").coalesce(1)
    params = tfidf.TfidfParams()
    want = sorted(tfidf.term_stats(docs, "text", params).collect())
    monkeypatch.setattr(tfidf, "HELD_COUNTS", 1)
    monkeypatch.setattr(tfidf, "HELD_WORDS", 0)
    monkeypatch.setattr(tfidf, "FLUSH", 1)
    assert sorted(tfidf.term_stats(docs, "text", params).collect()) == want
    found = {r["term"]: (r["df"], r["total"]) for r in want}
    assert found["red fox"] == (1, 2) and found["elan elan"] == (1, 1) and found["fox"] == (3, 4) and "the" not in found


def test_terms_are_not_gathered_in_front_of_their_exchange(spark):
    docs = spark.createDataFrame([(1, "red fox")], "id long, text string")
    plan = tfidf.term_stats(docs, "text", tfidf.TfidfParams())._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert plan.count("Exchange") == 1 and "HashAggregate" not in below and "MapInArrow" in below


def test_texts_stay_where_they_are_when_labels_are_narrow(spark):
    from riskrank.sources.testviews import raw_postings
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for labelled in (True, False):
            plan = raw_postings(spark, "/root/testdata/sf0.001", labelled)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
