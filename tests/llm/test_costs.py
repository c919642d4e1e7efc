"""Corpus operators whose disk or CPU time was more than they needed."""

import pickle
import random
import re

import numpy as np
import pytest

from riskrank.llm import chunks, pieces, records


def test_windows_are_computed_and_dealt_once(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "head " + text), (None, text), (3, None)], "doc_id long, text string")
    found = chunks.duplicate_runs(docs)
    assert found.count() == 2
    assert len(found.collect()) == 2
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("n_hot", [0, 2, 12])
def test_windows_are_dealt_once_when_heads_are_not_broadcast(spark, monkeypatch, n_hot):
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, "head " + text), (None, text), (3, None)], "doc_id long, text string")
    digests = sorted(r["digest"] for r in chunks.window_table(docs).select("digest").distinct().collect())
    monkeypatch.setattr(chunks, "_hot_digests", lambda *a: digests[:n_hot])
    monkeypatch.setattr(chunks, "HOT_SLOTS", 4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = chunks.duplicate_runs(docs)
        assert len(found.collect()) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == (2 if n_hot else 1)
    assert plan.count("MapInArrow") == 2  # the windows, and the runs of the marked ones
    dealt = re.findall(r"Exchange hashpartitioning\((?:digest|d|head_digest)#[^\n]*ENSURE_REQUIREMENTS", plan)
    assert len(dealt) == (1 if n_hot else 0)  # the hot digests' heads alone are dealt again


def test_texts_meet_their_runs_by_the_same_join_at_every_size(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "head " + text), (None, text), (3, None)], "doc_id long, text string")
    out = chunks.without_repeats(docs)
    kept = {r["doc_id"]: (r["clean"] == r["text"], r["n_removed_words"] > 0) for r in out.select("row.*", "clean", "n_removed_words").collect()}
    assert kept == {1: (True, False), 2: (False, True), None: (False, True), 3: (True, False)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("sentencepiece")
    return pieces.Pieces.from_model()


def test_known_characters_take_the_same_path(model):
    rng = random.Random(5)
    segments = ["".join(rng.choice("aeinrst▁.,0é中\U0001f600") for _ in range(rng.randint(1, 20))) for _ in range(2000)]
    segments = [s for s in segments if model.singles.issuperset(s)] + ["▁the", "▁internationally"]
    quick = [model.viterbi(s) for s in segments]
    model.singles, kept = set(), model.singles
    assert quick == [model.viterbi(s) for s in segments]
    model.singles = kept


def test_tasks_of_a_worker_share_their_segments(model):
    first = pieces.worker_model(pickle.loads(pickle.dumps(model)))
    first.packed("some words")
    assert pieces.worker_model(pickle.loads(pickle.dumps(model))) is first and first._cache
    other = pieces.Pieces(model.pieces, model.byte_ids, model.names)
    assert pieces.worker_model(other) is other


def test_lines_are_cut_where_a_word_follows_a_space():
    rng = random.Random(6)
    lines = ["".join(rng.choice("ab, \t\xa0　\x1c中") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for line in [*lines, "", " ", "a b", " a", "a ", "a  b"]:
        assert records._pieces_of(line) == re.split(r" (?=\S)", line), repr(line)


def test_a_piece_is_encoded_once(monkeypatch):
    encode = records.Encoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    asked, plain = [], encode._piece
    monkeypatch.setattr(encode, "_piece", lambda text: asked.append(text) or plain(text))
    texts = ["one two, two. Straße 中文 two", "two one", "", " two  one\none"]
    got = encode(texts) + encode(texts)
    assert len(asked) == len(set(asked))
    assert [np.frombuffer(ids, "<u2").tolist() for ids in got] == 2 * [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(records, "CACHE_PIECES", 0)
    assert encode(texts) == got[:4]


def test_a_very_common_passage_is_dealt_to_several_tasks(spark, monkeypatch):
    common = " ".join(f"common{i}" for i in range(30))
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(20)) + "\n" + common + "\n" + " ".join(f"end{i}x{k}" for k in range(20)))
            for i in range(60)] + [(None, common), (7, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def runs():
        return sorted((r["rid"], tuple(map(tuple, r["runs"]))) for r in found.collect())
    found = chunks.duplicate_runs(docs)
    assert chunks._hot_digests(docs, "doc_id", "text", 5, 12, 200)
    spread = runs()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2
    monkeypatch.setattr(chunks, "_hot_digests", lambda *a: [])
    found = chunks.duplicate_runs(docs)
    assert spread == runs() and len(spread) == 61
