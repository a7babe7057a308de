"""Searches over windows that are told from where words stand, against windows that are cut and tokenised one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import block_index, chunking, evaluation, retrieval, window_search

CONFIGURATIONS = ((30, 0.1), (50, 0.0), (40, 0.7))


def ranks(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_index, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon ñandú über naïve x 42 a_b 重製權利 著作".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["İstanbul ΟΔΟΣ Σίσυφος, Α.Σ' " * 9, " " * 90 + "alpha" + " " * 200 + "beta", None, "", "x" * 300, "著作權法重製" * 20, "only here, onlyhere! 😀alpha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = [(1, "alpha beta 重製"), (2, "istanbul οδος σίσυφος"), (3, "nothing known"), (4, None), (5, "onlyhere gamma gamma über"), (6, "elta lpha")]
    return docs, spark.createDataFrame(asked, "item_id long, text string")


def test_windows_told_from_their_words_are_windows_cut_one_by_one(tables, monkeypatch):
    docs, asked = tables
    monkeypatch.setattr(window_search, "PIECE", 400)  # many pieces a task
    cuts = [window_search.fixed(*c) for c in CONFIGURATIONS] + [window_search.sliding(50, 5)]
    counts = window_search.frequencies(docs, cuts)
    got = window_search.tfidf(docs, asked, cuts, 4, counts).collect()
    for c, chunks in enumerate([chunking.fixed_ratio(docs, *x) for x in CONFIGURATIONS] + [chunking.sliding_stop(docs, 50, 5)]):
        blocked = block_index.blocks(chunks, retrieval.KEYS)
        df = {r.term: r.df for r in block_index.frequencies(blocked).collect()}
        assert {r.term: r.n for r in counts.select("term", F.col(f"n{c}").alias("n")).collect() if r.term is not None and r.n} == df
        assert counts.where("term IS NULL").first()[f"n{c}"] == block_index.statistics(blocked).first()["n"]
        mine = sorted((r.query_id, r["rank"], r.doc_id, r.chunk_index, round(r.score, 6)) for r in got if r.cut == c)
        assert mine == ranks(retrieval.tfidf(chunks, asked, 4, blocked))
        text = {(r.doc_id, r.chunk_index): r.start for r in chunks.collect()}
        assert all(text[r.doc_id, r.chunk_index] == r.start for r in got if r.cut == c)


def test_queries_go_out_in_parts_and_no_rows_give_nothing(tables, monkeypatch):
    docs, asked = tables
    cuts = [window_search.sliding(50, 5)]
    want = ranks(window_search.tfidf(docs, asked, cuts))
    monkeypatch.setattr(block_index, "ASKED", 3)
    monkeypatch.setattr(window_search, "CELLS", 7)
    monkeypatch.setattr(window_search, "SUMMED", 5)
    assert ranks(window_search.tfidf(docs, asked, cuts)) == want
    assert window_search.tfidf(docs.where("false"), asked, cuts).count() == 0 and window_search.tfidf(docs, asked.where("false"), cuts).count() == 0


def test_a_grid_builds_no_index_and_agrees_with_one_index_each(tables, monkeypatch):
    docs, asked = tables
    said = lambda: sorted(map(tuple, evaluation.grid_evaluation(docs, asked, (30, 50), (0.0, 0.2), (1, 5)).collect()))
    with monkeypatch.context() as m:
        m.setattr(window_search, "TRAVEL", -1)
        want = said()
    monkeypatch.setattr(block_index, "blocks", None)  # reads, cuts and writes every configuration's chunks
    assert said() == want and len(want) == 8


def test_terms_are_compared_after_their_hash():
    import numpy as np
    import pyarrow as pa

    names = pa.array([f"w{i}" for i in range(1000)])
    known = window_search.Vocabulary(*window_search.vocabulary(names, np.arange(1000)[:, None]))
    assert known.counts[known.find(names), 0].tolist() == list(range(1000))
    known.hashes[:] = np.sort(window_search._hash(pa.array(["other"] * 1000), known.seed))
    assert (known.find(pa.array(["other", "w"])) == -1).all()


def test_characters_of_windows_against_windows_cut_one_by_one(tables, spark, monkeypatch):
    docs, asked = tables
    monkeypatch.setattr(window_search, "PIECE", 400)
    monkeypatch.setattr(window_search, "CELLS", 9)
    questions = asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).unionByName(spark.createDataFrame([(7, "？，"), (8, "，；著 作a😀"), (9, "ß")], "query_id long, question string"))
    for c in ((50, 5), (40, 28)):
        want = evaluation.character_pool(questions, chunking.sliding_stop(docs, *c)).collect()
        got = evaluation.character_pool_of_windows(questions, docs, window_search.sliding(*c))
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 3
