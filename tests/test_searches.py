"""Searches and joins that look at a part of the rows, against those that look at all."""

import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import block_index, question_spans, retrieval, set_join, vectors
from tessera.plans.queries import _chunks
from tessera.sources import table

DATA = "/root/testdata/sf0.001"
KEYS = ["doc_id", "chunk_index"]


def ranks(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_index, round(r.score, 6)) for r in df.collect())


def test_block_max_search_finds_what_a_full_search_finds(spark):
    chunks, queries = _chunks(spark, DATA), table(spark, DATA, "benchmark")
    full = retrieval.index(chunks)
    assert ranks(retrieval.bm25(chunks, queries)) == ranks(retrieval.top(retrieval.bm25_scores(full, queries), ["query_id"], 10, KEYS))
    assert ranks(retrieval.tfidf(chunks, queries)) == ranks(retrieval.top(retrieval.tfidf_scores(full, retrieval.query_terms(queries)), ["query_id"], 10, KEYS))
    blocked = block_index.blocks(chunks, KEYS, size=16)
    weighed, avgdl = retrieval.asked_bm25(blocked, retrieval.query_terms(queries))
    found = block_index.top_k(blocked, weighed, KEYS, block_index.bm25_weight(avgdl), 10)
    assert found.count() <= found.rdd.getNumPartitions() * queries.count() * 10
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    df = {r.term: r.df for r in block_index.frequencies(blocked).collect()}
    assert df == {r.term: r.df for r in retrieval.document_frequencies(full).collect()}


def test_asked_pairs_go_out_in_parts_and_empty_tables_give_nothing(spark, monkeypatch):
    chunks, queries = _chunks(spark, DATA), table(spark, DATA, "benchmark")
    want = ranks(retrieval.bm25(chunks, queries))
    monkeypatch.setattr(block_index, "ASKED", 500)
    assert ranks(retrieval.bm25(chunks, queries)) == want
    assert retrieval.bm25(chunks.where("false"), queries).count() == 0 and retrieval.tfidf(chunks, queries.where("false")).count() == 0
    monkeypatch.setattr(retrieval, "VOCABULARY", 0)
    assert len(ranks(retrieval.tfidf(chunks, queries))) == len(want)


def test_large_vocabularies_are_joined_with_blocks_not_with_pairs(spark, monkeypatch):
    chunks, queries = _chunks(spark, DATA), table(spark, DATA, "benchmark")
    want = ranks(retrieval.tfidf(chunks, queries))
    monkeypatch.setattr(retrieval, "VOCABULARY", 0)
    monkeypatch.setattr(retrieval, "tfidf_scores", None)  # makes a row of every chunk that shares a word with a query
    assert ranks(retrieval.tfidf(chunks, queries)) == want


def test_blocks_lie_in_small_row_groups(spark):
    import glob
    import pyarrow.parquet as pq

    docs = table(spark, "/root/testdata/sf0.01", "documents").coalesce(1)
    blocked = block_index.blocks(docs.select("doc_id", F.lit(0).alias("chunk_index"), F.explode(F.array_repeat("text", 12)).alias("content")), ["doc_id", "chunk_index"])
    held = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocked.inputFiles()]
    sizes = [m.row_group(g).total_byte_size for m in held for g in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 8 << 20


def test_odd_chunks_and_string_keys(spark):
    rows = [("a", None), ("b", ""), (None, "alpha beta"), ("d", "alpha alpha beta"), ("e", "alpha beta"), ("f", "gamma 重製權利")]
    chunks = spark.createDataFrame(rows, "name string, content string")
    blocked = block_index.blocks(chunks, ["name"], size=2)
    asked = spark.createDataFrame([(1, "alpha", 1.0), (1, "beta", 0.5), (2, "重製", 2.0), (3, "nothing", 1.0)], "query_id long, term string, weight double")
    got = {(r.query_id, r.name): r.score for r in block_index.top_k(blocked, asked, ["name"], lambda tf, norm: tf / norm, 5).collect()}
    assert got == pytest.approx({(1, None): 0.75, (1, "d"): 2 / 3 + 0.5 / 3, (1, "e"): 0.75, (2, "f"): 2.0 / 4})


def test_documents_by_their_best_chunk_without_every_score(spark):
    rng = random.Random(3)
    rows = [(i % 37, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(0, 12)))) for i in range(500)]
    chunks = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(rows)], "doc_id long, chunk_index int, content string").repartition(6)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "zeta"), (3, "nothing"), (4, "eta eta theta gamma")], "item_id long, text string")
    every = retrieval.bm25_scores(retrieval.index(chunks), asked).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    want = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in retrieval.top(every, ["query_id"], 20, ["doc_id"]).collect())
    blocked = block_index.blocks(chunks.select("doc_id", "content"), ["doc_id"], size=16)
    got = retrieval.bm25(chunks, asked, 20, blocked, keys=["doc_id"], once=True)
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in got.collect()) == want
    weighed, mean = retrieval.asked_bm25(blocked, retrieval.query_terms(asked))
    each = block_index.top_k(blocked, weighed, ["doc_id"], block_index.bm25_weight(mean), 5, once=True)
    assert each.count() <= 5 * 4 * blocked.rdd.getNumPartitions()
    assert each.groupBy("query_id", "doc_id", F.spark_partition_id()).count().where("count > 1").isEmpty()


def test_blocks_below_the_kth_score_are_skipped():
    names = pa.array(["a", "b"])
    state = block_index.Search(names, np.array([0, 1]), np.array([0, 0]), np.array([1.0, 1.0]), 1, 1, 2, lambda tf, norm: tf / norm)
    touched = []

    def block(k, tfs):
        n = len(tfs)

        def postings():
            touched.append(k)
            return np.array([0, n]), np.arange(n), np.array(tfs), np.full(n, 10.0)

        state.scan(pa.array(["a"]), np.array([max(tfs)]), np.array([10.0]), postings, lambda: [np.arange(n) + 100 * k])

    block(0, [9, 8, 1])
    block(1, [3, 7])
    block(2, [8, 2])
    block(3, [8, 20])
    assert touched == [0, 2, 3] and state.skipped == 1 and state.scored == 3
    assert list(zip(state.best[1], state.best[2])) == [(2.0, 301), (0.9, 0)]


def test_random_blocks_against_all_scores():
    rng = np.random.default_rng(2)
    terms, q, k = 12, 7, 5
    asked = sorted({(int(rng.integers(terms)), int(rng.integers(q))) for _ in range(30)})
    weight = rng.normal(1, 1, len(asked))
    state = block_index.Search(pa.array([f"t{i:02}" for i in range(terms)]), np.array([t for t, _ in asked]), np.array([x for _, x in asked]), weight, q, 1, k, lambda tf, norm: tf / norm)
    scores = {}
    for b in range(30):
        tf = rng.integers(0, 4, (terms + 3, 6)) * (rng.random((terms + 3, 6)) < 0.4)
        norm, names = tf.sum(0) + 1.0, [f"t{i:02}" for i in range(terms + 3)]
        has = np.flatnonzero(tf.sum(1))
        starts = np.r_[0, np.cumsum((tf[has] > 0).sum(1))]
        row = np.concatenate([np.flatnonzero(tf[t]) for t in has])
        low = np.array([norm[np.flatnonzero(tf[t])].min() for t in has])
        state.scan(pa.array([names[t] for t in has]), tf[has].max(1), low, lambda: (starts, row, np.concatenate([tf[t][tf[t] > 0] for t in has]), norm), lambda: [np.arange(6) + 6 * b])
        for (t, x), w in zip(asked, weight):
            for c in np.flatnonzero(tf[t]):
                scores[x, 6 * b + c] = scores.get((x, 6 * b + c), 0.0) + w * tf[t, c] / norm[c]
    want = [(x, c) for x in range(q) for c, _ in sorted(((c, s) for (y, c), s in scores.items() if y == x), key=lambda r: (-np.round(r[1], 6), r[0]))[:k]]
    assert list(zip(state.best[0], state.best[2])) == want and state.skipped > 0


# --- vectors --------------------------------------------------------------------------------------------------------------
def test_inverted_lists_reach_their_recall_and_read_probed_partitions(spark):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    exact = retrieval.dense(v, v.where("vec_id % 20 = 0"))
    lists = vectors.build(v)
    asked = vectors.unit(v.where("vec_id % 20 = 0"))
    got = vectors.first(vectors.search(lists, asked), 10)
    want = {(r.query_id, r.vec_id) for r in exact.collect()}
    assert len({(r.query_id, r.vec_id) for r in got.collect()} & want) >= 0.95 * len(want)
    assert lists.probes < len(lists.centroids) and lists.table(spark).count() == asked.count() * 20
    whole = vectors.first(vectors.search(lists, asked, probes=len(lists.centroids)), 10)
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in whole.collect()) == sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in exact.collect())
    one = vectors.search(lists, asked.where("vec_id = 40"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert one.select(F.countDistinct("vec_id")).first()[0] <= 10 * one.rdd.getNumPartitions()


def test_few_vectors_ties_and_none(spark):
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(6, None), (7, [0.0, 0.0]), (8, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.first(vectors.search(vectors.build(v, recall=1.0, k=3), vectors.unit(v), 3), 3)
    assert {(r.query_id, r.vec_id) for r in got.collect() if r.query_id == 0} == {(0, 1), (0, 2), (0, 3)}
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.dense(v, v, 3).collect())
    assert vectors.search(vectors.build(v.where("false")), vectors.unit(v)).count() == 0


# --- joins of sets and texts ---------------------------------------------------------------------------------------------------
def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(4)
    sets = lambda n: [(i, rng.sample("abcdefghijkl", rng.randint(0, 8))) for i in range(n)]
    left, right = sets(60), sets(90) + [(90, None)]
    for least in (0.3, 0.5, 0.8):
        got = set_join.similar_sets(spark.createDataFrame(left, "lid int, tokens array<string>"), spark.createDataFrame(right, "rid int, tokens array<string>"), least)
        jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
        want = {(i, j): jaccard(a, b) for (i, a), (j, b) in product(left, right) if b and jaccard(a, b) > least}
        assert {(r.lid, r.rid): r.score for r in got.collect()} == pytest.approx(want)


def test_words_and_runs_against_all_pairs(spark):
    rng = random.Random(6)
    make = lambda n, m: "".join(rng.choice("abcd") for _ in range(rng.randint(n, m)))
    words, texts = sorted({make(2, 5) for _ in range(40)}), [(i, make(0, 60)) for i in range(80)]
    df = spark.createDataFrame(texts, "rid int, text string")
    got = set_join.with_contained(spark.createDataFrame([(w,) for w in words], "word string"), df)
    assert sorted((r.word, r.rid) for r in got.collect()) == sorted((w, i) for w in words for i, t in texts if w in t)
    asked = [(i, make(0, 40)) for i in range(60)]
    near = {(r.lid, r.rid) for r in set_join.sharing_run(spark.createDataFrame(asked, "lid int, text string"), df, 0.4).collect()}

    def common(a, b):
        return max((n for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)

    assert {(i, j) for (i, a), (j, b) in product(asked, texts) if a and b and common(a, b) / max(len(a), len(b)) > 0.4} <= near


def test_the_cascade_makes_no_pairs_of_all(spark):
    items = spark.createDataFrame([(i, f"w{i} common words here {i * 7}", f"ask {i}") for i in range(50)], "query_id long, answer string, said string")
    spans = spark.createDataFrame([(i, f"w{i % 60} other common words {i}. a sentence of words w{i}") for i in range(400)], "span_id long, text string")
    for step in (question_spans.by_keywords, question_spans.by_characters, question_spans.by_overlap, question_spans.by_sentences, question_spans.by_concepts):
        plan = step(items, spans)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords_in_spans_against_plain_python_without_rows_of_texts_and_words(spark):
    rng = random.Random(11)
    make = lambda n: " ".join("".join(rng.choice("abcé重") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, n)))
    items, spans = [(i, make(9)) for i in range(40)] + [(40, None)], [(i, make(40)) for i in range(300)] + [(300, None), (301, "")]
    asked, texts = spark.createDataFrame(items, "query_id long, said string"), spark.createDataFrame(spans, "span_id long, text string").repartition(5)
    word = lambda t: list(dict.fromkeys(w for w in (t or "").split() if len(w) >= 2))
    share = lambda q, t: sum(len(w) for w in word(q) if w in t) / sum(map(len, word(q)))
    want = {(i, s): round(share(q, t), 6) for i, q in items if word(q) for s, t in spans if t and round(share(q, t), 6) > 0.3}
    rows = lambda df: {(r.query_id, r.span_id): r.score for r in df.collect()}
    assert rows(question_spans.by_keywords(asked, texts)) == pytest.approx(want)
    best = lambda found: {(i, s) for i in range(41) for s, _ in sorted(((s, x) for (j, s), x in found.items() if i == j), key=lambda r: (-r[1], r[0]))[:3]}
    few = question_spans.by_keywords(asked, texts, most=3)
    assert best(rows(few)) == best(want) and few.count() < len(want)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_characters_of_spans_against_plain_python_in_one_pass(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh重é ") for _ in range(rng.randint(1, n)))
    items, spans = [(i, make(9)) for i in range(40)] + [(40, None)], [(i, make(14)) for i in range(300)] + [(300, None)]
    asked, texts = spark.createDataFrame(items, "query_id long, answer string"), spark.createDataFrame(spans, "span_id long, text string").repartition(5)
    jaccard = lambda a, b: round(len({*a} & {*b}) / len({*a} | {*b}), 6)
    want = {(i, s): jaccard(a, t) for i, a in items if a for s, t in spans if t and jaccard(a, t) > 0.4}
    rows = lambda df: {(r.query_id, r.span_id): r.score for r in df.collect()}
    assert rows(question_spans.by_characters(asked, texts)) == pytest.approx(want)
    best = lambda found: {(i, s) for i in range(41) for s, _ in sorted(((s, x) for (j, s), x in found.items() if i == j), key=lambda r: (-r[1], r[0]))[:2]}
    few = question_spans.by_characters(asked, texts, most=2)
    assert best(rows(few)) == best(want) and few.count() < len(want)
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString()
