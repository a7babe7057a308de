"""Words by the best path against all segmentations, keywords, intervals against all pairs, and streams against batches."""

import math
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, graph, intervals, segmentation
from tessera.streaming import annotations


def all_paths(run, longest):
    if not run:
        yield []
    for k in range(1, min(longest, len(run)) + 1):
        for rest in all_paths(run[k:], longest):
            yield [run[:k], *rest]


def test_best_path_against_all_segmentations():
    rng = random.Random(1)
    for _ in range(40):
        words = Counter({"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 3))): rng.randint(1, 50) for _ in range(12)})
        lattice = segmentation.Lattice(dict(words))
        total = sum(words.values())
        for _ in range(10):
            run = "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(1, 8)))
            score = lambda p: sum(math.log(words[w] / total) if w in words else math.log(0.5 / total) if len(w) == 1 else -math.inf for w in p)
            best = max(all_paths(run, 3), key=lambda p: (round(score(p), 6), -len(p), [len(w) for w in p]))
            assert lattice.path(run) == best


def test_patterns_are_walked_as_they_are_searched_and_in_linear_time():
    rng = random.Random(9)
    for pattern in ("ab.*?c", "a.*?b.*?a", "ab", "aa.*?a", "a+.*?[bc]"):
        for _ in range(300):
            text = "".join(rng.choice("abc\n") for _ in range(rng.randint(0, 25)))
            assert list(graph.walker(pattern)(text)) == [m.span() for m in re.finditer(pattern, text, re.S)], (pattern, text)
    began = time.process_time()
    assert not list(graph.walker("如.*?時")("如" * 400_000))
    assert time.process_time() - began < 2


def test_dictionary_words_and_keywords(spark):
    rng = random.Random(2)
    said = [rng.choice("寅卯辰巳午未") + "著作權" + rng.choice("甲乙丙丁戊己") + "商標法" + rng.choice("庚辛壬癸子丑") for _ in range(60)]
    rows = spark.createDataFrame([(i, f"{t}，{'alpha beta' if i % 2 else 'Alpha'} {t[5:8]}") for i, t in enumerate(said)] + [(60, None), (61, ""), (62, "plain words")], "id long, text string")
    words = segmentation.dictionary(rows)
    found = {r.word for r in words.collect()}
    assert {"著作權", "商標法"} <= found and not {"權商", "作權", "標法甲"} & found
    tokens = {r.id: r.tokens for r in segmentation.segmented(rows, words).collect()}
    assert tokens[0][0] == "alpha" and tokens[0][2] == "著作權" and "商標法" in tokens[0] and tokens[60] == tokens[61] == [] and tokens[62] == ["plain", "words"]
    ranked = segmentation.keywords(segmentation.segmented(rows, words), "id", F.col("tokens"), 2).collect()
    df = Counter(t for ts in tokens.values() for t in set(ts) if len(t) > 1)
    for i, ts in tokens.items():
        score = {t: round(n * (math.log(64 / (1 + df[t])) + 1), 6) for t, n in Counter(t for t in ts if len(t) > 1).items()}
        want = sorted(score, key=lambda t: (-score[t], t))[:2]
        assert [r.term for r in sorted(ranked, key=lambda r: r["rank"]) if r.id == i] == want
    assert segmentation.dictionary(rows.where("false")).count() == 0
    with pytest.raises(ValueError, match="raise the least count"):
        segmentation.WORDS, kept = 1, segmentation.WORDS
        try:
            segmentation.segmented(rows, words)
        finally:
            segmentation.WORDS = kept


def test_intervals_against_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n, most: [(i, rng.randint(0, 2), s := rng.randint(-50, 400), s + rng.randint(-2, most)) for i in range(n)]
    left, right = make(150, 40), make(80, 200)
    got = intervals.touching(spark.createDataFrame(left, "i int, d int, s int, e int"), spark.createDataFrame(right, "j int, d int, cs int, ce int"), "d", (F.col("s"), F.col("e")), (F.col("cs"), F.col("ce")), 37)
    want = sorted((i, j) for i, d, s, e in left for j, f, a, b in right if d == f and s <= e and a <= b and max(s, a) <= min(e, b))
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_many_spans_of_one_long_document_make_no_pairs_of_all(spark):
    spans = spark.range(10_000).select(F.col("id").alias("span_id"), F.lit(1).alias("doc_id"), (F.col("id") * 12).alias("s"), (F.col("id") * 12 + 100).alias("e"))
    chunks = spark.range(300).select(F.lit(1).alias("doc_id"), F.col("id").alias("chunk_index"), (F.col("id") * 400).alias("start"), (F.col("id") * 400 + 500).alias("end"))
    met = intervals.touching(spans, chunks.select("doc_id", "chunk_index", F.col("start").alias("cs"), F.col("end").alias("ce")), "doc_id", (F.col("s"), F.col("e")), (F.col("cs"), F.col("ce")))
    assert met.count() < 20_000  # of 3,000,000 pairs
    assert evaluation.map_spans(spans, chunks).select("span_id").distinct().count() == 10_000


# --- streams --------------------------------------------------------------------------------------------------------------
START = datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, event_type string, value double, ts timestamp"


def events(spark, rows, path):
    spark.createDataFrame([(i, u, "t", 1.0, START + timedelta(minutes=m)) for i, u, m in rows], EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    source, check = tmp_path / "in", str(tmp_path / "check")
    steps = [[(1, 1, 0), (2, 1, 20), (3, 2, 5)], [(4, 1, 45), (5, 2, 100), (6, 1, 300)], [(7, 2, 400), (8, 1, 290)], [(9, 1, 1000), (10, 2, 1000)]]
    for rows in steps:
        events(spark, rows, source)
        stream = annotations.sessions(spark.readStream.schema(EVENTS).parquet(str(source)))
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()  # goes on from its checkpoint
        query.awaitTermination()
    key = lambda r: (r.user_id, r.session_start, r.session_end, r.n, r.total)
    whole = sorted(map(key, annotations.sessions(spark.read.parquet(str(source))).collect()))
    closed = [r for r in whole if r[2] <= START + timedelta(minutes=880)]  # the watermark is two hours behind
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == closed and len(closed) == 5
    events(spark, [(11, 3, 1)], source)  # too late
    stream = annotations.sessions(spark.readStream.schema(EVENTS).parquet(str(source)))
    stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert 3 not in {r.user_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_upserts_follow_a_stream_and_survive_a_batch_that_runs_again(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "annotation_id long, label string, at long"
    batches = [[(1, "E", 10), (2, "C", 11)], [(1, "U", 12), (3, "E", 5)], [(2, "E", 1)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        annotations.upsert(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "check"), ["annotation_id"], "at").awaitTermination()
    want = {(1, "U", 12), (2, "C", 11), (3, "E", 5)}
    assert {tuple(r) for r in annotations.current(spark, table, ["annotation_id"], "at").collect()} == want
    annotations.upsert(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "lost"), ["annotation_id"], "at").awaitTermination()  # the checkpoint is lost: all again
    assert {tuple(r) for r in annotations.current(spark, table, ["annotation_id"], "at").collect()} == want
    annotations.compacted(spark, table, str(tmp_path / "small"), ["annotation_id"], "at")
    assert {tuple(r) for r in annotations.current(spark, str(tmp_path / "small"), ["annotation_id"], "at").collect()} == want


def test_feedback_teaches_concepts(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "concept string, term string, helpful boolean"
    for rows in ([("reproduction", "copy", True), ("reproduction", "copy", True), ("reproduction", "sing", False)], [("reproduction", "copy", False), ("reproduction", "copy", True), ("reproduction", "sing", True), ("fair use", "teach", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        annotations.follow_feedback(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "check")).awaitTermination()
    assert [tuple(r) for r in annotations.learned(spark, table).collect()] == [("reproduction", "copy", 3, 4, 0.666667)]
