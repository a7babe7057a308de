"""Splitting along structure and concepts: brute force, properties, worked examples; routes of questions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import concept_spans, fusion, splitting, statutes

SHAPE = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SOME = st.lists(st.text(alphabet="指者但應申請第1條。\n因此，x", max_size=200), min_size=1, max_size=5)
TEXTS = [None, "", " \n", "第1條\n本法所稱甲是指乙。但丙不在此限。", "x" * 170, "第2條\n如有事時，應向機關申請。" * 12, "指" * 150, "。" * 90]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, content string")


def by_document(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["chunk_index"])):
        got.setdefault(r["doc_id"], []).append(r)
    return got


def concepts_of(text):
    """Every cue tried at every place, left to right without overlaps of one cue."""
    out = set()
    for kind, (_, cues) in concept_spans.CUES.items():
        for cue in cues:
            first, _, second = cue.removesuffix(concept_spans.REST).partition(concept_spans.GAP)
            at = 0
            while (at := text.find(first, at)) >= 0:
                end = next((i for i in range(at, len(text)) if text[i] in "。！？\n"), len(text))
                if second and text.find(second, at + len(first), end) < 0:
                    at += 1
                    continue
                out.add((at, end, kind))
                at = end
    return out


@SHAPE
@given(texts=SOME)
def test_concept_windows_against_brute_force(spark, texts):
    texts = TEXTS + texts
    plain = by_document(concept_spans.concept_windows(frame(spark, texts), 40, 0.2, whole=False))
    whole = by_document(concept_spans.concept_windows(frame(spark, texts), 40, 0.2))
    for i, t in enumerate(t or "" for t in texts):
        found = concepts_of(t)
        places = {p for a, b, _ in found for p in (a, b)} | {m.start() for m in re.finditer(concept_spans.STRUCTURE, t)} | {m.end() for m in re.finditer("[。！？]", t)}
        at, want, wide = 0, [], []
        while at < len(t):
            stop = len(t) if at + 40 >= len(t) else max([p for p in places if at < p <= at + 40], default=at + 40)
            torn = [(a, b) for a, b, _ in found if a < stop and b > at and not (at <= a and b <= stop)]
            for out, a, b in ((want, at, stop), (wide, min([at, *(a for a, _ in torn)]), max([stop, *(b for _, b in torn)]))):
                if t[a:b].strip():
                    kinds = {k for x, y, k in found if a <= x and y <= b}
                    out.append((t[a:b], a, b, [k for k in concept_spans.CUES if k in kinds]))
            at = len(t) if stop == len(t) else stop - 8 if stop - 8 > at else stop
        assert [(r["content"], r["start"], r["end"], r["kinds"]) for r in plain.get(i, [])] == want
        assert [(r["content"], r["start"], r["end"], r["kinds"]) for r in whole.get(i, [])] == wide


def test_concept_levels_keep_by_length_or_kind(spark):
    text = "本法所稱甲是指乙。" + "無事可記之句子。" * 40
    rows = by_document(concept_spans.concept_levels(frame(spark, [text, None]), 0.0))
    assert list(rows) == [0]
    for r in rows[0]:
        least, most = concept_spans.LEVEL_SIZES[r["level"]]
        assert least <= len(r["content"]) <= most or "definition" in r["kinds"] and r["level"] == "basic_unit_component"
    assert {r["level"] for r in rows[0]} == {"basic_unit", "basic_unit_component", "enumeration"}
    with pytest.raises(ValueError):
        concept_spans.concept_levels(frame(spark, [text]), sizes={"chapter": (1, 2)})


@SHAPE
@given(texts=SOME)
def test_structure_windows_cover_the_text(spark, texts):
    texts = TEXTS + texts
    got = by_document(splitting.structure_windows(frame(spark, texts), 30, 0.1, 10))
    for i, t in enumerate(texts):
        rows = got.get(i, [])
        assert bool(rows) == bool((t or "").strip())
        assert all(t[r["start"] : r["end"]] == r["content"] and len(r["content"]) <= 30 for r in rows)
        covered = {p for r in rows for p in range(r["start"], r["end"])}
        assert not "".join(c for p, c in enumerate(t or "") if p not in covered).strip()


def test_structure_windows_worked_example(spark):
    text = "第1條\n甲乙丙丁。\n第2條\n戊己庚辛壬癸子丑寅卯。"
    rows = by_document(splitting.structure_windows(frame(spark, [text]), 14, 0.0, 0))
    assert [r["content"] for r in rows[0]] == ["第1條\n甲乙丙丁。\n", "第2條\n", "戊己庚辛壬癸子丑寅卯。"]
    short = by_document(splitting.structure_windows(frame(spark, ["一二三四五。六七八九十", "甲因此乙，丙丁戊己庚辛", "甲 乙丙丁戊己庚辛"]), 8, 0.0, 0))
    assert [[r["content"] for r in short[i]] for i in range(3)] == [["一二三四五。", "六七八九十"], ["甲因此乙，", "丙丁戊己庚辛"], ["甲 ", "乙丙丁戊己庚辛"]]


def test_items_follow_their_article_if_they_say_too_little(spark):
    rows = [(1, 0, "item", "p", "（一）甲", "第1條\n主文"), (1, 1, "item", "p", "（二）應向機關申請", "第1條"), (1, 2, "item", "p", "長" * 200, "第1條"), (1, 3, "article", "p", "第1條", None), (1, 4, "item", "p", "（三）", None), (1, 5, "other", None, None, None)]
    got = statutes.six_levels(spark.createDataFrame(rows, "doc_id long, chunk_index int, level string, path string, content string, context string")).orderBy("chunk_index").collect()
    assert [r["content"] for r in got] == ["第1條\n主文\n（一）甲", "（二）應向機關申請", "長" * 200, "第1條", "（三）", None]
    assert [r["in_context"] for r in got] == [True, False, False, False, False, False]
    assert [r["level"] for r in got] == ["enumeration"] * 3 + ["basic_unit", "enumeration", "basic_unit"]


def test_routes_by_kind_and_complexity():
    every = tuple(fusion.RETRIEVERS)
    assert fusion.routes(every, "comparative", True) == {"concept_graph": 1.5, "multi_modal": 1.3}
    assert fusion.routes(("vector_search", "semantic_search"), "normative", False) == {"vector_search": 1.0}
    assert fusion.routes(("hybrid_rag", "hierarchical"), "unheard", True) == {"hybrid_rag": 1.0}
    assert fusion.routes(("concept_graph", "semantic_search"), "comparative", True) == {"concept_graph": 1.5}
    assert fusion.routes(("hybrid_rag", "vector_search"), "normative", True) == {"hybrid_rag": 1.2}
    with pytest.raises(ValueError):
        fusion.routes(("telepathy",), "normative", False)


def test_adaptive_of_nulls(spark):
    queries = spark.createDataFrame([(1, "explicit_article", None, ["第2條"]), (2, None, 0.9, None), (3, "conceptual", 0.9, [])], "query_id long, kind string, complexity double, articles array<string>")
    results = spark.createDataFrame(
        [(1, "hybrid_rag", 7, "第2條 文", 0.5, None), (1, "vector_search", 7, "第2條 文", 0.9, None), (2, "hybrid_rag", 8, None, 0.5, None), (3, "vector_search", 9, "", 0.5, True), (3, "semantic_search", 9, "", 0.3, False), (4, "hybrid_rag", 1, "", 1.0, False)],
        "query_id long, strategy string, result_id long, content string, score double, by_concept boolean",
    )
    got = {(r["query_id"], r["result_id"]): (r["score"], r["strategies"], r["rank"]) for r in fusion.adaptive(queries, results, ("hybrid_rag", "vector_search", "semantic_search")).collect()}
    assert got == {(1, 7): (0.9, 1, 1), (2, 8): (0.5, 1, 1), (3, 9): (0.495, 2, 1)}


def test_paths_are_walked_in_tasks_without_shuffling_paths(spark, monkeypatch):
    import random

    from tessera.operators import enrichment

    rng = random.Random(8)
    names = [f"n{i}" for i in range(14)] + ["é", "重製"]
    rows = sorted({(rng.choice(names), rng.choice(names)) for _ in range(70)})
    weight = {e: rng.choice((1.0, 0.5, 1 / 128, 1 / 3, 0.0000005)) for e in rows}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()] + [("n1", None, 1.0)], "src string, dst string, confidence double")
    starts = spark.createDataFrame([("n1",), ("n2",), ("é",), ("alone",), (None,)], "concept string")

    def walk(path, most):
        for a, b in rows:
            if a == path[-1] and b not in path and len(path) <= most:
                yield [*path, b]
                yield from walk([*path, b], most)

    for most in (1, 3, 4):
        want = sorted((s, ">".join(p), len(p) - 1) for s in ("n1", "n2", "é") for p in walk([s], most))
        with monkeypatch.context() as m:
            m.setattr(enrichment, "EDGES", 0)
            joined = sorted(map(tuple, enrichment.paths(edges, starts, most).collect()))
        with monkeypatch.context() as m:
            m.setattr(enrichment, "ROWS", 5)
            got = enrichment.paths(edges, starts, most)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, got.collect())) == joined and plan.count("Join") <= 1
        assert [r[:3] for r in joined] == want
    assert enrichment.paths(edges.where("false"), starts).count() == 0 and enrichment.paths(edges, starts.where("false")).count() == 0


def test_numbers_are_rounded_as_spark_rounds_them(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tessera.operators.enrichment import rounded

    x = [0.0, 1.0, 1 / 128, 3 / 128, 0.0000005, 0.1234565, 0.12345649999999999, 2 / 3, -1 / 128, 1234.5678905, *np.random.default_rng(1).random(200).tolist(), *[(1 / a + 1 / b) / 2 for a in range(1, 65) for b in (1, 64)]]
    want = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("v")).collect()]
    assert rounded(np.array(x)).tolist() == want
