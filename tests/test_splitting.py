"""Sequential splitters against brute force, worked examples and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking, learning, splitting

TEXTS = [None, "", "  \n ", "短句。", "一二三。四五六！七八九十" * 30, "word " * 200, "no stops at all" * 40, "\n\n".join(["para one is here", "two, three; four " * 20, "x" * 130]), "句。" * 300]
SHAPE = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SOME = st.lists(st.text(alphabet="ab。\n ，", max_size=160), min_size=1, max_size=5)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, content string")


def by_document(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["chunk_index"])):
        got.setdefault(r["doc_id"], []).append(r)
    return got


def slowly(text, size, tolerance, overlap, ends):
    """Looks at every position of the window's end."""
    out, at = [], 0
    while at < len(text):
        places = [i + 1 for i, c in enumerate(text) if c in ends and at + size - tolerance < i <= at + size]
        stop = max(places, default=min(len(text), at + size))
        out += [text[at:stop].strip()] if text[at:stop].strip() else []
        if stop == len(text):
            break
        at = stop - overlap
    return out


@pytest.mark.parametrize("size, overlap", [(5, 1), (3, 0), (500, 50)])
def test_windows_of_long_texts_are_cut_from_pieces(spark, monkeypatch, size, overlap):
    texts = [t for t in [*TEXTS, "著作é𝄞ab" * 90] if t]
    step, cut, asked = size - overlap, {}, F.substr
    for i, t in enumerate(texts):
        cut[i] = [(t[s : s + size], s, min(s + size, len(t))) for s in range(0, max(0, len(t) - overlap - 1) + 1, step) if t[s : s + size].strip(" ")]
    whole = []
    monkeypatch.setattr(F, "substr", lambda c, *rest: whole.append(str(c)) or asked(c, *rest))
    got = by_document(chunking.sliding_stop(frame(spark, texts).select("doc_id", "text"), size, overlap))
    assert {i: [(r["content"], r["start"], r["end"]) for r in rows] for i, rows in got.items()} == {i: c for i, c in cut.items() if c}
    assert whole.count("text") == 1  # only pieces are cut from the whole text, windows from pieces


@SHAPE
@given(texts=SOME)
def test_boundary_windows_against_brute_force(spark, texts):
    texts = TEXTS + texts
    got = by_document(splitting.boundary_windows(frame(spark, texts), 40, 12, 5))
    for i, t in enumerate(texts):
        rows = got.get(i, [])
        assert [r["content"] for r in rows] == slowly(t or "", 40, 12, 5, splitting.SENTENCE_ENDS)
        assert all(t[r["start"] : r["end"]] == r["content"] for r in rows)


@SHAPE
@given(texts=SOME)
def test_recursive_chunks_are_stretches_that_cover_the_text(spark, texts):
    texts = TEXTS + texts
    got = by_document(splitting.recursive(frame(spark, texts), 30, 6))
    for i, t in enumerate(texts):
        rows = got.get(i, [])
        assert bool(rows) == bool((t or "").strip())
        covered = set()
        for r in rows:
            assert t[r["start"] : r["end"]] == r["content"]
            covered.update(range(r["start"], r["end"]))
        assert all(t[k] in "".join(splitting.SEPARATORS) for k in set(range(len(t or ""))) - covered if rows)


def test_recursive_worked_examples(spark):
    texts = ["aaaa bbbb cccc", "aaaa。bbbb bbbb bbbb", "abcdefghijklm", "ab\n\ncd"]
    got = by_document(splitting.recursive(frame(spark, texts), 9, 0))
    assert [[r["content"] for r in got[i]] for i in range(4)] == [["aaaa bbbb", "cccc"], ["aaaa", "bbbb bbbb bbbb"], ["abcdefghi", "jklm"], ["ab\n\ncd"]]
    lapped = by_document(splitting.recursive(frame(spark, ["aaaa bbbb cccc"]), 9, 2))
    assert [r["content"] for r in lapped[0]] == ["aaaa bbbb", "bb cccc"]


def test_structured_lines_worked_example(spark):
    text = "第一章 總則\n第1條\n" + "甲" * 30 + "\n\n  第2條 \n" + "乙" * 30 + "\n第3條\n丙"
    got = by_document(splitting.structured_lines(frame(spark, [text, None, " \n"]), 100, 20, 1))
    assert list(got) == [0]
    assert [r["content"] for r in got[0]] == ["第一章 總則\n第1條\n" + "甲" * 30, "甲" * 30 + "\n第2條\n" + "乙" * 30, "乙" * 30 + "\n第3條\n丙"]
    merged = by_document(splitting.structured_lines(frame(spark, [text]), 100, 20, 0))
    assert merged[0][-1]["content"] == "第2條\n" + "乙" * 30 + "\n第3條\n丙"


def test_sizes_are_checked(spark):
    for bad in (lambda: splitting.recursive(frame(spark, ["a"]), 5, 5), lambda: splitting.boundary_windows(frame(spark, ["a"]), 10, 5, 5)):
        with pytest.raises(ValueError):
            bad()


def test_expansion_of_nulls_and_empty_names(spark):
    queries = spark.createDataFrame([(1, None), (2, ""), (3, "Tax law")], "query_id long, text string")
    concepts = spark.createDataFrame([(1, "", 1.0), (2, None, 1.0), (3, "LAW", 0.5), (4, "w", 0.5)], "order int, name string, confidence double")
    relations = spark.createDataFrame([], "order int, source string, target string, confidence double")
    got = {r["query_id"]: (r["expanded"], r["boost"]) for r in learning.expand(queries, concepts, relations).collect()}
    assert got == {1: ("", 0.0), 2: ("", 0.0), 3: ("Tax law LAW w", 0.1)}


def test_windows_are_cut_once_a_text(spark):
    docs = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "   ")], "doc_id long, text string")
    got = chunking.fixed_ratio(docs, 3, 0.4)
    assert sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in got.collect()) == [(1, 0, "abc"), (1, 1, "cde"), (1, 2, "efg"), (1, 3, "g")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("substr") == 2  # of a piece and of its windows; more: the array is made anew for a filter
