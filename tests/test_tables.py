"""Table functions give the rows of the functions that they name."""

import pytest

from tessera import catalog
from tessera.functions import tables

TEXT = "第1條\n本法所稱著作，是指文學之創作。如有下列情形時，不在此限。\n\n第2條\n因此應向主管機關申請註冊。" * 12


@pytest.mark.parametrize("name", sorted(tables.SPLITTERS))
def test_splitters_by_name(spark, name):
    docs = spark.createDataFrame([(1, TEXT), (2, "short text. another one."), (3, None), (4, "")], "doc_id long, text string")
    docs.createOrReplaceTempView("texts_to_split")
    tables.register(spark, name)
    want = sorted(map(str, tables.SPLITTERS[name](docs).collect()))
    assert want
    for dealt in (" PARTITION BY doc_id", ""):
        got = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT doc_id, text FROM texts_to_split){dealt})")
        assert sorted(map(str, got.collect())) == want


def test_parameters_of_a_table_function(spark):
    spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string").createOrReplaceTempView("texts_to_split")
    tables.register(spark, "split_recursive", size=30, overlap=5)
    rows = spark.sql("SELECT t.content FROM split_recursive(TABLE(texts_to_split)) t").collect()
    assert len(rows) > 3 and max(len(r.content) for r in rows) <= 30


def test_keywords_are_ranked_in_their_row_and_numerals_searched_once(spark, tmp_path):
    rows = [(1, "bb aa bb cc cc aa dd ee ff ff ff"), (2, None), (3, ""), (4, "xx yy xx"), (4, "yy zz zz zz xx"), (None, "pp qq qq")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id or 0, r["rank"], r.word) for r in catalog.QUERIES["keywords"](spark, str(tmp_path)).collect()))
    assert got == [(0, 1, "qq"), (0, 2, "pp"), (1, 1, "ff"), (1, 2, "bb"), (1, 3, "aa"), (1, 4, "cc"), (1, 5, "dd"), (4, 1, "xx"), (4, 2, "zz"), (4, 3, "yy")]
    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan("keywords") and plan("cn_numeral").count("regexp_extract_all") == 1


def test_citations_read_the_statutes_once(spark):
    plan = catalog.QUERIES["citation_query"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "rlike" not in plan.lower()


def test_citations_travel_to_the_nodes_and_labels_are_parsed_once(spark, monkeypatch):
    from tessera.functions import labels
    from tessera.operators import statutes

    names = ["doc_id", "law", *statutes.LEVELS, "kind", "place", "title", "content", "id"]
    rows = [(i, "法規名稱：民法", "第一章", None, f"第{i % 3 + 1}條", None, None, None, "article", [0, 0, 0, i], None, "", None) for i in range(300)]
    nodes = spark.createDataFrame(rows, "doc_id long, law string, " + ", ".join(f"{k} string" for k in statutes.LEVELS) + ", kind string, place array<int>, title string, content string, id string").toDF(*names)
    asked = spark.createDataFrame([(1, "民法第2條"), (2, "第一章"), (3, "刑法")], "query_id long, citation string")
    seen = []
    parsed = labels.level_info
    monkeypatch.setattr(labels, "level_info", lambda label, level: (seen.append(str(label)), parsed(label, level))[1])
    got = statutes.citation_search(nodes, asked)
    assert all("label" in s for s in seen)  # not the columns of the nodes
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" not in plan
    want = [(1, i) for i in range(300) if i % 3 == 1] + [(2, i) for i in range(300)]
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == want
