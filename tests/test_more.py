"""What SQL cannot express, against plain Python on small tables; and texts of scripts that the test data lack."""

import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import asking, chunking, enrichment, evaluation, fusion, gold, graph, metadata, pipelines, question_spans, retrieval, splitting, statutes

STATUTE = "著作人專有重製其著作之權利。依第2條規定，申請人應依程序申請登記。但有下列情形之一者，不在此限。違反前項規定者，處罰金。"


def words(text):
    low = text.lower()
    long = [w for w in re.split(r"(?:[^\w]|[一-鿿])+", low) if len(w) >= 2]
    return long + [h[i : i + 2] for h in re.findall(r"[一-鿿]+", low) if len(h) >= 2 for i in range(len(h) - 1)]


# --- words of any script ------------------------------------------------------------------------------------------------------------
def test_words_of_any_script(spark):
    texts = ["für Über ÉCOLE", "著作權法 a bc", "第3條 x", "", None, "字", "mixed著作word 42", "привет мир"]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.words(F.col("t")).alias("w"), T.words(F.col("t"), tokenizer="run").alias("r"), T.words(F.col("t"), tokenizer="char").alias("c"), T.importance_tokens(F.col("t")).alias("m"), T.nfkc("t").alias("n")).orderBy("i").collect()
    assert [r["w"] for r in got] == [words(t or "") for t in texts]
    assert got[1]["r"] == ["bc", "著作權法"] and got[1]["c"] == ["bc", "著", "作", "權", "法"] and "42" not in got[6]["m"] and got[5]["w"] == []
    assert spark.createDataFrame([("Ⅷ（３）",)], "t string").select(T.nfkc("t")).first()[0] == "VIII(3)"
    assert spark.createDataFrame([("b a b c a b",)], "t string").select(T.keywords(F.regexp_replace("t", "([a-c])", "$1$1"), 2)).first()[0] == ["bb", "aa"]


def test_searches_find_chinese(spark):
    rows = [(1, 0, STATUTE), (2, 0, "商標權人得禁止他人使用。"), (3, 0, "plain text without any"), (4, 0, "著作之重製與散布。")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")
    asked = spark.createDataFrame([(1, "重製著作"), (2, "商標"), (3, "nothing here")], "item_id long, text string")
    n, tokens = len(rows), [words(t) for *_, t in rows]
    df = Counter(w for t in tokens for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    avg = sum(map(len, tokens)) / n
    got = retrieval.bm25(chunks, asked).collect()
    for r in got:
        t = tokens[r["doc_id"] - 1]
        q = words({1: "重製著作", 2: "商標"}[r["query_id"]])
        want = sum((raw[w] if raw[w] >= 0 else floor) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in q if w in t)
        assert r["score"] == pytest.approx(want, abs=1e-6)
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(1, 1), (1, 4), (2, 2)} == {(r["query_id"], r["doc_id"]) for r in retrieval.tfidf(chunks, asked).collect()}
    both = retrieval.index(chunks, None, retrieval.with_bigrams(T.words(F.col("content")))), retrieval.query_terms(asked, tokens=retrieval.with_bigrams(T.words(F.col("text"))))
    hits = lambda share: {(r["query_id"], r["doc_id"]) for r in retrieval.tfidf_scores(*both, max_df=share).collect()}
    assert hits(1.0) == {(1, 1), (1, 4), (2, 2)} and hits(0.4) == {(2, 2)}  # the first question's words are in half of the chunks


def test_dense_in_several_blocks(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((60, 6)))] + [(60, None), (61, [0.0] * 6)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, retrieval.dense(v, v.where("vec_id % 3 = 0"), 4).collect()))
    assert sorted(map(tuple, retrieval.dense(v, v.where("vec_id % 3 = 0"), 4, block=5).collect())) == one and len(one) == 80
    assert retrieval.dense(v, v.where("vec_id > 900")).count() == 0


def test_fusion_does_not_depend_on_the_order(spark):
    rows = [(1, level, 9, "text", s, 1) for level, s in (("basic_unit", 0.167247), ("enumeration", 0.1672475), ("document", 0.100001))]
    frame = spark.createDataFrame(rows, "query_id long, level string, doc_id long, content string, score double, rank int")
    for strategy in fusion.STRATEGIES:
        got = {fusion.fuse(frame.orderBy(*order), strategy).select("score").first()[0] for order in (["level"], [F.desc("level")], ["score"])}
        assert len(got) == 1
    assert fusion.fuse(frame, "comb_anz").first()["level_scores"] == {"basic_unit": 0.167247, "enumeration": 0.1672475, "document": 0.100001}


# --- question sets to spans --------------------------------------------------------------------------------------------------------
def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best / max(len(a), len(b))


def test_longest_common_substring(spark):
    pairs = [("abcdef", "zabcy"), ("", "x"), ("著作權", "著作權"), ("aXbXc", "XbX"), ("ab", "cd"), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(question_spans.longest_common_share("a", "b").alias("x")).collect()
    assert [r["x"] for r in got] == [longest_common(a, b) if a and b else 0.0 for a, b in pairs]


def keys(text):
    out = set()
    for m in re.findall(r"第[0-9]+條(?:[之-][0-9]*|[0-9]+)?", re.sub("[ 　]+", "", text)):
        n, suffix = re.search("第([0-9]+)條", m)[1], re.search("條[之-]([0-9]*)", m)
        out |= {n} if m.endswith("條") else {f"{n}-{suffix[1][:k]}" for k in range(1, len(suffix[1]) + 1)} if suffix else set()
    return out


def test_question_spans_by_the_cascade(spark):
    spans = [(1, "第1條", "本法所稱著作，指屬於文學、科學之創作。"), (2, "第2條之1", "申請登記者應依程序辦理。"), (3, "第3條", "合理使用之範圍 alpha beta gamma."), (4, "第2條", "權利與義務之規定。"), (5, "第9條", None), (6, "第12條", "alpha beta gamma delta, epsilon zeta eta.")]
    items = [(1, "q", "第1條：x"), (2, "q", "第2條之1"), (3, "第3條之7", "ans"), (4, "q", "alpha beta gamma delta"), (5, "q", "申請登記者應依程序"), (6, "q", ""), (7, "zz", "qqqq wwww"), (8, "qqq", "權利義務規定之")]
    said = {i: f"{a} {q}" for i, q, a in items if a}
    want = set()
    base = {s: {k.split("-")[0] for k in keys(a)} for s, a, _ in spans}
    word = lambda t: list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", t) if len(w) >= 2))
    for i, text in said.items():
        exact = {(i, s, "article") for s, a, _ in spans if keys(a) & keys(text)}
        loose = {(i, s, "number") for s in base if base[s] & {k.split("-")[0] for k in keys(text)}}
        if exact or loose:
            want |= exact or loose
            continue
        answer = next(a for j, _, a in items if j == i)
        terms = [w for w in V.LEGAL_KEYWORDS + V.ABOUT if w in text]
        cut = lambda t: [x.strip() for x in re.split("[。！？；.!?;]", t) if len(x.strip()) > 5]
        alike = lambda a, b: len({*word(a)} & {*word(b)}) / len({*word(a)} | {*word(b)}) if word(a) and word(b) else 0.0
        tries = [
            ("keywords", 0.3, 3, lambda t: sum(len(w) for w in word(text) if w in t) / sum(map(len, word(text))) if word(text) else 0),
            ("characters", 0.4, 2, lambda t: len({*answer} & {*t}) / len({*answer} | {*t})),
            ("overlap", 0.4, 2, lambda t: longest_common(answer, t)),
            ("sentences", 0.3, 2, lambda t: sum(x for x in (max((alike(a, b) for b in cut(t)), default=0) for a in cut(answer)) if x > 0.5) / len(cut(answer)) if cut(answer) else 0),
            ("concepts", 0.3, 2, lambda t: 0.7 * sum(w in t for w in terms) / len(terms) + 0.3 * min(len(t) / 200, 1) if terms else 0),
        ]
        for name, least, most, score in tries:
            got = sorted(((-round(score(t), 6), s) for s, _, t in spans if t and round(score(t), 6) > least))[:most]
            if got:
                want |= {(i, s, name) for _, s in got}
                break
    found = question_spans.spans_of_questions(spark.createDataFrame(items, "query_id long, query string, answer string"), spark.createDataFrame(spans, "span_id long, article string, text string"))
    assert {(r["query_id"], r["span_id"], r["strategy"]) for r in found.collect()} == want and len({x[2] for x in want}) >= 3


# --- concept graphs -------------------------------------------------------------------------------------------------------------------
DOCS = [(1, STATUTE + "因此主管機關應予核准，包括前述情形。"), (2, "商標權人於侵害時，專有排除侵害之權利。除外規定另定之。第5條 不得為仿冒行為。"), (3, "plain"), (4, STATUTE), (5, None), (6, "如有侵害時，必須儘速辦理。所以申請人必須具備資格，但不得轉讓，不在此限。")]


def test_concept_graph_against_plain_python(spark):
    concepts, order = {}, []
    for doc, text in DOCS:
        for i, (name, kind, weight, ps) in enumerate(V.GRAPH_CONCEPTS):
            for j, p in enumerate(ps):
                for m in re.finditer(p, text or "", re.S):
                    key = m[0].strip().lower()
                    around = re.findall(r"第\s*([0-9]+)\s*條", text[max(0, m.start() - 200) : m.end() + 200])
                    if key not in concepts:
                        concepts[key] = [name, kind, weight, m[0].strip(), set()]
                        order.append(key)
                    concepts[key][4] |= {f"第{n}條" for n in around}
    typed = {}
    for doc, text in DOCS:
        for i, (name, ps) in enumerate(V.GRAPH_RELATIONS):
            for j, p in enumerate(ps):
                for m in re.finditer(p, text or "", re.S):
                    near = text[max(0, m.start() - 300) : m.end() + 300]
                    here = [c for c in order if concepts[c][3] in near]
                    share = len({*near.split()} & {*m[0].split()}) / max(1, len({*near.split()}))
                    for a, b in zip(here, here[1:]):
                        typed.setdefault((a, b, name), []).append(round(min(1, len(m[0].strip()) / 50 + 0.5 * share), 6))
    want = {}
    for (a, b, name), cs in typed.items():  # the last type of a pair to come up counts
        want[a, b] = (name, max(cs))
    found = graph.occurrences(spark.createDataFrame(DOCS, "doc_id long, content string"))
    nodes = graph.nodes(found)
    assert {r["concept"]: (r["name"], r["kind"], r["importance"], r["content"], tuple(r["articles"])) for r in nodes.collect()} == {k: (*v[:4], tuple(sorted(v[4]))) for k, v in concepts.items()}
    edges = graph.edges(found, nodes)
    assert {(r["src"], r["dst"]): (r["type"], r["confidence"]) for r in edges.collect()} == want and len(want) > 3

    query = "侵害 時 權利"
    shares = lambda t: any(w in t.lower() for w in query.split()) or any(w in query and w in t.lower() for w in V.GRAPH_KEYWORDS)
    paths, out = set(), defaultdict(list)
    for a, b in want:
        out[a].append(b)

    def go(path):
        if len(path) > 1:
            paths.add(path)
        if len(path) <= 3:
            for b in out[path[-1]]:
                if b not in path:
                    go((*path, b))

    for c in order:
        if shares(concepts[c][3]):
            go((c,))
    mean = lambda p: round(sum(concepts[c][2] for c in p) / len(p), 6)
    best = sorted(paths, key=lambda p: (-len(p), -mean(p), ">".join(p)))[:10]
    rows = []
    for p in best:
        along = round(sum(want[e][1] for e in zip(p, p[1:])) / (len(p) - 1), 6)
        rows += [(c, round(0.6 * concepts[c][2] + 0.4 * along, 6), len(rows) + i) for i, c in enumerate(p)]
    rows = sorted(rows[:5], key=lambda r: (-r[1], r[2]))
    got = graph.search(spark.createDataFrame([(1, query)], "query_id long, text string"), nodes, edges).orderBy("rank").collect()
    assert [(r["concept"], r["score"]) for r in got] == [(c, s) for c, s, _ in rows] and rows


# --- importance of articles -----------------------------------------------------------------------------------------------------------
def test_dynamic_importance_against_plain_python(spark):
    texts = ["權利 alpha beta beta gamma", "alpha 義務與權利 delta", "gamma gamma epsilon zeta 12", "", "eta theta"]
    rows = [(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "alone here"), (2, 1, "alone there")]
    got = {(r["law"], r["article_id"]): r for r in retrieval.dynamic_importance(spark.createDataFrame(rows, "law long, article_id long, text string")).collect()}
    tok = lambda t: [w for w in words(t) if w not in T.STOP_WORDS and not w.isdigit()]
    grams = lambda t: (lambda w: w + [" ".join(x) for x in zip(w, w[1:])])(tok(t))
    clip = lambda x: round(min(5.0, max(0.1, x)), 2)
    for law in (1, 2):
        docs = [t for k, _, t in rows if k == law]
        for i, target in enumerate(docs):
            every = [grams(t) for t in [*docs, target]]
            n, df = len(every), Counter(w for t in every for w in set(t))
            idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items() if d <= n * 0.95}
            vec = [{w: t.count(w) * idf[w] for w in set(t) if w in idf} for t in every]
            unit = [{w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in vec]
            tf = clip(10 * (0.7 * sum(unit[-1].values()) + 0.3 * sum(sum(unit[-1].get(w, 0) * x for w, x in u.items()) for u in unit[:-1]) / (n - 1))) if unit[-1] else 1.0
            toks = [tok(t) for t in docs]
            m, avg, dfs = len(toks), sum(map(len, toks)) / len(toks), Counter(w for t in toks for w in set(t))
            raw = {w: math.log(m - d + 0.5) - math.log(d + 0.5) for w, d in dfs.items()}
            floor = 0.25 * sum(raw.values()) / len(raw)
            scores = [sum((raw[w] if raw[w] >= 0 else floor) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in toks[i] if w in t) for t in toks]
            bm = clip(2 * (0.6 * sum(scores) / m + 0.4 * max(scores))) if toks[i] else 1.0
            r = got[law, i]
            assert r["tfidf"] == pytest.approx(tf, abs=0.011) and r["bm25"] == pytest.approx(bm, abs=0.011), (law, i, r, tf, bm)


def test_importance_in_tasks_and_by_joins_without_pairs_of_articles_and_terms(spark):
    rng = np.random.default_rng(8)
    rows = [(law, i, " ".join(rng.choice([f"w{x}" for x in range(30)], rng.integers(0, 25)))) for law, n in ((1, 40), (2, 1), (3, 7), (4, 0), (5, 25)) for i in range(n)] + [(3, 99, None)]
    articles = spark.createDataFrame(rows, "law long, article_id long, text string").repartition(3)
    sort = lambda df: sorted(tuple(r) for r in df.select("law", "article_id", "tfidf", "bm25", "importance").collect())
    tasks, joins, both = (sort(retrieval.dynamic_importance(articles, together=n)) for n in (512, 0, 10))
    assert len(tasks) == len(rows)
    for other in (joins, both):
        assert [r[:2] for r in other] == [r[:2] for r in tasks] and np.abs(np.array(other)[:, 2:] - np.array(tasks)[:, 2:]).max() < 0.011
    # a law's articles are not joined with all terms of the law
    assert "Join" not in retrieval.dynamic_importance(articles)._jdf.queryExecution().executedPlan().toString()


# --- splitting --------------------------------------------------------------------------------------------------------------------------
def test_sentence_length_chooses_the_window(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab 。"), n, p=[0.5, 0.3, 0.15, 0.05])) for n in (0, 1, 70, 500, 1300)] + ["x" * 400, None]

    def slow(text, size=60, other=40, overlap=7, share=0.5):
        at, out = 0, []
        while at < len(text):
            rest = text[at:]
            stop = min(len(text), at + (other if len(rest) / max(1, rest.count("。")) > size * share else size))
            if text[at:stop].strip():
                out.append(text[at:stop].strip())
            if stop == len(text):
                break
            at = max(at + 1, stop - overlap)
        return out

    got = splitting.by_sentence_length(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 60, 40, 7).orderBy("doc_id", "chunk_index").collect()
    assert [[r["content"] for r in got if r["doc_id"] == i] for i in range(len(texts))] == [slow(t or "") for t in texts]


def test_prefixed_structure(spark):
    text = "第一章 總則\n\n第1條\n" + "甲。" * 30 + "\n一、款\n" + "乙。" * 30 + "\n第2條\n短。"
    got = splitting.prefixed_structure(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string"), 50, 5).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in got} == {1} and got[0]["content"] == "第一章 總則" and got[-1]["content"] == "第2條\n短。" and got[-1]["prefix"] == ""
    cut = [r for r in got if r["prefix"]]
    assert len(cut) > 2 and all(r["prefix"].startswith("【第一章 總則】\n第1條\n") for r in cut) and all(len(r["content"]) <= 50 + len(r["prefix"]) for r in cut)
    assert "".join(c for r in cut for c in r["content"][len(r["prefix"]) :]).count("甲") >= 30
    with pytest.raises(ValueError):
        splitting.prefixed_structure(spark.createDataFrame([(1, text)], "doc_id long, text string"), 5, 5)


def test_strategies_by_name(spark):
    docs = spark.createDataFrame([(1, "Ein Satz. Noch einer.\n" * 40), (2, None)], "doc_id long, text string")
    for name in ("fixed_size", "sliding_window", "hierarchical", "rcts_hierarchical", "recursive", "paragraph", "semantic", "llm_semantic", "adaptive", "hybrid", "mean_sentence", "semantic_integrity", "no such"):
        assert chunking.strategy(name, chunk_size=200, overlap_ratio=0.1)(docs).where("doc_id = 1").count() > 0
    got = chunking.batch(docs, ("fixed_size",), (100,), (0.0, 1.0))
    assert [r["overlap_ratio"] for r in got.select("overlap_ratio").distinct().collect()] == [0.0]  # a ratio of 1 is refused and left out


def test_spans_are_recovered_in_order(spark):
    text = "aa bb aa bb cc"
    rows = [(1, 0, "aa bb"), (1, 1, "aa bb"), (1, 2, "aa"), (1, 3, "nowhere"), (1, 4, "cc")]
    got = chunking.recovered_spans(spark.createDataFrame(rows, "doc_id long, chunk_index int, content string"), spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()

    at, want = 0, []
    for *_, c in rows:
        start = text.find(c, at) if text.find(c, at) >= 0 else text.find(c) if c in text else at
        end = min(start + len(c), len(text))
        want.append((start, end))
        at = max(end, start)
    assert [(r["start"], r["end"]) for r in got] == want


# --- statutes, metadata, questions --------------------------------------------------------------------------------------------------------
def test_json_statutes_and_stores(spark, tmp_path):
    law = {"laws": [{"law_name": "法規名稱：甲法", "chapters": [{"chapter": "第一章", "sections": [{"section": "未分類節", "articles": [
        {"article": "第1條", "content": "本文。", "metadata": {"id": "法規名稱：甲法_1"}, "items": [{"item": "1", "content": "項一", "sub_items": [{"sub_item": "x", "content": "款"}]}]},
        {"article": "第2條", "content": "（刪除）"}, {"article": "未標示條文", "content": "法規名稱 前言"}]}]}]}]}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps(law, ensure_ascii=False))
    (tmp_path / "j" / "b.json").write_text("no json")
    read = sources.json_documents(spark, str(tmp_path / "j")).where("laws IS NOT NULL").select(F.lit(1).cast("long").alias("doc_id"), "laws", "filename")
    assert read.first()["filename"] == "a.json"
    nodes = statutes.tree_nodes(read)
    assert statutes.tree_text(nodes).first()["text"].split("\n\n") == ["法規名稱：甲法", "第一章", "未分類節", "第1條", "本文。", "1", "項一", "x", "款", "第2條", "（刪除）", "未標示條文", "法規名稱 前言"]
    assert [(r["kind"], r["category"], r["article_number"], r["item_number"], r["id"]) for r in statutes.normalised(nodes).orderBy("place").collect()] == [("article", "甲法", 1, None, "甲法_1"), ("paragraph", "甲法", 1, 1, None), ("subparagraph", "甲法", 1, None, None), ("article", "甲法", 2, None, None)]
    assert [r["content"] for r in statutes.unit_chunks(nodes, "article").orderBy("chunk_index").collect()][0] == "【法規名稱：甲法】\n第一章\n第1條\n本文。\n1\n項一\n一\n款"
    assert [r["chunk_id"] for r in statutes.node_chunks(nodes, 4, 1).orderBy("chunk_id").collect()][:2] == ["未標示條文_part_1", "未標示條文_part_2"]
    assert sources.json_statutes(spark.createDataFrame([("{",), (None,)], "json string")).where("laws IS NOT NULL").count() == 0

    chunks = spark.createDataFrame([(1, "basic_unit", "a"), (2, "document", "b")], "doc_id long, level string, content string")
    sources.write_levels(chunks, str(tmp_path / "store"))
    sources.write_levels(chunks.where("level = 'document'").withColumn("content", F.lit("new")), str(tmp_path / "store"))
    assert {r["content"] for r in sources.read_levels(spark, str(tmp_path / "store")).collect()} == {"a", "new"} and sources.read_levels(spark, str(tmp_path / "store"), ("document",)).count() == 1
    assert {(r["doc_id"], r["content"]) for r in sources.replace_documents(chunks, chunks.where("doc_id = 2").withColumn("content", F.lit("c"))).collect()} == {(1, "a"), (2, "c")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text(" text ")
    (tmp_path / "t" / "y.txt").write_text("  ")
    assert [(r["filename"], r["text"]) for r in sources.text_documents(spark, str(tmp_path / "t")).collect()] == [("x.txt", "text")]


def test_statutes_are_walked_once_and_dealt_once(spark):
    part = {"paragraph": "1", "content": "項", "subparagraphs": [{"subparagraph": "甲", "content": "款", "items": [{"item": "x", "content": "目"}]}]}
    articles = [{"article": "第1條", "content": "一", "paragraphs": [part]}, {"article": "第2條", "content": "（刪除）", "items": [{"item": "1", "content": "舊項", "sub_items": [{"sub_item": "乙", "content": "舊款"}]}]}, {"article": "第3條", "content": "三", "items": [{"item": "2", "content": "尾"}]}]
    laws = [{"law_name": "甲法", "chapters": [{"chapter": "第一章", "sections": [{"section": "未分類節", "articles": articles}]}, {"chapter": "第二章"}]}, {"law_name": "乙法"}]
    rows = [(1, json.dumps({"laws": laws})), (2, json.dumps({"laws": []})), (3, None)]
    nodes = statutes.tree_nodes(sources.json_statutes(spark.createDataFrame(rows, "doc_id long, json string")))
    got = {tuple(r["place"]): (r["kind"], r["article"], r["title"], r["content"]) for r in nodes.collect()}
    assert len(got) == nodes.count() == 14
    assert got[0, 0, 0, 0, 0, 0, 0] == ("item", "第1條", "x", "目") and got[0, 0, 0, 1, 0, 0] == ("subparagraph", "第2條", "乙", "舊款") and got[1,] == ("law", None, "乙法", "") and got[0, 1] == ("chapter", None, "第二章", "")
    units = statutes.unit_chunks(nodes, "law")
    assert [r["content"] for r in units.orderBy("chunk_index").collect()] == ["【甲法】\n第一章\n第1條\n一\n1\n項\n一\n款\n(一)\n目\n第3條\n三\n2\n尾\n第二章", "【乙法】"]
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan and "Union" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_matches_do_not_depend_on_how_much_a_task_takes_apart_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([*DOCS, (99, None), (98, "")], "doc_id long, content string").coalesce(1)
    want = sorted(map(str, graph.occurrences(docs).collect()))
    monkeypatch.setattr(graph, "PIECE", 1)
    assert sorted(map(str, graph.occurrences(docs).collect())) == want and want


def test_citations_in_words(spark):
    texts = ["著作權法第十條之一第2項第三款", "第3條-2", "民法", "第一章第二節", "", "第 5 條 第（一）目"]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(statutes.cited(F.col("t")).alias("c")).collect()]
    assert (got[0]["law"], got[0]["article"], got[0]["paragraph"], got[0]["subparagraph"]) == ("著作權法", "10-1", "2", "3")
    assert got[1]["article"] == "3-2" and got[2]["law"] == "民法" and (got[3]["chapter"], got[3]["section"]) == ("1", "2") and got[4]["law"] is None and got[5]["article"] == "5"


def test_metadata_inherits_and_repeats(spark):
    rows = [("a", "商標法第1條 商標權人專有權利，應申請註冊。", "article", "商標法", 1), ("b", "商標法 說明", None, "商標法", 1), ("c", "商標法 說明", None, "商標法", 1), ("d", "第一章 總則", "chapter", "", None), ("e", None, None, None, None), ("f", "nothing", None, "", None)]
    got = {r["chunk_id"]: r for r in metadata.enhanced(spark.createDataFrame(rows, "chunk_id string, content string, level string, category string, article_number int")).collect()}
    assert [got[k]["enhancement"] for k in "abcdef"] == ["full", "inherited", "inherited", "medium", "light", "light"] and got["b"]["type"] == got["a"]["type"] and got["c"]["inherited_from"] == "商標法_第1條"
    assert metadata.statistics(metadata.enhanced(spark.createDataFrame([], "chunk_id string, content string, level string, category string, article_number int"))).count() == 0


def test_gold_places(spark):
    texts = ["第3條第1項第1款：本法用詞", "第28-1條", "第十條之一", "（三）", "第二目之3", None, "第３條"]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(gold.place(F.col("t")).alias("p")).collect()]
    assert [(p["article_number"], p["article_suffix"], p["item_number"], p["clause_type"], p["clause_number"], p["clause_sub_number"]) for p in got] == [
        (3, None, 1, "款", 1, None), (28, 1, None, None, None, None), (10, 1, None, None, None, None), (None, None, None, "目", 3, None), (None, None, None, "目之", 2, 3), (None,) * 6, (3, None, None, None, None, None)
    ]


def test_gold_articles_are_the_first_named(spark):
    texts = ["第42條：第12條之1準用之，第12條不準用。", "第5-2條，第7條之1", "依第9條及第3-1條", "第4條之二，第6條", "之1"]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(gold.place(F.col("t")).alias("p")).collect()]
    assert [(p["article_number"], p["article_suffix"]) for p in got] == [(42, None), (5, 2), (9, None), (4, 2), (None, None)]


def test_answers_fall_back_to_first_sentences(spark):
    rows = [(1, "重製", 1, "無關文字。 第二句。 第三句。"), (1, "重製", 2, "又一句！ 末句。"), (1, "重製", 3, "不取。"), (2, "alpha", 1, "no. Alpha here! other"), (2, "alpha", 2, "Alpha here!")]
    got = enrichment.extractive_answers(spark.createDataFrame(rows, "query_id long, question string, rank int, content string")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["sentence"]) for r in got] == [(1, "無關文字。"), (1, "第二句。"), (1, "又一句！"), (1, "末句。"), (2, "no. Alpha here!"), (2, "Alpha here!")]


def test_routes_and_levels_on_nothing(spark):
    none = spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    assert pipelines.by_hierarchy(none, spark.createDataFrame([], "chunk_id long, hierarchy string")).count() == 0
    assert statutes.level_histogram(spark.createDataFrame([], "level string")).where("n = 0").count() == 6
    assert evaluation.rule_measures(spark.createDataFrame([], "query_id long, rank int, relevant boolean"), 5).count() == 0
    assert asking.analysed(spark.createDataFrame([(1, None)], "query_id long, text string")).first()["kind"] == "conceptual"


def test_only_texts_that_were_found_are_shuffled(spark):
    texts = spark.range(2000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("said "), F.repeat(F.lit("x"), 300)).alias("content"))
    ranked = spark.createDataFrame([(1, 7, 2), (1, 9, 1), (2, 7, 1), (2, 5000, 2)], "query_id long, chunk_id long, rank int")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pipelines.with_contents(ranked, texts)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftSemi" in plan  # the texts meet the names before they are dealt
        assert sorted((r.query_id, r.chunk_id, r.rank, r.content[:4]) for r in got.collect()) == [(1, 7, 2, "said"), (1, 9, 1, "said"), (2, 7, 1, "said")]
        assert [(r.query_id, r.n_chunks) for r in pipelines.contexts(ranked, texts).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
