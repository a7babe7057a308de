"""Registered queries on searches made of several, concept graphs, and measures. vec_id stands for doc_id, question i for the vector 20 i."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import values as V
from ..functions.text import words
from ..operators import asking, evaluation, fusion, gold, graph, pipelines, retrieval, window_search
from ..sources import stored, table
from .corpus import LC, LQ, any_of, chunks, count_of, joined, questions
from .labels import ANALYSED, ASKED, CONCEPT_VALUES, FOUND, REASONED, found
from .queries import ANSWER, DENSE, LEVEL, LEVELLED, PAIRED, RATIOS, SENTENCES, SIZES, SLIDING, SPANS, TFIDF, TOKENS, WEIGHT, _charset, _chunks, _docs, _levelled, _queries, _sides, _spans, _tfidf, _with_contents, query

HIERARCHY = "CASE WHEN regexp_matches(content, '第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條') THEN 'article' WHEN regexp_matches(content, '第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*[節章]') THEN 'section' WHEN regexp_matches(content, '總則|附則') THEN 'chapter' WHEN regexp_matches(content, '條文|規定|權利|義務|禁止|處罰') THEN 'article' ELSE 'general' END"
DENSE100 = f"{DENSE}, av AS (SELECT query_id, vec_id AS chunk_id, score AS vec, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cosine) WHERE rank <= 100)"
HIER = f"""{LC}, hl AS (SELECT doc_id AS chunk_id, {HIERARCHY} AS hierarchy FROM lc), hs AS (SELECT hierarchy, count(*) AS size FROM hl GROUP BY 1), ht AS (SELECT * FROM (VALUES ('article', 0, 1.0::DOUBLE, 20), ('section', 1, 0.8, 10), ('chapter', 2, 0.6, 10)) t(hierarchy, lvl, w, pool)),
hr AS (SELECT query_id, chunk_id, hierarchy, round(vec * w, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY lvl, av.rank) AS place FROM av JOIN hl USING (chunk_id) JOIN hs USING (hierarchy) JOIN ht USING (hierarchy) WHERE av.rank <= least(pool, size)),
hier AS (SELECT query_id, chunk_id, hierarchy, score, place AS rank FROM hr WHERE place <= 10)"""


def _dense100(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.dense(v, _queries(v), 100).select("query_id", F.col("vec_id").alias("chunk_id"), F.col("score").alias("vec"), "rank")


def _contents(spark, d):
    return chunks(spark, d).select(F.col("doc_id").alias("chunk_id"), "content")


def _hierarchical(spark, d, ranked):
    levels = _contents(spark, d).select("chunk_id", L.hierarchy(F.col("content")).alias("hierarchy"))
    return pipelines.by_hierarchy(ranked.select("query_id", "chunk_id", F.col("vec").alias("score"), "rank"), stored(levels))


@query(f"WITH {DENSE100}, {HIER} SELECT query_id, chunk_id, hierarchy, score, rank FROM hier")
def hierarchical_retrieve(spark, d):
    return _hierarchical(spark, d, _dense100(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def _asked(spark, d):
    return questions(spark, d).select((F.col("query_id") * 20).alias("query_id"), F.col("query").alias("text"))


@query(f"""WITH {LEVELLED}, {ASKED}, ch AS (SELECT query_id * 20 AS query_id, CASE WHEN recommended IN ('basic_unit', 'basic_unit_component', 'enumeration') THEN recommended ELSE 'basic_unit' END AS level FROM asked)
SELECT query_id, level, doc_id, score, rank::BIGINT AS rank FROM r JOIN ch USING (query_id, level) WHERE rank <= 10""")
def routed_retrieve(spark, d):
    """Levels of group_c only: questions for others fall back on the basic unit."""
    asked = _asked(spark, d).select("query_id", asking.granularity_asked(F.col("text"))["recommended"].alias("recommended"))
    return pipelines.routed(asked, _levelled(spark, d), ("group_c",)).withColumn("rank", F.col("rank").cast("long"))


FUSED_EL = f"""el AS (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY score DESC, doc_id) AS rk FROM (SELECT r.query_id, level, r.doc_id, content, round(0.6::DOUBLE * least(greatest(r.score, 0), 1) + 0.25::DOUBLE / (1 + exp(-coalesce(bm25, 0))), 6) AS score FROM r LEFT JOIN bv ON bv.query_id = r.query_id AND bv.chunk_id = r.doc_id)),
ff AS (SELECT query_id, doc_id, md5(content) AS content_hash, sum(score::DECIMAL(20, 9) * ({WEIGHT})::DECIMAL(3, 2))::DOUBLE / sum(({WEIGHT})::DECIMAL(3, 2))::DOUBLE AS score FROM el WHERE rk <= 10 GROUP BY ALL)"""


@query(f"""WITH {PAIRED.replace('rank <= 1000000', 'rank <= 20')}, {FUSED_EL}
SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM (SELECT query_id, doc_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id, content_hash) AS rank FROM ff) WHERE rank <= 10""")
def enhanced_level_fusion(spark, d):
    _, right = _sides(spark, d)
    rows = _levelled(spark, d).withColumnRenamed("score", "vec").drop("rank").join(right.select("query_id", F.col("chunk_id").alias("doc_id"), "bm25"), ["query_id", "doc_id"], "left")
    ready = rows.withColumns({"bm25": F.coalesce("bm25", F.lit(0.0)), "bonus": F.lit(0.0), "title": F.lit(0.0)})
    return pipelines.enhanced_levels(ready).select("query_id", "doc_id", "score", F.col("rank").cast("long"))


@query(f"""WITH {LEVELLED}, f AS (SELECT query_id, doc_id % 50 AS doc_id, md5(content) AS h, round(sum(score::DECIMAL(20, 9))::DOUBLE, 12) AS s FROM r GROUP BY ALL), t AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id, h) AS rank FROM f WHERE s >= -1) WHERE rank <= 15)
SELECT r.query_id, level, count(*) AS n, round(sum(score::DECIMAL(20, 9))::DOUBLE / count(*), 6) AS mean_score, count(t.doc_id) AS in_fused FROM r LEFT JOIN t ON t.query_id = r.query_id AND t.doc_id = r.doc_id % 50 GROUP BY r.query_id, level""")
def level_contributions(spark, d):
    rows = stored(_levelled(spark, d).withColumn("doc_id", F.col("doc_id") % 50))
    return fusion.contributions(rows, fusion.fuse(rows, "comb_sum_true", -1.0, 15))


GROUPED = ", ".join(f"('{g}', '{x}')" for g, xs in fusion.GROUPS.items() for x in xs)


@query(f"""WITH have AS (SELECT DISTINCT {LEVEL} AS level FROM embeddings WHERE label % 7 NOT IN (0, 2)), j AS (SELECT g.group_name, g.level, have.level IS NOT NULL AS ok FROM (VALUES {GROUPED}) g(group_name, level) LEFT JOIN have USING (level))
SELECT group_name, coalesce(string_agg(level, '|' ORDER BY level) FILTER (ok), '') AS available, coalesce(string_agg(level, '|' ORDER BY level) FILTER (NOT ok), '') AS missing, bool_and(ok) AS ready FROM j GROUP BY group_name""")
def group_availability(spark, d):
    return fusion.availability(table(spark, d, "embeddings").where("label % 7 NOT IN (0, 2)").select(F.expr(LEVEL).alias("level")))


@query(f"""WITH {DENSE100} SELECT query_id, chunk_id, coalesce(source, 'Unknown') AS name, av.rank::BIGINT AS rank FROM av LEFT JOIN documents ON doc_id = chunk_id * 3 WHERE av.rank <= 10""")
def results_with_documents(spark, d):
    """Vector v is a chunk of document 3 v here, so that some documents are missing."""
    found = _dense100(spark, d).where("rank <= 10").withColumn("doc_id", F.col("chunk_id") * 3)
    return pipelines.with_documents(found, table(spark, d, "documents").select("doc_id", F.col("source").alias("name"))).select("query_id", "chunk_id", "name", F.col("rank").cast("long"))


@query(f"SELECT {LEVEL} AS level, count(embedding) AS n_vectors, count(DISTINCT vec_id % 100) AS n_documents, max(len(embedding))::BIGINT AS dimension, count(*) FILTER (embedding IS NULL) AS n_missing FROM embeddings GROUP BY 1")
def embedding_inventory(spark, d):
    rows = table(spark, d, "embeddings").select(F.expr(LEVEL).alias("level"), (F.col("vec_id") % 100).alias("doc_id"), "embedding")
    return pipelines.inventory(rows).withColumn("dimension", F.col("dimension").cast("long"))


@query("SELECT * FROM (VALUES ('content_only'), ('group_c')) t(group_name)")
def inferred_groups(spark, d):
    rows = table(spark, d, "embeddings").select(F.expr(LEVEL).alias("level"))
    return pipelines.inferred_group(pipelines.without(rows, ("document", "document_component", "basic_unit_hierarchy", "other")))


CTX = f"{PAIRED}, {LC}, {LQ}"


@query(f"""WITH {CTX}, c AS (SELECT query_id, rank, substring(content, 1, 2000) AS said FROM bv JOIN lc ON doc_id = chunk_id WHERE rank <= 5) SELECT query_id, md5(string_agg(said, chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(*) AS n_chunks FROM c GROUP BY query_id""")
def answer_contexts(spark, d):
    _, right = _sides(spark, d)
    return pipelines.contexts(right, _contents(spark, d)).select("query_id", F.md5("context").alias("context_md5"), "n_chunks")


@query(f"""WITH {CTX}, ctx AS (SELECT bv.query_id, bv.rank, lq.query AS question, content FROM bv JOIN lc ON doc_id = chunk_id JOIN lq ON lq.query_id * 20 = bv.query_id WHERE bv.rank <= 5),
s AS (SELECT query_id, question, rank, unnest({SENTENCES}) AS sentence, unnest(generate_series(0, len({SENTENCES}) - 1)) AS pos FROM ctx), y AS (SELECT *, len(list_intersect({ANSWER.format('sentence')}, {ANSWER.format('question')})) AS n FROM s),
z AS (SELECT query_id, sentence, max(CASE WHEN n > 0 THEN n + least(length(sentence) / 200, 1.0::DOUBLE) ELSE 0 END) AS score, min(rank * 1000000 + pos) AS first FROM y WHERE n > 0 OR (rank <= 2 AND pos < 2) GROUP BY ALL), w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM z)
SELECT query_id, md5(sentence) AS sentence_md5, round(score, 6) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, first) AS rank FROM w WHERE score > 0 OR best = 0) WHERE rank <= 5 AND (score > 0 OR rank <= 4)""")
def generated_answers(spark, d):
    _, right = _sides(spark, d)
    got = pipelines.answers(right, _contents(spark, d), _asked(spark, d).withColumnRenamed("text", "question"))
    return got.select("query_id", F.md5("sentence").alias("sentence_md5"), "score", F.col("rank").cast("long"))


# --- routed by the question's kind ---------------------------------------------------------------------------------------------------
RRF10 = "rr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + av.rank), 0) + coalesce(1.0::DOUBLE / (60 + bv.rank), 0), 6) DESC, chunk_id) AS rank FROM av FULL JOIN bv USING (query_id, chunk_id))"
ROUTES = [(kind, hard, name, w) for kind in ("", *fusion.KINDS) for hard in (False, True) for name, w in fusion.routes(("vector_search", "hybrid_rag", "hierarchical", "semantic_search"), kind, hard).items()]
ROUTE_VALUES = ", ".join(f"('{k}', {str(h).lower()}, '{n}', {w}::DOUBLE)" for k, h, n, w in ROUTES)
ADAPTIVE = f"""{PAIRED}, {HIER}, {ANALYSED}, {RRF10},
found AS (SELECT query_id, 'vector_search' AS strategy, chunk_id, (101 - rank)::DOUBLE AS score FROM av UNION ALL SELECT query_id, 'hybrid_rag', chunk_id, 101 - rank FROM bv UNION ALL SELECT query_id, 'hierarchical', chunk_id, 11 - rank FROM hier UNION ALL SELECT query_id, 'semantic_search', chunk_id, 11 - rank FROM rr WHERE rank <= 10),
ask AS (SELECT query_id * 20 AS query_id, kind, complexity > 0.7 AS hard, articles FROM analysed), rt AS (SELECT * FROM (VALUES {ROUTE_VALUES}) t(kind, hard, strategy, w)),
wt AS (SELECT found.query_id, chunk_id, hard, strategy, score * w * CASE WHEN kind = 'conceptual' AND {any_of('content', V.ABOUT)} THEN 1.2::DOUBLE WHEN kind = 'normative' AND len(list_filter(articles, lambda a: contains(content, a))) > 0 THEN 1.3 WHEN kind = 'explicit_article' AND len(list_filter(articles, lambda a: contains(content, a))) > 0 THEN 1.5 ELSE 1 END AS score
  FROM found JOIN ask USING (query_id) JOIN rt USING (kind, hard, strategy) JOIN lc ON doc_id = chunk_id),
ad AS (SELECT query_id, chunk_id AS result_id, round(avg(score) * CASE WHEN hard AND count(DISTINCT strategy) > 1 THEN 1.1::DOUBLE ELSE 1 END, 6) AS score, count(DISTINCT strategy) AS strategies FROM wt GROUP BY query_id, chunk_id, hard)"""


def _strategies(spark, d):
    left, right = (stored(x) for x in _sides(spark, d))
    points = lambda most: (most - F.col("rank")).cast("double").alias("score")
    parts = {"vector_search": (left, 101), "hybrid_rag": (right, 101), "hierarchical": (_hierarchical(spark, d, left), 11), "semantic_search": (retrieval.rrf(left, right), 11)}
    results = None
    for name, (rows, most) in parts.items():
        part = rows.select("query_id", F.lit(name).alias("strategy"), "chunk_id", points(most))
        results = part if results is None else results.unionByName(part)
    return pipelines.with_contents(results, _contents(spark, d)).select("query_id", "strategy", F.col("chunk_id").alias("result_id"), "content", "score", L.any_of(F.col("content"), V.ABOUT).alias("by_concept")), tuple(parts)


@query(f"WITH {ADAPTIVE} SELECT * FROM ad")
def adaptive_retrieve(spark, d):
    results, names = _strategies(spark, d)
    return fusion.adaptive(asking.analysed(_asked(spark, d)), results, names).select("query_id", "result_id", "score", "strategies")


@query(f"""WITH {ADAPTIVE}, e AS (SELECT ad.score, wt.strategy FROM ad JOIN wt ON wt.query_id = ad.query_id AND wt.chunk_id = ad.result_id)
SELECT strategy, count(*) AS n, round(sum(score::DECIMAL(20, 9))::DOUBLE / count(*), 6) AS mean, min(score) AS low, max(score) AS high FROM e GROUP BY strategy""")
def strategy_performance(spark, d):
    results, names = _strategies(spark, d)
    results = stored(results)
    fused = fusion.adaptive(asking.analysed(_asked(spark, d)), results, names)
    table_ = spark.createDataFrame([r for r in ROUTES], "kind string, hard boolean, strategy string, weight double")
    asked = asking.analysed(_asked(spark, d)).select("query_id", "kind", (F.col("complexity") > fusion.COMPLEX).alias("hard")).join(F.broadcast(table_), ["kind", "hard"])
    by = results.join(asked, ["query_id", "strategy"]).groupBy("query_id", "result_id").agg(F.collect_set("strategy").alias("strategies"))
    return fusion.strategy_performance(fused.select("query_id", "result_id", "score").join(by, ["query_id", "result_id"]))


# --- concept graphs ------------------------------------------------------------------------------------------------------------------
GRAPH_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS t, {j} AS p, '{name}' AS name, '{kind}' AS kind, {w}::DOUBLE AS importance, trim(unnest(regexp_extract_all(content, '(?s){p}')), ' ' || chr(9) || chr(10) || chr(13)) AS said FROM lc" for i, (name, kind, w, ps) in enumerate(V.GRAPH_CONCEPTS) for j, p in enumerate(ps))


def _graph(spark, d):
    return stored(graph.occurrences(chunks(spark, d).select("doc_id", "content")))


@query(f"WITH {LC}, oc AS ({GRAPH_SQL}) SELECT md5(lower(said)) AS concept_md5, arg_min(name, doc_id * 100 + t * 10 + p) AS name, arg_min(kind, doc_id * 100 + t * 10 + p) AS kind, arg_min(importance, doc_id * 100 + t * 10 + p) AS importance FROM oc WHERE said <> '' GROUP BY lower(said)")
def concept_nodes(spark, d):
    return graph.nodes(_graph(spark, d)).select(F.md5("concept").alias("concept_md5"), "name", "kind", "importance")


@query()
def concept_edges(spark, d):
    found = _graph(spark, d)
    return graph.edges(found, stored(graph.nodes(found))).select(F.md5("src").alias("src_md5"), F.md5("dst").alias("dst_md5"), "type", "confidence")


@query(f"""WITH {LC}, oc AS ({GRAPH_SQL}), n AS (SELECT DISTINCT lower(said) AS concept FROM oc WHERE said <> ''), tk AS (SELECT concept, unnest({TOKENS.format('concept')}) AS term FROM n), tf AS (SELECT concept, term, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT concept, term, tf * (ln((1 + (SELECT count(*) FROM n))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), l AS (SELECT concept, sqrt(sum(w * w)) AS l FROM w GROUP BY concept) SELECT md5(concept) AS concept_md5, term, round(w / l, 6) AS weight FROM w JOIN l USING (concept)""")
def concept_embeddings(spark, d):
    known = graph.nodes(_graph(spark, d)).select("concept", F.col("concept").alias("content"))
    return graph.embeddings(known).select(F.md5("concept").alias("concept_md5"), "term", "weight")


@query()
def concept_search(spark, d):
    found = _graph(spark, d)
    known = stored(graph.nodes(found))
    got = graph.search(questions(spark, d).select("query_id", F.col("query").alias("text")), known, stored(graph.edges(found, known)))
    return got.select("query_id", F.md5("concept").alias("concept_md5"), F.md5("path").alias("path_md5"), "score", F.col("rank").cast("long"))


LINK_SQL = " UNION ALL ".join(f"SELECT doc_id, pos, '{kind}' AS type, {x}::DOUBLE AS confidence, trim(regexp_extract(clause, '(?s)^{p}', 1)) AS s, trim(regexp_extract(clause, '(?s)^{p}', 2)) AS t FROM cl" for kind, p, x in graph.LINKED)
CLAUSES = f"{LC}, cl AS (SELECT doc_id, unnest(string_split_regex(content, '[。，；：]')) AS clause, unnest(generate_series(0, len(string_split_regex(content, '[。，；：]')) - 1)) AS pos FROM lc)"


@query(f"WITH {CLAUSES}, f AS ({LINK_SQL}) SELECT doc_id AS chunk_id, pos::BIGINT AS pos, type, confidence, md5(s) AS source_md5, md5(t) AS target_md5 FROM f WHERE s <> '' AND t <> ''")
def concept_links(spark, d):
    return graph.linked(_contents(spark, d)).select("chunk_id", F.col("pos").cast("long"), "type", "confidence", F.md5("source").alias("source_md5"), F.md5("target").alias("target_md5"))


NAMED_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS rule, pos, '{kind}' AS kind, {x}::DOUBLE AS confidence, regexp_replace(regexp_replace(regexp_extract(clause, '{'(?s)^' if p.startswith('(.+)') else '(?s)'}{p}', 1), '[，。；：！？ \\t\\n\\r\\f]+', '', 'g'), '{graph.MEANINGLESS}', '', 'g') AS name FROM cl" for i, (kind, p, x) in enumerate(graph.EXTRACTED))
WORD_SQL = " UNION ALL ".join(f"SELECT doc_id, {len(graph.EXTRACTED) + i}, 0, '關鍵詞', 0.6::DOUBLE, '{w}' FROM lc WHERE contains(content, '{w}')" for i, (dm, w) in enumerate((dm, w) for dm, ws in graph.EXTRACT_DOMAINS.items() for w in ws))


@query(f"""WITH {CLAUSES}, f AS (SELECT * FROM ({NAMED_SQL}) WHERE length(name) >= 2 UNION ALL {WORD_SQL}), a AS (SELECT lower(name) AS concept, list_sort(list_distinct(flatten(list(regexp_extract_all(content, '第[0-9]+(-[0-9]+)?條'))))) AS arts FROM f JOIN lc USING (doc_id) GROUP BY 1),
g AS (SELECT lower(name) AS concept, arg_min(kind, (1 - confidence) * 1e12 + doc_id * 10000.0 + rule * 100 + pos) AS kind, max(confidence) AS confidence, count(*) AS n FROM f GROUP BY 1)
SELECT md5(concept) AS concept_md5, kind, confidence, n, {joined('arts')} AS articles FROM g JOIN a USING (concept)""")
def document_concepts(spark, d):
    return graph.extracted(_contents(spark, d)).select(F.md5("concept").alias("concept_md5"), "kind", "confidence", "n", F.array_join("articles", "|").alias("articles"))


@query(f"""WITH {CLAUSES}, f AS (SELECT doc_id, lower(name) AS concept FROM (SELECT * FROM ({NAMED_SQL}) WHERE length(name) >= 2 UNION ALL {WORD_SQL})), x AS (SELECT DISTINCT unnest(regexp_extract_all(content, '第[0-9]+(-[0-9]+)?條')) AS article, concept FROM f JOIN lc USING (doc_id))
SELECT article, count(*) AS n, md5(string_agg(concept, '|' ORDER BY concept)) AS concepts_md5 FROM x GROUP BY article""")
def article_concepts(spark, d):
    return graph.article_map(graph.extracted(_contents(spark, d))).select("article", "n", F.md5(F.array_join("concepts", "|")).alias("concepts_md5"))


# --- measures ----------------------------------------------------------------------------------------------------------------------
QC, CC = (f"list_distinct(list_filter(string_split(translate({{0}}, '{marks}', ''), ''), lambda x: x <> ''))" for marks in (evaluation.QUESTION_MARKS, evaluation.CHUNK_MARKS))


@query(f"""WITH {TFIDF}, qs AS (SELECT item_id AS query_id, {QC.format('text')} AS q FROM benchmark), j AS (SELECT query_id, rank, q, len(list_intersect(q, {CC.format('content')})) / len(q) AS share FROM tfidf JOIN chunks USING (doc_id, chunk_index) JOIN qs USING (query_id) WHERE rank <= 10),
cset AS (SELECT {CC.format('content')} AS c FROM chunks), po AS (SELECT query_id, count(*) AS relevant FROM qs, cset WHERE len(q) > 0 AND len(list_intersect(q, c)) >= 0.3::DOUBLE * len(q) GROUP BY 1)
SELECT query_id, round(count(*) FILTER (rank <= 5 AND share >= 0.5) / count(*) FILTER (rank <= 5), 6) AS "precision", round(count(*) FILTER (share >= 0.3) / count(*), 6) AS omega, round(coalesce(count(*) FILTER (rank <= 5 AND share >= 0.3) / any_value(relevant), 0), 6) AS recall FROM j LEFT JOIN po USING (query_id) GROUP BY query_id""")
def character_metrics(spark, d):
    ranked = _with_contents(spark, d, _tfidf(spark, d))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    pool = evaluation.character_pool_of_windows(asked, _docs(spark, d), window_search.sliding())
    return evaluation.character_measures(ranked, pool, 5)


@query(f"""WITH {SLIDING}, p AS (SELECT doc_id, content, "end", string_split_regex(content, '[.!?]') AS ps FROM chunks), w AS (SELECT *, CASE WHEN len(ps) > 1 THEN 1 - len(list_filter(ps, lambda s: trim(s) <> '')) / len(ps) ELSE 1.0::DOUBLE END AS whole FROM p)
SELECT doc_id, round(sum(round(whole, 9)::DECIMAL(18, 9))::DOUBLE / count(*), 6) AS faithfulness, round(least(greatest(0.6::DOUBLE * (1 - sum(length(content)) / count(*) / max("end")) + 0.4::DOUBLE * count(*) / (max("end") / 500), 0), 1), 6) AS fragmentation FROM w GROUP BY doc_id""")
def faithfulness(spark, d):
    return evaluation.faithfulness(_chunks(spark, d), ".!?")


SPLIT = "list_distinct(list_filter(string_split_regex(lower({0}), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
LAWS5 = tuple(V.LAW_VARIANTS)


def _pairs(spark, d):
    """Questions with the contents that a BM25 search finds for them; scores fall with the rank."""
    asked = asking.reasoned(questions(spark, d).select("query_id", F.col("query").alias("text")))
    mapped = F.concat(F.filter("found", lambda x: x["how"] == "everyday_term"), "fired")
    names = F.transform(F.array_sort(F.array_distinct(F.transform(mapped, lambda x: F.struct(x["term"].alias("term"), x["concept"].alias("concept"))))), lambda x: x["concept"])
    blanks = lambda c: F.size(F.filter(F.split(c, "[ \\t\\n\\r\\f]+"), lambda w: w != ""))
    asked = asked.select("query_id", F.col("text").alias("query"), "expanded", (blanks("expanded") / blanks("text")).alias("expansion"), names.alias("concepts"))
    met = asked.join(found(spark, d), "query_id")
    return _contents(spark, d).join(retrieval.small(stored(met)), "chunk_id").withColumn("score", 1.0 / (1 + F.col("rank")))


RULE_POINTS = f"""{REASONED}, {LC}, {FOUND}, ex AS (SELECT query_id, string_agg(concept, ' ' ORDER BY i, j) AS names FROM fd GROUP BY query_id), fx AS (SELECT query_id, string_agg(concept, ' ' ORDER BY i) AS names FROM (SELECT DISTINCT query_id, i, concept FROM fr) GROUP BY query_id),
ar AS (SELECT DISTINCT query_id, article FROM (SELECT query_id, article FROM fd JOIN (VALUES {", ".join(f"('{c}', '{a}')" for c, _, _, arts in V.REASONING_CONCEPTS for a in arts)}) a(concept, article) USING (concept) UNION ALL SELECT query_id, article FROM fr JOIN (VALUES {", ".join(f"('{r}', '{a}')" for r, _, _, _, arts in V.REASONING_RULES for a in arts)}) a(rule, article) USING (rule))),
ag AS (SELECT query_id, string_agg(article, ' ' ORDER BY article) AS articles FROM ar GROUP BY query_id), mp AS (SELECT query_id, list_transform(list_sort(list_distinct(list(term || chr(1) || concept))), lambda x: string_split(x, chr(1))[2])[1:5] AS concepts FROM (SELECT query_id, term, concept FROM fd WHERE how = 'everyday_term' UNION ALL SELECT query_id, term, concept FROM fr) GROUP BY query_id),
eq AS (SELECT query_id, query, concat_ws(' ', query, ex.names, fx.names, ag.articles) AS expanded, coalesce(concepts, []) AS concepts FROM lq LEFT JOIN ex USING (query_id) LEFT JOIN fx USING (query_id) LEFT JOIN ag USING (query_id) LEFT JOIN mp USING (query_id)),
pr AS (SELECT eq.*, chunk_id, rank, content, 1.0::DOUBLE / (1 + rank) AS score, len(list_filter(string_split_regex(expanded, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) / len(list_filter(string_split_regex(query, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS expansion,
  list_concat(list_concat(regexp_extract_all(query, '第[ \\t\\n\\r]*([0-9]+)[ \\t\\n\\r]*條', 1), regexp_extract_all(query, '條[ \\t\\n\\r]*([0-9]+)', 1)), regexp_extract_all(query, 'article[ \\t\\n\\r]*([0-9]+)', 1)) AS nums FROM eq JOIN rk USING (query_id) JOIN lc ON doc_id = chunk_id),
pt AS (SELECT *, round(0.5::DOUBLE * CASE {HIERARCHY} WHEN 'section' THEN 0.8 WHEN 'chapter' THEN 0.6 WHEN 'general' THEN 0.4 ELSE 1 END * {count_of('content', V.ABOUT)} + CASE WHEN len(list_filter(nums, lambda n: contains(content, '第' || n || '條') OR contains(content, '第 ' || n || ' 條'))) > 0 THEN 4 ELSE 0 END
  + 2 * ({" + ".join(f"(contains(query, '{x}') AND contains(content, '{x}'))::INT" for x in LAWS5)}) + least(0.8::DOUBLE * len(list_intersect({SPLIT.format('expanded')}, {SPLIT.format('content')})), 3)
  + list_sum(list_concat([0.0::DOUBLE], list_transform(concepts, lambda x: CASE WHEN NOT contains(content, x) THEN 0.0::DOUBLE WHEN x = '改作' THEN 2.5 ELSE 1.5 END))) + CASE WHEN contains(content, '改作') AND (contains(query, '改寫') OR contains(query, '語氣')) THEN 3 ELSE 0 END
  + 0.3::DOUBLE * len(list_intersect({SPLIT.format('query')}, {SPLIT.format('content')})) + CASE WHEN score > 0.3 THEN score * 1.5 ELSE 0 END, 6) AS base FROM pr),
rp AS (SELECT query_id, chunk_id, rank, round(base + CASE WHEN len(nums) = 0 AND base > 1 THEN 0.3::DOUBLE ELSE 0 END, 6) AS points, round(CASE WHEN len(nums) > 0 THEN 3.0::DOUBLE ELSE 1.5 END * CASE WHEN expansion > 2 THEN 0.7::DOUBLE ELSE 1 END, 6) AS least_points FROM pt)"""


@query(f"WITH {RULE_POINTS} SELECT query_id, chunk_id, points, points >= least_points AS relevant FROM rp")
def rule_relevance(spark, d):
    return evaluation.rule_points(_pairs(spark, d)).select("query_id", "chunk_id", "points", "relevant")


@query(f"WITH {RULE_POINTS}, j AS (SELECT *, points >= least_points AS rel FROM rp) SELECT query_id, round(count(*) FILTER (rel AND rank <= 5) / 5, 6) AS \"precision\", round(coalesce(count(*) FILTER (rel AND rank <= 5) / nullif(count(*) FILTER (rel), 0), 0), 6) AS recall, count(*) FILTER (rel) AS n_relevant FROM j GROUP BY query_id")
def rule_metrics(spark, d):
    return evaluation.rule_measures(evaluation.rule_points(_pairs(spark, d)), 5)


FAR = f"""{SLIDING}, fs AS (SELECT doc_id * 10 + i AS span_id, doc_id, i, length(text) + CASE i WHEN 0 THEN -100 WHEN 1 THEN 300 WHEN 2 THEN 1500 ELSE 5000 END AS s FROM documents, generate_series(0, 3) g(i) WHERE length(text) > 150),
sx AS (SELECT span_id, doc_id, i, s, s + 60 AS e FROM fs), x AS (SELECT span_id, doc_id, i, chunk_index, start AS cs, "end" AS ce, s, e, greatest(0, start - e, s - "end") AS gap, greatest(0, least(e, "end") - greatest(s, start)) AS o FROM sx JOIN chunks USING (doc_id)),
mm AS (SELECT span_id, doc_id, chunk_index, 'span' AS how FROM x WHERE o > 0 OR gap <= 0.1 * (ce - cs)), lf AS (SELECT * FROM x WHERE span_id NOT IN (SELECT span_id FROM mm)), nr AS (SELECT span_id, any_value(doc_id) AS doc_id, any_value(i) AS i, min(gap) AS gap, arg_min(chunk_index, gap * 100000 + chunk_index) AS chunk_index FROM lf GROUP BY span_id)"""


def _far_spans(spark, d):
    at = F.length("text") + F.expr("CASE i WHEN 0 THEN -100 WHEN 1 THEN 300 WHEN 2 THEN 1500 ELSE 5000 END")
    rows = _docs(spark, d).where("length(text) > 150").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select((F.col("doc_id") * 10 + F.col("i")).alias("span_id"), "doc_id", at.alias("s"), (at + 60).alias("e"))


@query(f"""WITH {FAR} SELECT span_id, doc_id, chunk_index::BIGINT AS chunk_index, how FROM mm UNION ALL SELECT span_id, doc_id, CASE WHEN gap >= 1000 AND doc_id % 2 = 0 THEN 0 ELSE chunk_index END::BIGINT, CASE WHEN gap >= 1000 AND doc_id % 2 = 0 THEN 'text' ELSE 'nearest' END FROM nr WHERE gap < 2000 OR doc_id % 2 = 0""")
def span_mapping_fallbacks(spark, d):
    """Spans in a text, and 300, 1,500 and 5,000 characters behind it; for even documents the first chunk is like them."""
    spans = _far_spans(spark, d)
    similar = spans.where("doc_id % 2 = 0").select("span_id", "doc_id", F.lit(0).alias("chunk_index"), F.lit(0.2).alias("score"))
    return evaluation.map_spans_or_nearest(spans, _chunks(spark, d), similar).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"WITH {FAR} SELECT span_id, doc_id, chunk_index::BIGINT AS chunk_index, gap::BIGINT AS distance FROM (SELECT span_id, doc_id, min(gap) AS gap, arg_min(chunk_index, gap * 100000 + chunk_index) AS chunk_index FROM x GROUP BY ALL) WHERE gap < 2000")
def nearest_chunks(spark, d):
    return evaluation.nearest_chunks(_far_spans(spark, d), _chunks(spark, d)).select("span_id", "doc_id", F.col("chunk_index").cast("long"), F.col("distance").cast("long"))


@query(f"""WITH {SLIDING}, r AS (SELECT doc_id, chunk_index, coalesce(sum(length(content) - 50) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs, length(content) AS n FROM chunks), sp AS (SELECT doc_id AS span_id, doc_id, (doc_id % 5) * 100 AS s, (doc_id % 5) * 100 + 450 AS e FROM documents),
x AS (SELECT span_id, doc_id, chunk_index, greatest(0, least(e, cs + n) - greatest(s, cs)) AS o, (e - s) + n AS u FROM sp JOIN r USING (doc_id)) SELECT span_id, doc_id, chunk_index::BIGINT AS chunk_index, round(o / (u - o), 6) AS iou FROM x WHERE o / (u - o) > 0.5""")
def span_mapping_ranges(spark, d):
    spans = _docs(spark, d).select(F.col("doc_id").alias("span_id"), "doc_id", ((F.col("doc_id") % 5) * 100).alias("s"), ((F.col("doc_id") % 5) * 100 + 450).alias("e"))
    return evaluation.map_by_cumulative_ranges(spans, _chunks(spark, d), 50).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"""WITH {SPANS}, rel AS (SELECT span_id AS query_id, doc_id * 100000 + chunk_index AS chunk_id FROM m), sd AS (SELECT doc_id, list_distinct({TOKENS.format('substring(text, instr(text, chr(10)), 120)')}) AS said FROM documents WHERE instr(text, chr(10)) > 0), rk AS (SELECT doc_id AS query_id, doc_id * 100000 + chunk_index AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_intersect(said, list_distinct({TOKENS.format('content')}))) DESC, chunk_index) AS rank FROM chunks JOIN sd USING (doc_id)),
p AS (SELECT k, query_id, count(DISTINCT rel.chunk_id) AS n, count(*) FILTER (rank <= k) AS hits FROM rel JOIN rk USING (query_id, chunk_id), (VALUES (1), (3), (5), (10)) t(k) GROUP BY ALL) SELECT k::BIGINT AS k, round(avg(hits / k), 6) AS "precision", round(avg(hits / n), 6) AS recall, count(*) AS n_queries FROM p GROUP BY k""")
def mapped_metrics(spark, d):
    """Chunks that hold a span, against a search for the span's words among the chunks of its document."""
    ids = lambda df: df.withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_index"))
    relevant = ids(evaluation.map_spans(_spans(spark, d), _chunks(spark, d))).select(F.col("span_id").alias("query_id"), "chunk_id")
    said = _docs(spark, d).where(F.instr("text", "\n") > 0).select("doc_id", F.array_distinct(words(F.substring(F.col("text"), F.instr("text", "\n"), F.lit(120)))).alias("said"))
    shared = _chunks(spark, d).join(said, "doc_id").select("doc_id", "chunk_index", F.size(F.array_intersect("said", words(F.col("content")))).alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "chunk_index")
    ranked = ids(shared).select(F.col("doc_id").alias("query_id"), "chunk_id", F.row_number().over(order).alias("rank"))
    return gold.id_set_measures(relevant, ranked, (1, 3, 5, 10)).withColumn("k", F.col("k").cast("long"))


GRID = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a in SIZES for b in RATIOS) + ") t(size, ratio)),\n" + f"""ch AS (SELECT size, ratio, doc_id, row_number() OVER (PARTITION BY size, ratio, doc_id ORDER BY s) - 1 AS chunk_index, substring(text, s + 1, size) AS content FROM (SELECT doc_id, text, size, ratio, unnest(generate_series(0, length(text) - 1, size - floor(size * ratio)::INT)) AS s FROM documents, g WHERE length(text) > 0) WHERE trim(substring(text, s + 1, size)) <> ''),
tok AS (SELECT size, ratio, doc_id, chunk_index, {TOKENS.format('content')} AS toks FROM ch), n AS (SELECT size, ratio, count(*) AS n FROM ch GROUP BY size, ratio), tf AS (SELECT size, ratio, doc_id, chunk_index, term, count(*) AS tf FROM (SELECT size, ratio, doc_id, chunk_index, unnest(toks) AS term FROM tok) GROUP BY ALL), df AS (SELECT size, ratio, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL), idf AS (SELECT size, ratio, term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM df JOIN n USING (size, ratio)), w AS (SELECT size, ratio, doc_id, chunk_index, term, tf * idf AS w FROM tf JOIN idf USING (size, ratio, term)), qw AS (SELECT size, ratio, query_id, term, qtf * idf AS w FROM q JOIN idf USING (term)),
le AS (SELECT size, ratio, doc_id, chunk_index, sqrt(sum(w * w)) AS l FROM w GROUP BY ALL), ql AS (SELECT size, ratio, query_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY ALL), dt AS (SELECT size, ratio, query_id, doc_id, chunk_index, sum(w.w * qw.w) AS dot FROM w JOIN qw USING (size, ratio, term) GROUP BY ALL),
rk AS (SELECT size, ratio, query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY size, ratio, query_id ORDER BY round(dot / le.l / ql.l, 6) DESC, doc_id, chunk_index) AS rank FROM dt JOIN le USING (size, ratio, doc_id, chunk_index) JOIN ql USING (size, ratio, query_id)),
j AS (SELECT size, ratio, query_id, rank, len(list_intersect({_charset('b.text')}, {_charset('ch.content')})) >= 0.5 * len({_charset('b.text')}) AS rel FROM rk JOIN ch USING (size, ratio, doc_id, chunk_index) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 5),
per AS (SELECT size, ratio, k, query_id, count(*) FILTER (rel AND rank <= k) AS hits, count(*) FILTER (rel) AS r FROM j, (VALUES (1), (5)) t(k) GROUP BY ALL),
ge AS (SELECT size, ratio, any_value(n) AS n_chunks, k, round(avg(hits / k), 6) AS p, round(avg(CASE WHEN r > 0 THEN hits / r END), 6) AS rc, round(avg(CASE WHEN r > 0 THEN least(r, 5) / 5 END), 6) AS om FROM per JOIN n USING (size, ratio) GROUP BY size, ratio, k)"""


def _grid(spark, d):
    rows = evaluation.grid_evaluation(_docs(spark, d), table(spark, d, "benchmark"), SIZES, RATIOS, (1, 5))
    return rows.withColumns({"chunk_size": F.col("chunk_size").cast("long"), "k": F.col("k").cast("long")})


@query(f'WITH {GRID} SELECT size::BIGINT AS chunk_size, ratio::DOUBLE AS overlap_ratio, n_chunks, k::BIGINT AS k, p AS "precision", rc AS recall, om AS omega FROM ge')
def grid_evaluation(spark, d):
    return _grid(spark, d)


@query(f"WITH {GRID} SELECT size::BIGINT AS chunk_size, ratio::DOUBLE AS overlap_ratio, round(0.4::DOUBLE * om + 0.3::DOUBLE * p + 0.3::DOUBLE * rc, 6) AS score FROM ge WHERE k = 5 ORDER BY 3 DESC, 1, 2 LIMIT 1")
def best_configuration(spark, d):
    rows = stored(_grid(spark, d)).where("k = 5")
    return evaluation.best_configuration(rows, evaluation.configuration_score(F.col("omega"), F.col("precision"), F.col("recall")), ["chunk_size", "overlap_ratio"])


@query("SELECT event_type AS level, count(*) FILTER (event_id % 3 = 0)::BIGINT AS \"E\", count(*) FILTER (event_id % 3 = 1)::BIGINT AS \"C\", count(*) FILTER (event_id % 3 = 2)::BIGINT AS \"U\" FROM events WHERE user_id % 7 <> 0 GROUP BY event_type")
def annotation_counts(spark, d):
    """Events stand for annotations, users for queries; those of every seventh query are deleted first."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("level"), F.col("user_id").alias("query_id"), F.element_at(F.array(F.lit("E"), F.lit("C"), F.lit("U")), (F.col("event_id") % 3 + 1).cast("int")).alias("label"))
    return evaluation.annotation_counts(evaluation.without_queries(rows, rows.where("query_id % 7 = 0").select("query_id").distinct()))


@query()
def dynamic_importance(spark, d):
    """Chunks of a document are the articles of its law."""
    rows = _chunks(spark, d).select(F.col("doc_id").alias("law"), F.col("chunk_index").cast("long").alias("article_id"), F.col("content").alias("text"))
    return retrieval.dynamic_importance(rows)
