"""Registered queries on labels, contents, questions, metadata and gold answers, over the statute-like tables of corpus.py."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions import values as V
from ..operators import asking, evaluation, gold, metadata, retrieval
from ..operators import question_spans as question_spans_
from ..operators.retrieval import top
from .corpus import ASKS, LAWS, LC, LQ, PHRASES, any_of, chunks, count_of, held, joined, numeral, pick, questions
from .queries import TOKENS, query

# --- labels and contents ------------------------------------------------------------------------------------------------------------
N = "(doc_id % 99 + 1)"
LABEL_OF = {"chapter": f"'第' || {numeral(N)} || '章 甲'", "section": f"'第 ' || {N} || ' 節'", "article": f"'第' || {numeral(N)} || '條' || CASE WHEN doc_id % 2 = 0 THEN '之' || {numeral('(doc_id % 9 + 1)')} ELSE '' END", "paragraph": f"CASE WHEN doc_id % 2 = 0 THEN '第' || {N} || '項' ELSE {N} || '.' END", "subparagraph": f"{numeral(N)} || '、'", "item": f"'（' || {numeral(N)} || '）'"}


@query(f"""WITH d AS (SELECT doc_id, level, {N}::VARCHAR AS n FROM documents, (VALUES {", ".join(f"('{x}')" for x in LABEL_OF)}) t(level))
SELECT doc_id, level, n AS number, CASE WHEN level = 'article' AND doc_id % 2 = 0 THEN (doc_id % 9 + 1)::VARCHAR END AS suffix,
  CASE WHEN level = 'article' THEN n || CASE WHEN doc_id % 2 = 0 THEN '-' || (doc_id % 9 + 1) ELSE '' END END AS canonical, n || CASE WHEN level = 'article' AND doc_id % 2 = 0 THEN '-' || (doc_id % 9 + 1) ELSE '' END AS key FROM d""")
def label_levels(spark, d):
    rows = chunks(spark, d).select("doc_id")
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), L.level_info(F.expr(sql), level).alias("info")) for level, sql in LABEL_OF.items()]))
    return rows.select("doc_id", each.alias("e")).select("doc_id", "e.level", "e.info.number", "e.info.suffix", "e.info.canonical", "e.info.key")


@query(f"""WITH {LC}, r AS (SELECT doc_id, list_concat(list_concat(list_concat(regexp_extract_all(content, '第[一二三四五六七八九十百千0-9]+條'), regexp_extract_all(content, '第[一二三四五六七八九十百千0-9]+項')), regexp_extract_all(content, '第[一二三四五六七八九十百千0-9]+款')),
  list_filter([CASE WHEN regexp_matches(content, '前項|前條|準用之|依.*規定|比照.*辦理|適用.*規定') THEN 'internal_reference' END, CASE WHEN regexp_matches(content, '本法|本條例|本規則|本辦法') THEN 'self_reference' END, CASE WHEN regexp_matches(content, '其他法律|相關法規|其他法規|其他條例') THEN 'external_reference' END], lambda x: x IS NOT NULL)) AS rs FROM lc)
SELECT doc_id, {joined("list_sort(list_distinct(rs))")} AS refs FROM r""")
def cross_refs(spark, d):
    return chunks(spark, d).select("doc_id", F.array_join(T.cross_references(F.col("content")), "|").alias("refs"))


@query(f"""WITH {LC}, t AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN phrase WHEN 1 THEN more || ' x' ELSE ' ' || {pick(PHRASES, '(doc_id * 5) % 16')} END AS target FROM lc),
p AS (SELECT doc_id, regexp_replace(content, '[ \\t\\n\\r\\f　]+', ' ', 'g') AS w, regexp_replace(trim(target), '[ \\t\\n\\r\\f　]+', ' ', 'g') AS t FROM t),
q AS (SELECT doc_id, length(t) AS n, instr(w, t) - 1 AS a, instr(w, substring(t, 1, 15)) - 1 AS b FROM p)
SELECT doc_id, CASE WHEN a >= 0 THEN a WHEN n > 10 AND b >= 0 THEN b ELSE 0 END::BIGINT AS start, CASE WHEN a >= 0 THEN a + n WHEN n > 10 AND b >= 0 THEN b + n ELSE 0 END::BIGINT AS stop, CASE WHEN a >= 0 THEN 1.0::DOUBLE WHEN n > 10 AND b >= 0 THEN 0.7 ELSE 0.0 END AS confidence FROM q""")
def text_position(spark, d):
    target = F.expr(f"CASE doc_id % 3 WHEN 0 THEN phrase WHEN 1 THEN more || ' x' ELSE ' ' || {pick(PHRASES, '(doc_id * 5) % 16')} END")
    return chunks(spark, d).select("doc_id", L.position(F.col("content"), target).alias("p")).select("doc_id", F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("stop"), "p.confidence")


NUMBERS = ("第([0-9]+條)", "第([一二三四五六七八九十百千]+)條", "第([0-9]+-[0-9]+條)", "第([0-9]+[之-][0-9]+條)")
LAW_NAME = "trim(coalesce(nullif(regexp_extract(content, '【([^】]+)】', 1), ''), nullif(regexp_extract(content, '^([^第章節條項]+法)', 1), ''), regexp_extract(content, '([^第章節條項]+法)', 1)))"
LINE = "coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda s: regexp_replace(s, '^[ \\t\\r　]+|[ \\t\\r　]+$', '', 'g')), lambda s: length(s) < 50 AND regexp_matches(s, '%s'))[1], content)" % "|".join(NUMBERS)
FOUND = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in NUMBERS) + ")"


@query(f"WITH {LC}, l AS (SELECT doc_id, {LAW_NAME} AS law_name, {LINE} AS line, regexp_extract(law || '_0_x', '^([^_]+)', 1) AS law_of_id FROM lc) SELECT doc_id, md5(law_name) AS law_md5, coalesce('第' || {FOUND}, '') AS article, law_of_id FROM l")
def content_names(spark, d):
    c = F.col("content")
    return chunks(spark, d).select("doc_id", F.md5(L.law_name(c)).alias("law_md5"), L.article_number(c).alias("article"), L.law_name_of_id(F.concat("law", F.lit("_0_x"))).alias("law_of_id"))


@query(f"""WITH {LC}, l AS (SELECT *, {LINE} AS line, CASE WHEN doc_id % 3 = 0 THEN '未分類章' WHEN doc_id % 3 = 1 THEN '第二章' ELSE '三' END AS chapter, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '1' END AS section FROM lc)
SELECT doc_id, concat_ws(' ', law, CASE WHEN doc_id % 3 = 1 THEN chapter WHEN doc_id % 3 = 2 THEN '第三章' END, CASE WHEN doc_id % 2 = 1 THEN '第1節' END, coalesce('第' || {FOUND}, label), CASE WHEN doc_id % 4 = 1 THEN '第1項' WHEN doc_id % 4 = 2 THEN '第1-3項' END) AS description FROM l""")
def descriptions(spark, d):
    chapter, section = F.expr("CASE WHEN doc_id % 3 = 0 THEN '未分類章' WHEN doc_id % 3 = 1 THEN '第二章' ELSE '三' END"), F.expr("CASE WHEN doc_id % 2 = 0 THEN '' ELSE '1' END")
    items = F.expr("CASE WHEN doc_id % 4 = 1 THEN array('1') WHEN doc_id % 4 = 2 THEN array('1', '2', '3') ELSE cast(array() AS array<string>) END")
    return chunks(spark, d).select("doc_id", L.description(F.concat(F.lit("法規名稱："), "law"), chapter, section, F.col("label"), F.col("content"), items).alias("description"))


def _match(c: str, patterns: tuple) -> str:
    return f"regexp_matches({c}, '{'|'.join(patterns)}')"


@query(f"""WITH {LC} SELECT doc_id, {_match('content', V.DEFINITION)} AS definition, {_match('content', V.PROCEDURE)} AS procedural, {_match('content', V.ENUMERATION)} AS enumeration, {_match('content', V.NORM)} AS normative,
  regexp_matches(content, '第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條') AS refers, round({count_of('content', V.LEGAL_KEYWORDS)} / greatest(len(list_filter(string_split_regex(content, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')), 1), 6) AS density,
  CASE part WHEN 'law' THEN 'document' WHEN 'chapter' THEN 'document_component' WHEN 'section' THEN 'basic_unit_hierarchy' WHEN 'article' THEN CASE WHEN length(content) > 200 AND {_match('content', V.DEFINITION)} THEN 'basic_unit_component' ELSE 'basic_unit' END WHEN 'paragraph' THEN 'basic_unit_component' ELSE 'enumeration' END AS level,
  CASE WHEN regexp_matches(content, '第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條') THEN 'article' WHEN regexp_matches(content, '第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*[節章]') THEN 'section' WHEN regexp_matches(content, '總則|附則') THEN 'chapter' WHEN regexp_matches(content, '條文|規定|權利|義務|禁止|處罰') THEN 'article' ELSE 'general' END AS hierarchy FROM lc""")
def chunk_semantics(spark, d):
    c = F.col("content")
    got = chunks(spark, d).select("doc_id", L.semantics(c).alias("s"), L.granularity(F.col("part"), c).alias("level"), L.hierarchy(c).alias("hierarchy"))
    return got.select("doc_id", "s.definition", "s.procedural", "s.enumeration", "s.normative", "s.refers", F.round("s.concept_density", 6).alias("density"), "level", "hierarchy")


ARTICLE_LEVEL = "(part = 'article' OR regexp_matches(content, '第[一二三四五六七八九十0-9]+條|條文|規定'))"
CHAPTER_LEVEL = "(part IN ('chapter', 'section') OR regexp_matches(content, '第[一二三四五六七八九十0-9]+[章節]|[章節][ \\t]*[：:]|總則|分則|附則'))"
ARTICLE_ID = "CASE WHEN doc_id % 2 = 0 THEN law || '_第' || article || '條' WHEN regexp_extract(content, '第([0-9]+)條', 1) <> '' AND regexp_extract(content, '([^。，；：]+法)', 1) <> '' THEN regexp_extract(content, '([^。，；：]+法)', 1) || '_第' || regexp_extract(content, '第([0-9]+)條', 1) || '條' END"


def _category(rows):
    """Even documents know their law and article, odd ones only by their text."""
    return rows.withColumns({"category": F.when(F.col("doc_id") % 2 == 0, F.col("law")).otherwise(""), "number": F.when(F.col("doc_id") % 2 == 0, F.col("article"))})


@query(f"WITH {LC} SELECT doc_id, {ARTICLE_LEVEL} AS is_article, {CHAPTER_LEVEL} AS is_chapter, md5({ARTICLE_ID}) AS article_id_md5 FROM lc")
def level_predicates(spark, d):
    c, p = F.col("content"), F.col("part")
    return _category(chunks(spark, d)).select("doc_id", L.is_article(c, p).alias("is_article"), L.is_chapter_or_section(c, p).alias("is_chapter"), F.md5(L.article_id(c, F.col("category"), F.col("number"))).alias("article_id_md5"))


PLAIN = "regexp_replace(content, '[ 　]+', '', 'g')"


@query(f"""WITH {LC}, q AS (SELECT DISTINCT doc_id % 120 + 1 AS n, CASE WHEN doc_id % 7 = 0 THEN doc_id % 3 + 1 END AS s FROM documents),
p AS MATERIALIZED (SELECT doc_id, {PLAIN} AS plain FROM lc WHERE regexp_matches(lower(content), '第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條') OR {any_of('lower(content)', V.LAW_VARIANTS['著作權法'])})
SELECT doc_id, n::BIGINT AS article, s::BIGINT AS suffix FROM p, q WHERE contains(plain, '第' || n || '條') AND regexp_matches(plain, CASE WHEN s IS NULL THEN '第' || n || '條([^0-9之-]|$)' ELSE '第' || n || '條[之-]' || s END)""")
def article_matches(spark, d):
    lc = chunks(spark, d)
    asked = lc.select(F.col("article").cast("long"), F.expr("CASE WHEN doc_id % 7 = 0 THEN doc_id % 3 + 1 END").cast("long").alias("suffix")).distinct().withColumn("key", F.concat_ws("-", "article", "suffix"))
    named = lc.select("doc_id", "content", F.explode(L.article_keys(F.col("content"))).alias("key"))
    return named.join(retrieval.small(asked), "key").where(L.law_match(F.col("content"), F.lit("著作權法"))).select("doc_id", "article", "suffix").distinct()


# the longest whole characters within the limit, by trying every length around it
LIMIT = 3000
CLEAN1 = "regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[【】〖〗『』［］〔〕｛｝〈〉《》「」]', '', 'g')"
CLEAN2 = f"regexp_replace(regexp_replace(regexp_replace({CLEAN1}, '\\n[ \\t\\n]*\\n[ \\t\\n]*\\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '(?m)^[ \\t]+|[ \\t]+$', '', 'g')"
TRIM = "regexp_replace({}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


@query(f"""WITH c AS (SELECT doc_id, {CLEAN2} AS t FROM documents),
m AS (SELECT doc_id, t, CASE WHEN strlen(t) <= {LIMIT} THEN t ELSE left(t, list_max(list_filter(generate_series({LIMIT // 4}, {LIMIT}), lambda i: strlen(left(t, i)) <= {LIMIT}))) END AS k FROM c),
p AS (SELECT *, floor(length(k) * 0.8::DOUBLE)::BIGINT AS b, substring(k, floor(length(k) * 0.8::DOUBLE)::BIGINT + 1) AS tail FROM m),
z AS (SELECT *, CASE WHEN contains(tail, chr(10) || chr(10)) THEN b + length(tail) - instr(reverse(tail), chr(10) || chr(10)) - 1 END AS para, length(regexp_extract(tail, '(?s)^.*[。！？.!?]')) AS sent FROM p)
SELECT doc_id, md5({TRIM.format(f"CASE WHEN strlen(t) <= {LIMIT} THEN t WHEN para IS NOT NULL THEN left(k, para) WHEN sent > 0 THEN left(k, b + sent) ELSE k END")}) AS cleaned_md5 FROM z""")
def api_texts(spark, d):
    from .queries import _docs

    return _docs(spark, d).select("doc_id", F.md5(L.cleaned(F.coalesce("text", F.lit("")), LIMIT)).alias("cleaned_md5"))


# --- questions ----------------------------------------------------------------------------------------------------------------------
def _level_score(patterns: tuple) -> str:
    parts = [f"0.1::DOUBLE * len(regexp_extract_all(t, '{p}')) + 0.01::DOUBLE * length(array_to_string(regexp_extract_all(t, '{p}'), ''))" for p in patterns]
    return f"round(least(1.0::DOUBLE, {' + '.join(parts)}), 9)"


LEVEL_SCORES = ", ".join(f"{_level_score(ps)} AS s{i}" for i, ps in enumerate(V.LEVEL_PATTERNS.values()))
LEVEL_SUM, LEVEL_MAX = "round(s0 + s1 + s2 + s3 + s4 + s5, 9)", "greatest(s0, s1, s2, s3, s4, s5)"
LEVEL_CASE = "CASE " + " ".join(f"WHEN s{i} = top THEN '{name}'" for i, name in enumerate(V.LEVEL_PATTERNS)) + " END"
ASKED = f"""{LQ}, sc AS (SELECT query_id, {LEVEL_SCORES} FROM (SELECT query_id, lower(trim(query)) AS t FROM lq)), mx AS (SELECT *, {LEVEL_SUM} AS total, {LEVEL_MAX} AS top FROM sc),
asked AS (SELECT query_id, CASE WHEN top < 0.3 AND total > 0.5 THEN 'mixed' ELSE {LEVEL_CASE} END AS level, CASE WHEN top < 0.3 AND total > 0.5 THEN 0.5::DOUBLE WHEN total > 0 THEN round(top / total, 6) ELSE 0 END AS confidence, CASE WHEN top < 0.3 AND total > 0.5 THEN 'basic_unit' ELSE {LEVEL_CASE} END AS recommended FROM mx)"""


@query(f"WITH {ASKED} SELECT * FROM asked")
def query_classify(spark, d):
    return questions(spark, d).select("query_id", asking.granularity_asked(F.col("query")).alias("g")).select("query_id", "g.*")


def _kind_score(name: str) -> str:
    own = " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in V.KIND_PATTERNS[name])
    extra = f" + len(regexp_extract_all(t, '{V.KIND_PATTERNS['explicit_article'][0]}'))" if name == "explicit_article" else ""
    return f"0.5::DOUBLE * ({own}){extra}"


TERMS = tuple(w for ws in V.DOMAIN_TERMS.values() for w in ws)
KIND_CASE = "CASE " + " ".join(f"WHEN k{i} = top THEN '{name}'" for i, name in enumerate(V.KIND_PATTERNS)) + " END"
SUITED = "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in xs)}]" for k, xs in V.STRATEGIES_OF.items()) + " END"
ANALYSED = f"""{LQ}, k0 AS (SELECT query_id, query AS t FROM lq),
k1 AS (SELECT query_id, t, {", ".join(f"{_kind_score(name)} AS k{i}" for i, name in enumerate(V.KIND_PATTERNS))}, list_sort(list_distinct(list_concat({held('t', TERMS)}, regexp_extract_all(t, '{V.CONCEPT_PATTERN}')))) AS concepts,
  list_concat(list_transform(regexp_extract_all(t, '第[ \\t\\n\\r]*([0-9]+)[ \\t\\n\\r]*條', 1), lambda n: '第' || n || '條'), list_transform(regexp_extract_all(t, '(?i)article[ \\t\\n\\r]*([0-9]+)', 1), lambda n: 'Article ' || n)) AS articles,
  {" + ".join(f"CASE WHEN contains(t, '{w}') THEN {x}::DOUBLE ELSE 0 END" for w, x in V.COMPLEXITY)} AS said FROM k0),
k2 AS (SELECT *, greatest(k0, k1, k2, k3, k4, k5) AS top, round(least(1.0::DOUBLE, said + 0.3::DOUBLE * least(1.0::DOUBLE, length(t) / 100) + 0.2::DOUBLE * least(1.0::DOUBLE, len(concepts) / 5)), 6) AS complexity FROM k1),
analysed AS (SELECT *, {KIND_CASE} AS kind, least(1.0::DOUBLE, top / 2) AS confidence FROM k2)"""


@query(f"""WITH {ANALYSED} SELECT query_id, kind, confidence, {joined('concepts')} AS concepts, {joined('articles')} AS articles, complexity,
  {joined(f"list_sort(list_distinct(list_concat(list_concat(list_concat({SUITED}, CASE WHEN complexity > 0.7 THEN ['multi_strategy', 'adaptive_fusion'] ELSE [] END), CASE WHEN len(concepts) > 3 THEN ['concept_expansion'] ELSE [] END), CASE WHEN len(articles) > 0 THEN ['article_focused', 'legal_structure'] ELSE [] END)))")} AS strategies,
  length(t)::BIGINT AS length, len(list_filter(string_split_regex(t, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))::BIGINT AS words, {any_of('t', V.NEGATION)} AS negation,
  CASE WHEN {any_of('t', ('?', '？'))} THEN 'question' WHEN {any_of('t', ('，', ','))} THEN 'compound' WHEN {any_of('t', V.CONJUNCTION)} THEN 'conjunction' ELSE 'simple' END AS structure FROM analysed""")
def query_analysis(spark, d):
    got = asking.analysed(questions(spark, d).select("query_id", F.col("query").alias("text")))
    joined_ = [F.array_join(c, "|").alias(c) for c in ("concepts", "articles", "strategies")]
    return got.select("query_id", "kind", "confidence", *joined_, "complexity", F.col("features.length").cast("long").alias("length"), F.col("features.words").cast("long").alias("words"), "features.negation", "features.structure")


LAW_ASKED = "CASE WHEN contains(t, '著作權法') THEN '著作權法' WHEN contains(t, '商標法') THEN '商標法' WHEN contains(t, '專利法') THEN '專利法' ELSE '' END"
TERM_LIST = "list_filter([" + ", ".join(f"CASE WHEN {any_of('t', ws)} THEN '{n}' END" for n, ws in V.SYNONYMS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {LQ}, k AS (SELECT *, query AS t FROM lq) SELECT query_id, {LAW_ASKED} AS law, CASE WHEN query_id % 4 <> 0 THEN article END::BIGINT AS article_number, NULL::BIGINT AS article_suffix, {joined(TERM_LIST)} AS terms FROM k")
def query_features(spark, d):
    got = asking.features(questions(spark, d).select("query_id", F.col("query").alias("text")))
    return got.select("query_id", "law", F.col("article_number").cast("long"), F.col("article_suffix").cast("long"), F.array_join("terms", "|").alias("terms"))


CONCEPT_VALUES = ", ".join(f"({i}, {j}, '{c}', '{how}', '{w}', {x}::DOUBLE)" for i, (c, own, everyday, _) in enumerate(V.REASONING_CONCEPTS) for j, (how, w, x) in enumerate([("legal_term", w, 1.0) for w in own] + [("everyday_term", w, 0.8) for w in everyday]))
RULE_VALUES = ", ".join(f"({i}, {j}, '{r}', '{w}', '{c}', {x}::DOUBLE)" for i, (r, ws, c, x, _) in enumerate(V.REASONING_RULES) for j, w in enumerate(ws))
ARTICLE_VALUES = ", ".join([f"('{c}', '{a}')" for c, _, _, arts in V.REASONING_CONCEPTS for a in arts])
RULE_ARTICLES = ", ".join([f"('{r}', '{a}')" for r, _, _, _, arts in V.REASONING_RULES for a in arts])
REASONED = f"""{LQ}, ct AS (SELECT * FROM (VALUES {CONCEPT_VALUES}) t(i, j, concept, how, term, confidence)), rt AS (SELECT * FROM (VALUES {RULE_VALUES}) t(i, j, rule, term, concept, confidence)),
fd AS (SELECT query_id, i, j, concept, how, term, confidence FROM lq JOIN ct ON contains(lower(query), term)),
fr AS (SELECT query_id, i, j, rule, term, concept, confidence FROM lq JOIN rt ON contains(lower(query), term) WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.query_id = lq.query_id AND fd.concept = rt.concept))"""


@query(f"WITH {REASONED} SELECT query_id, concept, how, term, confidence FROM fd UNION ALL SELECT query_id, concept, 'rule', term, confidence FROM fr")
def reasoning_expand(spark, d):
    got = asking.reasoned(questions(spark, d).select("query_id", F.col("query").alias("text")))
    return got.select("query_id", F.explode(F.concat("found", "fired")).alias("x")).select("query_id", "x.*")


@query(f"""WITH {REASONED}, ar AS (SELECT DISTINCT query_id, article FROM (SELECT query_id, article FROM fd JOIN (VALUES {ARTICLE_VALUES}) a(concept, article) USING (concept) UNION ALL SELECT query_id, article FROM fr JOIN (VALUES {RULE_ARTICLES}) a(rule, article) USING (rule))),
a AS (SELECT query_id, string_agg(article, ' ' ORDER BY article) AS articles FROM ar GROUP BY query_id), f AS (SELECT query_id, string_agg(concept, ' ' ORDER BY i, j) AS names FROM fd GROUP BY query_id),
r AS (SELECT query_id, string_agg(concept, ' ' ORDER BY i) AS names FROM (SELECT DISTINCT query_id, i, rule, concept FROM fr) GROUP BY query_id),
b AS (SELECT query_id, string_agg(concept || '=' || confidence, ' ' ORDER BY concept) AS best FROM (SELECT query_id, concept, max(confidence) AS confidence FROM fr GROUP BY ALL) GROUP BY query_id)
SELECT query_id, md5(concat_ws(' ', query, f.names, r.names, a.articles)) AS expanded_md5, coalesce(a.articles, '') AS articles, coalesce(best, '') AS confidences FROM lq LEFT JOIN f USING (query_id) LEFT JOIN r USING (query_id) LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""")
def expanded_queries(spark, d):
    got = asking.reasoned(questions(spark, d).select("query_id", F.col("query").alias("text")))
    best = F.array_join(F.transform("confidences", lambda x: F.concat(x["concept"], F.lit("="), x["confidence"].cast("string"))), " ")
    return got.select("query_id", F.md5("expanded").alias("expanded_md5"), F.array_join("articles", " ").alias("articles"), best.alias("confidences"))


WORDS = "list_distinct(regexp_extract_all({}, '[\\pL\\pN_]+'))"
ART = "regexp_extract({}, '第[ \\t\\n\\r]*([0-9]+(?:之[0-9]+)?)[ \\t\\n\\r]*條', 1)"


@query(f"""WITH {LQ}, s AS (SELECT a.query_id, b.query_id AS other_id, lower(trim(a.query)) AS a, lower(trim(CASE WHEN b.query_id % 11 = 0 THEN b.ask ELSE b.query END)) AS b FROM lq a JOIN lq b ON a.query_id % 20 = 0 OR a.query_id = b.query_id)
SELECT query_id, other_id, CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.9 WHEN {ART.format('a')} <> '' AND {ART.format('a')} = {ART.format('b')} THEN 0.8
  WHEN len(list_intersect({held('a', tuple(V.LAW_VARIANTS))}, {held('b', tuple(V.LAW_VARIANTS))})) > 0 THEN 0.7 ELSE round(len(list_intersect({WORDS.format('a')}, {WORDS.format('b')})) / len(list_distinct(list_concat({WORDS.format('a')}, {WORDS.format('b')}))) * 0.6::DOUBLE, 6) END AS similarity FROM s""")
def question_similarity(spark, d):
    """Every twentieth question, and each with itself, against all questions."""
    lq = questions(spark, d)
    b = lq.select(F.col("query_id").alias("other_id"), F.when(F.col("query_id") % 11 == 0, F.col("ask")).otherwise(F.col("query")).alias("b"))
    pairs = retrieval.small(lq.select("query_id", F.col("query").alias("a"))).join(b, (F.col("query_id") % 20 == 0) | (F.col("query_id") == F.col("other_id")))
    return pairs.select("query_id", "other_id", asking.similarity(F.col("a"), F.col("b")).alias("similarity"))


# --- metadata -------------------------------------------------------------------------------------------------------------------------
RULE_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS rule, '{kind}' AS kind, {w}::DOUBLE AS importance, pos, trim(regexp_extract(clause, '{'(?s)^' if p.startswith('(.+)') else '(?s)'}{p}', 1)) AS concept FROM cl" for i, (kind, p, w) in enumerate(V.CONCEPT_RULES))
CLAUSES = f"{LC}, cl AS (SELECT doc_id, unnest(string_split_regex(content, '[。，；：]')) AS clause, unnest(generate_series(0, len(string_split_regex(content, '[。，；：]')) - 1)) AS pos FROM lc)"


def _ids(rows):
    return rows.withColumnRenamed("doc_id", "chunk_id")


@query(f"""WITH {CLAUSES}, f AS ({RULE_SQL}) SELECT doc_id AS chunk_id, md5(concept) AS concept_md5, arg_min(kind, rule * 1000000 + pos) AS kind, arg_min(importance, rule * 1000000 + pos) AS importance FROM f WHERE concept <> '' GROUP BY doc_id, concept""")
def legal_concepts(spark, d):
    return metadata.concepts(_ids(chunks(spark, d))).select("chunk_id", F.md5("concept").alias("concept_md5"), "kind", "importance")


REL_SQL = " UNION ALL ".join(f"SELECT doc_id, pos, '{name}' AS relation, trim(regexp_extract(clause, '(?s)^{p}', 1)) AS s, trim(regexp_extract(clause, '(?s)^{p}', 2)) AS o FROM cl" for p, name in V.RELATION_RULES)


@query(f"WITH {CLAUSES}, f AS ({REL_SQL}) SELECT doc_id AS chunk_id, pos::BIGINT AS pos, relation, md5(s) AS subject_md5, md5(o) AS object_md5 FROM f WHERE s <> '' AND o <> ''")
def legal_relations(spark, d):
    return metadata.relations(_ids(chunks(spark, d))).select("chunk_id", F.col("pos").cast("long"), "relation", F.md5("subject").alias("subject_md5"), F.md5("object").alias("object_md5"))


TYPE_N = ", ".join(f"{count_of('content', ws)} AS t{i}" for i, ws in enumerate(V.ARTICLE_TYPES.values()))
TYPE_MAX = "greatest(" + ", ".join(f"t{i}" for i in range(len(V.ARTICLE_TYPES))) + ")"
# confidence grows with the count up to .9 (three words), so the first type with the most words, counted up to three, wins
TYPE_CASE = f"CASE WHEN {TYPE_MAX} < 2 THEN '一般規定' " + " ".join(f"WHEN least(t{i}, 3) = least({TYPE_MAX}, 3) THEN '{name}'" for i, name in enumerate(V.ARTICLE_TYPES)) + " END"
TYPE_CONF = f"CASE WHEN {TYPE_MAX} < 2 THEN 0.5::DOUBLE ELSE round(least(0.9::DOUBLE, 0.2::DOUBLE * {TYPE_MAX} + 0.3::DOUBLE), 6) END"
DOMAIN_N = ", ".join(f"{count_of('content', ws)} AS d{i}" for i, ws in enumerate(V.LEGAL_DOMAINS.values()))
DOMAIN_MAX = "greatest(" + ", ".join(f"d{i}" for i in range(len(V.LEGAL_DOMAINS))) + ")"
DOMAIN_CASE = "CASE " + " ".join(f"WHEN d{i} = {DOMAIN_MAX} THEN '{name}'" for i, name in enumerate(V.LEGAL_DOMAINS)) + " END"
LIGHT_CASE = "CASE " + " ".join(f"WHEN d{i} > 0 THEN '{name}'" for i, name in enumerate(V.LEGAL_DOMAINS)) + " ELSE '其他' END"
CHAPTER_CASE = "CASE " + " ".join(f"WHEN regexp_matches(content, '{p}') THEN '{name}'" for p, name, _ in V.CHAPTER_TYPES) + " ELSE '一般章節' END"


def _tags(groups: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {any_of('content', ws)} THEN '{n}' END" for n, ws in groups.items()) + "], lambda x: x IS NOT NULL)"


TYPED = f"{LC}, ty AS (SELECT *, {TYPE_N}, {DOMAIN_N} FROM lc)"


@query(f"""WITH {TYPED} SELECT doc_id, {TYPE_CASE} AS type, {TYPE_CONF} AS type_confidence, {DOMAIN_CASE} AS domain, least(1.0::DOUBLE, {DOMAIN_MAX} / 5) AS domain_confidence, {LIGHT_CASE} AS light, {CHAPTER_CASE} AS chapter,
  {joined(_tags(V.INTENTS))} AS intents, {joined(_tags(V.SCOPES))} AS scopes, {joined(held('content', tuple(w for w, _, _ in V.STRUCTURAL)))} AS structural,
  len(list_concat(list_concat(CASE WHEN contains(content, '權利') THEN [1, 2, 3] ELSE [] END, CASE WHEN contains(content, '義務') THEN [1, 2, 3] ELSE [] END), CASE WHEN regexp_matches(content, '處罰|違反') THEN [1, 2, 3] ELSE [] END)[1:5])::BIGINT AS n_questions, {joined(held('content', V.STATUTE_TERMS))} AS terms FROM ty""")
def classify_documents(spark, d):
    c = F.col("content")
    got = chunks(spark, d).select("doc_id", metadata.article_type(c).alias("t"), metadata.domain(c).alias("d"), metadata.light_domain(c)["domain"].alias("light"), metadata.chapter_type(c)["type"].alias("chapter"), F.array_join(metadata.tags(c, V.INTENTS), "|").alias("intents"), F.array_join(metadata.tags(c, V.SCOPES), "|").alias("scopes"),
        F.array_join(F.transform(metadata.structural_concepts(c), lambda x: x["concept"]), "|").alias("structural"), F.size(metadata.canned_questions(c)).cast("long").alias("n_questions"), F.array_join(metadata.keywords(c)["terms"], "|").alias("terms"))
    return got.select("doc_id", "t.type", F.col("t.confidence").alias("type_confidence"), "d.domain", F.col("d.confidence").alias("domain_confidence"), "light", "chapter", "intents", "scopes", "structural", "n_questions", "terms")


ENHANCED = f"""{TYPED}, one AS (SELECT md5(content) AS hash, arg_min(doc_id, doc_id) AS first_id FROM ty GROUP BY 1),
wk AS (SELECT hash, doc_id, CASE WHEN {ARTICLE_LEVEL} THEN 'full' WHEN {CHAPTER_LEVEL} THEN 'medium' ELSE 'light' END AS how, {ARTICLE_ID} AS article_id, {TYPE_CASE} AS atype, {CHAPTER_CASE} AS ctype, {DOMAIN_CASE} AS domain, least(1.0::DOUBLE, {DOMAIN_MAX} / 5) AS conf, {LIGHT_CASE} AS light FROM ty JOIN one ON first_id = doc_id),
pa AS (SELECT article_id, arg_max(atype, doc_id) AS ptype, arg_max(domain, doc_id) AS pdomain, arg_max(conf, doc_id) AS pconf FROM wk WHERE how = 'full' AND article_id IS NOT NULL GROUP BY article_id),
en AS (SELECT ty.doc_id AS chunk_id, CASE WHEN how = 'light' AND ptype IS NOT NULL THEN 'inherited' ELSE how END AS enhancement, article_id, CASE WHEN how = 'full' THEN atype WHEN how = 'medium' THEN ctype ELSE ptype END AS type,
  CASE WHEN how <> 'light' THEN domain ELSE coalesce(pdomain, light) END AS domain, CASE WHEN how <> 'light' THEN conf WHEN ptype IS NOT NULL THEN pconf WHEN light = '其他' THEN 0.1::DOUBLE ELSE 0.7 END AS domain_confidence, CASE WHEN how = 'light' AND ptype IS NOT NULL THEN article_id END AS inherited_from
  FROM ty JOIN wk ON hash = md5(content) LEFT JOIN pa USING (article_id))"""


def _enhanced(spark, d):
    rows = _category(chunks(spark, d)).select(F.col("doc_id").alias("chunk_id"), "content", F.col("part").alias("level"), "category", F.col("number").alias("article_number"))
    return metadata.enhanced(rows)


@query(f"WITH {ENHANCED} SELECT chunk_id, enhancement, md5(article_id) AS article_id_md5, type, domain, domain_confidence, md5(inherited_from) AS inherited_md5 FROM en")
def metadata_batch(spark, d):
    return _enhanced(spark, d).select("chunk_id", "enhancement", F.md5("article_id").alias("article_id_md5"), "type", "domain", "domain_confidence", F.md5("inherited_from").alias("inherited_md5"))


@query(f"WITH {ENHANCED} SELECT enhancement, count(*) AS n, count(inherited_from) AS inherited, count(DISTINCT article_id) AS articles FROM en GROUP BY enhancement")
def metadata_stats(spark, d):
    return metadata.statistics(_enhanced(spark, d))


@query("""WITH m AS (SELECT doc_id, source, lang FROM documents), c AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'checked' END AS source, 1 AS moment FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' END, 2 FROM labels),
l AS (SELECT doc_id, arg_max(source, moment) FILTER (source IS NOT NULL) AS source FROM c GROUP BY doc_id) SELECT m.doc_id, coalesce(l.source, m.source) AS source, lang FROM m LEFT JOIN l USING (doc_id)""")
def metadata_update(spark, d):
    from ..sources import table

    labels = table(spark, d, "labels")
    changes = labels.select("doc_id", F.when(F.col("quality") == 1, "checked").alias("source"), F.lit(1).alias("at")).unionByName(labels.select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("source"), F.lit(2).alias("at")))
    return metadata.updated(table(spark, d, "documents").select("doc_id", "source", "lang"), changes, "doc_id", "at")


@query(f"""WITH {LC}, s AS (SELECT {count_of('content', V.LEGAL_KEYWORDS)} AS n, length(content) % 10 / 10 AS importance, {_match('content', V.DEFINITION)} AS a, contains(content, '除外') AS b, contains(content, '情形') AS c FROM lc)
SELECT count(*) AS total_chunks, count(*) FILTER (n > 0) AS concept_chunks, count(*) FILTER (a) AS definition_chunks, count(*) FILTER (b) AS exception_chunks, count(*) FILTER (c) AS condition_chunks, round(avg(importance) FILTER (n > 0), 6) AS avg_importance, round(sum(n) / count(*), 6) AS concept_density FROM s""")
def concept_stats(spark, d):
    c = F.col("content")
    rows = chunks(spark, d).select(L.count_of(c, V.LEGAL_KEYWORDS).alias("concept_count"), (F.length(c) % 10 / 10).alias("importance"), L.semantics(c)["definition"].alias("has_definition"), F.contains(c, F.lit("除外")).alias("has_exception"), F.contains(c, F.lit("情形")).alias("has_condition"))
    return metadata.concept_statistics(rows)


# --- gold answers ---------------------------------------------------------------------------------------------------------------------
GOLD_LAW = LAW_ASKED.replace("(t,", "(query,")


@query(f"""WITH {LQ} SELECT query_id, label, {GOLD_LAW} AS law,
  CASE WHEN query_id % 5 <> 4 OR query_id % 4 <> 0 THEN article END::BIGINT AS article_number, CASE WHEN query_id % 5 <> 4 AND query_id % 6 = 1 THEN query_id % 3 + 1 END::BIGINT AS article_suffix FROM lq""")
def gold_items(spark, d):
    got = gold.gold(questions(spark, d))
    return got.select("query_id", "label", "law", F.col("article_number").cast("long"), F.col("article_suffix").cast("long"))


GOLD = f"""{LC}, {LQ}, g AS (SELECT query_id, {GOLD_LAW} AS law, article AS n, CASE WHEN query_id % 5 <> 4 AND query_id % 6 = 1 THEN query_id % 3 + 1 END AS s FROM lq WHERE label = 'Yes' AND (query_id % 5 <> 4 OR query_id % 4 <> 0)),
rel AS (SELECT query_id, doc_id AS chunk_id FROM lc, g WHERE regexp_matches({PLAIN}, CASE WHEN s IS NULL THEN '第' || n || '條([^0-9之-]|$)' ELSE '第' || n || '條[之-]' || s END)
  AND (g.law = '' OR regexp_matches(lower(content), '第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條')))"""


def _relevant(spark, d):
    return gold.relevant_chunks(gold.gold(questions(spark, d)), chunks(spark, d).select(F.col("doc_id").alias("chunk_id"), "content"))


@query(f"WITH {GOLD} SELECT DISTINCT query_id, chunk_id FROM rel")
def gold_relevant(spark, d):
    return _relevant(spark, d)


#: A BM25 search of the questions for whole contents, the first ten: rk(query_id, chunk_id, rank).
FOUND = f"""bt AS (SELECT doc_id, {TOKENS.format('content')} AS toks FROM lc), bn AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM bt), bf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM bt) GROUP BY ALL),
bd AS (SELECT term, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM bf, bn GROUP BY term), bi AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25::DOUBLE * avg(raw) FROM bd) ELSE raw END AS idf FROM bd),
bq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM lq) GROUP BY ALL),
bs AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / avgdl))), 6) AS score FROM bf JOIN bq USING (term) JOIN bi USING (term) JOIN bt USING (doc_id), bn GROUP BY ALL),
rk AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs) WHERE rank <= 10)"""


def found(spark, d):
    """(query_id, chunk_id, rank): the first ten contents of each question by BM25."""
    asked = questions(spark, d).select("query_id", F.col("query").alias("text"))
    rows = retrieval.bm25(chunks(spark, d).select("doc_id", "content"), asked, keys=["doc_id"], key="query_id")
    return rows.select("query_id", F.col("doc_id").alias("chunk_id"), "rank")


@query(f"""WITH {GOLD}, {FOUND}, n AS (SELECT query_id, count(DISTINCT chunk_id) AS n FROM rel GROUP BY ALL), h AS (SELECT query_id, rank FROM rk JOIN (SELECT DISTINCT * FROM rel) USING (query_id, chunk_id)),
p AS (SELECT k, query_id, any_value(n) AS n, count(rank) FILTER (rank <= k) AS hits FROM n CROSS JOIN (VALUES (1), (3), (5), (10)) t(k) LEFT JOIN h USING (query_id) GROUP BY ALL)
SELECT k::BIGINT AS k, round(avg(hits / k), 6) AS "precision", round(avg(hits / n), 6) AS recall, count(*) AS n_queries FROM p GROUP BY k""")
def gold_metrics(spark, d):
    """Gold evaluation of the BM25 search of the questions."""
    return gold.id_set_measures(_relevant(spark, d), found(spark, d), (1, 3, 5, 10)).withColumn("k", F.col("k").cast("long"))


def _items(spark, d):
    """Questions; every third names no article."""
    third = F.col("query_id") % 3 == 0
    bare = F.when(third, F.regexp_replace("answer", "第[0-9]+條[之0-9]*", "")).otherwise(F.col("answer"))
    return questions(spark, d).select("query_id", F.when(third, "").otherwise(F.col("query")).alias("query"), bare.alias("answer"))


def _converted(spark, d):
    spans = chunks(spark, d).select(F.col("doc_id").alias("span_id"), F.col("label").alias("article"), F.col("content").alias("text"))
    items = _items(spark, d)
    return items, question_spans_.spans_of_questions(items, spans)


ITEMS = f"""{LC}, {LQ}, it AS (SELECT query_id, answer, concat_ws(' ', answer, query) AS said FROM (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN '' ELSE query END AS query,
  CASE WHEN query_id % 3 = 0 THEN regexp_replace(answer, '第[0-9]+條[之0-9]*', '', 'g') ELSE answer END AS answer FROM lq) WHERE answer <> ''), sp AS (SELECT doc_id AS span_id, content AS text FROM lc WHERE content <> '')"""
BEST = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, span_id) AS rank FROM s WHERE score > {0}) SELECT query_id, span_id, score, rank::BIGINT AS rank FROM ranked WHERE rank <= {1}"


def _best_spans(spark, d, step, most):
    spans = chunks(spark, d).where("content <> ''").select(F.col("doc_id").alias("span_id"), F.col("content").alias("text"))
    items = _items(spark, d).where("answer <> ''").select("query_id", F.concat_ws(" ", "answer", "query").alias("said"), "answer")
    return top(step(items, spans), ["query_id"], most, ["span_id"]).select("query_id", "span_id", "score", F.col("rank").cast("long"))


@query(f"""WITH {ITEMS}, w AS (SELECT query_id, list_filter(list_distinct(regexp_extract_all(said, '[\\pL\\pN]+')), lambda x: length(x) >= 2) AS ws FROM it), wide AS (SELECT query_id, ws, list_sum(list_transform(ws, lambda x: length(x))) AS total FROM w WHERE len(ws) > 0),
s AS (SELECT query_id, span_id, round(coalesce(list_sum(list_transform(list_filter(ws, lambda x: contains(text, x)), lambda x: length(x))), 0)::DOUBLE / total, 6) AS score FROM wide, sp), {BEST.format('0.3', 3)}""")
def question_spans_keywords(spark, d):
    return _best_spans(spark, d, partial(question_spans_.by_keywords, most=3), 3)


@query(f"""WITH {ITEMS}, a AS (SELECT query_id, list_distinct(regexp_extract_all(answer, '(?s).')) AS x FROM it), b AS (SELECT span_id, list_distinct(regexp_extract_all(text, '(?s).')) AS y FROM sp), m AS (SELECT query_id, span_id, len(x) AS n, len(y) AS k, len(list_intersect(x, y)) AS c FROM a, b),
s AS (SELECT query_id, span_id, round(c::DOUBLE / (n + k - c), 6) AS score FROM m), {BEST.format('0.4', 2)}""")
def question_spans_characters(spark, d):
    return _best_spans(spark, d, partial(question_spans_.by_characters, most=2), 2)


@query()
def question_spans(spark, d):
    return _converted(spark, d)[1]


@query()
def question_span_stats(spark, d):
    return gold.conversion_statistics(*_converted(spark, d))
