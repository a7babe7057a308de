"""Registered queries, continued: splitting along structure and concepts, six levels in context, routed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concept_spans, fusion, splitting, statutes
from .queries import PAIRED, _docs, _laws, _sides, query
from .structure import LIVE, _digest

#: Headings and sentence ends of the documents at hand, in place of those of statutes.
LATIN_HEADING = r"^[A-Z][^.\n]{0,40}$"


@query()
def chunk_structure_windows(spark, d):
    return _digest(splitting.structure_windows(_docs(spark, d), ends=".!?。", opens=LATIN_HEADING))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents),
c AS (SELECT doc_id, len(ls) AS lines, len(list_filter(ls, lambda s: regexp_matches(s, '^[A-Z][^.\\n]{0,40}$'))) AS headings FROM l)
SELECT doc_id, lines, headings, round(headings::DOUBLE / greatest(lines, 1), 6) AS density FROM c""")
def structure_density(spark, d):
    return splitting.structure_density(_docs(spark, d), LATIN_HEADING).select("doc_id", F.col("lines").cast("long"), F.col("headings").cast("long"), "density")


@query()
def chunk_concept_windows(spark, d):
    return _digest(concept_spans.concept_windows(_docs(spark, d)))


@query()
def chunk_concept_levels(spark, d):
    return concept_spans.concept_levels(_docs(spark, d)).select("doc_id", F.col("chunk_index").cast("long"), "level", F.md5("content").alias("content_md5"))


@query(f"""WITH {LIVE}, c AS (SELECT m.doc_id, m.node, m.level AS part, m.content AS original,
  m.level = 'item' AND length(m.content) < 200 AND NOT regexp_matches(m.content, '本法.*?定義|本法.*?規定|本法.*?用詞|應.*?申請|得.*?辦理|依.*?程序') AS in_context, a.own AS context
  FROM multi m LEFT JOIN own a ON m.doc_id = a.doc_id AND a.kind = 'article' AND starts_with(m.path, a.path || '/'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY node) - 1 AS chunk_index, CASE part WHEN 'law' THEN 'document' WHEN 'chapter' THEN 'document_component' WHEN 'section' THEN 'basic_unit_hierarchy' WHEN 'article' THEN 'basic_unit' WHEN 'paragraph' THEN 'basic_unit_component' ELSE 'enumeration' END AS level,
  part, md5(original) AS original_md5, md5(CASE WHEN in_context THEN context || chr(10) || original ELSE original END) AS content_md5, in_context FROM c""")
def statute_six_levels(spark, d):
    return statutes.six_levels(statutes.multi_level(statutes.parts(_laws(spark, d)))).select("doc_id", F.col("chunk_index").cast("long"), "level", "part", F.md5("original").alias("original_md5"), F.md5("content").alias("content_md5"), "in_context")


