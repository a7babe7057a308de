"""Registered queries, continued: sequential splitters, statutes at all levels, weights of articles, learning from feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, splitting, statutes
from ..sources import table
from .corpus import pick
from .queries import NODES_SQL, _docs, _laws, query


def _digest(chunks):
    return chunks.select("doc_id", F.col("chunk_index").cast("long"), F.md5("content").alias("content_md5"), *[F.col(c).cast("long").alias({"end": "stop"}.get(c, c)) for c in ("start", "end") if c in chunks.columns])


# --- sequential splitters: tested against brute force and by their properties ----------------------------------------------
@query()
def chunk_boundary_windows(spark, d):
    return _digest(splitting.boundary_windows(_docs(spark, d), ends=".\n!?。！？"))


@query()
def chunk_recursive(spark, d):
    return _digest(splitting.recursive(_docs(spark, d)))


@query()
def chunk_structured_lines(spark, d):
    return _digest(splitting.structured_lines(_docs(spark, d)))


# --- statutes ----------------------------------------------------------------------------------------------------------------
LIVE = f"""{NODES_SQL},
own AS (SELECT *, regexp_replace(path, '^.*/', '') || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END AS own FROM nodes),
multi AS (SELECT h.doc_id, h.node, h.kind AS level, h.path, string_agg(b.own, chr(10) ORDER BY b.node) AS content FROM own h JOIN own b ON h.doc_id = b.doc_id AND (b.path = h.path OR starts_with(b.path, h.path || '/'))
  WHERE NOT contains(h.path, '第3條') GROUP BY ALL
  UNION ALL SELECT doc_id, -1, 'law', '', string_agg(own, chr(10) ORDER BY node) FROM own GROUP BY doc_id)"""


@query(f"WITH {LIVE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY node) - 1 AS chunk_index, level, path, md5(content) AS content_md5 FROM multi")
def statute_multi_level(spark, d):
    return statutes.multi_level(statutes.parts(_laws(spark, d))).select("doc_id", F.col("chunk_index").cast("long"), "level", "path", F.md5("content").alias("content_md5"))


@query(f"""WITH {LIVE} SELECT m.doc_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.node) - 1 AS chunk_index, m.level, md5(CASE WHEN m.level = 'article' THEN o.own ELSE m.content END) AS content_md5
FROM multi m LEFT JOIN own o ON m.doc_id = o.doc_id AND m.node = o.node WHERE m.level IN ('law', 'chapter', 'section', 'article')""")
def statute_articles_only(spark, d):
    return statutes.multi_level(statutes.parts(_laws(spark, d)), deep=False, whole_articles=False).select("doc_id", F.col("chunk_index").cast("long"), "level", F.md5("content").alias("content_md5"))


CHAPTERS, SECTIONS, TITLES = ("第一章 總則", "第五章 罰則", "第六章 附則", "第三章 施行程序", "第二章"), ("第一節 通則", "", "第二節"), ("第2條 用詞定義", "第30條", "第40條 施行", "第9條 釋義")
WEIGHED = f"(SELECT doc_id, {pick(CHAPTERS, 'doc_id % 5')} AS chapter, {pick(SECTIONS, 'doc_id % 3')} AS section, {pick(TITLES, 'doc_id % 4')} AS article FROM documents)"


@query(f"""SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN doc_id % 4 IN (0, 3) THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN doc_id % 5 = 1 THEN 1.2::DOUBLE ELSE 1 END
  * CASE WHEN doc_id % 5 = 3 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN doc_id % 5 = 2 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN doc_id % 3 = 0 THEN 1.2::DOUBLE ELSE 1 END, 2) AS weight FROM {WEIGHED}""")
def article_importance(spark, d):
    rows = spark.sql(f"SELECT * FROM {WEIGHED}".replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    return rows.select("doc_id", statutes.importance(F.col("chapter"), F.col("section"), F.col("article")).alias("weight"))


# --- learning from feedback: events stand for feedback, their types for patterns -----------------------------------------------
FEEDBACK = "f AS (SELECT event_type AS pattern_id, count(*) FILTER (event_id % 3 <> 0) AS successes, count(*) FILTER (event_id % 3 = 0) AS failures FROM events GROUP BY ALL)"


def _feedback(spark, d):
    said = table(spark, d, "events").select(F.col("event_type").alias("pattern_id"), (F.col("event_id") % 3 != 0).alias("success"))
    return learning.pattern_counts(said.select("pattern_id").distinct().withColumn("threshold", F.lit(0.98)), said)


@query(f"WITH {FEEDBACK} SELECT pattern_id, 0.98::DOUBLE AS threshold, successes, failures, CASE WHEN successes > 0 THEN 1.0::DOUBLE END AS after_success, CASE WHEN failures > 0 THEN 0.93::DOUBLE END AS after_failure FROM f")
def feedback_patterns(spark, d):
    return _feedback(spark, d)


@query(f"WITH {FEEDBACK} SELECT count(*) AS patterns, count(*) FILTER (successes > failures) AS successful, round(sum(successes)::DOUBLE / sum(successes + failures), 6) AS success_rate FROM f")
def feedback_rates(spark, d):
    return learning.pattern_rates(_feedback(spark, d))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def feedback_recent(spark, d):
    return learning.recent(table(spark, d, "events"), "ts", "event_id").select("event_id", "event_type", "ts")


LEARNED = "(1, 'the', 0.9{d}), (2, 'And', 0.5{d}), (3, 'ö', 0.8{d}), (4, 'answer', 0.7{d})"
LED = "(1, 'what', 'question', 0.8{d}), (2, 'is', 'being', 0.6{d})"


@query(f"""WITH k AS (SELECT 0 AS kind, o, term, term AS adds, 0.1::DOUBLE * c AS boost FROM (VALUES {LEARNED.replace('{d}', '::DOUBLE')}) t(o, term, c)
  UNION ALL SELECT 1, o, term, adds, 0.05::DOUBLE * c FROM (VALUES {LED.replace('{d}', '::DOUBLE')}) t(o, term, adds, c))
SELECT item_id AS query_id, md5(any_value(text) || coalesce(string_agg(' ' || adds, '' ORDER BY kind, o), '')) AS expanded_md5, round(coalesce(sum(boost), 0), 6) AS boost
FROM benchmark LEFT JOIN k ON contains(lower(text), lower(term)) GROUP BY item_id""")
def learned_expansion(spark, d):
    concepts = spark.sql(f"SELECT * FROM VALUES {LEARNED.replace('{d}', 'D')} AS t(order, name, confidence)")
    relations = spark.sql(f"SELECT * FROM VALUES {LED.replace('{d}', 'D')} AS t(order, source, target, confidence)")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return learning.expand(queries, concepts, relations).select("query_id", F.md5("expanded").alias("expanded_md5"), "boost")


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL")
def learned_distribution(spark, d):
    return learning.distribution(table(spark, d, "documents"), ["lang", "source"])
