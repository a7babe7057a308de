"""Registered queries on words found in the corpus and on sessions of the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segmentation
from ..sources import table
from ..streaming import annotations
from .corpus import LC, chunks
from .queries import query

DICTIONARY = rf"""{LC}, r AS (SELECT run, count(*) AS c FROM (SELECT unnest(regexp_extract_all(content, '\p{{Han}}+')) AS run FROM lc) GROUP BY 1),
o AS (SELECT substring(run, i, n) AS word, CASE WHEN i > 1 THEN substring(run, i - 1, 1) ELSE '' END AS l, substring(run, i + n, 1) AS r, c FROM (SELECT run, c, n, unnest(generate_series(1, length(run) - n + 1)) AS i FROM r, (VALUES (1), (2), (3), (4)) t(n) WHERE length(run) >= n)),
f AS (SELECT word, sum(c) AS n FROM o GROUP BY 1), a AS (SELECT sum(n)::DOUBLE AS total FROM f WHERE length(word) = 1),
hl AS (SELECT word, ln(sum(x)) - sum(x * ln(x)) / sum(x) AS h FROM (SELECT word, l, sum(c)::DOUBLE AS x FROM o WHERE length(word) > 1 GROUP BY ALL) GROUP BY word), hr AS (SELECT word, ln(sum(x)) - sum(x * ln(x)) / sum(x) AS h FROM (SELECT word, r, sum(c)::DOUBLE AS x FROM o WHERE length(word) > 1 GROUP BY ALL) GROUP BY word),
co AS (SELECT f.word, any_value(f.n) AS n, round(min(ln(f.n::DOUBLE * total / (x.n::DOUBLE * y.n))), 6) AS cohesion FROM f, a, (VALUES (1), (2), (3)) t(k), f x, f y WHERE k < length(f.word) AND f.n >= 5 AND x.word = substring(f.word, 1, k) AND y.word = substring(f.word, k + 1) GROUP BY f.word),
fr AS (SELECT word, n, cohesion, round(least(hl.h, hr.h), 6) AS freedom FROM co JOIN hl USING (word) JOIN hr USING (word))"""


@query(f"WITH {DICTIONARY} SELECT word, n::BIGINT AS n, cohesion, freedom FROM fr WHERE cohesion >= 1 AND freedom >= 0.5 UNION ALL SELECT word, n::BIGINT, NULL, NULL FROM f WHERE length(word) = 1")
def word_dictionary(spark, d):
    return segmentation.dictionary(chunks(spark, d), "content")


def _segmented(spark, d):
    rows = chunks(spark, d).select("doc_id", "content")
    return segmentation.segmented(rows, segmentation.dictionary(rows, "content"), "content")


@query()
def segment_words(spark, d):
    """The words of every content, as one text; tests hold paths against all segmentations of short texts."""
    return _segmented(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n_words"), F.md5(F.array_join("tokens", " ")).alias("words_md5"))


@query()
def segmented_keywords(spark, d):
    return segmentation.keywords(_segmented(spark, d), "doc_id", F.col("tokens")).withColumns({"tf": F.col("tf").cast("long"), "rank": F.col("rank").cast("long")})


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return annotations.sessions(table(spark, d, "events"))
