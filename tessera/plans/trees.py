"""Registered queries on splitting and on statutes as trees: one JSON statute per document, with the document's whole text dealt
over its articles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import text as T
from ..operators import chunking, retrieval, splitting, statutes
from ..sources import table
from .corpus import LAWS, LC, any_of, chunks, joined, pick
from .queries import SLIDING, TOKENS, _chunks, _docs, greedy, query
from .structure import _digest

# --- statutes as JSON ------------------------------------------------------------------------------------------------------------------
#: Articles of a document's law, and the piece of its text that article i (from 0) holds.
COUNT = "(1 + doc_id % 4)"
PIECE = "substring(body, CAST(floor(length(body) * i / {0}) AS INT) + 1, CAST(floor(length(body) * (i + 1) / {0}) AS INT) - CAST(floor(length(body) * i / {0}) AS INT))".format(COUNT)
LABEL = "CASE WHEN i = 0 AND doc_id % 5 = 0 THEN '未標示條文' ELSE '第' || (i + 1) || '條' || CASE WHEN doc_id % 3 = 0 THEN '之2' ELSE '' END END"
NAMES = f"SELECT doc_id, {pick(LAWS, 'doc_id % 5')} AS law, coalesce(text, '') AS body FROM documents"


def _json(spark, d):
    """(doc_id, json): the newer names for even documents, the older ones for odd ones."""
    rows = spark.sql(NAMES.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    sub = lambda names: f"array(named_struct('{names[1]}', '甲', 'content', '款文' || i, 'items', array(named_struct('item', 'x', 'content', '目文' || i))))"
    part = lambda names: f"CASE WHEN i % 2 = 0 THEN array(named_struct('{names[0]}', '1', 'content', '項文' || i, '{names[2]}', {sub(names)})) ELSE array() END"
    article = lambda names, key: f"transform(sequence(0, CAST({COUNT} AS INT) - 1), i -> named_struct('article', {LABEL}, 'content', CASE WHEN i = 1 THEN '（刪除）' ELSE {PIECE} END, 'metadata', named_struct('id', '法規名稱：' || law || '_' || i), '{key}', {part(names)}))"
    law = lambda articles: f"to_json(named_struct('laws', array(named_struct('law_name', '法規名稱：' || law, 'chapters', array(named_struct('chapter', '第一章 總則', 'sections', array(named_struct('section', '未分類節', 'articles', {articles}))))))))"
    new, old = ("paragraph", "subparagraph", "subparagraphs"), ("item", "sub_item", "sub_items")
    return rows.select("doc_id", F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {law(article(new, 'paragraphs'))} ELSE {law(article(old, 'items'))} END").alias("json"))


def _nodes(spark, d):
    return statutes.tree_nodes(sources.json_statutes(_json(spark, d)))


#: The rows of _nodes(): place as text, titles and contents.
NODES = f"""b AS ({NAMES}), ar AS (SELECT *, unnest(generate_series(0, {COUNT} - 1)) AS i FROM b), art AS (SELECT doc_id, law, i, {LABEL} AS article, CASE WHEN i = 1 THEN '（刪除）' ELSE {PIECE} END AS content FROM ar),
nodes AS (SELECT doc_id, law, 'law' AS kind, '0' AS place, '法規名稱：' || law AS title, '' AS content, -1 AS i, NULL AS article FROM b UNION ALL SELECT doc_id, law, 'chapter', '0/0', '第一章 總則', '', -1, NULL FROM b UNION ALL SELECT doc_id, law, 'section', '0/0/0', '未分類節', '', -1, NULL FROM b
  UNION ALL SELECT doc_id, law, 'article', '0/0/0/' || i, article, content, i, article FROM art UNION ALL SELECT doc_id, law, 'paragraph', '0/0/0/' || i || '/0', '1', '項文' || i, i, article FROM art WHERE i % 2 = 0
  UNION ALL SELECT doc_id, law, 'subparagraph', '0/0/0/' || i || '/0/0', '甲', '款文' || i, i, article FROM art WHERE i % 2 = 0 UNION ALL SELECT doc_id, law, 'item', '0/0/0/' || i || '/0/0/0', 'x', '目文' || i, i, article FROM art WHERE i % 2 = 0)"""


def _place(c: str = "place"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "/")


@query(f"WITH {NODES} SELECT doc_id, kind, place, title, md5(content) AS content_md5 FROM nodes")
def tree_nodes(spark, d):
    return _nodes(spark, d).select("doc_id", "kind", _place().alias("place"), "title", F.md5("content").alias("content_md5"))


@query(f"WITH {NODES} SELECT doc_id, md5(string_agg(CASE WHEN trim(content) = '' THEN title ELSE title || chr(10) || chr(10) || content END, chr(10) || chr(10) ORDER BY place)) AS text_md5 FROM nodes GROUP BY doc_id")
def tree_text(spark, d):
    return statutes.tree_text(_nodes(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"""WITH {NODES} SELECT doc_id, kind, place, CASE WHEN kind = 'article' THEN law || '_' || i END AS id, law AS category, article AS article_label, CASE WHEN article <> '未標示條文' THEN i + 1 END::BIGINT AS article_number, CASE WHEN article <> '未標示條文' AND doc_id % 3 = 0 THEN 2 END::BIGINT AS article_suffix,
  CASE WHEN kind = 'paragraph' THEN 1 END::BIGINT AS item_number, CASE WHEN kind = 'subparagraph' THEN '目' END AS clause_type FROM nodes WHERE i >= 0 AND article <> '未標示條文'""")
def tree_normalised(spark, d):
    got = statutes.normalised(_nodes(spark, d))
    return got.select("doc_id", "kind", _place().alias("place"), "id", "category", "article_label", *[F.col(c).cast("long") for c in ("article_number", "article_suffix", "item_number")], "clause_type")


SAID = "CASE kind WHEN 'subparagraph' THEN '一' WHEN 'item' THEN '(一)' ELSE title END || CASE WHEN trim(content) <> '' THEN chr(10) || content ELSE '' END"


@query(f"""WITH {NODES}, live AS (SELECT *, {SAID} AS said FROM nodes WHERE NOT (i = 1)) SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.i) - 1 AS chunk_index, md5('【法規名稱：' || any_value(a.law) || '】' || chr(10) || '第一章 總則' || chr(10) || string_agg(b.said, chr(10) ORDER BY b.place)) AS content_md5
FROM live a JOIN live b ON a.doc_id = b.doc_id AND a.i = b.i WHERE a.kind = 'article' GROUP BY a.doc_id, a.i""")
def unit_articles(spark, d):
    return statutes.unit_chunks(_nodes(spark, d), "article").select("doc_id", F.col("chunk_index").cast("long"), F.md5("content").alias("content_md5"))


@query(f"""WITH {NODES}, live AS (SELECT *, {SAID} AS said FROM nodes WHERE i <> 1 AND kind NOT IN ('law', 'section')) SELECT doc_id, 0::BIGINT AS chunk_index, md5('【法規名稱：' || any_value(law) || '】' || chr(10) || string_agg(said, chr(10) ORDER BY place)) AS content_md5 FROM live GROUP BY doc_id""")
def unit_laws(spark, d):
    return statutes.unit_chunks(_nodes(spark, d), "law").select("doc_id", F.col("chunk_index").cast("long"), F.md5("content").alias("content_md5"))


@query(f"""WITH {NODES}, n AS (SELECT doc_id, kind, content, CASE kind WHEN 'article' THEN article WHEN 'paragraph' THEN article || '_1' WHEN 'subparagraph' THEN article || '_1_甲' ELSE article || '_1_甲_x' END AS base FROM nodes WHERE i >= 0 AND content <> ''),
w AS (SELECT *, unnest(CASE WHEN length(content) <= 500 THEN [0] ELSE generate_series(0, greatest(0, length(content) - 51), 450) END) AS s FROM n)
SELECT doc_id, CASE WHEN length(content) > 500 THEN base || '_part_' || (s // 450 + 1) WHEN kind = 'article' THEN base || '_main' ELSE base END AS chunk_id, md5(substring(content, s + 1, 500)) AS content_md5 FROM w""")
def node_chunks(spark, d):
    return statutes.node_chunks(_nodes(spark, d)).select("doc_id", "chunk_id", F.md5("content").alias("content_md5"))


CITATIONS = ((1, "著作權法第1條"), (2, "第2條"), (3, "商標法第一章第3條第一項"), (4, "民法第四條之2"), (5, "刑法"), (6, "第一條第1項第1款"), (7, "專利法第9條"), (8, "第2-2條"))


@query(f"""WITH {NODES}, q AS (SELECT * FROM (VALUES (1, '著作權法', '1', NULL), (2, NULL, '2', NULL), (3, '商標法', '3', 'paragraph'), (4, '民法', '4-2', NULL), (5, '刑法', NULL, NULL), (7, '專利法', '9', NULL)) t(query_id, lw, ar, pk)),
k AS (SELECT *, CASE WHEN article <> '未標示條文' THEN (i + 1) || CASE WHEN doc_id % 3 = 0 THEN '-2' ELSE '' END END AS akey FROM nodes)
SELECT query_id::BIGINT AS query_id, doc_id, kind, place, row_number() OVER (PARTITION BY query_id ORDER BY len(string_split(place, '/')), doc_id, list_transform(string_split(place, '/'), lambda x: x::INT)) AS rank FROM q JOIN k ON (lw IS NULL OR lw = law) AND (ar IS NULL OR ar = akey) AND (pk IS NULL OR kind IN ('paragraph', 'subparagraph', 'item'))""")
def citation_query(spark, d):
    """Citations in words; numbered clauses are not found in laws whose clauses bear no numerals, and 第N-M條 is no article with a suffix of its own."""
    citations = spark.createDataFrame([c for c in CITATIONS if c[0] not in (6, 8)], "query_id long, citation string")
    return statutes.citation_search(_nodes(spark, d), citations).select("query_id", "doc_id", "kind", _place().alias("place"), F.col("rank").cast("long"))


@query(f"""WITH {NODES}, c AS (SELECT *, list_transform(string_split(place, '/'), lambda x: x::INT) AS at FROM nodes), f AS (SELECT law, article, arg_min(content, doc_id * 1000 + i) AS parent FROM nodes WHERE kind = 'article' GROUP BY ALL)
SELECT doc_id, place, md5(CASE WHEN kind IN ('paragraph', 'subparagraph', 'item') THEN parent END) AS parent_md5 FROM c LEFT JOIN f USING (law, article)""")
def parent_articles(spark, d):
    rows = _nodes(spark, d).withColumn("chunk_index", F.col("place"))
    return statutes.parents(rows).select("doc_id", _place("chunk_index").alias("place"), F.md5("parent_content").alias("parent_md5"))


LEVEL = "CASE kind WHEN 'law' THEN 'document' WHEN 'chapter' THEN 'document_component' WHEN 'section' THEN 'basic_unit_hierarchy' WHEN 'article' THEN 'basic_unit' ELSE 'enumeration' END"


@query(f"WITH {NODES}, h AS (SELECT {LEVEL} AS level, count(*) AS n FROM nodes WHERE kind <> 'paragraph' GROUP BY 1) SELECT level, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('document'), ('document_component'), ('basic_unit_hierarchy'), ('basic_unit'), ('basic_unit_component'), ('enumeration')) t(level) LEFT JOIN h USING (level)")
def level_histogram(spark, d):
    return statutes.level_histogram(_nodes(spark, d).where("kind <> 'paragraph'").select(F.expr(LEVEL).alias("level")))


# lists of amendments around a document's text
AMENDED = """SELECT doc_id, '法規名稱：示範法' || chr(10) || '修正日期：民國 100 年 1 月 2 日' || chr(10) || '生效狀態：x' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '1. 中華民國九十年修正' || chr(10) || chr(10) || '續：增訂條文' || chr(10) ELSE '' END || '第1條' || chr(10) || '政院定之' || chr(10) || translate(coalesce(text, ''), chr(10) || chr(13), '  ') || '。' || chr(10) || '1. 本條施行' AS text FROM documents"""


@query("SELECT doc_id, md5('第1條' || chr(10) || translate(coalesce(text, ''), chr(10) || chr(13), '  ') || '。') AS text_md5 FROM documents")
def amendments_cleaned(spark, d):
    laws = spark.sql(AMENDED.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    return statutes.clean(laws).select("doc_id", F.md5("text").alias("text_md5"))


# --- splitting ----------------------------------------------------------------------------------------------------------------------------
@query("""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS chunk_index, md5(substring(text, s + 1, 400)) AS content_md5, s::BIGINT AS start, least(s + 400, length(text))::BIGINT AS stop
FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 320)) AS s FROM documents WHERE trim(text) <> '') WHERE trim(substring(text, s + 1, 400)) <> ''""")
def chunk_overlap_windows(spark, d):
    return _digest(chunking.overlap_windows(_docs(spark, d), 400, 0.2))


PARAGRAPHS = """pp AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: CASE WHEN length(p) <= 800 THEN [p] ELSE list_transform(list_filter(string_split(list_reduce(list_concat([''], string_split(p, '。')),
  lambda a, s: CASE WHEN length(string_split(a, chr(31))[-1]) + length(s) <= 800 THEN a || s || '。' ELSE a || chr(31) || s || '。' END), chr(31)), lambda c: length(c) >= 50), lambda c: trim(c)) END)) AS ps FROM documents WHERE text IS NOT NULL),
pc AS (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM pp WHERE len(ps) > 0), pa AS (SELECT doc_id, i, 0 AS o, ps[i] AS content FROM pc UNION ALL SELECT doc_id, i, 1, right(ps[i], 40) || substring(ps[i + 1], 41) FROM pc WHERE length(ps[i]) > 40 AND length(ps[i + 1]) > 40)"""


@query(f"WITH {PARAGRAPHS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, o) - 1 AS chunk_index, md5(content) AS content_md5, o = 1 AS overlapped FROM pa")
def chunk_paragraphs(spark, d):
    return chunking.paragraphs_then_sentences(_docs(spark, d), 800, 50, 40).select("doc_id", F.col("chunk_index").cast("long"), F.md5("content").alias("content_md5"), "overlapped")


_BLANK = "list_filter(string_split(text, {0}), lambda s: trim(s) <> '')"
_SENTENCES = greedy("list_filter(string_split(regexp_replace(text, '([。！？；;])', '\\1' || chr(30), 'g'), chr(30)), lambda s: s <> '')", 600, "''")
OVERSIZE = f"""op AS (SELECT doc_id, text, CASE WHEN length(text) <= 600 THEN [text] WHEN len({_BLANK.format('chr(10) || chr(10)')}) > 1 THEN {_BLANK.format('chr(10) || chr(10)')} WHEN len({_BLANK.format('chr(10)')}) > 1 THEN {_BLANK.format('chr(10)')} ELSE {_SENTENCES} END AS ps FROM documents WHERE text IS NOT NULL),
oc AS (SELECT doc_id, CASE WHEN length(text) <= 600 THEN ps ELSE list_transform(string_split(list_reduce(list_transform(ps, lambda p: trim(p)), lambda a, s: CASE WHEN length(string_split(a, chr(31))[-1]) + length(s) > 600
  THEN a || chr(31) || CASE WHEN length(string_split(a, chr(31))[-1]) > 60 AND trim(right(string_split(a, chr(31))[-1], 60)) <> '' THEN trim(right(string_split(a, chr(31))[-1], 60)) || chr(10) || chr(10) || s ELSE s END ELSE a || chr(10) || chr(10) || s END), chr(31)), lambda c: trim(c)) END AS cs FROM op)"""


@query(f"WITH {OVERSIZE} SELECT doc_id, unnest(generate_series(0, len(cs) - 1)) AS chunk_index, md5(unnest(cs)) AS content_md5 FROM oc")
def chunk_oversize(spark, d):
    whole = _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    return chunking.split_oversize(whole, 600).select("doc_id", F.col("part").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


@query()
def chunk_prefixed_structure(spark, d):
    return _digest(splitting.prefixed_structure(_docs(spark, d)))


@query()
def chunk_by_sentence_length(spark, d):
    return _digest(splitting.by_sentence_length(_docs(spark, d), mark="."))


@query(f"""WITH {SLIDING}, bad AS (SELECT DISTINCT c.doc_id FROM chunks c JOIN documents d USING (doc_id) WHERE instr(text, content) - 1 <> start)
SELECT doc_id, chunk_index::BIGINT AS chunk_index, start::BIGINT AS lowest, "end"::BIGINT AS highest FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM bad)""")
def recovered_spans(spark, d):
    """Windows found again in their texts, odd and even ones by themselves, since neighbours overlap and the search goes on from the
    last one's end; the texts in which every window occurs first where it was cut."""
    docs = _docs(spark, d)
    cut = chunking.sliding_stop(docs)
    bad = cut.join(docs, "doc_id").where(F.instr("text", F.col("content")) - 1 != F.col("start")).select("doc_id").distinct()
    part = cut.join(bad, "doc_id", "left_anti").select("doc_id", "chunk_index", "content")
    found = [chunking.recovered_spans(part.where(f"chunk_index % 2 = {k}"), docs) for k in (0, 1)]
    return found[0].unionByName(found[1]).select("doc_id", F.col("chunk_index").cast("long"), F.col("start").cast("long").alias("lowest"), F.col("end").cast("long").alias("highest"))


@query(f"""WITH {SLIDING}, sp AS (SELECT doc_id, doc_id * 10 + i AS span_id, i * 700 AS s, i * 700 + 650 AS e FROM documents, generate_series(0, 9) g(i)),
x AS (SELECT c.doc_id, chunk_index, span_id, (least("end", e) - greatest(start, s)) / ("end" - start) AS share FROM chunks c JOIN sp USING (doc_id) WHERE s < "end" AND start < e)
SELECT doc_id, chunk_index::BIGINT AS chunk_index, span_id, round(share, 6) AS share, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY round(share, 6) DESC, span_id) AS rank FROM x WHERE share > 0.1""")
def span_overlaps(spark, d):
    spans = _docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select((F.col("doc_id") * 10 + F.col("i")).alias("span_id"), "doc_id", (F.col("i") * 700).alias("s"), (F.col("i") * 700 + 650).alias("e"))
    return chunking.overlapping_spans(_chunks(spark, d), spans).select("doc_id", F.col("chunk_index").cast("long"), "span_id", "share", F.col("rank").cast("long"))


@query(f"WITH {SLIDING} SELECT c.doc_id, count(*) AS n_chunks, round(greatest(0, sum(length(content)) / length(any_value(text)) - 1), 6) AS rate FROM chunks c JOIN documents d USING (doc_id) GROUP BY c.doc_id")
def chunk_overlap_rate(spark, d):
    return chunking.overlap_rate(_chunks(spark, d), _docs(spark, d))


@query("""WITH g AS (SELECT * FROM (VALUES (300, 0.0), (300, 0.2), (600, 0.0), (600, 0.2)) t(size, ratio)),
f AS (SELECT 'fixed_size' AS strategy, size, ratio, length(substring(text, s + 1, size)) AS n FROM (SELECT text, size, ratio, unnest(generate_series(0, length(text) - 1, size - floor(size * ratio)::INT)) AS s FROM documents, g WHERE length(text) > 0) WHERE trim(substring(text, s + 1, size)) <> ''),
w AS (SELECT 'sliding_window' AS strategy, size, ratio, length(substring(text, s + 1, size)) AS n FROM (SELECT text, size, ratio, unnest(generate_series(0, greatest(0, length(text) - floor(size * ratio)::INT - 1), size - floor(size * ratio)::INT)) AS s FROM documents, g WHERE length(text) > 0) WHERE trim(substring(text, s + 1, size)) <> '')
SELECT strategy, size::BIGINT AS chunk_size, ratio::DOUBLE AS overlap_ratio, count(*) AS n_chunks, round(avg(n), 6) AS mean_chars FROM (SELECT * FROM f UNION ALL SELECT * FROM w) GROUP BY ALL""")
def strategy_batch(spark, d):
    rows = chunking.batch(_docs(spark, d), ("fixed_size", "sliding_window"), (300, 600), (0.0, 0.2))
    return rows.groupBy("strategy", F.col("chunk_size").cast("long").alias("chunk_size"), "overlap_ratio").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"))


KEYWORDS = f"""k AS (SELECT doc_id, unnest(t) AS w, unnest(generate_series(1, len(t))) AS pos FROM (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS t FROM documents) WHERE len(t) > 0),
c AS (SELECT doc_id, w, count(*) AS n, min(pos) AS first FROM k GROUP BY doc_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)"""


@query(f"WITH {KEYWORDS} SELECT doc_id, rank, w AS word FROM r WHERE rank <= 5")
def keywords(spark, d):
    """The words of whole texts, counted inside the row. Documents of several rows, if there are any, are counted over all of them."""
    docs = _docs(spark, d).select("doc_id", "text")
    again = sources.stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    ranked = lambda rows: rows.select("doc_id", F.posexplode(T.keywords(F.col("text"))).alias("at", "word")).select("doc_id", (F.col("at") + 1).cast("long").alias("rank"), "word")
    if again.isEmpty():
        return ranked(docs)
    many = again.select(F.col("doc_id").alias("id"))
    repeated = F.col("doc_id").eqNullSafe(F.col("id"))
    tokens = docs.join(many, repeated, "left_semi").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("at", "word"))
    counted = tokens.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    over = counted.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("doc_id", F.col("rank").cast("long"), "word")
    return ranked(docs.join(many, repeated, "left_anti")).unionByName(over)
