"""Statute-like tables made from the documents and benchmark at hand, by SQL that Spark and DuckDB read alike: one chunk of a law
per document, with the document's whole text, and one question per benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import spread, table

LAWS = ("著作權法", "商標法", "專利法", "民法", "刑法")
PHRASES = (
    "本法所稱著作是指屬於文學之創作，作者享有重製權利。", "申請人應依程序向主管機關申請註冊。", "但有下列情形之一者，不在此限。", "違反前項規定者，處三年以下有期徒刑或罰金。",
    "依第3條第1項規定，商標權人得禁止他人使用。", "總則：本條例適用於一般情形。", "（1）合理使用包括教學與研究。", "專利權人專有實施發明之權利；他人不得仿冒。",
    "其他法律另有規定者，從其規定。", "附則及罰則另定之。", "著作人必須辦理登記，因此主管機關應予核准。", "契約當事人負損害賠償責任。",
    "一、定義 二、範圍 三、程序", "著作權人於侵害發生時得請求賠償，除外規定不適用前述情形。", "plain words without any rule", "第12條之1準用之，第12條不準用。",
)
ASKS = (
    "什麼是重製的定義？", "如何申請商標註冊的流程", "與專利法的差別，請比較分析", "有哪些案例或情形？", "規定應不得翻譯出版嗎", "整部法律的全文內容", "第一章總則有哪些內容", "第二節的標題",
    "第3項第1款的內容", "條文規定的範圍與影響是否適用", "改編並上傳到網路分享", "學校教學時影印與下載", "article 15 of the code", "發明的新穎性與進步性的關係", "plain question?", "仿冒與混淆的概念",
)


def pick(items: tuple, at: str) -> str:
    """items[at], at from 0 to len(items) - 1, as SQL."""
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


def numeral(n: str) -> str:
    """The Chinese numeral of n, 1 to 99, as SQL."""
    names = "'一二三四五六七八九'"
    return f"(CASE WHEN {n} >= 20 THEN substring({names}, CAST(floor({n} / 10) AS INT), 1) ELSE '' END || CASE WHEN {n} >= 10 THEN '十' ELSE '' END || CASE WHEN {n} % 10 > 0 THEN substring({names}, CAST({n} % 10 AS INT), 1) ELSE '' END)"


_ARTICLE = "'第' || (doc_id % 120 + 1) || '條' || CASE WHEN doc_id % 7 = 0 THEN '之' || (doc_id % 3 + 1) ELSE '' END"
#: doc_id, law, part, article, label, phrase, content: one row per document.
CHUNKS = f"""SELECT doc_id, law, part, article, label, chr(10) || phrase || body AS tail,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE law || label || chr(10) END || phrase || chr(10) || more || chr(10) || body AS content, phrase, more
FROM (SELECT doc_id, {pick(LAWS, 'doc_id % 5')} AS law, {pick(('law', 'chapter', 'section', 'article', 'paragraph', 'subparagraph', 'item'), 'doc_id % 7')} AS part, doc_id % 120 + 1 AS article, {_ARTICLE} AS label,
  {pick(PHRASES, 'doc_id % 16')} AS phrase, {pick(PHRASES, 'CAST(floor(doc_id / 16) AS INT) % 16')} AS more, coalesce(text, '') AS body FROM documents)"""
#: query_id, law, article, query, answer, label: one row per benchmark item.
QUESTIONS = f"""SELECT item_id AS query_id, law, article, '請問' || CASE WHEN item_id % 3 = 0 THEN '' ELSE law END || CASE WHEN item_id % 4 = 0 THEN '' ELSE '第' || article || '條' END || ask || ' ' || coalesce(body, '') AS query,
  CASE WHEN item_id % 5 = 4 THEN '' ELSE '第' || article || '條' || CASE WHEN item_id % 6 = 1 THEN '之' || (item_id % 3 + 1) ELSE '' END || CASE WHEN item_id % 2 = 0 THEN '第二項第' || (item_id % 4 + 1) || '款' ELSE '' END || '：' || reply END AS answer,
  CASE WHEN item_id % 8 = 7 THEN 'No' ELSE 'Yes' END AS label, ask
FROM (SELECT item_id, {pick(LAWS, 'item_id % 5')} AS law, item_id % 120 + 1 AS article, {pick(ASKS, 'item_id % 16')} AS ask, {pick(PHRASES, 'CAST(item_id * 7 AS BIGINT) % 16')} AS reply, text AS body FROM benchmark)"""
LC, LQ = f"lc AS ({CHUNKS})", f"lq AS ({QUESTIONS})"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CHUNKS.replace("FROM documents", "FROM {documents}"), documents=spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(QUESTIONS.replace("FROM benchmark", "FROM {benchmark}"), benchmark=table(spark, d, "benchmark"))


# --- pieces of oracles ------------------------------------------------------------------------------------------------------------
def any_of(c: str, words: tuple) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def count_of(c: str, words: tuple) -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


def held(c: str, words: tuple) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({c}, w))"


def joined(c: str) -> str:
    return f"array_to_string({c}, '|')"
