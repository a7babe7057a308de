"""Gold answers: what articles a question's answer names, which chunks they make relevant, and measures against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.labels import NUM, article_keys, first_group, law_match
from .retrieval import small

FIELDS = ("article_number", "article_suffix", "item_number", "clause_type", "clause_number", "clause_sub_number")


def place(text: Column) -> Column:
    """struct of FIELDS: the article, item and clause that a text names first. An article is 第N條之M, 第N-M條 or 第N條, whichever stands
    first: one that the text only refers to later is not it; of 款, （目） and 第N目之M the last kind that occurs counts. White space stays."""
    return T.let(T.nfkc_like(F.coalesce(text, F.lit(""))), _place)


def _place(t: Column) -> Column:
    named = f"第({NUM})(?:條(?:之({NUM}))?|-({NUM})條)"
    clause, item, sub = f"第({NUM})款", "[（(]([0-9一二兩三四五六七八九十〇零]+)[)）]", f"第({NUM})目之({NUM})"
    article, suffix = F.regexp_extract(t, named, 1), F.concat(F.regexp_extract(t, named, 2), F.regexp_extract(t, named, 3))
    number = F.when(t.rlike(sub), F.regexp_extract(t, sub, 1)).when(t.rlike(item), F.regexp_extract(t, item, 1)).otherwise(F.regexp_extract(t, clause, 1))
    return F.struct(
        T.label_number(article).alias("article_number"),
        T.label_number(suffix).alias("article_suffix"),
        T.label_number(F.regexp_extract(t, f"第({NUM})項", 1)).alias("item_number"),
        F.when(t.rlike(sub), "目之").when(t.rlike(item), "目").when(t.rlike(clause), "款").alias("clause_type"),
        T.label_number(number).alias("clause_number"),
        T.label_number(F.when(t.rlike(sub), F.regexp_extract(t, sub, 2))).alias("clause_sub_number"),
    )


def gold(items: DataFrame) -> DataFrame:
    """(query_id, label, law, FIELDS) of items(query_id, query, answer, label): each field by the answer, else by the question; the
    law by the question, else by the answer, empty if neither names one."""
    law = lambda c: F.coalesce(*[F.when(F.contains(F.col(c), F.lit(name)), name) for name in V.LAWS_ASKED])
    got = items.select("query_id", "label", F.coalesce(law("query"), law("answer"), F.lit("")).alias("law"), place(F.col("answer")).alias("a"), place(F.col("query")).alias("q"))
    return got.select("query_id", "label", "law", *[F.coalesce(f"a.{f}", f"q.{f}").alias(f) for f in FIELDS])


def relevant_chunks(golds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the chunks(chunk_id, content) that name a question's article and can be of its law.

    An equality join on the articles that chunks name; golds without an article and negative ones (label other than yes) are
    left out. The golds are broadcast if a count shows that they are few.
    """
    asked = golds.where((F.lower(F.trim("label")) == "yes") & F.col("article_number").isNotNull()).select("query_id", "law", F.concat_ws("-", F.col("article_number").cast("string"), F.col("article_suffix").cast("string")).alias("article"))
    named = chunks.select("chunk_id", "content", F.explode(article_keys(F.col("content"))).alias("article"))
    return named.join(small(asked), "article").where(law_match(F.col("content"), F.col("law"))).select("query_id", "chunk_id").distinct()


def id_set_measures(relevant: DataFrame, ranked: DataFrame, ks: tuple, by: tuple = ()) -> DataFrame:
    """(by, k, precision, recall, n_queries): means over the queries that have a relevant chunk, of the relevant share of the first
    k ids and of the share of all relevant ids that they hold. relevant(by, query_id, chunk_id), ranked(by, query_id, chunk_id, rank)."""
    keys = [*by, "query_id"]
    total = relevant.groupBy(*keys).agg(F.count_distinct("chunk_id").alias("n"))
    hits = ranked.join(relevant.distinct(), [*keys, "chunk_id"], "left_semi").groupBy(*keys).agg(F.collect_set("rank").alias("ranks"))
    each = total.join(hits, keys, "left").select(*keys, "n", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hit = F.size(F.filter("ranks", lambda r: r <= F.col("k")))
    return each.groupBy(*by, "k").agg(F.round(F.avg(hit / F.col("k")), 6).alias("precision"), F.round(F.avg(hit / F.col("n")), 6).alias("recall"), F.count("*").alias("n_queries"))


def conversion_statistics(items: DataFrame, found: DataFrame) -> DataFrame:
    """(n_items, n_with_spans, coverage) of a converted question set."""
    per = items.select("query_id").join(found.select("query_id").distinct().withColumn("has", F.lit(1)), "query_id", "left")
    return per.agg(F.count("*").alias("n_items"), F.count("has").alias("n_with_spans"), F.round(F.count("has") / F.count("*"), 6).alias("coverage"))
