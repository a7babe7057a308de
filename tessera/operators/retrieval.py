"""Indexes and search. Queries are a small stated set; what is broadcast is measured first and shuffled when large."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import importance_tokens, let, ngrams, words
from ..sources import stored
from . import block_index, importance
from .set_join import small
from .vectors import Nearest, matrix, unit

#: Words of a vocabulary (a word and a number each, about 50 MB) that may be broadcast.
VOCABULARY = 1_000_000


def top(scored: DataFrame, by: list[str], k: int, ties: list[str], score: str = "score") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.round(score, 6).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


KEYS = ["doc_id", "chunk_index"]


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of an array of words, by term: sorted once, each run of equal words is a term. No words: no terms."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda p, j: F.struct(F.get(s, p).alias("term"), (F.get(at, j + 1) - p).alias("tf"))))

    return let(F.array_sort(tokens), runs)


def index(chunks: DataFrame, keys: list[str] | None = None, tokens: Column | None = None) -> DataFrame:
    """(keys, dl, terms array<struct<term, tf>>): the index that all searches and statistics read, written once to the shared folder.

    Tokens are counted inside the row, so building it shuffles nothing. tokens: an array column, else words() of content.
    """
    keys = KEYS if keys is None else keys
    rows = chunks.select(*keys, (words(F.col("content")) if tokens is None else tokens).alias("tokens"))
    return stored(rows.select(*keys, F.size("tokens").alias("dl"), counted(F.col("tokens")).alias("terms")))


def _postings(indexed: DataFrame, *columns: str) -> DataFrame:
    """(columns, term, tf) of every term of every chunk."""
    return indexed.select(*columns, F.explode("terms").alias("t")).select(*columns, "t.term", "t.tf")


def document_frequencies(indexed: DataFrame) -> DataFrame:
    return _postings(indexed).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, key: str = "item_id", tokens: Column | None = None) -> DataFrame:
    """(query_id, term, qtf) of queries(key, text)."""
    return queries.select(F.col(key).alias("query_id"), F.explode(words(F.col("text")) if tokens is None else tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(indexed: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, epsilon: float = 0.25, keys: list[str] | None = None) -> DataFrame:
    """(query_id, keys, score) of Okapi BM25 for every chunk with a term of the query; a negative idf becomes epsilon times the
    vocabulary's mean idf. The vocabulary is counted once; what is joined with the postings are the asked terms only."""
    keys = KEYS if keys is None else keys
    asked = query_terms(queries)
    stats = indexed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = stored(document_frequencies(indexed).join(F.broadcast(stats)).select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg((F.avg("raw") * epsilon).alias("floor"))
    idf = raw.join(small(asked.select("term").distinct()), "term", "left_semi").join(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    weighted = asked.join(idf, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return _postings(indexed, *keys, "dl").join(small(weighted), "term").groupBy("query_id", *keys).agg(F.sum(part * F.col("qtf")).alias("score"))


def asked_bm25(blocked: DataFrame, asked: DataFrame, epsilon: float = 0.25) -> tuple[DataFrame, float]:
    """(query_id, term, weight) of asked(query_id, term, qtf) by the frequencies of a block-max index, and the mean length of its
    chunks. weight: qtf * idf; a negative idf becomes epsilon times the vocabulary's mean idf."""
    n, avgdl = block_index.statistics(blocked).first()
    raw = stored(block_index.frequencies(blocked).select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * epsilon
    idf = F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw"))
    return raw.join(small(asked), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")), avgdl or 1.0


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, blocked: DataFrame | None = None, keys: list[str] | None = None, key: str = "item_id", once: bool = False) -> DataFrame:
    """Okapi BM25 top k chunks(keys, content) per query(key, text); see bm25_scores(). Each task keeps its own first k by a block-max
    index, which is built unless one is given. once: keys repeat, and count once, by the best score of their chunks."""
    keys = KEYS if keys is None else keys
    blocked = block_index.blocks(chunks, keys) if blocked is None else blocked
    weighed, avgdl = asked_bm25(blocked, query_terms(queries, key))
    scored = block_index.top_k(blocked, weighed, keys, block_index.bm25_weight(avgdl), k, once)
    if once:
        scored = scored.groupBy("query_id", *keys).agg(F.max("score").alias("score"))
    return top(scored, ["query_id"], k, keys).withColumn("score", F.round("score", 6))


def index_statistics(indexed: DataFrame) -> DataFrame:
    vocabulary = document_frequencies(indexed).agg(F.count("*").alias("vocabulary"))
    return indexed.agg(F.count("*").alias("n_chunks"), F.round(F.avg("dl"), 6).alias("mean_length")).join(F.broadcast(vocabulary))


def tfidf_scores(indexed: DataFrame, asked: DataFrame, keys: list[str] | None = None, max_df: float = 1.0) -> DataFrame:
    """(query_id, keys, score): cosine of smoothed, L2-normalised TF-IDF vectors, tf * (ln((1 + N) / (1 + df)) + 1), N over the chunks.

    asked(query_id, term, qtf). Terms in more than a share max_df of the chunks are left out. A chunk's length is summed where
    its row is (partial sums), and only asked terms are multiplied.
    """
    keys = KEYS if keys is None else keys
    n = indexed.agg(F.count("*").alias("n"))
    idf = stored(document_frequencies(indexed).join(F.broadcast(n)).where(F.col("df") <= F.col("n") * max_df).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    weighed = asked.join(idf, "term").withColumn("qw", F.col("qtf") * F.col("idf"))
    norms = weighed.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    weighed = weighed.join(norms, "query_id").select("query_id", "term", (F.col("qw") / F.col("qn")).alias("qw"), "idf")
    dots = _postings(indexed, *keys).join(small(weighed), "term").groupBy("query_id", *keys).agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot"))
    w = F.col("tf") * F.col("idf")
    lengths = _postings(indexed, *keys).join(small(idf, VOCABULARY), "term").groupBy(*keys).agg(F.sqrt(F.sum(w * w)).alias("len"))
    return dots.join(lengths, keys).select("query_id", *keys, (F.col("dot") / F.col("len")).alias("score"))


def tfidf_blocks(blocked: DataFrame, max_df: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(idf of all terms, the block-max index with the lengths of its chunks' vectors): the lengths are worked out once, not in each
    search."""
    n = block_index.statistics(blocked).first()["n"]
    idf = stored(block_index.frequencies(blocked).where(F.col("df") <= n * max_df).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    return idf, block_index.with_lengths(blocked, idf, VOCABULARY)


def asked_tfidf(idf: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, term, weight) of asked(query_id, term, qtf): the term's part of the query's unit vector, times its idf in chunks."""
    weighed = idf.join(small(asked), "term").withColumn("qw", F.col("qtf") * F.col("idf"))
    norms = weighed.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    return weighed.join(norms, "query_id").select("query_id", "term", (F.col("qw") / F.col("qn") * F.col("idf")).alias("weight"))


def tfidf(chunks: DataFrame, queries: DataFrame, k: int = 10, blocked: DataFrame | None = None) -> DataFrame:
    """TF-IDF cosine top k chunks per query; see tfidf_scores(). Each task keeps its own first k by a block-max index, which is built
    unless one is given."""
    blocked = block_index.blocks(chunks, KEYS) if blocked is None else blocked
    idf, measured = tfidf_blocks(blocked)
    scored = block_index.top_k(measured, asked_tfidf(idf, query_terms(queries)), KEYS, block_index.cosine_weight(), k)
    return top(scored, ["query_id"], k, KEYS).select("query_id", *KEYS, F.round("score", 6).alias("score"), "rank")


def with_bigrams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words."""
    return let(tokens, lambda t: F.concat(t, ngrams(t, 2)))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, level: str | None = None, block: int = 4096) -> DataFrame:
    """Exact cosine top k of queries(vec_id, embedding) against all vectors, per level if one is named, without the query itself.

    Queries are dealt into blocks of about `block` by hash of their key, in the shared folder. One block after another is broadcast:
    each task multiplies its vectors, a few at a time, with the block and keeps its first k per query and level over all its
    batches, so the driver holds one block, and what is shuffled is tasks x queries x k rows, not pairs. Zero and null vectors are skipped.
    """
    spark = vectors.sparkSession
    asked = stored(unit(queries))
    blocks = max(1, -(-asked.count() // block))
    side = unit(vectors, "vec_id", "embedding", (F.col(level).cast("string") if level else F.lit("")).alias("level"))

    def one(b: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((part.column(0).to_numpy(), matrix(part.column(1).combine_chunks())))

        def search(batches):
            ids, q = shared.value
            states: dict[str, Nearest] = {}
            for batch in batches if len(ids) else ():
                own, v, levels = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).fill_null("")
                for name in levels.unique().to_pylist():
                    at = np.flatnonzero(pc.equal(levels, name).to_numpy(zero_copy_only=False))
                    states.setdefault(name, Nearest(ids, q, k)).add(own[at], v[at])
            for name, state in states.items():
                query, found, score = state.rows()
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array([name] * len(query), pa.string()), pa.array(score)], names=["query_id", "vec_id", "level", "score"])

        return top(side.mapInArrow(search, "query_id long, vec_id long, level string, score double"), ["query_id", "level"], k, ["vec_id"])

    found = one(0) if blocks == 1 else stored(one(0))
    for b in range(1, blocks):
        found = found.unionByName(stored(one(b)))
    return found


def rrf(left: DataFrame, right: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked relations (query_id, chunk_id, rank); a missing side adds nothing."""
    both = left.select("query_id", "chunk_id", F.col("rank").alias("r1")).join(right.select("query_id", "chunk_id", F.col("rank").alias("r2")), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return top(both.withColumn("score", part("r1") + part("r2")), ["query_id"], k, ["chunk_id"]).withColumn("score", F.round("score", 6))


def enhanced_score(vector: float = 0.6, lexical: float = 0.25, metadata: float = 0.15) -> Column:
    """.6 vec within 0 and 1, .25 sigmoid(bm25), .15 bonus (at most .4), and title_bonus() as it is, of columns vec, bm25, bonus, title."""
    return vector * F.least(F.greatest(F.col("vec"), F.lit(0.0)), F.lit(1.0)) + lexical / (1 + F.exp(-F.col("bm25"))) + metadata * F.least("bonus", F.lit(0.4)) + F.col("title")


def title_bonus(label: Column, chapter: Column, category: Column, law: Column) -> Column:
    """Booleans: the question names the article's label .15, the chapter .05, the category .065, the law .035; at most .4."""
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.least(part(label, 0.15) + part(chapter, 0.05) + part(category, 0.065) + part(law, 0.035), F.lit(0.4))


def enhanced(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Top k by enhanced_score() of (query_id, chunk_id, vec, bm25, bonus, title); the pool are the 2 k highest sums of vec and bm25."""
    pool = top(candidates.withColumn("raw", F.round(F.col("vec") + F.col("bm25"), 6)), ["query_id"], 2 * k, ["chunk_id"], "raw").drop("rank", "raw")
    return top(pool.withColumn("score", enhanced_score()), ["query_id"], k, ["chunk_id"]).withColumn("score", F.round("score", 6))


def rule_bonus(law: Column, same_article: Column, same_suffix: Column, term: Column) -> Column:
    """Law .15, article .15 (half if the suffix differs), term .05; at most .4. Arguments are booleans."""
    part = F.when(law, 0.15).otherwise(0.0) + F.when(same_article & same_suffix, 0.15).when(same_article, 0.075).otherwise(0.0) + F.when(term, 0.05).otherwise(0.0)
    return F.least(part, F.lit(0.4))


def rule_rank(candidates: DataFrame, k: int = 10) -> DataFrame:
    """.8 vector + bonus, of (query_id, chunk_id, vec, bonus)."""
    return top(candidates.withColumn("score", F.lit(0.8) * F.col("vec") + F.col("bonus")), ["query_id"], k, ["chunk_id"]).withColumn("score", F.round("score", 6))


def _importance_by_joins(rows: DataFrame, sizes: DataFrame, k1: float, b: float, epsilon: float, max_df: float) -> DataFrame:
    """(law, article_id, tfidf, bm25) of rows(law, article_id, tokens) of laws with more articles than one task takes; as
    importance.measures(), by joins: articles meet through each term that they share, which is quadratic in a law's articles."""
    keys = ["law", "article_id"]
    counts = stored(index(rows, keys, F.col("tokens")).select(*keys, "dl"))
    stats = sizes.join(counts.groupBy("law").agg(F.avg("dl").alias("avgdl")), "law")
    grams = _postings(index(rows, keys, with_bigrams(F.col("tokens"))), *keys)
    dfs = grams.groupBy("law", "term").agg(F.count("*").alias("df")).join(stats, "law").withColumns({"word": ~F.contains("term", F.lit(" ")), "raw": F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)})
    dfs = stored(dfs)
    floors = dfs.where("word").groupBy("law").agg((F.avg("raw") * epsilon).alias("floor"))
    idf = lambda d: F.when(d <= (F.col("n") + 1) * max_df, F.log((F.col("n") + 2) / (1 + d)) + 1).otherwise(0.0)
    weight = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    every = grams.join(dfs, ["law", "term"]).join(counts, keys).join(floors, "law", "left").withColumns({"plain": idf(F.col("df")), "own": idf(F.col("df") + 1)})
    every = every.select(*keys, "term", F.col("word").cast("long").alias("word"), (F.col("tf") * F.col("plain")).alias("p"), (F.col("tf") * F.col("own")).alias("x"), F.when(F.col("word"), F.col("tf")).otherwise(0).alias("asked"), F.when(F.col("word"), weight).otherwise(0.0).alias("part"))
    every = stored(every)
    lengths = stored(every.groupBy(*keys).agg(F.sum(F.col("p") * F.col("p")).alias("base"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.sum("x").alias("total"), F.sum("word").alias("words")))
    mine = every.select("law", F.col("article_id").alias("target"), "term", F.col("x").alias("tx"), "asked")
    pairs = every.select(*keys, "term", "x", (F.col("x") * F.col("x") - F.col("p") * F.col("p")).alias("change"), "part", "word").join(mine, ["law", "term"])
    pairs = pairs.groupBy("law", "target", "article_id").agg(F.sum(F.col("x") * F.col("tx")).alias("dot"), F.sum("change").alias("change"), F.sum(F.col("asked") * F.col("part")).alias("s"), F.sum("word").alias("met"))
    pairs = pairs.join(lengths.select(*keys, "base"), keys)
    cosine = F.sum(F.when(F.col("dot") > 0, F.col("dot") / F.sqrt(F.col("base") + F.col("change"))))
    met = F.col("met") > 0
    of = pairs.groupBy("law", F.col("target").alias("article_id")).agg(cosine.alias("cos"), F.sum("s").alias("sum"), F.max(F.when(met, F.col("s"))).alias("top"), F.sum(F.when(met, 1).otherwise(0)).alias("hits"))
    of = rows.select(*keys).join(lengths.join(of, keys), keys, "left").join(sizes, "law")
    tfidf = F.when(F.col("total") > 0, 10 * (0.7 * F.col("total") + 0.3 * F.col("cos") / F.col("n")) / F.col("length"))
    # articles that share no word score 0
    top_ = F.when(F.col("hits") < F.col("n"), F.greatest("top", F.lit(0.0))).otherwise(F.col("top"))
    return of.select(*keys, tfidf.alias("tfidf"), F.when(F.col("words") > 0, 2 * (0.6 * F.col("sum") / F.col("n") + 0.4 * top_)).alias("bm25"))


def dynamic_importance(articles: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, max_df: float = 0.95, together: int = 512) -> DataFrame:
    """(law, article_id, tfidf, bm25, importance) of articles(law, article_id, text): how an article's terms weigh among those of its law.

    TF-IDF (words and pairs of words, over the law's articles and the article once more, without terms in over max_df of them):
    10 (.7 sum of its unit vector + .3 mean cosine to all articles); BM25 of the article as a question against all articles:
    2 (.6 mean + .4 maximum). Both lie within .1 and 5; importance is .3 + .7 (.6 TF-IDF + .4 BM25). Articles without terms have 1 for
    either. Only articles of one law meet, through the terms they share: in one task if the law has at most `together`, else by joins.
    """
    clip = lambda c: F.round(F.least(F.lit(5.0), F.greatest(F.lit(0.1), c)), 2)
    rows = articles.where("law IS NOT NULL").select("law", "article_id", importance_tokens(F.col("text")).alias("tokens"))
    large = stored(articles.groupBy("law").agg(F.count("*").alias("n")).where(F.col("n") > together))
    if large.isEmpty():
        measured = importance.laws_in_tasks(rows, k1, b, epsilon, max_df)
    else:
        named = small(large.select("law"))
        by_joins = _importance_by_joins(stored(rows.join(named, "law")), large, k1, b, epsilon, max_df)
        measured = importance.laws_in_tasks(rows.join(named, "law", "left_anti"), k1, b, epsilon, max_df).unionByName(by_joins)
    # least and greatest skip nulls, so articles without terms are told first
    cut = lambda c: F.when(F.col(c).isNull(), 1.0).otherwise(clip(F.col(c)))
    both = measured.unionByName(articles.where("law IS NULL").select("law", "article_id", F.lit(None).cast("double").alias("tfidf"), F.lit(None).cast("double").alias("bm25"))).select("law", "article_id", cut("tfidf").alias("tfidf"), cut("bm25").alias("bm25"))
    return both.withColumn("importance", F.round(0.3 + 0.7 * (0.6 * F.col("tfidf") + 0.4 * F.col("bm25")), 2))
