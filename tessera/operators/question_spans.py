"""Which spans hold the answer to a question: a cascade of ever looser matches, each over the questions that are still open.

No step makes all pairs of questions and spans: each has a filter that gives the pairs which can pass, and only these are scored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import values as V
from ..functions.labels import article_keys
from ..sources import stored
from .set_join import sharing_run, similar_sets, small

KEYWORD_SHARE, JACCARD, OVERLAP, SENTENCE, CONCEPT = 0.3, 0.4, 0.4, 0.3, 0.3
#: Two sentences count as alike from this share of their keywords on.
ALIKE = 0.5
TERMS = V.LEGAL_KEYWORDS + V.ABOUT


def keywords(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))), lambda w: F.length(w) >= 2)


def characters(text: Column) -> Column:
    return F.array_distinct(F.split(text, ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[。！？；.!?;]"), lambda s: F.trim(s)), lambda s: F.length(s) > 5)


@F.pandas_udf(DoubleType())
def longest_common_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring over that of the longer text; no built-in function tells it."""

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        u, v = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (x, y))
        run, best = np.zeros(len(v) + 1, np.int64), 0
        for c in u:
            run[1:] = np.where(v == c, run[:-1] + 1, 0)
            best = max(best, int(run.max()))
        return best / max(len(u), len(v))

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b)])


class _Asked:
    """Questions' keywords, and which of them stand in which words of texts; words are looked at once for as long as they are remembered."""

    def __init__(self, query: np.ndarray, word: pa.Array, remembered: int = 1 << 20):
        coded = word.dictionary_encode()
        self.words, self.remembered, self.known = coded.dictionary.to_pylist(), remembered, {}
        self.queries, at = np.unique(query, return_inverse=True)
        lengths = np.array([len(w) for w in self.words], np.float32)
        codes = np.asarray(coded.indices, np.int64)
        # float sums of lengths are exact below 2 ** 24
        self.weights = np.zeros((len(self.words), len(self.queries)), np.float32)
        self.weights[codes, at] = lengths[codes]
        self.all = np.bincount(at, lengths[codes], len(self.queries)).astype(np.int64)
        self.by_start: dict[str, list] = {}
        for k, w in enumerate(self.words):
            self.by_start.setdefault(w[:2], []).append((k, w))

    def within(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = list({k for i in range(len(word) - 1) for k, w in self.by_start.get(word[i : i + 2], ()) if word.startswith(w, i)})
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[word] = found
        return found

    def hits(self, texts: pa.Array) -> np.ndarray:
        """By text and question: the summed length of the question's keywords that stand in the words of the text."""
        coded = texts.flatten().dictionary_encode()
        each = [self.within(w) for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in each], np.int64)
        held, starts = np.array([k for x in each for k in x], np.int64), np.cumsum(sizes) - sizes
        code = np.asarray(coded.indices, np.int64)
        row = np.repeat(np.arange(len(texts)), np.asarray(texts.value_lengths().fill_null(0), np.int64))
        n = sizes[code]
        at = np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        has = np.zeros((len(texts), len(self.words)), np.float32)
        has[np.repeat(row, n), held[at]] = 1
        return has @ self.weights


#: Questions whose keywords travel at once.
QUESTIONS = 512


def by_keywords(items: DataFrame, spans: DataFrame, least: float = KEYWORD_SHARE, most: int | None = None) -> DataFrame:
    """(query_id, span_id, score): the share, by length, of a question's keywords that stand in the span, if over `least`.

    A keyword stands in a text if it does in one of the text's own keywords, so each distinct word is looked through once and a text
    goes by as its words: no rows of texts and words. Questions go out QUESTIONS at a time. items(query_id, said), spans(span_id,
    text). most: a task gives out only rows that can be among the first `most` of a question, by score, then span_id.
    """
    spark, kind, key = spans.sparkSession, spans.schema["span_id"].dataType.simpleString(), items.schema["query_id"].dataType.simpleString()
    asked = stored(items.select("query_id", F.explode(keywords(F.col("said"))).alias("word")))
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUESTIONS))
    texts = spans.select("span_id", F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}]+"), F.lit(0)).alias("words"))

    def one(b: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids, words = part.column("query_id").combine_chunks() if len(part) else None, part.column("word").combine_chunks() if len(part) else None
        distinct = ids.dictionary_encode() if ids is not None else None
        shared = spark.sparkContext.broadcast((distinct, words))

        def run(batches):
            distinct, words = shared.value
            if distinct is None:
                return
            state = _Asked(np.asarray(distinct.indices, np.int64), words)
            names, total = distinct.dictionary, state.all
            # scores of one question tell its hits apart once rounded, if its keywords are not too long together
            ordered = most is not None and total.max() < 400_000
            kept = None
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    rows = batch.slice(start, 256)
                    hits = state.hits(rows.column(1))
                    at, q = np.nonzero(hits > total * (least - 1e-6))
                    got = pa.table([pa.array(q), rows.column(0).take(pa.array(at)), pa.array(hits[at, q].astype(np.int64))], names=["q", "span_id", "hit"])
                    kept = got if kept is None else pa.concat_tables([kept, got])
                    if kept.num_rows > 1 << 16:
                        if ordered:
                            kept = _first(kept, most)
                        if not ordered or kept.num_rows > 1 << 15:
                            yield from give(kept, names, total)
                            kept = None
            if kept is not None:
                yield from give(_first(kept, most) if ordered else kept, names, total)

        def give(rows, names, total):
            q = rows.column("q").combine_chunks()
            yield from pa.table([names.take(q), rows.column("span_id"), rows.column("hit"), pa.array(total[np.asarray(q)])], names=["query_id", "span_id", "hit", "total"]).combine_chunks().to_batches()

        return texts.mapInArrow(run, f"query_id {key}, span_id {kind}, hit long, total long")

    found = one(0) if blocks == 1 else stored(one(0))
    for b in range(1, blocks):
        found = found.unionByName(stored(one(b)))
    return found.select("query_id", "span_id", F.round(F.col("hit") / F.col("total"), 6).alias("score")).where(F.col("score") > least)


def _first(rows: pa.Table, most: int) -> pa.Table:
    """The first `most` rows of each q, by hit from above, then span_id."""
    rows = rows.sort_by([("q", "ascending"), ("hit", "descending"), ("span_id", "ascending")]).combine_chunks()
    q = rows.column("q").to_numpy()
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return rows.filter(pa.array(rank < most))


def by_characters(items: DataFrame, spans: DataFrame, least: float = JACCARD, most: int | None = None) -> DataFrame:
    """(query_id, span_id, score): Jaccard similarity of the characters of answer and span, if over `least`.

    One pass over the spans, as in by_keywords(): the answers' characters travel, QUESTIONS answers at a time, and a text's distinct
    ones are counted against all of them where it lies; see there for `most`.
    """
    spark, kind, key = spans.sparkSession, spans.schema["span_id"].dataType.simpleString(), items.schema["query_id"].dataType.simpleString()
    asked = stored(items.select("query_id", F.explode(characters(F.col("answer"))).alias("token")))
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUESTIONS))
    texts = spans.select("span_id", characters(F.col("text")).alias("tokens"))

    def one(b: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        given = (part.column("query_id").combine_chunks().dictionary_encode(), part.column("token").combine_chunks().dictionary_encode()) if len(part) else None
        shared = spark.sparkContext.broadcast(given)

        def run(batches):
            if shared.value is None:
                return
            ids, tokens = shared.value
            at, names = np.asarray(ids.indices, np.int64), ids.dictionary
            weights = np.zeros((len(tokens.dictionary), len(names)), np.float32)
            weights[np.asarray(tokens.indices), at] = 1
            size = np.bincount(at, minlength=len(names))
            kept = None
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    rows = batch.slice(start, 256)
                    listed = rows.column(1)
                    n = np.asarray(listed.value_lengths().fill_null(0), np.int64)
                    code = pc.index_in(listed.flatten(), value_set=tokens.dictionary)
                    held = np.asarray(code.is_valid())
                    has = np.zeros((len(n), len(weights)), np.float32)
                    has[np.repeat(np.arange(len(n)), n)[held], np.asarray(code.fill_null(0))[held]] = 1
                    common = (has @ weights).astype(np.int64)
                    whole = n[:, None] + size - common
                    r, q = np.nonzero(common > whole * (least - 1e-6))
                    got = pa.table([pa.array(q), rows.column(0).take(pa.array(r)), pa.array(np.floor(common[r, q] * 1e6 / whole[r, q] + 0.5)), pa.array(common[r, q]), pa.array(whole[r, q])], names=["q", "span_id", "hit", "common", "whole"])
                    kept = got if kept is None else pa.concat_tables([kept, got])
                    if kept.num_rows > 1 << 16:
                        kept = kept if most is None else _first(kept, most)
                        if kept.num_rows > 1 << 15:
                            yield from give(kept, names)
                            kept = None
            if kept is not None:
                yield from give(kept if most is None else _first(kept, most), names)

        def give(rows, names):
            yield from pa.table([names.take(rows.column("q").combine_chunks()), rows.column("span_id"), rows.column("common"), rows.column("whole")], names=["query_id", "span_id", "common", "whole"]).combine_chunks().to_batches()

        return texts.mapInArrow(run, f"query_id {key}, span_id {kind}, common long, whole long")

    found = one(0) if blocks == 1 else stored(one(0))
    for b in range(1, blocks):
        found = found.unionByName(stored(one(b)))
    return found.select("query_id", "span_id", F.round(F.col("common") / F.col("whole"), 6).alias("score")).where(F.col("score") > least)


def by_overlap(items: DataFrame, spans: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(query_id, span_id, score): the longest common substring of answer and span over the longer one's length, if over `least`."""
    left, right = items.select(F.col("query_id").alias("lid"), F.col("answer").alias("text")), spans.select(F.col("span_id").alias("rid"), "text")
    met = sharing_run(left, right, least).join(small(left.withColumnRenamed("text", "answer")), "lid").join(right, "rid")
    return met.select(F.col("lid").alias("query_id"), F.col("rid").alias("span_id"), F.round(longest_common_share("answer", "text"), 6).alias("score")).where(F.col("score") > least)


def by_sentences(items: DataFrame, spans: DataFrame, least: float = SENTENCE) -> DataFrame:
    """(query_id, span_id, score): mean over the answer's sentences of the best similarity of keywords to a sentence of the span, those
    of at most ALIKE counting nothing, if over `least`. A sentence that many spans have is compared once."""
    said = stored(items.select("query_id", F.size(sentences(F.col("answer"))).alias("n"), F.posexplode(sentences(F.col("answer"))).alias("i", "sentence")).select("query_id", "n", "i", keywords(F.col("sentence")).alias("tokens")))
    told = stored(spans.select("span_id", F.explode(F.array_distinct(F.transform(sentences(F.col("text")), lambda s: F.array_sort(keywords(s))))).alias("tokens")).where(F.size("tokens") > 0))
    once = told.select(F.xxhash64("tokens").alias("rid"), "tokens").dropDuplicates(["rid"])
    left = said.select(F.struct("query_id", "i").alias("lid"), "tokens")
    alike = similar_sets(left, once, ALIKE)
    best = alike.join(told.select(F.xxhash64("tokens").alias("rid"), "span_id"), "rid").groupBy(F.col("lid.query_id").alias("query_id"), F.col("lid.i").alias("i"), "span_id").agg(F.max("score").alias("best"))
    n = said.select("query_id", "n").distinct()
    return best.groupBy("query_id", "span_id").agg(F.sum("best").alias("sum")).join(small(n), "query_id").select("query_id", "span_id", F.round(F.col("sum") / F.col("n"), 6).alias("score")).where(F.col("score") > least)


def by_concepts(items: DataFrame, spans: DataFrame, least: float = CONCEPT, most: int = 2) -> DataFrame:
    """(query_id, span_id, score): .7 of the share of the question's terms that the span has and .3 of its length up to 200, if over
    `least`; the first `most` a question. Spans with the same terms and length score alike, so only the first of these meet questions."""
    terms = F.array(*[F.lit(w) for w in TERMS])
    held = lambda c: F.filter(terms, lambda w: F.contains(F.col(c), w))
    classes = spans.select("span_id", held("text").alias("has"), F.least(F.length("text"), F.lit(200)).alias("len")).where(F.size("has") > 0)
    # the least ids of a class: partial aggregation, at most `most` ids a task
    first = classes.groupBy("has", "len").agg(F.min("span_id").alias("a"))
    kept = first.select("has", "len", F.col("a").alias("span_id"))
    for _ in range(most - 1):
        rest = classes.join(first, ["has", "len"]).where(F.col("span_id") > F.col("a")).groupBy("has", "len").agg(F.min("span_id").alias("b"))
        first = rest.select("has", "len", F.col("b").alias("a"))
        kept = kept.unionByName(first.select("has", "len", F.col("a").alias("span_id")))
    kept = stored(kept)
    asked = items.select("query_id", held("said").alias("terms")).where(F.size("terms") > 0)
    met = asked.select("query_id", "terms", F.explode("terms").alias("term")).join(kept.select("*", F.explode("has").alias("term")), "term").drop("term").distinct()
    score = F.round(0.7 * F.size(F.array_intersect("terms", "has")) / F.size("terms") + 0.3 * F.col("len") / 200, 6)
    return met.select("query_id", "span_id", score.alias("score")).where(F.col("score") > least)


def spans_of_questions(items: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, span_id, strategy, score): which of spans(span_id, article, text) hold the answer to items(query_id, query, answer).

    The first of seven strategies that finds anything counts: the same article with suffix; its number alone; keywords
    weighted by length (over .3, best 3); Jaccard of characters (over .4, best 2); longest common substring (over .4);
    keywords sentence by sentence (over .3, best 2); shared concepts, .7, and length, .3 (over .3, best 2). Ties go to the smaller
    span_id. A question that a strategy answers does not reach the next one.
    """
    said = stored(items.where(F.coalesce("answer", F.lit("")) != "").select("query_id", F.concat_ws(" ", "answer", "query").alias("said"), "answer"))
    base = lambda c: F.array_distinct(F.transform(article_keys(c), lambda k: F.regexp_extract(k, "^[0-9]+", 0)))
    own = spans.select("span_id", F.get(article_keys(F.col("article")), F.lit(0)).alias("key"), F.get(base(F.col("article")), F.lit(0)).alias("base"))
    exact = said.select("query_id", F.explode(article_keys(F.col("said"))).alias("key")).join(own, "key").select("query_id", "span_id", F.lit("article").alias("strategy"), F.lit(1.0).alias("score"))
    loose = said.join(exact, "query_id", "left_anti").select("query_id", F.explode(base(F.col("said"))).alias("base")).join(own, "base").select("query_id", "span_id", F.lit("number").alias("strategy"), F.lit(1.0).alias("score"))
    done = stored(exact.unionByName(loose).distinct())
    texts = spans.where(F.coalesce("text", F.lit("")) != "").select("span_id", "text")
    open_ = stored(said.join(small(done.select("query_id").distinct()), "query_id", "left_anti"))
    for name, step, most in (("keywords", partial(by_keywords, most=3), 3), ("characters", partial(by_characters, most=2), 2), ("overlap", by_overlap, 2), ("sentences", by_sentences, 2), ("concepts", by_concepts, 2)):
        if open_.isEmpty():
            break
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "span_id")
        found = stored(step(open_, texts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "span_id", F.lit(name).alias("strategy"), "score"))
        done = done.unionByName(found)
        open_ = stored(open_.join(small(found.select("query_id").distinct()), "query_id", "left_anti"))
    return done
